"""The catalog: one wide table of file metadata, and the tree that its paths form."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovana.functions import text

SCHEMA = T.StructType(
    [
        T.StructField("id", T.DecimalType(20, 0)),
        T.StructField("path", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("directory_path", T.StringType()),
        T.StructField("file_extension", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("modified_time", T.TimestampType()),
        T.StructField("created_time", T.TimestampType()),
        T.StructField("is_directory", T.BooleanType()),
        T.StructField("is_hidden", T.BooleanType()),
        T.StructField("volume_name", T.StringType()),
        T.StructField("normalized_name", T.StringType()),
        T.StructField("normalized_path", T.StringType()),
    ]
)
COLUMNS = SCHEMA.fieldNames()
#: What a file without a modification time has: the earliest day that Python can still read back.
DISTANT_PAST = "0001-01-02 00:00:00"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def derive(raw: DataFrame, ids: bool = True) -> DataFrame:
    """Catalog rows from ``path``, ``is_directory`` and, as far as present, ``size_bytes``, ``modified_time``,
    ``created_time``, ``os_hidden`` and ``volume_name``. Folded columns are made here, once, and stored."""
    have = set(raw.columns)
    opt = lambda name, default: F.coalesce(F.col(name), default) if name in have else default
    path = F.when(F.col("path").rlike("^/+$"), "/").otherwise(F.regexp_replace("path", "/+$", ""))
    df = raw.withColumn("path", path)
    name = text.last_component(F.col("path"))
    df = df.withColumn("name", F.when(F.col("path") == "/", "/").otherwise(name))
    return df.select(
        (text.stable_id(F.col("path")) if ids else F.lit(None).cast("decimal(20,0)")).alias("id"),
        "path",
        "name",
        text.parent_path(F.col("path")).alias("directory_path"),
        text.extension(F.col("name")).alias("file_extension"),
        F.when(F.col("is_directory"), F.lit(0)).otherwise(F.greatest(opt("size_bytes", F.lit(0)), F.lit(0))).cast("long").alias("size_bytes"),
        opt("modified_time", F.lit(DISTANT_PAST).cast("timestamp")).cast("timestamp").alias("modified_time"),
        (F.col("created_time") if "created_time" in have else F.lit(None)).cast("timestamp").alias("created_time"),
        "is_directory",
        (opt("os_hidden", F.lit(False)) | text.is_hidden_path(F.col("path"))).alias("is_hidden"),
        opt("volume_name", F.lit("")).alias("volume_name"),
        text.fold(F.col("name")).alias("normalized_name"),
        text.fold(F.col("path")).alias("normalized_path"),
    )


def spread(raw: DataFrame) -> DataFrame:
    """Rows dealt out by ``path``, before work that costs far more than reading them: a file of few bytes is one task, however many rows it has.

    What is made of the path stays behind the dealing: filters would be moved before it, and their expressions with them.
    """
    dealt = raw.repartition("path").withColumn("_path", F.explode(F.array("path")))
    return dealt.select(*[F.col("_path").alias("path") if c == "path" else F.col(f"`{c}`") for c in raw.columns])


def kind_name() -> Column:
    return F.when(F.col("is_directory") & (F.col("file_extension") == "app"), "Application").when(F.col("is_directory"), "Folder").otherwise("File")


def ancestors(path: Column, itself: bool = False) -> Column:
    """The directories above an absolute path, nearest to the root first; the root itself is left out."""
    parts = text.components(path)
    last = F.size(parts) - (0 if itself else 1)
    up = F.transform(F.sequence(F.lit(1), last), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    return F.when(last >= 1, up).otherwise(F.array().cast("array<string>"))


def depth(path: Column) -> Column:
    return F.size(text.components(path))


def exploded(df: DataFrame, itself: bool = False) -> DataFrame:
    """One row per row and ancestor, with ``path`` and ``ancestor`` only: the side that prefix tests join on."""
    return df.select("path", F.explode(ancestors(F.col("path"), itself)).alias("ancestor"))


def with_parent(df: DataFrame) -> DataFrame:
    """Each row with its parent's id (``parent_id``), null where the parent isn't in the catalog."""
    parents = df.select(F.col("directory_path").alias("path")).distinct()
    up = df.join(parents, "path", "left_semi").select(F.col("path").alias("_up"), F.col("id").alias("parent_id"))
    return df.join(up, df["directory_path"] == up["_up"], "left").drop("_up")


def directories(df: DataFrame) -> DataFrame:
    """Each directory that holds a row, once (``path``): what lies above rows is told for them, not row by row."""
    return df.select(text.parent_path(F.col("path")).alias("path")).distinct()


def children(df: DataFrame) -> DataFrame:
    """directory_path, n_children and the number of directories among them."""
    return df.where("path <> '/'").groupBy("directory_path").agg(F.count("*").alias("n_children"), F.count_if("is_directory").alias("n_directories"))


def virtual_rows(df: DataFrame) -> DataFrame:
    """Directories that paths imply but the catalog lacks; their ids can't meet those of real rows."""
    need = exploded(directories(df), itself=True).select(F.col("ancestor").alias("path")).distinct()
    missing = need.join(df.select("path"), "path", "left_anti").withColumn("is_directory", F.lit(True))
    return derive(missing, ids=False).withColumn("id", text.stable_id(F.concat(F.lit("virtual:"), F.col("path"))))


def with_virtual(df: DataFrame) -> DataFrame:
    """The tree: real rows and virtual ones, told apart by ``is_virtual``."""
    return df.withColumn("is_virtual", F.lit(False)).unionByName(virtual_rows(df).withColumn("is_virtual", F.lit(True)))


def results_only(tree: DataFrame) -> DataFrame:
    """Virtual rows take part in tree operations and are never returned."""
    return tree.where("not is_virtual").drop("is_virtual")


def with_visibility(df: DataFrame) -> DataFrame:
    """``is_visible``: neither the row nor a row above it is hidden. Hidden directories meet the ancestors of distinct directories by an equi-join."""
    hidden = df.where("is_hidden and is_directory").select(F.col("path").alias("ancestor"))
    below = exploded(directories(df.where("not is_hidden")), itself=True).join(hidden, "ancestor", "left_semi").select(F.col("path").alias("_up")).distinct().withColumn("_below", F.lit(True))
    out = df.withColumn("_up", text.parent_path(F.col("path"))).join(below, "_up", "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (~F.col("is_hidden") & F.col("_below").isNull()).alias("is_visible"))


def with_order(tree: DataFrame) -> DataFrame:
    """``row_id`` in depth-first order, ``subtree_end`` (exclusive) and ``depth``; for a snapshot, not for a query.

    Rows are range-partitioned by their components, counted per partition, and numbered from each
    partition's offset: no task sees the whole table.
    """
    parts = tree.withColumn("_c", text.components(F.col("path")))
    spark = tree.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = parts.repartitionByRange(width, "_c").withColumn("_p", F.spark_partition_id())
    order = Window.partitionBy("_p").orderBy("_c")
    # kept, as the numbers and the counts must come from one and the same partitioning, and the order is made once
    # (_m: the last number among rows of one path)
    numbered = placed.withColumns({"_n": F.row_number().over(order), "_m": F.count("*").over(order)}).drop("_c").persist(StorageLevel.DISK_ONLY)
    sizes = numbered.groupBy("_p").agg(F.max("_n").alias("_s"))  # as many rows as partitions
    before = sizes.withColumn("_o", F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_o", F.lit(0)).alias("_o"))
    rows = numbered.join(F.broadcast(before), "_p").withColumns({"row_id": (F.col("_n") + F.col("_o") - 1).cast("long"), "_m": (F.col("_m") + F.col("_o")).cast("long"), "_up": text.parent_path(F.col("path"))}).drop("_p", "_n", "_o")
    # the last row of each directory first, then the last one of all below it: a row isn't multiplied by its ancestors
    ends = rows.groupBy("_up").agg((F.max("row_id") + 1).alias("_e"))
    last = ends.select("_e", F.explode(ancestors(F.col("_up"), itself=True)).alias("ancestor")).groupBy("ancestor").agg(F.max("_e").alias("_e"))
    top = rows.join(last, rows["path"] == last["ancestor"], "left").drop("ancestor", "_up")
    return top.withColumn("subtree_end", F.greatest("_e", "_m")).withColumn("depth", depth(F.col("path"))).drop("_e", "_m")


def subtree(ordered: DataFrame, path: str) -> DataFrame:
    """A directory and everything under it, by its interval of rows."""
    top = ordered.where(F.col("path") == path).select(F.col("row_id").alias("_s"), F.col("subtree_end").alias("_e"))
    return ordered.join(F.broadcast(top.limit(1)), (F.col("row_id") >= F.col("_s")) & (F.col("row_id") < F.col("_e"))).drop("_s", "_e")


def under(df: DataFrame, directories: DataFrame, how: str = "left_semi", itself: bool = True) -> DataFrame:
    """Rows at or under some directory (``path`` of ``directories``), or with ``left_anti`` all others: equi-joins on ancestors, no prefix test."""
    tops = directories.select(F.col("path").alias("ancestor")).distinct()
    hit = exploded(df, itself).join(tops, "ancestor", "left_semi").select("path").distinct()
    return df.join(hit, "path", how)


def expand_hits(df: DataFrame, hits: DataFrame) -> DataFrame:
    """All rows below directories that a predicate picked."""
    return under(df, hits.where("is_directory"), itself=False)


def point_lookup(df: DataFrame, path: str) -> DataFrame:
    return df.where(F.col("path") == path)


def roots_table(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Configured roots in order, each once, standardised: ``root_id``, ``root``."""
    seen: dict[str, None] = {}
    for r in roots:
        r = r.strip().rstrip("/") or ("/" if r.strip() else "")
        if r and r != ".":
            seen.setdefault(r if r.startswith("/") else "/" + r)
    return spark.createDataFrame([(i, r) for i, r in enumerate(seen)], "root_id int, root string")


def with_root(df: DataFrame, roots: DataFrame) -> DataFrame:
    """``root_id`` and ``root`` of the longest root at or above each row, ties to the lowest id; null outside all."""
    tops = roots.select("root_id", "root")
    every = df.select("path", F.explode(F.array_union(F.array(F.lit("/")), ancestors(F.col("path"), itself=True))).alias("root"))
    found = every.join(tops, "root").groupBy("path").agg(F.max_by(F.struct("root_id", "root"), F.struct(F.length("root"), -F.col("root_id"))).alias("_r"))
    return df.join(found, "path", "left").withColumn("root_id", F.col("_r.root_id")).withColumn("root", F.col("_r.root")).drop("_r")


def visible_before(ordered: DataFrame) -> DataFrame:
    """Running count of visible rows by ``row_id``: a range's count is a difference of two of them."""
    lots = ordered.withColumn("_lot", (F.col("row_id") / 65_536).cast("long"))
    within = F.sum(F.col("is_visible").cast("long")).over(Window.partitionBy("_lot").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0))
    totals = lots.groupBy("_lot").agg(F.sum(F.col("is_visible").cast("long")).alias("_t"))
    before = totals.withColumn("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    return lots.withColumn("_w", within).join(before, "_lot").withColumn("visible_through", F.col("_w") + F.col("_b")).drop("_lot", "_w", "_b")
