"""Helpers shared by the corpus operators: tables, scratch space, memory, joins on hot keys, graph components."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- columns


def col(name: str) -> Column:
    """A column by its whole name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *but: str) -> Column:
    """All columns of ``df`` but some as one struct, so that no name of theirs can clash with an operator's."""
    names = [c for c in df.columns if c not in but]
    return F.struct(*[col(c).alias(c) for c in names]) if names else F.struct(F.lit(None).cast("int").alias("none"))


def unpacked(row: str, columns: list[str], **new: Column) -> list[Column]:
    """The columns that ``packed`` has put into ``row``, in their order, with some put in from elsewhere."""
    return [(new[c] if c in new else F.col(row).getField(c)).alias(c) for c in columns]


def kept_names(keep: tuple[str, ...], results: tuple[str, ...]) -> list[str]:
    """Names of kept columns in a result: one that a result column has comes under ``kept_`` and its name."""
    taken, out = {r.lower() for r in results}, []
    for k in keep:
        name = k
        while name.lower() in taken:
            name = "kept_" + name
        taken.add(name.lower())
        out.append(name)
    return out


# --- scratch space

_SCOPE: contextvars.ContextVar[str] = contextvars.ContextVar("scratch", default="")
#: When the driver last collected what is no longer in use.
_COLLECTED = [0.0]


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a session without other machines may do without the setting: it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        sc = spark.sparkContext
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="trovana-")
        sc.setCheckpointDir(root)
    return root


def _folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/trovana-{spark.sparkContext.applicationId}{_SCOPE.get()}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _collect(spark: SparkSession) -> None:
    """Shuffle files of finished steps go once their plans are collected: not more often than every few seconds."""
    if time.monotonic() - _COLLECTED[0] > 4:
        spark._jvm.System.gc()
        _COLLECTED[0] = time.monotonic()


#: Spark's setting to delete a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write within go as it ends; collecting garbage misses them, as Spark's event queue holds the last plan."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder (or another ``folder`` there) and read it back.

    Cuts the lineage, so losing an executor never replays what lies before, and
    gives the next steps a compressed columnar input of known size.
    """
    spark = df.sparkSession
    path = f"{folder or _folder(spark)}/{label}-{uuid.uuid4().hex}"
    with _passing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    _collect(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = (path, None)
    return out


def bucketed(df: DataFrame, key: str, buckets: int, label: str, unique: bool = False) -> DataFrame:
    """``materialise``, in buckets by ``key``: joins on it don't move these rows again.

    With ``unique`` one row of each key stays, chosen where the buckets are, so that rows move once.
    """
    spark = df.sparkSession
    name = f"trovana_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{_folder(spark)}/{name}"
    rows = df.repartition(buckets, key)
    if unique:
        rows = rows.dropDuplicates([key])
    with _passing_shuffles(spark):
        rows.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    _collect(spark)
    out = spark.table(name)
    out._scratch = (path, name)
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete tables that ``materialise`` or ``bucketed`` has made and nothing reads any more."""
    for df in dfs:
        path, name = getattr(df, "_scratch", None) or (None, None)
        if name:
            df.sparkSession.sql(f"drop table if exists {name}")
        if path:
            _delete(df.sparkSession, path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What is written within goes at the end; results that are to stay are written to the folder outside, which is given."""
    outside = _folder(spark)
    token = _SCOPE.set(f"{_SCOPE.get()}/scope-{uuid.uuid4().hex}")
    try:
        yield outside
    finally:
        path = _folder(spark)
        _SCOPE.reset(token)
        _delete(spark, path)


def release_scratch(spark: SparkSession) -> None:
    """Delete everything ``materialise`` has written in this application; call it once results are stored."""
    _delete(spark, f"{scratch_root(spark)}/trovana-{spark.sparkContext.applicationId}")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that a task and its file take at least, where a table's size is known.
TOGETHER = 50_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about so many ``rows``, in as many partitions as they need.

    Few rows aren't dealt over hundreds of tasks and files, which in rounds cost far more than the rows; many stay as they are.
    """
    few = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TOGETHER))
    return df.coalesce(few) if few < shuffle_width(df.sparkSession) else df


# --- memory of Python workers


def give_back() -> None:
    """Return free memory to the system, so that a worker between tasks is as small as a new one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bytes of a batch that are made into Python objects at once.
SLICE = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes; a row isn't cut."""
    for b in batches:
        step = max(1, b.num_rows * size // max(b.nbytes, 1))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], object] | None = None):
    """``run`` for ``mapInArrow``: it gets small batches, and at a task's end forgets what it has kept and gives memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(slices(batches))
        finally:
            if forget:
                forget()
            give_back()

    return wrapped


# --- filters of fixed size

#: Bits of a filter that tells which rows can be wanted: 8 MB, whatever the corpus. Where it is full, it spares nothing, which is right too.
FILTER_BITS = 26


def bit_filter(rows: DataFrame, key: str) -> np.ndarray:
    """The bits of all values of a long column."""
    slot = F.pmod(key, F.lit(1 << FILTER_BITS))
    words = rows.select(slot.alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("v")).toArrow()
    out = np.zeros(1 << FILTER_BITS >> 6, np.int64)  # as many rows at most
    out[words["w"].to_numpy()] = words["v"].to_numpy()
    del words
    give_back()
    return out.view(np.uint64)


def in_filter(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values can be among those of the filter; all that are, are."""
    slot = values & ((1 << FILTER_BITS) - 1)
    return ((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


# --- joins on keys that few rows or a third of all may have

#: A key is hot if it has more than this share of all rows: so many keys at most are broadcast.
HOT = 20_000


def heavy_join(rows: DataFrame, lookup: DataFrame, key: str, count: str, total: int, how: str = "inner", hot: int = HOT) -> DataFrame:
    """``rows`` joined with ``lookup`` on ``key``, of which ``lookup`` has one row each with the number of its ``rows``.

    Hot keys, those with over a ``hot``-th of the ``total`` rows, are broadcast with their lookup rows; if the others
    have to be shuffled, none has more than that share, and rows that need no lookup any more, or have no key, are dealt
    by a hash of all they hold. ``count`` is dropped. ``how`` is inner or left.
    """
    is_hot = F.col(count) * hot > max(total, 1)
    names = [c for c in lookup.columns if c not in (key, count)]
    found = F.struct(*[col(c).alias(c) for c in names]) if names else F.struct(F.lit(1).alias("one"))
    some = lookup.where(is_hot).select(col(key), found.alias("_hot"))
    # always 0, which the optimizer must not know: a constant would leave the join's keys, and all rows without a key meet in one task
    zero = F.pmod(F.xxhash64(col(key)), F.lit(1).cast("long"))
    rest = lookup.where(~is_hot).select(col(key).alias("_key"), zero.alias("_salt"), found.alias("_cold"))
    done = F.col("_hot").isNotNull() | col(key).isNull()
    held = [col(c) for c in rows.columns if "map<" not in rows.schema[c].dataType.simpleString()]  # maps have no hash
    ours = rows.join(F.broadcast(some), key, "left").withColumn("_key", F.when(~done, col(key)))
    ours = ours.withColumn("_salt", F.when(done, F.xxhash64(*held)).otherwise(0))
    out = ours.join(rest, ["_key", "_salt"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    if how == "inner":
        out = out.where("_found is not null")
    return out.select(*[col(c) for c in rows.columns], *[F.col("_found").getField(c).alias(c) for c in names])


# --- graphs


def components(edges: DataFrame, label: str = "components", max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component being its smallest node.

    ``edges`` has long columns ``a`` and ``b``; self loops and repeats are allowed, nodes without an
    edge to another node get no row. ``rows``: their number, if it is known. Alternates pointer jumping and small-star steps, so the number of
    rounds grows with the logarithm of a component's diameter and the edge count never grows.
    Only counts reach the driver. Minima are combined before each shuffle, so a hub costs no more
    than other nodes; what is joined to a hub's row is a plain equi-join that Spark can split.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("p"))
        .distinct()
    )
    e = materialise(e if rows is None else gathered(e, rows), label)
    count = e.count()  # no round adds to it
    for _ in range(max_rounds):
        low = e.groupBy("n").agg(F.min("p").alias("m"), F.count("*").alias("c"))
        low = materialise(gathered(low, count), label)
        jump = low.select(F.col("n").alias("p"), F.col("m").alias("up"))
        many = low.where("c > 1").select("n", F.col("m").alias("own"))
        # a node's other parents hang below its smallest parent from now on
        star = e.join(many, "n").where("p <> own").select(F.col("p").alias("n"), F.col("own").alias("p"))
        flat = low.select("n", F.col("m").alias("p"))
        raised = flat.join(jump, "p", "left").select("n", F.coalesce("up", "p").alias("p"), F.col("up").isNotNull().cast("int").alias("moved"))
        new = raised.unionByName(star.withColumn("moved", F.lit(1))).groupBy("n", "p").agg(F.max("moved").alias("moved"))
        new = materialise(gathered(new, count), label)
        changed = new.where("moved = 1").limit(1).count()
        e = new.select("n", "p")
        if not changed:
            return e.select(F.col("n").alias("node"), F.col("p").alias("component")).unionByName(
                gathered(e.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct(), count)
            )
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
