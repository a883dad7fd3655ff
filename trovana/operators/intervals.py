"""Subtrees as intervals of row numbers: merging them, and telling which rows lie in one.

``with_order`` numbers a tree depth first, so everything below a directory is one range of numbers. A set of
directories becomes a set of ranges; overlapping and touching ones are merged, and the rows meet them lot by
lot, a lot being ``LOT`` consecutive numbers. Whatever a directory holds, no task sees more than whole
lots, and no row is multiplied by its ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive numbers that stay together.
LOT = 65_536


def _carried(df: DataFrame, value: Column, combine, name: str, including: bool) -> DataFrame:
    """A running maximum of ``value`` by ``start``: within a lot first, then over the lots before it.

    The table of lots has a row for each ``LOT`` numbers: it alone passes through one task.
    """
    rows = Window.partitionBy("_lot").orderBy("start").rowsBetween(Window.unboundedPreceding, 0 if including else -1)
    before = Window.orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    lots = df.groupBy("_lot").agg(combine(value).alias("_most")).select("_lot", combine("_most").over(before).alias("_before"))
    within = df.withColumn("_within", combine(value).over(rows))
    return within.join(lots, "_lot").withColumn(name, F.greatest("_within", "_before")).drop("_within", "_before")


def merge_intervals(intervals: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """Disjoint intervals ``[start, stop)`` of whole numbers that cover what the given ones do; touching ones become one.

    Empty intervals and those with a null end count for nothing.
    """
    some = intervals.select(F.col(start).cast("long").alias("start"), F.col(stop).cast("long").alias("stop")).where("start < stop")
    some = some.groupBy("start").agg(F.max("stop").alias("stop")).withColumn("_lot", F.floor(F.col("start") / LOT))
    reached = _carried(some, F.col("stop"), F.max, "_reached", including=False)
    # an interval that begins beyond all ends so far begins an island, which is named by its start
    new = F.when(F.col("_reached").isNull() | (F.col("start") > F.col("_reached")), F.col("start"))
    island = _carried(reached.withColumn("_new", new), F.col("_new"), F.max, "_island", including=True)
    return island.groupBy("_island").agg(F.max("stop").alias("stop")).select(F.col("_island").alias("start"), "stop")


def pieces(merged: DataFrame) -> DataFrame:
    """Merged intervals cut at the lots' borders: ``_lot``, ``start``, ``stop``."""
    lots = merged.withColumn("_lot", F.explode(F.sequence(F.floor(F.col("start") / LOT), F.floor((F.col("stop") - 1) / LOT))))
    return lots.select("_lot", F.greatest("start", F.col("_lot") * LOT).alias("start"), F.least("stop", (F.col("_lot") + 1) * LOT).alias("stop"))


def with_covered(rows: DataFrame, intervals: DataFrame, name: str = "covered", at: str = "row_id", start: str = "start", stop: str = "stop", only: bool = False) -> DataFrame:
    """``rows`` with a boolean ``name``: does ``at`` lie in one of the intervals? With ``only`` just those rows, without it.

    Of merged intervals only the last one that begins at or before a row can hold it, so within a lot one pass over
    rows and intervals in order decides. Lots without intervals are left out by ``only`` before anything else.
    """
    cut = pieces(merge_intervals(intervals, start, stop))
    ours = rows.select(F.floor(F.col(at) / LOT).alias("_lot"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.col(at).alias("_at"))
    if only:
        ours = ours.join(cut.select("_lot").distinct(), "_lot", "left_semi")
    marks = cut.select("_lot", F.lit(None).cast(ours.schema["_row"].dataType).alias("_row"), F.col("start").alias("_at"), "stop")
    every = ours.withColumn("stop", F.lit(None).cast("long")).select("_lot", "_row", "_at", "stop").unionByName(marks)
    # an interval that begins at a row stands before it
    order = Window.partitionBy("_lot").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = every.withColumn("_last", F.last("stop", ignorenulls=True).over(order)).where("_row is not null")
    inside = F.coalesce(F.col("_at") < F.col("_last"), F.lit(False))
    if only:
        return seen.where(inside).select("_row.*")
    return seen.select("_row.*", inside.alias(name))


def below(ordered: DataFrame, directories: DataFrame, itself: bool = False) -> DataFrame:
    """Rows of an ordered tree below some of its directories (``row_id``, ``subtree_end``), whichever and how many; with ``itself`` those too."""
    if itself:
        return with_covered(ordered, directories, start="row_id", stop="subtree_end", only=True)
    # a directory is below another one or not at all: its own row is left out by beginning behind it
    return with_covered(ordered, directories.select((F.col("row_id") + 1).alias("start"), F.col("subtree_end").alias("stop")), only=True)


def with_visibility(ordered: DataFrame) -> DataFrame:
    """``is_visible`` as in ``catalog.with_visibility``, by the intervals of hidden directories."""
    hidden = ordered.where("is_hidden and is_directory")
    out = with_covered(ordered, hidden.select((F.col("row_id") + 1).alias("start"), F.col("subtree_end").alias("stop")), "_below")
    return out.withColumn("is_visible", ~F.col("is_hidden") & ~F.col("_below")).drop("_below")


def subtree_totals(ordered: DataFrame, *values: str) -> DataFrame:
    """``row_id`` of each directory with ``n_below`` and, for each value, ``<value>_below``: sums over what lies below it.

    A running sum over the order, read where a subtree ends and at its directory: two equi-joins on row numbers,
    however large the subtree is.
    """
    lots = ordered.select("row_id", "subtree_end", "is_directory", F.lit(1).alias("n"), *values).withColumn("_lot", F.floor(F.col("row_id") / LOT))
    names = ["n", *values]
    within = Window.partitionBy("_lot").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    sums = lots.groupBy("_lot").agg(*[F.sum(F.coalesce(F.col(v), F.lit(0))).alias(f"_s_{v}") for v in names])
    carried = sums.select("_lot", *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in names])
    running = lots.select("*", *[F.sum(F.coalesce(F.col(v), F.lit(0))).over(within).alias(f"_w_{v}") for v in names]).join(carried, "_lot")
    running = running.select("row_id", "subtree_end", "is_directory", *[(F.col(f"_w_{v}") + F.col(f"_b_{v}")).cast("long").alias(f"_r_{v}") for v in names])
    ends = running.select((F.col("row_id") + 1).alias("subtree_end"), *[F.col(f"_r_{v}").alias(f"_e_{v}") for v in names])
    out = running.where("is_directory").join(ends, "subtree_end")
    return out.select("row_id", *[(F.col(f"_e_{v}") - F.col(f"_r_{v}")).alias("n_below" if v == "n" else f"{v}_below") for v in names])
