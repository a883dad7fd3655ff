"""Change events and upkeep of a catalog, as batch operations that a stream calls too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovana.operators import catalog, exclusion

#: Bits of an event's flags.
MUST_SCAN, USER_DROPPED, KERNEL_DROPPED, IDS_WRAPPED, HISTORY_DONE, ROOT_CHANGED = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
REMOVED, RENAMED, IS_DIR = 0x200, 0x800, 0x20000
UNSAFE = USER_DROPPED | KERNEL_DROPPED | IDS_WRAPPED | ROOT_CHANGED
#: Scopes beyond which a history is collapsed to parents, then given up.
MOST_SCOPES = 5000
#: Changes beyond which a delta is compacted instead of kept.
LARGE_DELTA = 10_000


def has(mask: int) -> Column:
    return F.col("flags").bitwiseAND(mask) != 0


def decoded(events: DataFrame) -> DataFrame:
    """``history_done``, ``unsafe``, ``recursive`` and ``is_directory`` of events (path, flags, event_id)."""
    unsafe = has(UNSAFE)
    return events.select("*", has(HISTORY_DONE).alias("history_done"), unsafe.alias("unsafe"), (has(MUST_SCAN) | unsafe).alias("recursive"), has(IS_DIR).alias("is_directory"), has(REMOVED | RENAMED).alias("parent_scope"))


def coalesced(events: DataFrame) -> DataFrame:
    """One row per path: flags combined, the latest id, the first position."""
    return events.groupBy("path").agg(F.bit_or("flags").alias("flags"), F.max("event_id").alias("event_id"), F.min("event_id").alias("first_event_id"))


def latest(rows: DataFrame, key: str = "path", order: str = "event_id") -> DataFrame:
    """The row with the greatest ``order`` of each key."""
    rest = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def cursors(events: DataFrame, roots: DataFrame) -> DataFrame:
    """The latest event id of each root."""
    return with_event_root(events, roots).where("root is not null").groupBy("root").agg(F.max("event_id").alias("event_id"))


def with_event_root(events: DataFrame, roots: DataFrame) -> DataFrame:
    """The deepest configured root at or above each event's path."""
    paths = events.select("path").distinct()
    return events.join(catalog.with_root(paths, roots).select("path", "root"), "path", "left")


def indexable(events: DataFrame, roots: list[str], patterns=exclusion.DEFAULT_PATTERNS) -> DataFrame:
    """Coalesced events that the rules let through: cheap tests first, then all rules.

    A path that is pruned as a file is tried as a directory again, as a flag may be missing.
    """
    rows = decoded(coalesced(events)).where(~exclusion.event_prefilter(F.col("path"), patterns))
    rows = rows.where(_within(F.col("path"), roots))
    both = exclusion.with_decisions(rows, roots, patterns, {"": F.col("is_directory"), "_again": F.lit(True)})
    again = (F.col("decision") == exclusion.PRUNE) & ~F.col("is_directory") & (F.col("decision_again") == exclusion.INDEX)
    return both.withColumn("decision", F.when(again, exclusion.INDEX).otherwise(F.col("decision"))).drop("decision_again", "rule", "rule_again").where(F.col("decision") != exclusion.PRUNE)


def _within(path: Column, roots: list[str]) -> Column:
    test = F.lit(False)
    for r in roots:
        test = test | (path == r) | path.startswith(r.rstrip("/") + "/")
    return test


def scopes(events: DataFrame) -> DataFrame:
    """``scope`` of each event: the directory itself, the parent for removals and renames, else the path; never above its root."""
    path, root = F.col("path"), F.col("root")
    parent = catalog.text.parent_path(path)
    inside = (parent == root) | parent.startswith(F.concat(F.regexp_replace(root, "/$", ""), F.lit("/")))
    parent = F.when((parent != "/") & inside, parent).otherwise(root)
    scope = F.when(path == root, root).when(F.col("is_directory") | (F.col("decision") == exclusion.DESCEND), path).when(F.col("recursive") | F.col("parent_scope"), parent).otherwise(path)
    return events.withColumn("scope", scope)


def minimal(paths: DataFrame) -> DataFrame:
    """Paths without those that another one covers: an equi-join on proper ancestors."""
    one = paths.select("path").distinct()
    covered = catalog.exploded(one).join(one.select(F.col("path").alias("ancestor")), "ancestor", "left_semi").select("path").distinct()
    return one.join(covered, "path", "left_anti")


def routed(found: DataFrame) -> DataFrame:
    """Scopes (path, is_directory) as directories to rescan and files to update; files below such a directory go."""
    directories = found.where("is_directory").select("path").distinct()
    files = found.where("not is_directory").select("path").distinct()
    rest = catalog.under(files, directories, "left_anti")
    return directories.withColumn("kind", F.lit("directory")).unionByName(rest.withColumn("kind", F.lit("file")))


def catch_up(events: DataFrame, roots: DataFrame, root_paths: list[str], completed: bool = True, have_cursors: bool = True, patterns=exclusion.DEFAULT_PATTERNS, most: int = MOST_SCOPES) -> tuple[str, DataFrame | None]:
    """What to do after a downtime: ("full", None), ("full", scopes), ("scoped", scopes) or ("upToDate", None).

    Only counts and flags are read back; the scopes stay a DataFrame.
    """
    if not have_cursors or not completed:
        return "full", None
    flags = decoded(events)
    if not flags.where("history_done").limit(1).count():
        return "full", None
    kept = with_event_root(indexable(flags.where("not history_done").select("path", "flags", "event_id"), root_paths, patterns), roots).where("root is not null")
    scoped = scopes(kept)
    unsafe = scoped.where("recursive").select(F.col("root").alias("path"))
    found = scoped.select(F.col("scope").alias("path")).distinct()
    some = unsafe.limit(1).count() > 0
    if found.limit(most).count() >= most and not some:
        parents = minimal(found.select(catalog.text.parent_path(F.col("path")).alias("path")))
        if parents.limit(most).count() >= most:
            return "full", None
        found = parents
    if some:
        return "full", minimal(unsafe.unionByName(found))
    if not found.limit(1).count():
        return "upToDate", None
    return "scoped", minimal(found)


def without_subtrees(df: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows that lie neither at nor under any of the paths."""
    return catalog.under(df, paths, "left_anti")


def upsert(df: DataFrame, changed: DataFrame) -> DataFrame:
    """New rows win by path."""
    return df.join(changed.select("path").distinct(), "path", "left_anti").select(*df.columns).unionByName(changed.select(*df.columns))


def replace_scopes(df: DataFrame, rescanned: DataFrame, paths: DataFrame) -> DataFrame:
    """A rescan of some subtrees: what was under them goes, what was found there comes."""
    return without_subtrees(df, minimal(paths)).select(*df.columns).unionByName(rescanned.select(*df.columns))


#: Columns that searches read; a change of others is metadata only.
SEARCH_KEYS = ("path", "name", "file_extension", "is_directory", "is_hidden", "volume_name")
METADATA = ("size_bytes", "modified_time", "created_time")


def split_changes(df: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metadata only, structural): rows whose search keys are as before, and the others."""
    old = df.select(F.col("path").alias("_p"), F.struct(*[F.col(c) for c in SEARCH_KEYS]).alias("_k"))
    rows = changed.join(old, changed["path"] == old["_p"], "left").withColumn("_same", F.coalesce(F.struct(*[F.col(c) for c in SEARCH_KEYS]) == F.col("_k"), F.lit(False)))
    rest = changed.columns
    return rows.where("_same").select(*rest), rows.where("not _same").select(*rest)


def replace_metadata(df: DataFrame, delta: DataFrame) -> DataFrame:
    """Metadata of a delta over the base, row by row."""
    new = delta.select("path", *[F.col(c).alias(f"_new_{c}") for c in METADATA], F.lit(True).alias("_hit"))
    rows = df.join(new, "path", "left")
    return rows.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in METADATA else F.col(c) for c in df.columns])


def overlay(df: DataFrame, upserts: DataFrame, deleted: DataFrame) -> DataFrame:
    """A base under structural changes: deleted subtrees go first, then new rows win."""
    return upsert(without_subtrees(df, deleted), upserts)


def apply_batch(df: DataFrame, events: DataFrame, current: DataFrame, roots: list[str], patterns=exclusion.DEFAULT_PATTERNS) -> DataFrame:
    """A catalog after a batch of events, ``current`` being what exists now at and under the events' paths.

    All rows at and under these paths give way to those that exist: of a directory that was looked at, what isn't
    there any more goes too. Order and repeats don't matter, as the state is read again: applying a batch twice
    changes nothing.
    """
    kept = indexable(events, roots, patterns).select("path").distinct()
    now = exclusion.indexable(catalog.under(current, kept), roots, patterns)
    return upsert(without_subtrees(df, kept), now)


def empty_roots(roots: DataFrame, df: DataFrame) -> DataFrame:
    """Configured roots that have no rows and want a first scan."""
    return roots.join(df.where("root is not null").select("root").distinct(), "root", "left_anti")


def pending_after(pending: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Pending paths less those under prefixes that were just reconciled."""
    return catalog.under(pending, reconciled, "left_anti")


def needs_compaction(n_changes: int, rescanned_directories: int) -> bool:
    return n_changes > LARGE_DELTA or rescanned_directories > 0


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy()))
