"""Versioned report store: point reads, latest and previous versions, upserts and deletes.

Every operator takes DataFrames and returns one; windows are partitioned by the key of a report,
so they need one exchange and no group larger than a report's own versions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def where_given(df: DataFrame, **equal: object) -> DataFrame:
    """Conjunction of equalities; arguments that are None add nothing."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def number_versions(df: DataFrame, key: Sequence[str], order: Sequence[str], into: str = "version") -> DataFrame:
    """Version 1, 2, … of each key in the given order."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def latest(df: DataFrame, key: Sequence[str], version: str = "version") -> DataFrame:
    """The row of the highest version of each key."""
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version)))
    return df.withColumn("_rn", newest).filter("_rn = 1").drop("_rn")


def latest_value(df: DataFrame, key: Sequence[str], value: str, version: str = "version") -> DataFrame:
    """One column of the latest version, combined before the shuffle instead of sorted after it."""
    return df.groupBy(*key).agg(F.max_by(value, version).alias(value), F.max(version).alias(version))


def previous(df: DataFrame, key: Sequence[str], column: str, version: str = "version") -> DataFrame:
    """Add ``previous_<column>``: its value in the version before, null for the first."""
    w = Window.partitionBy(*key).orderBy(version)
    return df.withColumn(f"previous_{column}", F.lag(column).over(w))


def max_version(keys: DataFrame, versions: DataFrame, key: Sequence[str], version: str = "version") -> DataFrame:
    """Highest version of each key asked for, 0 where there is none."""
    top = versions.groupBy(*key).agg(F.max(version).alias("max_version"))
    return keys.join(top, list(key), "left").withColumn("max_version", F.coalesce("max_version", F.lit(0)))


def append_revisions(stored: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str], content: str = "content") -> DataFrame:
    """Rows to append for ``new``: version max + 1, … for each key, and 16 digits of the content's md5."""
    top = stored.groupBy(*key).agg(F.max("version").alias("_top"))
    w = Window.partitionBy(*key).orderBy(*order)
    out = new.join(top, list(key), "left").withColumn("version", (F.coalesce("_top", F.lit(0)) + F.row_number().over(w)).cast("int"))
    return out.withColumn("content_hash", F.substring(F.md5(F.col(content).cast("binary")), 1, 16)).drop("_top")


def update_known(stored: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Overwrite ``columns`` where a change gives a value; other columns of ``changes`` are ignored."""
    c = changes.select(F.col(key).alias("_k"), *[F.col(x).alias(f"_{x}") for x in columns])
    joined = stored.join(c, F.col(key) == F.col("_k"), "left")
    return joined.select(*[F.coalesce(F.col(f"_{x}"), F.col(x)).alias(x) if x in columns else F.col(x) for x in stored.columns])


def delete_keys(stored: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """What stays after deleting all rows of the given keys."""
    return stored.join(keys, on, "left_anti")


def upsert_plan(stored: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): insert what is new, update what changed, skip what is equal, keep what did not come."""
    a = stored.select(F.col(key), F.col(digest).alias("_old"))
    b = incoming.select(F.col(key), F.col(digest).alias("_new"))
    action = (
        F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "keep").when(F.col("_old") == F.col("_new"), "skip").otherwise("update")
    )
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def first_given(frames: Sequence[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """Merge sources by priority: the value of the first that has the key, tagged with its name."""
    tagged = None
    for rank, (name, df) in enumerate(frames):
        part = df.select(key, F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("origin"), F.col(value).alias(value)).alias("_v")).filter(F.col(f"_v.{value}").isNotNull())
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy(key).agg(F.min("_v").alias("_v")).select(key, F.col(f"_v.{value}").alias(value), F.col("_v.origin").alias("origin"))


def rollup(df: DataFrame, by: str, time: str) -> DataFrame:
    """Number of rows and newest time of each group."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("newest"))


def newest(df: DataFrame, time: str, tie: str, n: int) -> DataFrame:
    """The ``n`` newest rows; ``tie`` makes the order total."""
    return df.orderBy(F.desc(time), F.asc(tie)).limit(n)


def for_dependencies(latest_rows: DataFrame, dependencies: DataFrame, on: str) -> DataFrame:
    """Latest rows of the keys a list names: one semi-join instead of a read for each."""
    return latest_rows.join(dependencies, on, "left_semi")


def stable_checkpoint(completed: Column, revising: Column, layer_done: Column) -> Column:
    """Kind of checkpoint, the first that holds: completed, revision, layer, intermediate."""
    return F.when(completed, "completed").when(revising, "revision").when(layer_done, "layer").otherwise("intermediate")


def session_status(completed: Column, paused: Column, started: Column) -> Column:
    return F.when(completed, "completed").when(paused, "paused").when(started, "running").otherwise("pending")


def merge_lists(df: DataFrame, key: str, items: str, order: str) -> DataFrame:
    """Key-wise concatenation of lists in order, first of equal items kept."""
    ordered = F.array_sort(F.collect_list(F.struct(order, items)))
    return df.groupBy(key).agg(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x[items]))).alias(items))


def merge_maps(df: DataFrame, key: Sequence[str], name: str, value: str, order: str) -> DataFrame:
    """Key-wise map merge where later entries win, as (key, name, value) rows."""
    return df.groupBy(*key, name).agg(F.max_by(value, order).alias(value))


def add_missing_columns(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Additive migration: columns (type, default) that are absent are added, running it again changes nothing."""
    for name, (kind, value) in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value).cast(kind))
    return df
