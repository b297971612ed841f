"""What changed between full snapshots: gaps and islands over key and row hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validity_intervals(versions: DataFrame, key: str, columns: Sequence[str], index: str = "snapshot_index") -> DataFrame:
    """(key, columns, first, last): the longest runs of consecutive snapshots in which a key's row stays the same.

    `versions` holds at most one row per key and snapshot. A run ends where the next index is missing or the row
    hash differs; equal hashes are confirmed column by column (null equals null, NaN equals NaN). A window holds the
    rows of one key, one per snapshot. Rows with a null key or index belong to no run.
    """
    w = Window.partitionBy(key).orderBy(index)
    hashed = versions.where(F.col(key).isNotNull() & F.col(index).isNotNull()).select(
        key, index, *columns, F.xxhash64(*columns).alias("_hash")
    )
    same = F.col(index) == F.lag(index).over(w) + 1
    for c in ["_hash", *columns]:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    starts = hashed.withColumn("_starts", F.when(same, 0).otherwise(1))
    runs = starts.withColumn("_run", F.sum("_starts").over(w))
    return runs.groupBy(key, "_run").agg(
        *[F.first(c).alias(c) for c in columns], F.min(index).alias("first"), F.max(index).alias("last")
    ).drop("_run")


def change_events(
    intervals: DataFrame, key: str, snapshots: DataFrame, index: str = "snapshot_index"
) -> DataFrame:
    """(index, key, change) from validity intervals; index is that of the later snapshot of each consecutive pair.

    An interval that starts where another of the same key ended just before is a change; any other start, but in the
    first snapshot, is an addition; an end, but in the last snapshot, without such a successor is a removal.
    """
    w = Window.partitionBy(key).orderBy("first")
    begin, end_ = snapshots.agg(F.min(index), F.max(index)).first()
    near = intervals.select(
        key, "first", "last", F.lag("last").over(w).alias("_before"), F.lead("first").over(w).alias("_after")
    )
    start = F.when(F.col("_before") == F.col("first") - 1, "changed").when(F.col("first") > F.lit(begin), "added")
    end = F.when(
        (F.col("last") < F.lit(end_)) & (F.col("_after").isNull() | (F.col("_after") > F.col("last") + 1)), "removed"
    )
    events = F.explode(
        F.array(
            F.struct(F.col("first").alias("at"), start.alias("change")),
            F.struct((F.col("last") + 1).alias("at"), end.alias("change")),
        )
    )
    return near.select(key, events.alias("e")).where("e.change IS NOT NULL").select(
        F.col("e.at").alias(index), key, F.col("e.change").alias("change")
    )


def snapshot_changes(
    versions: DataFrame, key: str, columns: Sequence[str], snapshots: DataFrame, index: str = "snapshot_index"
) -> DataFrame:
    """Added, removed and changed keys of each snapshot against the one before. No snapshots or versions: no rows."""
    return change_events(validity_intervals(versions, key, columns, index), key, snapshots, index)
