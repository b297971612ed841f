"""History of changing attributes: a type-two dimension, merged snapshot by snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.runtime import cut


def merge_snapshot(
    current: DataFrame, snapshot: DataFrame, at: int, key: str, columns: Sequence[str]
) -> DataFrame:
    """One merge: (key, columns, hash, valid_from, valid_to); valid_to is null in open versions.

    Attribute hashes are compared with the current (open) version of each key. Where they are equal, confirmed column
    by column with null equal to null and NaN to NaN, the version stays open. Otherwise it is closed at at - 1 and,
    if the key is in the snapshot, a new version is opened at `at`. A key missing from the snapshot is closed.
    """
    now = snapshot.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.xxhash64(*columns).alias("_hash"))
    both = current.join(now, key, "full_outer")
    same = F.col("hash").eqNullSafe(F.col("_hash"))
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    same = same & F.col("valid_from").isNotNull() & F.col("_hash").isNotNull()
    old = lambda to: F.struct(*columns, "hash", "valid_from", to.cast("int").alias("valid_to"))
    new = F.struct(
        *[F.col(f"_{c}").alias(c) for c in columns],
        F.col("_hash").alias("hash"),
        F.lit(at).alias("valid_from"),
        F.lit(None).cast("int").alias("valid_to"),
    )
    versions = F.array(
        F.when(F.col("valid_from").isNotNull(), F.when(same, old(F.lit(None))).otherwise(old(F.lit(at - 1)))),
        F.when(F.col("_hash").isNotNull() & ~same, new),
    )
    return both.select(key, F.explode(versions).alias("v")).where("v IS NOT NULL").select(key, "v.*")


def history(
    versions: DataFrame, key: str, columns: Sequence[str], indexes: Sequence[int], index: str = "snapshot_index"
) -> DataFrame:
    """(key, columns, valid_from, valid_to) of all keys over the snapshots `indexes` (consecutive, ascending).

    `versions` has at most one row per key and snapshot and is written once, a part per snapshot; each merge reads its
    own snapshot and the open versions only, and its result is cut from the lineage. valid_to of versions that hold
    in the last snapshot is that snapshot. Rows with a null key are left out; no rows give no history.
    """
    rows = cut(versions.where(F.col(key).isNotNull()).select(key, F.col(index).cast("int").alias(index), *columns), index)
    current = rows.where("false").select(
        key,
        *columns,
        F.lit(0).cast("long").alias("hash"),
        F.lit(0).alias("valid_from"),
        F.lit(None).cast("int").alias("valid_to"),
    )
    closed: DataFrame | None = None
    for at in indexes:
        merged = cut(merge_snapshot(current, rows.where(F.col(index) == at), at, key, columns))
        done = merged.where("valid_to IS NOT NULL")
        closed = done if closed is None else closed.unionByName(done)
        current = merged.where("valid_to IS NULL")
    last = max(indexes, default=0)
    ended = current.withColumn("valid_to", F.lit(last))
    every = ended if closed is None else closed.unionByName(ended)
    return every.select(key, *columns, "valid_from", "valid_to")


def as_of(versions: DataFrame, at: int) -> DataFrame:
    """The versions that held at snapshot index `at`."""
    return versions.where((F.col("valid_from") <= at) & (F.col("valid_to") >= at))
