"""The project's tables: one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def without_nan(column: str) -> list[Column]:
    """The column with null for NaN, and <column>_is_nan."""
    nan = F.coalesce(F.isnan(column), F.lit(False))
    return [F.when(~nan, F.col(column)).alias(column), nan.alias(f"{column}_is_nan")]


def rows_that_count(
    subhalos: DataFrame, columns: list[str], snapshots: DataFrame | None = None
) -> DataFrame:
    """The current version of each track and snapshot: the row with the greatest delivered_at.

    Rows with a null or negative track_id are no version; rows that share the greatest delivered_at are identical,
    so each attribute may be taken from any of them. With `snapshots` (one row per snapshot_index) the position in
    time is added and snapshots that are not listed there are left out. All aggregates keep fixed-width buffers,
    so the reduction happens before the shuffle, however often one track was delivered.
    """
    keyed = subhalos.where("track_id >= 0").select("snapshot_id", "track_id", "delivered_at", *columns)
    latest = keyed.groupBy("snapshot_id", "track_id").agg(
        *[F.max_by(c, F.coalesce("delivered_at", F.lit(0).cast("timestamp"))).alias(c) for c in columns]
    )
    if snapshots is None:
        return latest
    times = snapshots.select(F.col("snapshot_id").cast("long").alias("snapshot_id"), "snapshot_index").distinct()
    return latest.join(times, "snapshot_id")
