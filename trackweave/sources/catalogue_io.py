"""The catalogue and the restart state on disk: Parquet by snapshot, sorted by track (IO14-IO20, F13, F14)."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_catalogue(tracks: DataFrame, path: str, metadata: dict[int, dict] | None = None) -> None:
    """Tracks by snapshot, range-partitioned and sorted by track id, so lookups by id skip row groups.

    Each snapshot's partition is replaced as a whole and others are left; so is its row of `metadata` (by snapshot_id).
    """
    (
        tracks.repartitionByRange("snapshot_id", "track_id")
        .sortWithinPartitions("snapshot_id", "track_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_id")
        .parquet(f"{path}/tracks")
    )
    if metadata is not None:
        rows = [(int(k), json.dumps(v, sort_keys=True)) for k, v in metadata.items()]
        (
            tracks.sparkSession.createDataFrame(rows, "snapshot_id long, value string")
            .coalesce(1)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("snapshot_id")
            .parquet(f"{path}/metadata")
        )


def read_catalogue(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, snapshot_id: int | None = None, expected: int | None = None
) -> DataFrame:
    """Tracks of one or all snapshots, only the columns asked for. `expected` rows, if given, are counted and checked."""
    df = spark.read.parquet(f"{path}/tracks")
    df = df if snapshot_id is None else df.where(F.col("snapshot_id") == snapshot_id)
    df = df if columns is None else df.select("snapshot_id", *[c for c in columns if c != "snapshot_id"])
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"the catalogue holds {n} tracks, {expected} were expected")
    return df


def read_metadata(spark: SparkSession, path: str) -> dict[int, dict]:
    """The metadata of every snapshot, by its id."""
    rows = spark.read.parquet(f"{path}/metadata").select("snapshot_id", "value").collect()  # one row per snapshot
    return {int(r["snapshot_id"]): json.loads(r["value"]) for r in rows}


def write_state(members: DataFrame, path: str) -> None:
    """Source members by snapshot, in order of track and rank: what a run is restarted from (IO15)."""
    (
        members.repartitionByRange("snapshot_id", "track_id", "rank")
        .sortWithinPartitions("snapshot_id", "track_id", "rank")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_id")
        .parquet(f"{path}/source")
    )


def read_state(spark: SparkSession, path: str, snapshot_id: int | None, schema: T.StructType) -> DataFrame:
    """The members as of a snapshot; an empty frame where a run starts from nothing (None)."""
    if snapshot_id is None:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{path}/source").where(F.col("snapshot_id") == snapshot_id)


def drop_states(spark: SparkSession, path: str, below: int) -> list[int]:
    """Delete the states of snapshots before `below`; only an explicit call does so (IO20). Returns their ids."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/source")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for f in fs.listStatus(root) if fs.exists(root) else []:
        name = f.getPath().getName()
        if name.startswith("snapshot_id=") and int(name.split("=")[1]) < below:
            fs.delete(f.getPath(), True)
            gone.append(int(name.split("=")[1]))
    return sorted(gone)


def by_track(catalogue: DataFrame, requests: Sequence[int], columns: Sequence[str], missing: int | None = None) -> DataFrame:
    """One row per requested track id, in the order of the requests (column ordinal), repeated ids repeated.

    Missing ids raise unless a fill value is given. The request list comes from the caller's own memory.
    """
    spark = catalogue.sparkSession
    asked = spark.createDataFrame([(i, int(t)) for i, t in enumerate(requests)], "ordinal int, track_id long")
    found = catalogue.where(F.col("track_id").isin(*{int(t) for t in requests})).select("track_id", *columns, F.lit(True).alias("_f"))
    out = asked.join(found, "track_id", "left")
    if missing is None:
        gone = [r["track_id"] for r in out.where("_f IS NULL").select("track_id").limit(5).collect()]
        if gone:
            raise KeyError(f"tracks {gone} are not in the catalogue")
    fill = F.lit(missing)
    return out.select("ordinal", "track_id", *[F.when(F.col("_f"), F.col(c)).otherwise(fill).alias(c) for c in columns])
