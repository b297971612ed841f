"""Formats by name: snapshots, groups and split maps; further ones are registered by the user (IO1, IO2, IO6)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.operators.positions import paint
from trackweave.operators.ranking import global_positions
from trackweave.sources import blocks

Reader = Callable[..., DataFrame]


def _parquet(spark: SparkSession, path: str, **_) -> DataFrame:
    return spark.read.parquet(path)


def _blocks(spark: SparkSession, path: str, **options) -> DataFrame:
    blocks.register(spark)
    return spark.read.format("blocks").options(**options).load(path=path)


def _group_members(version: int, id_bytes: int) -> Reader:
    def load(spark: SparkSession, path: str, ids: str = "", mask: int = 0, **_) -> DataFrame:
        """(group_id, particle_id): ids counted off by the lengths of the groups in `path`."""
        blocks.register(spark)
        lengths = spark.read.format("group_lengths").options(version=version).load(path=path)
        listed = spark.read.format("group_ids").options(version=version, id_bytes=id_bytes, mask=mask).load(path=ids)
        counted = global_positions(lengths.select("group_id", F.coalesce("length", F.lit(0)).alias("length")), "group_id", "length")
        ranges = counted.select("group_id", F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("end"))
        return paint(listed, "position", ranges, [], "group_id").where("group_id >= 0").select("group_id", "particle_id")

    return load


SNAPSHOTS: dict[str, Reader] = {"parquet": _parquet, "blocks": _blocks}
GROUPS: dict[str, Reader] = {
    "parquet": _parquet, "groups2_int": _group_members(2, 4), "groups2_long": _group_members(2, 8),
    "groups3_int": _group_members(3, 4), "groups3_long": _group_members(3, 8),
}


def register(name: str, snapshot: Reader | None = None, group: Reader | None = None) -> None:
    """Add or replace a format; readers take (spark, path, **options)."""
    if snapshot:
        SNAPSHOTS[name] = snapshot
    if group:
        GROUPS[name] = group


def _load(known: dict[str, Reader], what: str, spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    if name not in known:
        raise ValueError(f"unknown {what} format {name}; known are {', '.join(sorted(known))}")
    return known[name](spark, path, **options)


def load_snapshot(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    return _load(SNAPSHOTS, "snapshot", spark, name, path, **options)


def load_groups(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    return _load(GROUPS, "group", spark, name, path, **options)


def groups_of_particles(particles: DataFrame, by: Sequence[str] = (), host: str = "host_id") -> DataFrame:
    """(by, host_id, n, first_id) of the groups that particles name, -1 and null being none (IO5, IO9)."""
    return particles.where(F.col(host) >= 0).groupBy(*by, host).agg(F.count("*").alias("n"), F.min("particle_id").alias("first_id"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) split links; a missing file or folder stands for no splits (IO6), anything else is read or fails."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "key long, value long")
    return spark.read.parquet(path).select("key", "value")
