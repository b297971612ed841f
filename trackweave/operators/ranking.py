"""Ranks, running peaks, offsets and dense ids (W1-W15, A16, IO19)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions import physics as ph


def member_ranks(rows: DataFrame, by: Sequence[str], order: Sequence[Column], field: Column | None = None) -> DataFrame:
    """rows with `member_rank` from 0 in the given order within `by`; where `field` holds, 0 for all.

    Rows outside any group are set to 0 before the window, so they form no window of their own. The window holds the
    tracks of one group, which share its members between them.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    if field is None:
        return rows.withColumn("member_rank", F.row_number().over(w) - 1)
    outside = F.coalesce(field, F.lit(False))
    ranked = rows.where(~outside).withColumn("member_rank", F.row_number().over(w) - 1)
    return ranked.unionByName(rows.where(outside).withColumn("member_rank", F.lit(0)))


def global_positions(rows: DataFrame, order: str, weight: str | None = None) -> DataFrame:
    """rows with `position` (from 0) and, with a weight, `offset`: the weights' sum over all rows before.

    Rows are range-partitioned by `order` (unique) and numbered within their partitions; the partitions' totals, one
    small row each, are summed up and added. No window holds the whole table.
    """
    from trackweave.runtime import cut

    parts = rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    parts = cut(parts)  # the numbers of the range partitions stay as they are
    w = Window.partitionBy("_part").orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    value = F.col(weight) if weight else F.lit(0)
    sums = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(value).alias("_w"))
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sums.select(
        "_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_w").over(over), F.lit(0)).alias("_w0")
    )
    out = (
        parts.withColumn("position", F.row_number().over(w) - 1)
        .withColumn("offset", F.coalesce(F.sum(value).over(before), F.lit(0)))
        .join(F.broadcast(starts), "_part")
        .withColumns({"position": F.col("position") + F.col("_n0"), "offset": F.col("offset") + F.col("_w0")})
        .drop("_part", "_n0", "_w0")
    )
    return out if weight else out.drop("offset")


def positions_within(rows: DataFrame, by: Sequence[str], order: Sequence[Column], weight: str | None = None) -> DataFrame:
    """rows with `position` (from 0) and, with a weight, `offset` within each group `by`, in the given unique order.

    All groups are placed by one range partitioning, so a hot group is spread over many windows, also where its rows
    tie in all but the last column of the order; then each group's first position and offset, one row, are subtracted.
    Weights must not be negative; the columns of `by` must not be null. Orders are ascending, nulls first.
    """
    o = F.struct(*by, *[c.alias(f"o{i}") for i, c in enumerate(order)])
    placed = global_positions(rows.withColumn("_o", o), "_o", weight).drop("_o")
    first = placed.groupBy(*by).agg(F.min("position").alias("_p0"), *([F.min("offset").alias("_w0")] if weight else []))
    out = placed.join(first, list(by)).withColumn("position", F.col("position") - F.col("_p0"))
    return (out.withColumn("offset", F.col("offset") - F.col("_w0")).drop("_w0") if weight else out).drop("_p0")


def energy_places(members: DataFrame, by: Sequence[str], energy: str = "binding_energy") -> DataFrame:
    """members with `place` from 1 within their track: bound ones first, then by energy and particle."""
    order = [~ph.is_bound(energy), F.col(energy).isNull(), F.col(energy), F.col("particle_id")]
    return positions_within(members, by, order).withColumn("place", (F.col("position") + 1).cast("int")).drop("position")


def running_peak(rows: DataFrame, key: str, index: str, value: str, carry: Sequence[str]) -> DataFrame:
    """rows with peak_<value> and peak_<carry>: the greatest value so far and the carried columns of the last row that
    attained it (W10). A window holds one row per snapshot of a key. Null and NaN values attain nothing."""
    w = Window.partitionBy(key).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    real = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    best = F.max(F.when(real, F.struct(F.col(value).alias("v"), F.col(index).alias("i"), *[F.col(c).alias(f"c_{c}") for c in carry]))).over(w)
    return (
        rows.withColumn("_b", best)
        .withColumns({f"peak_{value}": F.col("_b.v"), **{f"peak_{c}": F.col(f"_b.c_{c}") for c in carry}})
        .drop("_b")
    )


def last_isolation(rows: DataFrame, key: str, index: str, satellite: Column, ids: DataFrame) -> DataFrame:
    """rows with last_isolation: the id of the snapshot before the latest one in which the key turned satellite.

    -1 for keys that never were satellites so far. ids: (index, snapshot_id).
    """
    w = Window.partitionBy(key).orderBy(index)
    turned = F.when(satellite & ~F.coalesce(F.lag(satellite).over(w), F.lit(False)), F.col(index) - 1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_t", turned).withColumn("_i", F.last("_t", True).over(upto)).drop("_t")
    names = ids.select(F.col(index).alias("_i"), F.col("snapshot_id").alias("_id"))
    return (
        marked.join(names, "_i", "left").withColumn("last_isolation", F.coalesce("_id", F.lit(-1))).drop("_i", "_id")
    )


def truncated(members: DataFrame, tracks: DataFrame, by: Sequence[str], factor: float, rank: str = "rank") -> DataFrame:
    """The members of each track that stay in its source: the first floor(n_bound * factor), or n_bound if it is at
    most 1 (W9)."""
    keep = F.when(F.col("n_bound") <= 1, F.col("n_bound")).otherwise(F.floor(F.col("n_bound") * factor))
    return members.join(tracks.select(*by, keep.alias("_keep")), list(by)).where(F.col(rank) < F.col("_keep")).drop("_keep")
