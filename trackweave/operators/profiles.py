"""Density profiles of groups: cumulative mass over radius, peaks and overdensities.

A group's members are ordered by radius in chunks of equal-width radius bins: counts and masses of the bins merge
before the shuffle and are summed up over at most `bins` rows; only the order within a bin is sorted. So a hot group is
spread over `bins` windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 256


def cumulative(rows: DataFrame, by: Sequence[str], r: str, bins: int = BINS) -> DataFrame:
    """rows with n_in and m_in, the count and mass within and with this row, by r and then particle_id."""
    top = rows.groupBy(*by).agg(F.max(r).alias("_top"))
    share = F.floor(F.sqrt(F.col(r) / F.nullif(F.col("_top"), F.lit(0.0))) * bins)  # denser bins inside
    binned = rows.join(top, list(by)).withColumn("_bin", F.coalesce(F.least(share, F.lit(bins - 1)), F.lit(0)).cast("int")).drop("_top")
    sums = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_n"), F.sum("mass").alias("_m"))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *by,
        "_bin",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_m").over(before), F.lit(0.0)).alias("_m0"),
    )
    w = Window.partitionBy(*by, "_bin").orderBy(r, "particle_id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        binned.withColumn("n_in", F.row_number().over(w))
        .withColumn("m_in", F.sum("mass").over(w))
        .join(starts, [*by, "_bin"])
        .withColumns({"n_in": F.col("n_in") + F.col("_n0"), "m_in": F.col("m_in") + F.col("_m0")})
        .drop("_bin", "_n0", "_m0")
    )


def summary(profile: DataFrame, by: Sequence[str], r: str, soft: str, density: str) -> DataFrame:
    """(by, n, r_max, v2_max, r_half, r_enclose, m_over, r_over) of the rows of `cumulative`.

    Radii below the softening count as the softening. v2_max is the greatest M(<r) / r and r_max where it is reached
    first. r_half is the radius of row n / 2 (rounded down, from 0). m_over is the mass within the outermost row with
    M(<r) above density times r cubed, r_over the radius of that mean density; both null if there is none. Groups of
    one row get zeros.
    """
    c = profile.withColumn("_r", F.greatest(F.col(r), F.col(soft)))
    v2 = F.col("m_in") / F.col("_r")
    n = profile.groupBy(*by).agg(F.count("*").alias("n"))
    over = F.when(F.col("m_in") > F.col(density) * F.pow("_r", F.lit(3)), F.struct(F.col("n_in"), F.col("m_in"), F.col(density).alias("d")))
    half = F.max(F.when(F.col("n_in") == F.floor(F.col("n") / 2) + 1, F.col("_r")))
    s = c.join(n, list(by)).groupBy(*by).agg(
        F.first("n").alias("n"),
        F.max(F.struct(v2.alias("v2"), (-F.col("_r")).alias("r"))).alias("_v"),
        half.alias("r_half"),
        F.max("_r").alias("r_enclose"),
        F.max(over).alias("_o"),
    )
    some = F.col("n") > 1
    zero = F.lit(0.0)
    return s.select(
        *by,
        "n",
        F.when(some, -F.col("_v.r")).otherwise(zero).alias("r_max"),
        F.when(some, F.col("_v.v2")).otherwise(zero).alias("v2_max"),
        F.when(some, F.col("r_half")).otherwise(zero).alias("r_half"),
        F.when(some, F.col("r_enclose")).otherwise(zero).alias("r_enclose"),
        F.when(some, F.col("_o.m_in")).otherwise(zero).alias("m_over"),
        F.when(some, F.pow(F.try_divide(F.col("_o.m_in"), F.col("_o.d")), F.lit(1 / 3))).otherwise(zero).alias("r_over"),
    )
