"""Catalogue statistics and the sorted catalogue (A15, A24, IO14-IO19, F13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mass_function(tracks: DataFrame, mass: str, edges: Sequence[float], by: Sequence[str]) -> DataFrame:
    """(by, bin, centre, n): rows per mass bin [edge, next edge), the last bin with its right edge.

    centre is the geometric mean of the edges. Masses that are null, NaN or outside the edges fall into no bin; empty
    bins have no row.
    """
    m = F.col(mass)
    bins = F.lit(None).cast("int")
    last = len(edges) - 2
    for i in range(last, -1, -1):
        inside = (m >= edges[i]) & ((m <= edges[i + 1]) if i == last else (m < edges[i + 1]))
        bins = F.when(inside, i).otherwise(bins)
    centres = F.array(*[F.lit(round((a * b) ** 0.5, 9)) for a, b in zip(edges, edges[1:])])
    counted = tracks.where(~F.isnan(m)).withColumn("bin", bins).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return counted.select(*by, "bin", F.get(centres, F.col("bin")).alias("centre"), "n")
