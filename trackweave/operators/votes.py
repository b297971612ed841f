"""Votes: which host, descendant or central a track gets (V1-V3, A5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_tracers(
    members: DataFrame, by: Sequence[str], n: int, tracer: Column, rank: str = "rank", spill: bool = True
) -> DataFrame:
    """The n best members of each group in order of rank, tracers before others, with `order` from 0 (A5).

    With spill=False only tracers are taken. Spark keeps only n rows per group and task before it shuffles.
    """
    rows = members.withColumn("_tracer", tracer)
    rows = rows if spill else rows.where("_tracer")
    w = Window.partitionBy(*by).orderBy(F.col("_tracer").desc(), F.col(rank), F.col("particle_id"))
    return rows.withColumn("order", F.row_number().over(w) - 1).where(F.col("order") < n).drop("_tracer")


def weighted_host(tracers: DataFrame, by: Sequence[str], host: str = "host_id", order: str = "order") -> DataFrame:
    """(by, host, score): the host with the highest sum of weights 1 / (1 + sqrt(order)) (V1).

    -1 (no group) is a candidate like any other; members whose host is null take no part. Scores are compared to nine
    decimals; equal ones go to the smallest host.
    """
    scores = (
        tracers.where(F.col(host).isNotNull())
        .groupBy(*by, host)
        .agg(F.round(F.sum(1 / (1 + F.sqrt(F.col(order)))), 9).alias("score"))
    )
    best = F.max(F.struct(F.col("score"), (-F.col(host)).alias("h")))
    return scores.groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.h")).alias(host), F.col("b.score").alias("score"))


def descendant(stored: DataFrame, members: DataFrame, by: Sequence[str], particle: str, candidate: str) -> DataFrame:
    """(by, candidate, n_matches): the candidate that holds most of the stored tracers (V2).

    Equal counts go to the lowest candidate; groups none of whose tracers is held by anyone get no row.
    """
    counts = stored.select(*by, particle).join(members.select(particle, candidate), particle).groupBy(*by, candidate)
    best = F.max(F.struct(F.col("n"), (-F.col(candidate)).alias("c")))
    return (
        counts.agg(F.count("*").alias("n"))
        .groupBy(*by)
        .agg(best.alias("b"))
        .select(*by, (-F.col("b.c")).alias(candidate), F.col("b.n").alias("n_matches"))
    )


def central(candidates: DataFrame, by: Sequence[str], mass: str, distance: str, track: str, ratio: float) -> DataFrame:
    """(by, track): of the candidates with at least `ratio` of the group's greatest mass, the one at least distance (V3).

    Equal distances go to the more massive, then to the lower track id. Candidates without mass take no part; an
    unknown distance comes last. Both steps are aggregates, so a group of any size is reduced before the shuffle.
    """
    greatest = candidates.groupBy(*by).agg((F.max(mass) * ratio).alias("_least"))
    near = F.min(F.struct(F.coalesce(F.col(distance), F.lit(float("inf"))), (-F.col(mass)).alias("m"), F.col(track).alias("t")))
    return (
        candidates.join(greatest, list(by))
        .where(F.col(mass) >= F.col("_least"))
        .groupBy(*by)
        .agg(near.alias("b"))
        .select(*by, F.col("b.t").alias(track))
    )
