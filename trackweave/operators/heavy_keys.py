"""Per-key results where a few keys hold most rows: exact quantiles from mergeable histograms.

No step gathers a key's values. Each round counts, per (key, bin), how many values fall in and their least and
greatest; such counts merge map-side, so a hot key sends a bounded number of rows per task. The bin that holds a
wanted rank becomes the next round's interval; when its least and greatest value agree, the rank is resolved.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.runtime import BROADCAST_ROWS, cut

#: Bins of the first histogram (over the global range) and of each refinement (over one interval).
FIRST_BINS, BINS = 4096, 256
#: A key is joined by broadcast if it has at least this share of all rows; there are at most 1 / share such keys.
HOT_SHARE = 0.001


def _bin(v: Column, lo: Column, hi: Column, bins: int, log: bool) -> Column:
    """A bin of [lo, hi], rising with v; lo and hi fall into different bins unless equal.

    Halves avoid an overflow of large differences; differences of small numbers are taken whole, as half the least
    number there is would be 0.
    """
    if log:  # equal ratios instead of equal widths, for values spread over many magnitudes
        scale = lambda x: F.signum(x) * F.log1p(F.abs(x))
        v, lo, hi = scale(v), scale(lo), scale(hi)
    big = F.greatest(F.abs(lo), F.abs(hi)) > 1
    share = F.when(big, F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)).otherwise(F.try_divide(v - lo, hi - lo))
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.when(hi > lo, share).otherwise(0.0) * bins).cast("int")))


def _unit(top: float) -> int:
    """The power of ten in whose multiples values up to `top` are added up: sums of any 10^12 rows fit 38 digits, and no
    digit that a double of that size can show is lost. -6 for values of usual size."""
    if top == 0:
        return -6
    size = math.floor(math.log10(top))
    return size - 21 if size > 15 else -6 if size >= -3 else size - 18


def _scaled(v: Column, power: int) -> Column:
    """v times 10 to the power, in steps that don't overflow."""
    while power:
        step = max(-300, min(300, power))
        v, power = v * F.lit(10.0**step), power - step
    return v


def _refine(rows: DataFrame, active: DataFrame, hot: DataFrame, n_active: int, log: bool, broadcast_rows: int) -> DataFrame:
    """Histograms of the active intervals: (key, lo, bin, n, least, most)."""
    intervals = active.select("key", "lo", "hi").distinct()
    within = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    if n_active <= broadcast_rows:
        joined = rows.join(F.broadcast(intervals), "key").where(within)
    else:  # the few hot keys map-side, the others by a shuffle in which none of them is heavy
        hot_rows = rows.join(F.broadcast(intervals.join(F.broadcast(hot), "key", "left_semi")), "key").where(within)
        cold = rows.join(F.broadcast(hot), "key", "left_anti")
        joined = hot_rows.unionByName(cold.join(intervals.join(F.broadcast(hot), "key", "left_anti"), "key").where(within))
    return joined.groupBy("key", "lo", _bin(F.col("v"), F.col("lo"), F.col("hi"), BINS, log).alias("bin")).agg(
        F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")
    )


def _locate(ranks: DataFrame, hist: DataFrame) -> DataFrame:
    """The bin of each wanted rank (key, p, lo, rank): (key, p, lo, hi, rank), rank now counted within the bin."""
    w = Window.partitionBy("key", "lo").orderBy("bin")
    sums = hist.withColumn("upto", F.sum("n").over(w))
    return (
        ranks.select("key", "p", "lo", "rank")
        .join(sums, ["key", "lo"])
        .where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        .select(
            "key",
            "p",
            F.col("least").alias("lo"),
            F.col("most").alias("hi"),
            (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"),
        )
    )


def per_key_profile(
    df: DataFrame,
    key: str,
    value: str,
    probabilities: Sequence[float] = (0.25, 0.5, 0.75),
    overload_share: float = 0.04,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Rows, values and exact quantiles of every key, with the keys named that hold an overload_share of all rows.

    Columns: key, n_rows, n_values, v_min, v_max, v_sum, overloaded, q0, q1, ... in the order of `probabilities`.
    The quantile of p is the least value whose rank is at least p times n_values (as SQL's quantile_disc). Null, NaN
    and infinite values count as rows only; a key without values has null quantiles. v_sum (double) adds the values rounded
    to six decimals, or to as many digits as the greatest value's size asks for if that is beyond 10^16 or below 10^-3,
    so it doesn't depend on the order; beyond the doubles it is infinite. Rows with a null key belong to no key, but to all rows, against
    which overload_share is taken. Tied and repeated values count each. An empty table gives no rows.
    """
    v = F.col(value).cast("double")
    top = 1.7976931348623157e308
    finite = F.when(v.between(-top, top), v)
    rows = df.select(F.col(key).alias("key"), finite.alias("v"))
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    unit = _unit(max(abs(low), abs(high)))
    first = F.when(F.col("v").isNotNull(), _bin(F.col("v"), F.lit(low), F.lit(high), FIRST_BINS, False))
    hist = cut(
        rows.groupBy("key", first.alias("bin")).agg(
            F.count("*").alias("n"),
            F.min("v").alias("least"),
            F.max("v").alias("most"),
            F.sum(_scaled(F.col("v"), -unit).cast("decimal(38,0)") if unit != -6 else F.col("v").cast("decimal(28,6)")).alias("total"),
        )
    )
    n_all = hist.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    enough = Decimal(str(overload_share)) * n_all
    has = F.col("bin").isNotNull()
    keys = (
        hist.where("key IS NOT NULL")
        .groupBy("key")
        .agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("n_values"),
            F.min("least").alias("v_min"),
            F.max("most").alias("v_max"),
            _scaled(F.sum("total").cast("double"), unit if unit != -6 else 0).alias("v_sum"),
        )
        .withColumn("overloaded", F.col("n_rows") >= F.lit(enough))
    )
    wanted = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("p"),
                    F.greatest(F.lit(1), F.ceil(F.lit(Decimal(str(p))) * F.col("n_values"))).cast("long").alias("rank"),
                )
                for i, p in enumerate(probabilities)
            ]
        )
    )
    ranks = (
        keys.where("n_values > 0").select("key", wanted.alias("w")).select("key", "w.p", F.lit(low).alias("lo"), "w.rank")
    )
    located = _locate(ranks, hist.where("key IS NOT NULL AND bin IS NOT NULL").withColumn("lo", F.lit(low)))
    hot = keys.where(F.col("n_rows") >= F.lit(max(1, n_all) * HOT_SHARE)).select("key")  # at most 1 / HOT_SHARE rows
    done: list[DataFrame] = []
    valued, log = rows.where("key IS NOT NULL AND v IS NOT NULL"), False
    while True:
        located = cut(located)
        done.append(located.where("lo = hi"))
        active = located.where("lo < hi")
        n_active = active.count()
        if not n_active:
            break
        located = _locate(active, _refine(valued, active, hot, n_active, log, broadcast_rows))
        log = not log
    resolved = done[0]
    for d in done[1:]:
        resolved = resolved.unionByName(d)
    wide = resolved.groupBy("key").agg(
        *[F.max(F.when(F.col("p") == i, F.col("lo"))).alias(f"q{i}") for i in range(len(probabilities))]
    )
    return keys.join(wide, "key", "left").withColumnRenamed("key", key)
