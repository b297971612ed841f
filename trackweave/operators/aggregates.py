"""Aggregates over the members of a group: means, types, kinematics, shapes, spreads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.geometry import Vec, cross, minus, nearest, norm2, vec

XYZ, VEL = ("x", "y", "z"), ("vx", "vy", "vz")
N_TYPES = 6


def _mean(value: Column, mass: Column) -> Column:
    return F.try_divide(F.sum(mass * value), F.sum(mass))


def mean_motion(rows: DataFrame, by: Sequence[str], order: str, box: str | None = "box_size") -> DataFrame:
    """(by, mass, x, y, z, vx, vy, vz): mass-weighted mean position and velocity (A1, A2).

    Positions are taken relative to the group's first row by `order` and then id, so a group across the box edge has
    its mean near itself; the result is not wrapped again. A group without mass has null means. One partial
    aggregate finds the origins, one sums; a hot group is reduced before either shuffle.
    """
    origin = rows.groupBy(*by).agg(F.min_by(F.struct(*XYZ), F.struct(order, "particle_id")).alias("o"))
    m = F.col("mass")
    r = rows.join(origin, list(by))
    near = {c: nearest(F.col(c) - F.col(f"o.{c}"), box) if box else F.col(c) - F.col(f"o.{c}") for c in XYZ}
    sums = r.groupBy(*by).agg(
        F.sum(m).alias("mass"),
        *[(_mean(near[c], m) + F.first(F.col(f"o.{c}"))).alias(c) for c in XYZ],
        *[_mean(F.col(c), m).alias(c) for c in VEL],
    )
    return sums


def type_counts(rows: DataFrame, by: Sequence[str], kind: str = "type") -> DataFrame:
    """(by, n_0 .. n_5, m_0 .. m_5, n, m): counts and masses per type and in all; other types only count in all (A3)."""
    per = [F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in range(N_TYPES)]
    mass = [F.coalesce(F.sum(F.when(F.col(kind) == k, F.col("mass"))), F.lit(0.0)).alias(f"m_{k}") for k in range(N_TYPES)]
    return rows.groupBy(*by).agg(*per, *mass, F.count("*").alias("n"), F.sum("mass").alias("m"))


def tracer_index(rows: DataFrame, by: Sequence[str], tracer: Column, rank: str = "rank") -> DataFrame:
    """(by, tracer_index): the least rank of a tracer, 0 if there is none (A4)."""
    return rows.groupBy(*by).agg(F.coalesce(F.min(F.when(tracer, F.col(rank))), F.lit(0)).alias("tracer_index"))


def core(rows: DataFrame, by: Sequence[str], order: str, box: str | None = "box_size") -> DataFrame:
    """(by, x, y, z, vx, vy, vz, sigma_r, sigma_v, n): mean and spread of the rows given, mass-weighted.

    The spread is the root of the variances' sum over the three axes. Groups without mass have nulls.
    """
    origin = rows.groupBy(*by).agg(F.min_by(F.struct(*XYZ), F.struct(order, "particle_id")).alias("o"))
    r = rows.join(origin, list(by))
    dx = {c: nearest(F.col(c) - F.col(f"o.{c}"), box) if box else F.col(c) - F.col(f"o.{c}") for c in XYZ}
    m = F.col("mass")
    first = {c: _mean(dx[c], m) for c in XYZ} | {c: _mean(F.col(c), m) for c in VEL}
    second = {c: _mean(dx[c] * dx[c], m) for c in XYZ} | {c: _mean(F.col(c) * F.col(c), m) for c in VEL}
    spread = {c: second[c] - first[c] * first[c] for c in (*XYZ, *VEL)}
    var = {c: F.when(v > 0, v).when(v.isNotNull(), 0.0) for c, v in spread.items()}
    return r.groupBy(*by).agg(
        *[(first[c] + F.first(F.col(f"o.{c}"))).alias(c) for c in XYZ],
        *[first[c].alias(c) for c in VEL],
        F.sqrt(var["x"] + var["y"] + var["z"]).alias("sigma_r"),
        F.sqrt(var["vx"] + var["vy"] + var["vz"]).alias("sigma_v"),
        F.count("*").alias("n"),
    )


def core_size(n_bound: Column, factor: float, least: int) -> Column:
    return F.greatest(F.floor(n_bound * factor), F.lit(least))


def kinematics(rows: DataFrame, by: Sequence[str], centre: Vec, velocity: Vec, energy: str, thermal: bool = False) -> DataFrame:
    """(by, potential, kinetic, lx, ly, lz): specific energies and angular momentum about a centre.

    rows carry energy, scale_factor, hz and box_size; lengths are made physical and the Hubble flow is added. The
    potential is the mean energy (without the thermal one) less the kinetic one. Groups of at most one row get 0.
    """
    a, m = F.col("scale_factor"), F.col("mass")
    dx = tuple(d * a for d in minus(vec(""), centre, "box_size"))
    dv = tuple(v - w + F.col("hz") * d for v, w, d in zip(vec("", VEL), velocity, dx))
    e = F.col(energy) - F.col("u") if thermal else F.col(energy)
    kinetic = F.try_divide(F.sum(norm2(dv) * m) * 0.5, F.sum(m))  # type: ignore[arg-type]
    some = F.count("*") > 1
    ls = cross(dx, dv)  # type: ignore[arg-type]
    zero = F.lit(0.0)
    return rows.groupBy(*by).agg(
        F.when(some, _mean(e, m) - kinetic).otherwise(zero).alias("potential"),
        F.when(some, kinetic).otherwise(zero).alias("kinetic"),
        *[F.when(some, _mean(x, m)).otherwise(zero).alias(f"l{c}") for c, x in zip("xyz", ls)],
    )


def inertia(rows: DataFrame, by: Sequence[str], centre: Vec, most_bound: Column) -> DataFrame:
    """(by, ixx, ixy, ixz, iyy, iyz, izz and the same weighted, w_...): inertia tensors about a centre (A10).

    The most bound row, which is the centre itself, is skipped; both are divided by the mass of all rows. The weighted
    one divides each product by r squared and multiplies by the mass. Rows at the centre itself add nothing to it.
    """
    d = dict(zip("xyz", minus(vec(""), centre, "box_size")))
    r2 = norm2(tuple(d.values()))  # type: ignore[arg-type]
    m = F.col("mass")
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    out = []
    for weighted in (False, True):
        for p, q in pairs:
            one = d[p] * d[q] * m / F.nullif(r2, F.lit(0.0)) if weighted else d[p] * d[q] * m
            total = F.try_divide(F.coalesce(F.sum(F.when(~most_bound, one)), F.lit(0.0)), F.sum(m))
            out.append(total.alias(f"{'w_' if weighted else ''}i{p}{q}"))
    return rows.groupBy(*by).agg(*out)


def upscale(rows: DataFrame, by: Sequence[str], sampled: Column, kind: str = "type") -> DataFrame:
    """(by, type, factor): what the sampled members' masses are to be multiplied by to hold all mass.

    Per type the ratio of all to sampled mass; then all factors of a group are raised so that types without any
    sampled member are made up for. Groups without sampled mass get no factor.
    """
    m = rows.withColumn("_s", F.when(sampled, F.col("mass")).otherwise(0.0))
    per = m.groupBy(*by, kind).agg(F.sum("mass").alias("_all"), F.sum("_s").alias("_part"))
    whole = per.groupBy(*by).agg(F.sum("_all").alias("_true"), F.sum(F.when(F.col("_part") > 0, F.col("_all"))).alias("_scaled"))
    return (
        per.where("_part > 0")
        .join(whole, list(by))
        .select(*by, kind, (F.col("_all") / F.col("_part") * F.col("_true") / F.col("_scaled")).alias("factor"))
    )


def running_sum(rows: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, chunk: str) -> DataFrame:
    """rows with `upto`, the sum of value over the group's rows up to and with this one in the given order.

    `chunk` is a column that splits every group into consecutive pieces of bounded size in the same order: sums are
    first taken within chunks, then the chunks' totals are summed up, so no window holds a whole hot group.
    """
    inner = Window.partitionBy(*by, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("upto", F.sum(value).over(inner))
    totals = rows.groupBy(*by, chunk).agg(F.sum(value).alias("_t"))
    outer = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_t").over(outer), F.lit(0))).drop("_t")
    return within.join(starts, [*by, chunk]).withColumn("upto", F.col("upto") + F.col("_start")).drop("_start")
