"""Queries of aggregates, profiles, ranks and catalogue statistics (A1-A24, W1-W15, IO19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.config import Config
from trackweave.functions import geometry as g
from trackweave.functions import physics as ph
from trackweave.operators import aggregates as ag
from trackweave.operators import catalogue as cat
from trackweave.operators import profiles as pr
from trackweave.operators import ranking as rk
from trackweave.operators import votes
from trackweave.operators.properties import centred
from trackweave.sources.relations import EPOCH, groups, members, particles, snapshots, sql, tracks

CONFIG = Config()
KEYS = ["snapshot_id", "track_id"]
MOTION = ["x", "y", "z", "vx", "vy", "vz", "mass", "u", "type"]
TRACER = lambda: ph.is_tracer("type", CONFIG.tracer_mask)


def bound_members(s: SparkSession, d: str, columns: list[str] = MOTION) -> DataFrame:
    """Bound members with their particle's columns and the scalars of the snapshot."""
    p = particles(s, d, columns).select("snapshot_id", "particle_id", *columns, *EPOCH)
    return members(s, d).where("bound").join(p, ["snapshot_id", "particle_id"])


def _centred(s: SparkSession, d: str) -> DataFrame:
    return centred(bound_members(s, d), KEYS)


def _rounded(df: DataFrame, keys: list[str], digits: dict[str, int]) -> DataFrame:
    return df.select(*keys, *[F.round(c, n).alias(c) if n else F.col(c) for c, n in digits.items()])


def a1_mean_motion(s: SparkSession, d: str) -> DataFrame:
    """Mass-weighted mean position and velocity of every track's bound members."""
    out = ag.mean_motion(bound_members(s, d), KEYS, "rank")
    return _rounded(out, KEYS, {"mass": 8, "x": 5, "y": 5, "z": 5, "vx": 4, "vy": 4, "vz": 4})


def a23_group_motion(s: SparkSession, d: str) -> DataFrame:
    """Mass-weighted mean position and velocity of the particles of every group, across the box edge too (also IO13)."""
    p = particles(s, d, ["x", "y", "z", "vx", "vy", "vz", "mass", "host_id"]).where("host_id >= 0")
    out = ag.mean_motion(p, ["snapshot_id", "host_id"], "particle_id")
    return _rounded(out, ["snapshot_id", "host_id"], {"mass": 8, "x": 5, "y": 5, "z": 5, "vx": 4, "vy": 4, "vz": 4})


def a3_types(s: SparkSession, d: str) -> DataFrame:
    """Members and masses of every track per particle type."""
    out = ag.type_counts(bound_members(s, d, ["mass", "type"]), KEYS)
    return _rounded(out, KEYS, {**{f"n_{k}": 0 for k in range(6)}, **{f"m_{k}": 8 for k in range(6)}, "n": 0, "m": 8})


def a4_tracer_index(s: SparkSession, d: str) -> DataFrame:
    """The rank of every track's most bound tracer."""
    return ag.tracer_index(bound_members(s, d, ["type"]), KEYS, TRACER())


def a5_tracers(s: SparkSession, d: str) -> DataFrame:
    """The ten most bound tracers of every track, filled up with others."""
    return votes.first_tracers(bound_members(s, d, ["type"]), KEYS, 10, TRACER()).select(*KEYS, "order", "particle_id")


def a6_core(s: SparkSession, d: str) -> DataFrame:
    """Mean and spread in phase space of the core of every track."""
    m = votes.first_tracers(bound_members(s, d), KEYS, CONFIG.SubCoreSizeMin, TRACER())
    out = ag.core(m, KEYS, "order")
    return _rounded(out, KEYS, {"x": 5, "vx": 4, "sigma_r": 4, "sigma_v": 3, "n": 0})


def a7_kinematics(s: SparkSession, d: str) -> DataFrame:
    """Specific energies and angular momentum about the most bound member of every track."""
    out = ag.kinematics(_centred(s, d), KEYS, g.vec("c"), g.vec("cv"), "binding_energy")
    return _rounded(out, KEYS, {"potential": 2, "kinetic": 2, "lx": 2, "ly": 2, "lz": 2})


def a8_profiles(s: SparkSession, d: str) -> DataFrame:
    """Peak circular velocity, half and outer radius and overdensity mass of every track."""
    soft = ph.softening("softening", "max_physical_softening", "scale_factor")
    rows = _centred(s, d).select(
        *KEYS, "particle_id", "mass", g.distance(g.vec(""), g.vec("c"), "box_size").alias("r"), soft.alias("soft"), ph.virial_density(200.0, "hz", "scale_factor").alias("density"), "scale_factor"
    )
    out = pr.summary(pr.cumulative(rows, KEYS, "r"), KEYS, "r", "soft", "density")
    return _rounded(out, KEYS, {"n": 0, "r_max": 6, "v2_max": 6, "r_half": 6, "r_enclose": 6, "m_over": 6, "r_over": 6})


def a10_inertia(s: SparkSession, d: str) -> DataFrame:
    """Inertia tensors about the most bound member of every track."""
    out = ag.inertia(_centred(s, d), KEYS, g.vec("c"), F.col("particle_id") == F.col("first_id"))
    axes = ("xx", "xy", "xz", "yy", "yz", "zz")
    return _rounded(out, KEYS, {**{f"i{a}": 4 for a in axes}, **{f"w_i{a}": 6 for a in axes}})


def a12_host_counts(s: SparkSession, d: str) -> DataFrame:
    """Tracks without a group and groups without a track, per snapshot."""
    h = groups(s, d).select("snapshot_id", F.col("halo_id").alias("host_halo_id"))
    t = tracks(s, d, ["host_halo_id"])
    hostless = t.groupBy("snapshot_id").agg(F.count_if(F.coalesce("host_halo_id", F.lit(-1)) < 0).alias("n_hostless"))
    empty = h.join(t, ["snapshot_id", "host_halo_id"], "left_anti").groupBy("snapshot_id").agg(F.count("*").alias("n_empty"))
    return hostless.join(empty, "snapshot_id", "full_outer").na.fill(0)


def a13_track_counts(s: SparkSession, d: str) -> DataFrame:
    """Tracks born, dead and sunk in every snapshot."""
    t = tracks(s, d, ["snapshot_of_birth", "snapshot_of_death", "snapshot_of_sink"])
    here = lambda c: F.count_if(F.col(c) == F.col("snapshot_id"))
    return t.groupBy("snapshot_id").agg(
        here("snapshot_of_birth").alias("n_born"), here("snapshot_of_death").alias("n_died"), here("snapshot_of_sink").alias("n_sunk")
    )


def a14_imbalance(s: SparkSession, d: str) -> DataFrame:
    """How much larger than the mean the largest track of every snapshot is, by members."""
    n = members(s, d, ["rank"]).groupBy(*KEYS).agg(F.count("*").alias("n"))
    return n.groupBy("snapshot_id").agg(F.round(F.max("n") / F.avg("n"), 6).alias("imbalance"))


def a15_mass_function(s: SparkSession, d: str) -> DataFrame:
    """Resolved tracks per logarithmic mass bin, centrals and satellites apart."""
    t = tracks(s, d, ["m_bound", "n_bound", "rank"]).where("n_bound > 1")
    edges = [10 ** (-2 + 0.5 * i) for i in range(11)]
    return cat.mass_function(t.withColumn("central", F.col("rank") == 0), "m_bound", edges, ["snapshot_id", "central"])


def a16_cumulative(s: SparkSession, d: str) -> DataFrame:
    """N(>= m) over all tracks of the last snapshot, by a distributed global rank; of all snapshots: a16_all_cumulative."""
    top = snapshots(s, d).agg(F.max("snapshot_index")).first()[0]
    t = tracks(s, d, ["m_bound"]).where(F.col("snapshot_index") == top).where("m_bound > 0 AND NOT isnan(m_bound)")
    ordered = t.select("track_id", "m_bound", F.struct((-F.col("m_bound")).alias("m"), "track_id").alias("o"))
    return rk.global_positions(ordered, "o").select("track_id", "m_bound", (F.col("position") + 1).alias("n_above"))


def a16_all_cumulative(s: SparkSession, d: str) -> DataFrame:
    """N(>= m) over the tracks of every snapshot."""
    t = tracks(s, d, ["m_bound"]).where("m_bound > 0 AND NOT isnan(m_bound)").select(*KEYS, "m_bound")
    placed = rk.positions_within(t, ["snapshot_id"], [-F.col("m_bound"), F.col("track_id")])
    return placed.select(*KEYS, "m_bound", (F.col("position") + 1).alias("n_above"))


def a17_merger_rate(s: SparkSession, d: str) -> DataFrame:
    """Deaths per snapshot, sunk and disrupted."""
    t = tracks(s, d, ["snapshot_of_death", "snapshot_of_sink"])
    last = t.groupBy("track_id").agg(*[F.max_by(c, "snapshot_index").alias(c) for c in ("snapshot_of_death", "snapshot_of_sink")])
    dead = last.where("snapshot_of_death >= 0")
    sunk = F.coalesce("snapshot_of_sink", F.lit(-1)) == F.col("snapshot_of_death")
    return dead.groupBy("snapshot_of_death").agg(F.count_if(sunk).alias("n_sunk"), F.count_if(~sunk).alias("n_disrupted"))


def a18_upscale(s: SparkSession, d: str) -> DataFrame:
    """Factors that keep each type's mass when only the ten best members of a track are taken."""
    m = bound_members(s, d, ["mass", "type"])
    best = votes.first_tracers(m, KEYS, 10, F.lit(True)).select(*KEYS, "particle_id", F.lit(True).alias("picked"))
    rows = m.join(best, [*KEYS, "particle_id"], "left")
    return ag.upscale(rows, KEYS, F.coalesce("picked", F.lit(False))).select(*KEYS, "type", F.round("factor", 6).alias("factor"))


def a22_sources(s: SparkSession, d: str) -> DataFrame:
    """Members of every track."""
    return members(s, d, ["rank"]).groupBy(*KEYS).agg(F.count("*").alias("n_source"))


def a24_satellites(s: SparkSession, d: str) -> DataFrame:
    """Cumulative peak-mass function of the satellites of every group, by depth."""
    t = tracks(s, d, ["host_halo_id", "depth", "last_max_mass", "rank"]).where("rank > 0 AND host_halo_id >= 0")
    by = ["snapshot_id", "host_halo_id", "depth"]
    return rk.member_ranks(t, by, [F.col("last_max_mass").desc(), F.col("track_id")]).select(*by, "track_id", "last_max_mass", (F.col("member_rank") + 1).alias("n_above"))


def w1_member_ranks(s: SparkSession, d: str) -> DataFrame:
    """Rank of every track in its group by mass, peak velocity, tracer id and track id."""
    t = tracks(s, d, ["host_halo_id", "m_bound", "vmax_physical", "most_bound_particle_id"])
    t = t.withColumn("host_id", F.coalesce("host_halo_id", F.lit(-1)))
    m = F.when(~F.isnan("m_bound"), F.col("m_bound"))
    order = [F.coalesce(m, F.lit(-1.0)).desc(), F.col("vmax_physical").desc_nulls_last(), F.col("most_bound_particle_id").desc_nulls_last(), F.col("track_id").desc()]
    return rk.member_ranks(t, ["snapshot_id", "host_id"], order, F.col("host_id") < 0).select(*KEYS, "host_id", "member_rank")


def w3_satellites(s: SparkSession, d: str) -> DataFrame:
    """The same order with the catalogued central pinned to the front."""
    t = tracks(s, d, ["host_halo_id", "m_bound", "rank"]).where("host_halo_id >= 0")
    m = F.coalesce(F.when(~F.isnan("m_bound"), F.col("m_bound")), F.lit(-1.0))
    order = [(F.coalesce("rank", F.lit(-1)) == 0).desc(), m.desc(), F.col("track_id").desc()]
    return rk.member_ranks(t, ["snapshot_id", "host_halo_id"], order).select(*KEYS, "host_halo_id", "member_rank")


def w5_energy_order(s: SparkSession, d: str) -> DataFrame:
    """Members of every track by energy, bound ones first: the first hundred places, as its SQL has it; all of them are
    in w5_all_places."""
    m = members(s, d)
    w = Window.partitionBy(*KEYS).orderBy(ph.is_bound("binding_energy").desc(), F.col("binding_energy").asc_nulls_last(), F.col("particle_id"))
    return m.withColumn("place", F.row_number().over(w)).where("place <= 100").select(*KEYS, "particle_id", "place")


def w5_all_places(s: SparkSession, d: str) -> DataFrame:
    """Every member of every track with its place by energy, bound ones first."""
    return rk.energy_places(members(s, d, ["binding_energy"]), KEYS).select(*KEYS, "particle_id", "place")


def w9_truncated(s: SparkSession, d: str) -> DataFrame:
    """Members that stay in every track's source."""
    t = tracks(s, d, ["n_bound"])
    return rk.truncated(members(s, d, ["rank"]), t, KEYS, CONFIG.SourceSubRelaxFactor).groupBy(*KEYS).agg(F.count("*").alias("n_kept"))


def w10_peaks(s: SparkSession, d: str) -> DataFrame:
    """Running peak masses and velocities and when they were reached last."""
    t = tracks(s, d, ["m_bound", "vmax_physical", "rmax_comoving"])
    p = rk.running_peak(t, "track_id", "snapshot_index", "m_bound", ["snapshot_id"]).withColumnRenamed("peak_snapshot_id", "mass_at")
    p = rk.running_peak(p, "track_id", "snapshot_index", "vmax_physical", ["snapshot_id", "rmax_comoving"])
    return p.select(*KEYS, "peak_m_bound", "mass_at", "peak_vmax_physical", F.col("peak_snapshot_id").alias("vmax_at"), "peak_rmax_comoving")


def w10_isolation(s: SparkSession, d: str) -> DataFrame:
    """The snapshot before every track last turned into a satellite."""
    t = tracks(s, d, ["rank"])
    return rk.last_isolation(t, "track_id", "snapshot_index", F.coalesce("rank", F.lit(0)) > 0, snapshots(s, d)).select(*KEYS, "last_isolation")


def w12_offsets(s: SparkSession, d: str) -> DataFrame:
    """Where every track's particles start in the sorted catalogue of the last snapshot (also W4); of all snapshots:
    w12_all_offsets, and the particles themselves: w12_member_offsets."""
    top = snapshots(s, d).agg(F.max("snapshot_index")).first()[0]
    t = tracks(s, d, ["n_bound"]).where(F.col("snapshot_index") == top).select("track_id", F.coalesce("n_bound", F.lit(0)).alias("n_bound"))
    return rk.global_positions(t, "track_id", "n_bound").select("track_id", "n_bound", "position", "offset")


def w12_all_offsets(s: SparkSession, d: str) -> DataFrame:
    """Where every track's particles start in the sorted catalogue of its snapshot."""
    t = tracks(s, d, ["n_bound"]).select(*KEYS, F.coalesce("n_bound", F.lit(0)).alias("n_bound"))
    return rk.positions_within(t, ["snapshot_id"], [F.col("track_id")], "n_bound").select(*KEYS, "n_bound", "position", "offset")


def w12_member_offsets(s: SparkSession, d: str) -> DataFrame:
    """Every bound member with its offset in its snapshot's particles, sorted by track and rank of binding (IO19)."""
    m = members(s, d, ["bound", "rank"]).where("bound")
    return rk.positions_within(m, ["snapshot_id"], [F.col("track_id"), F.col("rank").isNull(), F.col("rank"), F.col("particle_id")]).select(*KEYS, "particle_id", F.col("position").alias("offset"))


def w13_new_ids(s: SparkSession, d: str) -> DataFrame:
    """Dense ids for new tracks of the groups without any, in order of snapshot and group, after the existing ones."""
    t = tracks(s, d, ["host_halo_id"])
    h = groups(s, d).select("snapshot_id", F.col("halo_id").alias("host_halo_id")).join(t, ["snapshot_id", "host_halo_id"], "left_anti")
    start = t.agg(F.max("track_id")).first()[0]
    placed = rk.global_positions(h.select("*", F.struct("snapshot_id", "host_halo_id").alias("o")), "o")
    return placed.select("snapshot_id", "host_halo_id", (F.col("position") + 1 + (-1 if start is None else start)).alias("track_id"))


def w14_most_massive(s: SparkSession, d: str) -> DataFrame:
    """The most massive track of every snapshot."""
    t = tracks(s, d, ["m_bound"]).where("m_bound IS NOT NULL AND NOT isnan(m_bound)")
    best = F.max(F.struct("m_bound", (-F.col("track_id")).alias("t")))
    return t.groupBy("snapshot_id").agg(best.alias("b")).select("snapshot_id", (-F.col("b.t")).alias("track_id"), F.col("b.m_bound").alias("m_bound"))


def w15_nested_order(s: SparkSession, d: str) -> DataFrame:
    """Every nested track with its ordinal in its parent's list."""
    return tracks(s, d, ["nested_subhalos"]).select(*KEYS, F.posexplode("nested_subhalos").alias("ordinal", "nested_track_id"))


QUERIES = {
    f.__name__: f
    for f in (
        a1_mean_motion, a23_group_motion, a3_types, a4_tracer_index, a5_tracers, a6_core, a7_kinematics, a8_profiles, a10_inertia, a12_host_counts,
        a13_track_counts, a14_imbalance, a15_mass_function, a16_cumulative, a16_all_cumulative, a17_merger_rate, a18_upscale, a22_sources, a24_satellites,
        w1_member_ranks, w3_satellites, w5_energy_order, w5_all_places, w9_truncated, w10_peaks, w10_isolation, w12_offsets, w12_all_offsets, w12_member_offsets, w13_new_ids,
        w14_most_massive, w15_nested_order,
    )
}

_B = f"""{sql("mems", "parts")},
  b AS (SELECT m.track_id, m.rank, m.binding_energy, p.* FROM mems m
    JOIN parts p ON p.snapshot_id = m.snapshot_id AND p.particle_id = m.particle_id WHERE m.bound)"""


def _near(e: str) -> str:
    return f"CASE WHEN {e} > box_size / 2 THEN {e} - box_size WHEN {e} < -box_size / 2 THEN {e} + box_size ELSE {e} END"


_FIRST = "first_value({0}) OVER (PARTITION BY snapshot_id, track_id ORDER BY rank, particle_id) AS c{0}"
_C = f"""{_B},
  f AS (SELECT *, first_value(particle_id) OVER (PARTITION BY snapshot_id, track_id ORDER BY rank, particle_id) AS first_id,
    {", ".join(_FIRST.format(c) for c in MOTION[:6])} FROM b),
  c AS (SELECT *, {", ".join(f"{_near(f'({a} - c{a})')} AS d{a}" for a in "xyz")} FROM f)"""
_MEAN = "CASE WHEN sum(mass) <> 0 THEN round({0} / sum(mass), {1}) END AS {2}"
_SIG = "greatest(0, sum(mass * {0} * {0}) / sum(mass) - pow(sum(mass * {0}) / sum(mass), 2))"
_PAIRS = ["xx", "xy", "xz", "yy", "yz", "zz"]
_TOP = "snapshot_index = (SELECT max(snapshot_index) FROM snapshots)"

ORACLES = {
    "a1_mean_motion": f"""{_C} SELECT snapshot_id, track_id, round(sum(mass), 8) AS mass,
      {", ".join(f"CASE WHEN sum(mass) <> 0 THEN round(sum(mass * d{a}) / sum(mass) + any_value(c{a}), 5) END AS {a}" for a in "xyz")},
      {", ".join(_MEAN.format(f"sum(mass * v{a})", 4, f"v{a}") for a in "xyz")} FROM c GROUP BY ALL""",
    "a23_group_motion": f"""{sql("parts")}, f AS (SELECT *, {", ".join(f"first_value({a}) OVER (PARTITION BY snapshot_id, host_id ORDER BY particle_id) AS c{a}" for a in "xyz")}
        FROM parts WHERE host_id >= 0),
      c AS (SELECT *, {", ".join(f"{_near(f'({a} - c{a})')} AS d{a}" for a in "xyz")} FROM f)
      SELECT snapshot_id, host_id, round(sum(mass), 8) AS mass,
      {", ".join(f"CASE WHEN sum(mass) <> 0 THEN round(sum(mass * d{a}) / sum(mass) + any_value(c{a}), 5) END AS {a}" for a in "xyz")},
      {", ".join(_MEAN.format(f"sum(mass * v{a})", 4, f"v{a}") for a in "xyz")} FROM c GROUP BY ALL""",
    "a3_types": f"""{_B} SELECT snapshot_id, track_id, {", ".join(f"count(*) FILTER (WHERE type = {k}) AS n_{k}" for k in range(6))},
      {", ".join(f"round(coalesce(sum(mass) FILTER (WHERE type = {k}), 0), 8) AS m_{k}" for k in range(6))}, count(*) AS n, round(sum(mass), 8) AS m
      FROM b GROUP BY ALL""",
    "a4_tracer_index": f"{_B} SELECT snapshot_id, track_id, coalesce(min(rank) FILTER (WHERE type IN (1, 4)), 0) AS tracer_index FROM b GROUP BY ALL",
    "a5_tracers": f"""{_B} SELECT snapshot_id, track_id, (k - 1)::INTEGER AS "order", particle_id FROM (SELECT *, row_number() OVER (
      PARTITION BY snapshot_id, track_id ORDER BY coalesce(type IN (1, 4), false) DESC, rank, particle_id) AS k FROM b) WHERE k <= 10""",
    "a6_core": f"""{_B}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, track_id
        ORDER BY coalesce(type IN (1, 4), false) DESC, rank, particle_id) AS k FROM b) WHERE k <= 20),
      f AS (SELECT *, {", ".join(f"first_value({a}) OVER (PARTITION BY snapshot_id, track_id ORDER BY k) AS c{a}" for a in "xyz")} FROM k),
      c AS (SELECT *, {", ".join(f"{_near(f'({a} - c{a})')} AS d{a}" for a in "xyz")} FROM f)
      SELECT snapshot_id, track_id, CASE WHEN sum(mass) <> 0 THEN round(sum(mass * dx) / sum(mass) + any_value(cx), 5) END AS x,
        {_MEAN.format("sum(mass * vx)", 4, "vx")}, CASE WHEN sum(mass) <> 0 THEN round(sqrt({" + ".join(_SIG.format(f"d{a}") for a in "xyz")}), 4) END AS sigma_r,
        CASE WHEN sum(mass) <> 0 THEN round(sqrt({" + ".join(_SIG.format(f"v{a}") for a in "xyz")}), 3) END AS sigma_v, count(*) AS n FROM c GROUP BY ALL""",
    "a7_kinematics": f"""{_C}, q AS (SELECT *, {", ".join(f"d{a} * scale_factor AS e{a}, v{a} - cv{a} + hz * d{a} * scale_factor AS w{a}" for a in "xyz")} FROM c),
      k AS (SELECT snapshot_id, track_id, count(*) AS n, sum(mass) AS m, sum(mass * (wx * wx + wy * wy + wz * wz)) / 2 AS kk, sum(mass * binding_energy) AS ee,
        sum(mass * (ey * wz - ez * wy)) AS sx, sum(mass * (ez * wx - ex * wz)) AS sy, sum(mass * (ex * wy - ey * wx)) AS sz FROM q GROUP BY ALL)
      SELECT snapshot_id, track_id, CASE WHEN n > 1 THEN round(ee / nullif(m, 0) - kk / nullif(m, 0), 2) ELSE 0 END AS potential,
        CASE WHEN n > 1 THEN round(kk / nullif(m, 0), 2) ELSE 0 END AS kinetic,
        {", ".join(f"CASE WHEN n > 1 THEN round(s{a} / nullif(m, 0), 2) ELSE 0 END AS l{a}" for a in "xyz")} FROM k""",
    "a8_profiles": f"""{_C}, r AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r,
        CASE WHEN max_physical_softening < 0 THEN softening ELSE least(softening, max_physical_softening / scale_factor) END AS soft,
        200.0::DOUBLE * hz * hz / 2.0 / 43.0071::DOUBLE * scale_factor * scale_factor * scale_factor AS rho FROM c),
      s AS (SELECT *, greatest(r, soft) AS rr, row_number() OVER w AS k, sum(mass) OVER w AS mi, count(*) OVER (PARTITION BY snapshot_id, track_id) AS n
        FROM r WINDOW w AS (PARTITION BY snapshot_id, track_id ORDER BY r, particle_id)),
      o AS (SELECT snapshot_id, track_id, max(n) AS n, max(mi / rr) AS v2, max(rr) FILTER (WHERE k = n // 2 + 1) AS rh, max(rr) AS re,
        arg_max(mi, k) FILTER (WHERE mi > rho * rr ** 3) AS mo, any_value(rho) AS rho, min_by(rr, (-(mi / rr), rr)) AS rm FROM s GROUP BY ALL)
      SELECT snapshot_id, track_id, n, CASE WHEN n > 1 THEN round(rm, 6) ELSE 0 END AS r_max, CASE WHEN n > 1 THEN round(v2, 6) ELSE 0 END AS v2_max,
        CASE WHEN n > 1 THEN round(rh, 6) ELSE 0 END AS r_half, CASE WHEN n > 1 THEN round(re, 6) ELSE 0 END AS r_enclose,
        CASE WHEN n > 1 THEN round(mo, 6) ELSE 0 END AS m_over, CASE WHEN n > 1 THEN round(pow(mo / rho, 1.0::DOUBLE / 3), 6) ELSE 0 END AS r_over FROM o""",
    "a10_inertia": f"""{_C}, q AS (SELECT *, particle_id <> first_id AS use, nullif(dx * dx + dy * dy + dz * dz, 0) AS r2 FROM c)
      SELECT snapshot_id, track_id, {", ".join(f"round(coalesce(sum(mass * d{p[0]} * d{p[1]}) FILTER (WHERE use), 0) / nullif(sum(mass), 0), 4) AS i{p}" for p in _PAIRS)},
        {", ".join(f"round(coalesce(sum(mass * d{p[0]} * d{p[1]} / r2) FILTER (WHERE use), 0) / nullif(sum(mass), 0), 6) AS w_i{p}" for p in _PAIRS)} FROM q GROUP BY ALL""",
    "a12_host_counts": f"""{sql("subs", "fofs")} SELECT s.snapshot_id::BIGINT AS snapshot_id,
      (SELECT count(*) FROM subs t WHERE t.snapshot_id = s.snapshot_id AND coalesce(t.host_halo_id, -1) < 0) AS n_hostless,
      (SELECT count(*) FROM fofs f WHERE f.snapshot_id = s.snapshot_id AND NOT EXISTS (SELECT 1 FROM subs t WHERE t.snapshot_id = f.snapshot_id
        AND t.host_halo_id = f.halo_id)) AS n_empty FROM snapshots s""",
    "a13_track_counts": f"""{sql("subs")} SELECT snapshot_id, count(*) FILTER (WHERE snapshot_of_birth = snapshot_id) AS n_born,
      count(*) FILTER (WHERE snapshot_of_death = snapshot_id) AS n_died, count(*) FILTER (WHERE snapshot_of_sink = snapshot_id) AS n_sunk FROM subs GROUP BY snapshot_id""",
    "a14_imbalance": f"""{sql("mems")}, n AS (SELECT snapshot_id, track_id, count(*) AS n FROM mems GROUP BY ALL)
      SELECT snapshot_id, round(max(n) / avg(n), 6) AS imbalance FROM n GROUP BY snapshot_id""",
    "a15_mass_function": f"""{sql("subs")}, e AS (SELECT i, pow(10::DOUBLE, -2 + 0.5 * i) AS lo, pow(10::DOUBLE, -2 + 0.5 * (i + 1)) AS hi FROM range(10) t(i)),
      n AS (SELECT snapshot_id, rank = 0 AS central, m_bound FROM subs WHERE n_bound > 1 AND NOT isnan(m_bound))
      SELECT snapshot_id, central, i::INTEGER AS bin, round(sqrt(lo * hi), 9) AS centre, count(*) AS n FROM n JOIN e ON m_bound >= lo AND (m_bound < hi OR i = 9 AND m_bound = hi)
      GROUP BY ALL""",
    "a16_cumulative": f"""{sql("subs")} SELECT track_id, m_bound, row_number() OVER (ORDER BY m_bound DESC, track_id) AS n_above FROM subs
      WHERE {_TOP} AND m_bound > 0 AND NOT isnan(m_bound)""",
    "a16_all_cumulative": f"""{sql("subs")} SELECT snapshot_id, track_id, m_bound, row_number() OVER (PARTITION BY snapshot_id ORDER BY m_bound DESC, track_id) AS n_above
      FROM subs WHERE m_bound > 0 AND NOT isnan(m_bound)""",
    "a17_merger_rate": f"""{sql("subs")}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY snapshot_index DESC) AS k FROM subs) WHERE k = 1)
      SELECT snapshot_of_death, count(*) FILTER (WHERE coalesce(snapshot_of_sink, -1) = snapshot_of_death) AS n_sunk,
        count(*) FILTER (WHERE coalesce(snapshot_of_sink, -1) <> snapshot_of_death) AS n_disrupted FROM l WHERE snapshot_of_death >= 0 GROUP BY ALL""",
    "a18_upscale": f"""{_B}, k AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, track_id ORDER BY rank, particle_id) <= 10 AS picked FROM b),
      t AS (SELECT snapshot_id, track_id, type, sum(mass) AS a, coalesce(sum(mass) FILTER (WHERE picked), 0) AS p FROM k GROUP BY ALL),
      w AS (SELECT *, sum(a) OVER o AS tt, sum(CASE WHEN p > 0 THEN a END) OVER o AS ts FROM t WINDOW o AS (PARTITION BY snapshot_id, track_id))
      SELECT snapshot_id, track_id, type, round(a / p * tt / ts, 6) AS factor FROM w WHERE p > 0""",
    "a22_sources": f"{sql('mems')} SELECT snapshot_id, track_id, count(*) AS n_source FROM mems GROUP BY ALL",
    "a24_satellites": f"""{sql("subs")} SELECT snapshot_id, host_halo_id, depth, track_id, last_max_mass, row_number() OVER (
      PARTITION BY snapshot_id, host_halo_id, depth ORDER BY last_max_mass DESC, track_id)::INTEGER AS n_above FROM subs WHERE rank > 0 AND host_halo_id >= 0""",
    "w1_member_ranks": f"""{sql("subs")} SELECT snapshot_id, track_id, coalesce(host_halo_id, -1) AS host_id, (CASE WHEN coalesce(host_halo_id, -1) < 0 THEN 0 ELSE
      row_number() OVER (PARTITION BY snapshot_id, coalesce(host_halo_id, -1) ORDER BY coalesce(CASE WHEN NOT isnan(m_bound) THEN m_bound END, -1) DESC,
        vmax_physical DESC NULLS LAST, most_bound_particle_id DESC NULLS LAST, track_id DESC) - 1 END)::INTEGER AS member_rank FROM subs""",
    "w3_satellites": f"""{sql("subs")} SELECT snapshot_id, track_id, host_halo_id, (row_number() OVER (PARTITION BY snapshot_id, host_halo_id
      ORDER BY coalesce(rank, -1) = 0 DESC, coalesce(CASE WHEN NOT isnan(m_bound) THEN m_bound END, -1) DESC, track_id DESC) - 1)::INTEGER AS member_rank
      FROM subs WHERE host_halo_id >= 0""",
    "w5_energy_order": f"""{sql("mems")} SELECT snapshot_id, track_id, particle_id, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, track_id
      ORDER BY coalesce(binding_energy < 0, false) DESC, binding_energy ASC NULLS LAST, particle_id) AS place FROM mems) WHERE place <= 100""",
    "w5_all_places": f"""{sql("mems")} SELECT snapshot_id, track_id, particle_id, (row_number() OVER (PARTITION BY snapshot_id, track_id
      ORDER BY coalesce(binding_energy < 0, false) DESC, binding_energy ASC NULLS LAST, particle_id))::INTEGER AS place FROM mems""",
    "w9_truncated": f"""{sql("mems", "subs")} SELECT m.snapshot_id, m.track_id, count(*) AS n_kept FROM mems m JOIN subs t
      ON t.snapshot_id = m.snapshot_id AND t.track_id = m.track_id WHERE m.rank < CASE WHEN t.n_bound <= 1 THEN t.n_bound ELSE floor(t.n_bound * 3.0) END GROUP BY ALL""",
    "w10_peaks": f"""{sql("subs")}, g AS (SELECT *, CASE WHEN NOT isnan(m_bound) THEN m_bound END AS mm FROM subs)
      SELECT a.snapshot_id, a.track_id, b.mm AS peak_m_bound, b.snapshot_id AS mass_at, v.vmax_physical AS peak_vmax_physical, v.snapshot_id AS vmax_at,
        v.rmax_comoving AS peak_rmax_comoving FROM g a
      LEFT JOIN LATERAL (SELECT mm, snapshot_id FROM g x WHERE x.track_id = a.track_id AND x.snapshot_index <= a.snapshot_index AND mm IS NOT NULL
        ORDER BY mm DESC, snapshot_index DESC LIMIT 1) b ON true
      LEFT JOIN LATERAL (SELECT vmax_physical, rmax_comoving, snapshot_id FROM g x WHERE x.track_id = a.track_id AND x.snapshot_index <= a.snapshot_index
        AND vmax_physical IS NOT NULL ORDER BY vmax_physical DESC, snapshot_index DESC LIMIT 1) v ON true""",
    "w10_isolation": f"""{sql("subs")}, t AS (SELECT *, coalesce(rank, 0) > 0 AS sat, coalesce(lag(coalesce(rank, 0) > 0) OVER (PARTITION BY track_id ORDER BY snapshot_index), false) AS was FROM subs),
      u AS (SELECT *, max(CASE WHEN sat AND NOT was THEN snapshot_index - 1 END) OVER (PARTITION BY track_id ORDER BY snapshot_index) AS i FROM t)
      SELECT u.snapshot_id, u.track_id, coalesce(s.snapshot_id, -1)::BIGINT AS last_isolation FROM u LEFT JOIN snapshots s ON s.snapshot_index = u.i""",
    "w12_offsets": f"""{sql("subs")} SELECT track_id, coalesce(n_bound, 0) AS n_bound, row_number() OVER (ORDER BY track_id) - 1 AS position,
      (coalesce(sum(coalesce(n_bound, 0)) OVER (ORDER BY track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM subs WHERE {_TOP}""",
    "w12_all_offsets": f"""{sql("subs")} SELECT snapshot_id, track_id, coalesce(n_bound, 0) AS n_bound, row_number() OVER (PARTITION BY snapshot_id ORDER BY track_id) - 1 AS position,
      (coalesce(sum(coalesce(n_bound, 0)) OVER (PARTITION BY snapshot_id ORDER BY track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM subs""",
    "w12_member_offsets": f"""{sql("mems")} SELECT snapshot_id, track_id, particle_id, row_number() OVER (PARTITION BY snapshot_id
      ORDER BY track_id, rank ASC NULLS LAST, particle_id) - 1 AS "offset" FROM mems WHERE bound""",
    "w13_new_ids": f"""{sql("subs", "fofs")} SELECT snapshot_id, halo_id AS host_halo_id, (SELECT max(track_id) FROM subs) + row_number() OVER (ORDER BY snapshot_id, halo_id) AS track_id
      FROM fofs f WHERE NOT EXISTS (SELECT 1 FROM subs t WHERE t.snapshot_id = f.snapshot_id AND t.host_halo_id = f.halo_id)""",
    "w14_most_massive": f"""{sql("subs")} SELECT snapshot_id, track_id, m_bound FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY m_bound DESC, track_id) AS k
      FROM subs WHERE m_bound IS NOT NULL AND NOT isnan(m_bound)) WHERE k = 1""",
    "w15_nested_order": f"""{sql("subs")} SELECT snapshot_id, track_id, (generate_subscripts(nested_subhalos, 1) - 1)::INTEGER AS ordinal, unnest(nested_subhalos) AS nested_track_id FROM subs""",
}
