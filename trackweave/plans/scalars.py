"""Queries of scalar functions, filters and scans (F1-F22, IO2-IO13, J8, J9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.config import Config
from trackweave.functions import geometry as g
from trackweave.functions import physics as ph
from trackweave.operators.lookups import lookup
from trackweave.sources import formats
from trackweave.sources.relations import groups, members, particles, snapshots, sql, tracks, with_epoch
from trackweave.sources.tables import without_nan

TRACERS = Config().tracer_mask


def _in_groups(s: SparkSession, d: str) -> DataFrame:
    """Particles beside the centre and velocity of their group."""
    c = groups(s, d).select("snapshot_id", F.col("halo_id").alias("host_id"), *[F.col(x).alias(f"g{x}") for x in ("x", "y", "z", "vx", "vy", "vz")])
    return particles(s, d).join(c, ["snapshot_id", "host_id"])


def f1_f5_geometry(s: SparkSession, d: str) -> DataFrame:
    """Separation of every particle from its group's centre, and the velocity against it."""
    p = _in_groups(s, d)
    x, v, x0, v0 = g.vec(""), g.vec("v"), g.vec("g"), g.vec("gv")
    rv = g.relative_velocity(x, v, x0, v0, "hz", "scale_factor", "box_size")
    return p.select(
        "snapshot_id",
        "particle_id",
        F.round(g.nearest(F.col("x") - F.col("gx"), "box_size"), 6).alias("dx"),
        F.round(g.distance(x, x0, "box_size"), 6).alias("r"),
        F.round(g.distance2(x, x0), 6).alias("open_r2"),
        F.round(g.dot(v, v0), 2).alias("v_dot"),
        F.round(g.norm2(rv), 2).alias("dv2"),
        g.cell("x", F.col("box_size") / 16, 16).alias("cell_x"),
    )


def f4_wrap(s: SparkSession, d: str) -> DataFrame:
    """Particles whose delivered position lies outside the box, wrapped into it, counted per snapshot."""
    from trackweave.sources.tables import read

    p = with_epoch(read(s, d, "particles"), s, d, ["box_size"])
    out = (F.col("x") < 0) | (F.col("x") >= F.col("box_size"))
    return p.groupBy("snapshot_id").agg(
        F.count_if(out).alias("n_outside"), F.sum(F.round(g.wrap("x", "box_size"), 3).cast("decimal(18,3)")).cast("double").alias("sum_x")
    )


def f6_tracers(s: SparkSession, d: str) -> DataFrame:
    """Tracers and particles exempt from subsampling, per snapshot and type."""
    keep = Config().keep_mask
    return particles(s, d, ["type"]).groupBy("snapshot_id", "type").agg(
        F.count("*").alias("n"), F.count_if(ph.is_tracer("type", TRACERS)).alias("n_tracers"), F.count_if(ph.is_tracer("type", keep)).alias("n_exempt")
    )


def f7_bound(s: SparkSession, d: str) -> DataFrame:
    """Members below zero energy, beside the flag that was delivered."""
    return members(s, d).groupBy("snapshot_id").agg(
        F.count("*").alias("n"), F.count_if(ph.is_bound("binding_energy")).alias("n_bound"), F.count_if(F.col("bound")).alias("n_flagged")
    )


def f8_states(s: SparkSession, d: str) -> DataFrame:
    """Centrals, trapped and living tracks per snapshot."""
    t = tracks(s, d, ["rank", "sink_track_id", "snapshot_of_death"])
    none = F.lit(-1)
    return t.groupBy("snapshot_id").agg(
        F.count_if(F.col("rank") == 0).alias("n_central"),
        F.count_if(F.coalesce("sink_track_id", none) != -1).alias("n_trapped"),
        F.count_if(F.coalesce("snapshot_of_death", none) == -1).alias("n_alive"),
        F.count("*").alias("n"),
    )


def f9_f11_epochs(s: SparkSession, d: str) -> DataFrame:
    """Softening, expansion rate and units of every snapshot, with its volume's mean particle density."""
    e = snapshots(s, d)
    n = particles(s, d, ["type"]).groupBy("snapshot_id").agg(F.count("*").alias("n"))
    h0 = ph.hubble_today("length_in_mpch", "vel_in_kms")
    density = F.col("n") / F.pow("box_size", F.lit(3))
    return e.join(n, "snapshot_id").select(
        "snapshot_id",
        F.round(ph.softening("softening", "max_physical_softening", "scale_factor"), 9).alias("softening_now"),
        F.round(ph.hubble("scale_factor", "omega_m0", "omega_lambda0", h0), 4).alias("hubble"),
        F.round(ph.gravity("mass_in_msunh", "length_in_mpch", "vel_in_kms"), 6).alias("gravity"),
        F.round(g.neighbour_range(F.lit(10.0), density), 6).alias("range_10"),
    )


def f12_partitions(s: SparkSession, d: str) -> DataFrame:
    """Particles per hash partition of their id: the spread a join by id works with."""
    return particles(s, d, ["type"]).groupBy(F.pmod(F.xxhash64("particle_id"), F.lit(64)).alias("part")).agg(F.count("*").alias("n"))


def f13_properties(s: SparkSession, d: str) -> DataFrame:
    """A few named properties of every track, the others never read; a mass that is NaN is null and marked as such."""
    t = tracks(s, d, ["n_bound", "m_bound", "vmax_physical"])
    return t.select("snapshot_id", "track_id", "n_bound", *without_nan("m_bound"), "vmax_physical")


def f14_by_track(s: SparkSession, d: str) -> DataFrame:
    """Requested tracks in the order of the requests, missing ones filled: every track's sink, as of the same snapshot."""
    t = tracks(s, d, ["sink_track_id", "n_bound", "m_bound"])
    asked = t.where("sink_track_id >= 0").select("snapshot_id", F.col("track_id").alias("request"), F.col("sink_track_id").alias("track_id"))
    return lookup(asked, t.select("snapshot_id", "track_id", "n_bound"), ["snapshot_id", "track_id"], ["n_bound"], -9999)


def f15_null_members(s: SparkSession, d: str) -> DataFrame:
    """Members left per track after dropping those whose particle is gone."""
    here = particles(s, d, ["type"]).select("snapshot_id", "particle_id")
    return members(s, d).join(here, ["snapshot_id", "particle_id"], "left_semi").groupBy("snapshot_id", "track_id").agg(F.count("*").alias("n_left"))


def f16_same_host(s: SparkSession, d: str) -> DataFrame:
    """Members kept by each track when those of another group are dropped; members without a group stay."""
    p = particles(s, d, ["host_id"]).select("snapshot_id", "particle_id", "host_id")
    t = tracks(s, d, ["host_halo_id"]).select("snapshot_id", "track_id", F.coalesce("host_halo_id", F.lit(-1)).alias("h"))
    m = members(s, d, ["rank"]).join(p, ["snapshot_id", "particle_id"]).join(t, ["snapshot_id", "track_id"])
    stays = (F.col("host_id") == F.col("h")) | (F.col("host_id") == -1)
    return m.groupBy("snapshot_id", "track_id").agg(F.count("*").alias("n_before"), F.count_if(stays).alias("n_after"))


def f17_small_groups(s: SparkSession, d: str) -> DataFrame:
    """Group ids of particles after groups of fewer than five particles are dissolved, counted per snapshot and id."""
    p = particles(s, d, ["host_id"]).select("snapshot_id", "particle_id", "host_id")
    sizes = p.where("host_id >= 0").groupBy("snapshot_id", "host_id").agg(F.count("*").alias("size"))
    kept = sizes.where("size >= 5").select("snapshot_id", "host_id", F.lit(True).alias("kept"))
    new = F.when(F.col("kept"), F.col("host_id")).otherwise(-1)
    return p.join(kept, ["snapshot_id", "host_id"], "left").groupBy("snapshot_id", new.alias("new_host_id")).agg(F.count("*").alias("n"))


def f18_units(s: SparkSession, d: str) -> DataFrame:
    """Masses, velocities and lengths of tracks in common units."""
    t = with_epoch(tracks(s, d, ["m_bound", "vmax_physical", "rmax_comoving"]).drop("snapshot_index"), s, d, ["mass_in_msunh", "length_in_mpch", "vel_in_kms", "scale_factor"])
    return t.select(
        "snapshot_id",
        "track_id",
        F.round(F.log10(F.when(F.col("m_bound") > 0, F.col("m_bound") * F.col("mass_in_msunh"))), 6).alias("log_mass"),
        F.round(F.col("vmax_physical") * F.col("vel_in_kms"), 4).alias("v_kms"),
        F.round(F.col("rmax_comoving") * F.col("length_in_mpch") * F.col("scale_factor"), 9).alias("r_mpch"),
    )


def f19_id_mask(s: SparkSession, d: str) -> DataFrame:
    """Distinct low bits of particle ids per snapshot."""
    low = F.col("particle_id").bitwiseAND(F.lit(0xFFF))
    return particles(s, d, ["type"]).groupBy("snapshot_id", low.alias("low")).agg(F.count("*").alias("n"))


def f22_host_mass_range(s: SparkSession, d: str) -> DataFrame:
    """Tracks whose group has a mass within [0.5, 5), 0 standing for tracks without a group."""
    h = groups(s, d).select("snapshot_id", F.col("halo_id").alias("host_halo_id"), F.col("mass").alias("group_mass"), F.col("n_part").alias("group_size"))
    t = tracks(s, d, ["host_halo_id"]).join(h, ["snapshot_id", "host_halo_id"], "left")
    t = t.withColumns({"group_mass": F.coalesce("group_mass", F.lit(0.0)), "group_size": F.coalesce("group_size", F.lit(0))})
    return t.where((F.col("group_mass") >= 0.5) & (F.col("group_mass") < 5.0)).select("snapshot_id", "track_id", "group_mass", "group_size")


def io2_group_totals(s: SparkSession, d: str) -> DataFrame:
    """Groups, their particles and the largest group of every snapshot."""
    h = groups(s, d)
    return h.groupBy("snapshot_id").agg(F.count("*").alias("n_groups"), F.sum("n_part").alias("n_particles"), F.max("n_part").alias("largest"))


def io5_groups_of_particles(s: SparkSession, d: str) -> DataFrame:
    """Groups built from the particles that name them (also IO9)."""
    p = particles(s, d, ["host_id"])
    return formats.groups_of_particles(p, ["snapshot_id"]).select("snapshot_id", "host_id", "n", "first_id")


def io13_merged_groups(s: SparkSession, d: str) -> DataFrame:
    """Group masses and mass-weighted mean velocities from partial sums that merge."""
    p = particles(s, d, ["vx", "mass", "host_id"]).where("host_id >= 0")
    m = F.col("mass").cast("decimal(18,9)")
    return p.groupBy("snapshot_id", "host_id").agg(
        F.sum(m).cast("double").alias("mass"), F.round(F.try_divide(F.sum(F.col("mass") * F.col("vx")), F.sum("mass")), 6).alias("mean_vx")
    )


QUERIES = {
    f.__name__: f
    for f in (
        f1_f5_geometry, f4_wrap, f6_tracers, f7_bound, f8_states, f9_f11_epochs, f12_partitions, f13_properties, f14_by_track,
        f15_null_members, f16_same_host, f17_small_groups, f18_units, f19_id_mask, f22_host_mass_range, io2_group_totals,
        io5_groups_of_particles, io13_merged_groups,
    )
}

_NEAR = "CASE WHEN {0} > p.box_size / 2 THEN {0} - p.box_size WHEN {0} < -p.box_size / 2 THEN {0} + p.box_size ELSE {0} END"
_DX, _DY, _DZ = (_NEAR.format(f"(p.{c} - f.{c})") for c in "xyz")

ORACLES = {
    "f1_f5_geometry": f"""{sql("parts", "fofs")},
      j AS (SELECT p.*, f.x AS fx, f.y AS fy, f.z AS fz, f.vx AS fvx, f.vy AS fvy, f.vz AS fvz, {_DX} AS dx, {_DY} AS dy, {_DZ} AS dz
        FROM parts p JOIN fofs f ON f.snapshot_id = p.snapshot_id AND f.halo_id = p.host_id),
      k AS (SELECT *, vx - fvx + hz * scale_factor * dx AS rx, vy - fvy + hz * scale_factor * dy AS ry, vz - fvz + hz * scale_factor * dz AS rz FROM j)
      SELECT snapshot_id, particle_id, round(dx, 6) AS dx, round(sqrt(dx * dx + dy * dy + dz * dz), 6) AS r,
        round((x - fx) * (x - fx) + (y - fy) * (y - fy) + (z - fz) * (z - fz), 6) AS open_r2,
        round(vx * fvx + vy * fvy + vz * fvz, 2) AS v_dot, round(rx * rx + ry * ry + rz * rz, 2) AS dv2,
        greatest(0, least(15, floor(x / (box_size / 16))))::INTEGER AS cell_x FROM k""",
    "f4_wrap": """SELECT p.snapshot_id, count(*) FILTER (WHERE x < 0 OR x >= box_size) AS n_outside,
      sum(round((x / box_size - floor(x / box_size)) * box_size, 3)::DECIMAL(18,3))::DOUBLE AS sum_x
      FROM particles p JOIN snapshots s ON s.snapshot_id = p.snapshot_id GROUP BY p.snapshot_id""",
    "f6_tracers": f"""{sql("parts")} SELECT snapshot_id, type, count(*) AS n, count(*) FILTER (WHERE type IN (1, 4)) AS n_tracers,
      count(*) FILTER (WHERE type = 5) AS n_exempt FROM parts GROUP BY snapshot_id, type""",
    "f7_bound": f"""{sql("mems")} SELECT snapshot_id, count(*) AS n, count(*) FILTER (WHERE binding_energy < 0) AS n_bound,
      count(*) FILTER (WHERE bound) AS n_flagged FROM mems GROUP BY snapshot_id""",
    "f8_states": f"""{sql("subs")} SELECT snapshot_id, count(*) FILTER (WHERE rank = 0) AS n_central,
      count(*) FILTER (WHERE coalesce(sink_track_id, -1) <> -1) AS n_trapped,
      count(*) FILTER (WHERE coalesce(snapshot_of_death, -1) = -1) AS n_alive, count(*) AS n FROM subs GROUP BY snapshot_id""",
    "f9_f11_epochs": f"""{sql("parts")}, c AS (SELECT snapshot_id, count(*) AS n FROM parts GROUP BY snapshot_id)
      SELECT s.snapshot_id::BIGINT AS snapshot_id, round(CASE WHEN max_physical_softening < 0 THEN softening
          ELSE least(softening, max_physical_softening / scale_factor) END, 9) AS softening_now,
        round(100 * length_in_mpch / vel_in_kms * sqrt(omega_m0 / scale_factor ** 3 + (1 - omega_m0 - omega_lambda0) / scale_factor ** 2
          + omega_lambda0), 4) AS hubble,
        round(43.0071::DOUBLE * (mass_in_msunh / 1e10) / (vel_in_kms * vel_in_kms) / length_in_mpch, 6) AS gravity,
        round(pow(10.0::DOUBLE / (n / box_size ** 3) * (0.75 / pi()), 1.0::DOUBLE / 3), 6) AS range_10 FROM snapshots s JOIN c ON c.snapshot_id = s.snapshot_id""",
    "f13_properties": f"{sql('subs')} SELECT snapshot_id, track_id, n_bound, CASE WHEN NOT isnan(m_bound) THEN m_bound END AS m_bound, "
      "coalesce(isnan(m_bound), false) AS m_bound_is_nan, vmax_physical FROM subs",
    "f14_by_track": f"""{sql("subs")} SELECT a.snapshot_id, a.track_id AS request, a.sink_track_id AS track_id,
      CASE WHEN b.track_id IS NULL THEN -9999 ELSE b.n_bound END AS n_bound
      FROM subs a LEFT JOIN subs b ON b.snapshot_id = a.snapshot_id AND b.track_id = a.sink_track_id WHERE a.sink_track_id >= 0""",
    "f15_null_members": f"""{sql("mems", "parts")} SELECT m.snapshot_id, m.track_id, count(*) AS n_left FROM mems m
      JOIN parts p ON p.snapshot_id = m.snapshot_id AND p.particle_id = m.particle_id GROUP BY m.snapshot_id, m.track_id""",
    "f16_same_host": f"""{sql("mems", "parts", "subs")} SELECT m.snapshot_id, m.track_id, count(*) AS n_before,
      count(*) FILTER (WHERE p.host_id = coalesce(t.host_halo_id, -1) OR p.host_id = -1) AS n_after FROM mems m
      JOIN parts p ON p.snapshot_id = m.snapshot_id AND p.particle_id = m.particle_id
      JOIN subs t ON t.snapshot_id = m.snapshot_id AND t.track_id = m.track_id GROUP BY m.snapshot_id, m.track_id""",
    "f17_small_groups": f"""{sql("parts")}, n AS (SELECT *, count(*) OVER (PARTITION BY snapshot_id, host_id) AS c FROM parts)
      SELECT snapshot_id, CASE WHEN host_id >= 0 AND c >= 5 THEN host_id ELSE -1 END AS new_host_id, count(*) AS n FROM n GROUP BY ALL""",
    "f18_units": f"""{sql("subs")} SELECT t.snapshot_id, track_id, round(log10(CASE WHEN m_bound > 0 AND NOT isnan(m_bound) THEN m_bound * mass_in_msunh
        WHEN isnan(m_bound) THEN m_bound END), 6) AS log_mass, round(vmax_physical * vel_in_kms, 4) AS v_kms,
      round(rmax_comoving * length_in_mpch * scale_factor, 9) AS r_mpch FROM subs t JOIN snapshots s ON s.snapshot_id = t.snapshot_id""",
    "f19_id_mask": f"""{sql("parts")} SELECT snapshot_id, particle_id & 4095 AS low, count(*) AS n FROM parts GROUP BY ALL""",
    "f22_host_mass_range": f"""{sql("subs", "fofs")} SELECT t.snapshot_id, t.track_id, f.mass AS group_mass, coalesce(f.n_part, 0) AS group_size
      FROM subs t JOIN fofs f ON f.snapshot_id = t.snapshot_id AND f.halo_id = t.host_halo_id WHERE f.mass >= 0.5 AND f.mass < 5""",
    "io2_group_totals": f"""{sql("fofs")} SELECT snapshot_id, count(*) AS n_groups, sum(n_part)::BIGINT AS n_particles, max(n_part) AS largest
      FROM fofs GROUP BY snapshot_id""",
    "io5_groups_of_particles": f"""{sql("parts")} SELECT snapshot_id, host_id, count(*) AS n, min(particle_id) AS first_id
      FROM parts WHERE host_id >= 0 GROUP BY snapshot_id, host_id""",
    "io13_merged_groups": f"""{sql("parts")} SELECT snapshot_id, host_id, sum(mass::DECIMAL(18,9))::DOUBLE AS mass,
      CASE WHEN sum(mass) <> 0 THEN round(sum(mass * vx) / sum(mass), 6) END AS mean_vx FROM parts WHERE host_id >= 0 GROUP BY snapshot_id, host_id""",
}
