"""Queries of joins, votes and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.config import Config
from trackweave.functions import geometry as g
from trackweave.functions import physics as ph
from trackweave.operators import lookups as lk
from trackweave.operators import progenitors as pg
from trackweave.operators import votes
from trackweave.sources.relations import groups, members, particles, snapshots, sql, tracks

CONFIG = Config()
TRACER = lambda: ph.is_tracer("type", CONFIG.tracer_mask)
KEYS = ["snapshot_id", "track_id"]


def _members_here(s: SparkSession, d: str, columns: list[str]) -> DataFrame:
    """Members with the columns of their particle in the same snapshot; vanished ones are left out."""
    p = particles(s, d, columns).select("snapshot_id", "snapshot_index", "particle_id", *columns)
    return members(s, d).join(p, ["snapshot_id", "particle_id"])


def _carried(s: SparkSession, d: str, columns: list[str]) -> DataFrame:
    """Members of every snapshot with the columns their particle has in the next one, whose index they get.

    host columns are null where the particle is not in the next snapshot.
    """
    p = particles(s, d, columns).select("snapshot_index", "particle_id", *columns)
    times = snapshots(s, d).select("snapshot_id", (F.col("snapshot_index") + 1).alias("snapshot_index"))
    m = members(s, d).join(F.broadcast(times), "snapshot_id").drop("snapshot_id")
    return m.join(p, ["snapshot_index", "particle_id"], "left")


def j1_lookup(s: SparkSession, d: str) -> DataFrame:
    """The group of every member's particle, -1 if the particle is gone."""
    t = particles(s, d, ["host_id"])
    return lk.lookup(members(s, d, ["rank"]), t, ["snapshot_id", "particle_id"], ["host_id"])


def j4_matches(s: SparkSession, d: str) -> DataFrame:
    """How often each member's particle is a member in the snapshot after, by any track, and the matches themselves:
    their number and the sum of the tracks that hold them."""
    m = members(s, d, ["rank"]).join(F.broadcast(snapshots(s, d).select("snapshot_id", "snapshot_index")), "snapshot_id")
    asked = m.select((F.col("snapshot_index") + 1).alias("snapshot_index"), "track_id", "particle_id")
    counted, found = lk.locate(asked, m.select("snapshot_index", "particle_id", F.col("track_id").alias("holder")), "particle_id", "holder", ["snapshot_index"])
    counts = counted.groupBy("snapshot_index", "track_id").agg(F.sum("n_found").alias("n_matches"), F.count_if(F.col("n_found") == 0).alias("n_unmatched"))
    rows = found.groupBy("snapshot_index", "track_id").agg(F.count("*").alias("n_rows"), F.sum("holder").alias("holders"))
    return counts.join(rows, ["snapshot_index", "track_id"], "left").na.fill(0, ["n_rows", "holders"])


def j6_most_bound_positions(s: SparkSession, d: str) -> DataFrame:
    """Positions of tracks without members from their tracer particle, the catalogue's own if it vanished."""
    p = particles(s, d, ["x", "y", "z"]).select("snapshot_id", F.col("particle_id").alias("most_bound_particle_id"), "x", "y", "z")
    t = tracks(s, d, ["n_bound", "most_bound_particle_id", "comoving_most_bound_position"]).where("n_bound = 0")
    own = t.select(*KEYS, "most_bound_particle_id", *[F.get("comoving_most_bound_position", F.lit(i)).alias(c) for i, c in enumerate("xyz")])
    return lk.carry_over(own, p, ["snapshot_id", "most_bound_particle_id"], ["x", "y", "z"]).select(*KEYS, "x", "y", "z")


def j8_properties(s: SparkSession, d: str) -> DataFrame:
    """Mass and type of every track's most bound particle, -1 if unmatched; unknown types are not matched."""
    t = tracks(s, d, ["most_bound_particle_id"]).select(*KEYS, F.col("most_bound_particle_id").alias("particle_id"))
    table = particles(s, d, ["mass", "type"]).where("type < 6")
    return lk.lookup(t, table, ["snapshot_id", "particle_id"], ["mass", "type"]).select(*KEYS, F.col("mass").cast("double").alias("mass"), F.col("type").cast("int").alias("type"))


def j9_group_info(s: SparkSession, d: str) -> DataFrame:
    """Mass and size of every track's group, 0 if unmatched."""
    h = groups(s, d).select("snapshot_id", F.col("halo_id").alias("host_halo_id"), "mass", "n_part")
    t = tracks(s, d, ["host_halo_id"]).join(h, ["snapshot_id", "host_halo_id"], "left")
    return t.select(*KEYS, F.coalesce("mass", F.lit(0.0)).alias("group_mass"), F.coalesce("n_part", F.lit(0)).alias("group_size"))


def j13_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Bound particles that more than one track of a snapshot holds."""
    return lk.duplicates(members(s, d).where("bound"), ["snapshot_id", "particle_id"], "track_id")


def j14_exclusive(s: SparkSession, d: str) -> DataFrame:
    """Particles of no track, per snapshot."""
    p = particles(s, d, ["type"]).select("snapshot_id", "particle_id")
    return p.join(members(s, d, ["rank"]), ["snapshot_id", "particle_id"], "left_anti").groupBy("snapshot_id").agg(F.count("*").alias("n_free"))


def j15_next_snapshot(s: SparkSession, d: str) -> DataFrame:
    """Every track's bound mass beside that of the snapshot before."""
    t = tracks(s, d, ["m_bound", "n_bound"])
    return lk.previous(t, "track_id", "snapshot_index", ["n_bound"]).select("snapshot_id", "track_id", "n_bound", "prev_n_bound")


def j16_match(s: SparkSession, d: str) -> DataFrame:
    """Tracks of the first and the last catalogue that were born in the same snapshot and group."""
    t = tracks(s, d, ["snapshot_of_birth", "host_halo_id"])
    birth = t.groupBy("track_id").agg(
        F.max_by("snapshot_of_birth", "snapshot_index").alias("snapshot_of_birth"), F.min_by("host_halo_id", "snapshot_index").alias("birth_host")
    )
    last = t.groupBy("track_id").agg(F.max("snapshot_index").alias("i"))
    ended = birth.join(last, "track_id")
    top = snapshots(s, d).agg(F.max("snapshot_index")).first()[0]
    keep = ["track_id", "snapshot_of_birth", "birth_host"]
    return pg.match_tracks(ended.where(F.col("i") < top).select(*keep), ended.where(F.col("i") == top).select(*keep))


def j17_as_of(s: SparkSession, d: str) -> DataFrame:
    """Every merged track's target's mass as of the merged track's peak."""
    t = tracks(s, d, ["m_bound", "sink_track_id", "snapshot_of_last_max_mass"])
    times = snapshots(s, d).select(F.col("snapshot_id").alias("snapshot_of_last_max_mass"), F.col("snapshot_index").alias("peak"))
    asked = t.where("sink_track_id >= 0").join(times, "snapshot_of_last_max_mass").select(
        F.col("sink_track_id").alias("track_id"), F.col("peak").alias("snapshot_index"), F.col("track_id").alias("merged"), "snapshot_id"
    )
    hist = t.select("track_id", "snapshot_index", F.when(~F.isnan("m_bound"), F.col("m_bound")).alias("m"))
    return lk.as_of(asked, hist, "track_id", "snapshot_index", ["m"]).select("snapshot_id", "merged", F.col("track_id").alias("target"), F.col("m").alias("target_mass"))


def j18_evolution(s: SparkSession, d: str) -> DataFrame:
    """The history since birth of every track that anything sank into."""
    t = tracks(s, d, ["n_bound", "sink_track_id", "snapshot_of_birth"])
    births = t.groupBy("track_id").agg(F.max_by("snapshot_of_birth", "snapshot_index").alias("snapshot_id")).join(
        snapshots(s, d).select("snapshot_id", F.col("snapshot_index").alias("birth_index")), "snapshot_id"
    ).select("track_id", "birth_index")
    wanted = t.where("sink_track_id >= 0").select(F.col("sink_track_id").alias("track_id"))
    return pg.evolution(t.select(*KEYS, "snapshot_index", "n_bound"), wanted, births).select(*KEYS, "n_bound")


def j21_edges(s: SparkSession, d: str) -> DataFrame:
    """Every nested track beside its parent, with both positions."""
    t = tracks(s, d, ["nested_parent_track_id", "depth", "n_bound"])
    return lk.parent_edges(t, "track_id", "nested_parent_track_id", ["depth", "n_bound"], ["snapshot_id"])


def v1_hosts(s: SparkSession, d: str) -> DataFrame:
    """The host in the next snapshot of every track with bound tracers there, voted by the ten most bound ones; of all
    tracks: v1_all_hosts."""
    m = _carried(s, d, ["host_id", "type"]).where("bound")
    best = votes.first_tracers(m, ["snapshot_index", "track_id"], CONFIG.NumTracerHostFinding, TRACER(), spill=False)
    return votes.weighted_host(best, ["snapshot_index", "track_id"])


def v1_all_hosts(s: SparkSession, d: str) -> DataFrame:
    """The host of every track in the next snapshot: voted by its ten most bound tracers, or that of the particle an
    orphan follows (no score), or -1."""
    by = ["snapshot_index", "track_id"]
    t = tracks(s, d, ["n_bound", "most_bound_particle_id"])
    t = t.withColumn("snapshot_index", F.col("snapshot_index") + 1).join(F.broadcast(snapshots(s, d).select("snapshot_index")), "snapshot_index")
    p = particles(s, d, ["host_id"]).select("snapshot_index", F.col("particle_id").alias("most_bound_particle_id"), F.col("host_id").alias("_followed"))
    followed = t.where("n_bound <= 1").join(p, ["snapshot_index", "most_bound_particle_id"]).select(*by, "_followed")
    j = t.select(*by).join(v1_hosts(s, d), by, "left").join(followed, by, "left")
    return j.select(*by, F.coalesce("host_id", "_followed", F.lit(-1)).alias("host_id"), "score")


def v2_descendants(s: SparkSession, d: str) -> DataFrame:
    """The track that holds most of every track's ten best tracers in the next snapshot."""
    m = _members_here(s, d, ["type"]).where("bound")
    stored = votes.first_tracers(m, ["snapshot_index", "track_id"], CONFIG.NumTracersForDescendants, TRACER())
    stored = stored.select((F.col("snapshot_index") + 1).alias("snapshot_index"), "track_id", "particle_id")
    code = lambda c: F.struct("snapshot_index", F.col(c).alias("p"))
    held = m.select(code("particle_id").alias("p"), F.col("track_id").alias("descendant"))
    asked = stored.select("snapshot_index", "track_id", code("particle_id").alias("p"))
    return votes.descendant(asked, held, ["snapshot_index", "track_id"], "p", "descendant")


def v3_centrals(s: SparkSession, d: str) -> DataFrame:
    """The central of every group: of its massive tracks the one slowest against the group."""
    t = tracks(s, d, ["host_halo_id", "m_bound", "comoving_average_position", "physical_average_velocity"])
    h = groups(s, d).select("snapshot_id", F.col("halo_id").alias("host_halo_id"), *[F.col(c).alias(f"g{c}") for c in ("x", "y", "z", "vx", "vy", "vz")])
    e = snapshots(s, d).select("snapshot_id", "hz", "scale_factor", "box_size")
    j = t.where("m_bound > 0 AND NOT isnan(m_bound)").join(h, ["snapshot_id", "host_halo_id"]).join(F.broadcast(e), "snapshot_id")
    get = lambda c: tuple(F.get(c, F.lit(i)) for i in range(3))
    dv = g.relative_velocity(get("comoving_average_position"), get("physical_average_velocity"), g.vec("g"), g.vec("gv"), "hz", "scale_factor", "box_size")
    c = j.select(*KEYS, "host_halo_id", "m_bound", F.round(g.norm2(dv), 3).alias("d2"))
    return votes.central(c, ["snapshot_id", "host_halo_id"], "m_bound", "d2", "track_id", CONFIG.MajorProgenitorMassRatio)


def k1_shared_particles(s: SparkSession, d: str) -> DataFrame:
    """Per snapshot: bound particles held more than once and the tracks involved."""
    m = members(s, d).where("bound")
    dup = lk.duplicates(m, ["snapshot_id", "particle_id"], "track_id")
    who = m.join(dup, ["snapshot_id", "particle_id"]).select("snapshot_id", "track_id").distinct()
    return dup.groupBy("snapshot_id").agg(F.count("*").alias("n_shared")).join(who.groupBy("snapshot_id").agg(F.count("*").alias("n_tracks")), "snapshot_id")


def k2_interhost(s: SparkSession, d: str) -> DataFrame:
    """Tracks with members of another group than their own."""
    p = particles(s, d, ["host_id"]).where("host_id >= 0").select("snapshot_id", "particle_id", "host_id")
    t = tracks(s, d, ["host_halo_id"]).select(*KEYS, F.coalesce("host_halo_id", F.lit(-1)).alias("h"))
    m = members(s, d, ["rank"]).join(p, ["snapshot_id", "particle_id"]).join(t, KEYS)
    return m.groupBy(*KEYS).agg(F.count_if(F.col("host_id") != F.col("h")).alias("n_foreign")).where("n_foreign > 0")


def k3_orphan_ids(s: SparkSession, d: str) -> DataFrame:
    """Per snapshot: orphans that follow another particle than in the snapshot before, but those that just sank."""
    t = tracks(s, d, ["n_bound", "most_bound_particle_id", "snapshot_of_sink"])
    j = lk.previous(t, "track_id", "snapshot_index", ["n_bound", "most_bound_particle_id"])
    j = j.where("n_bound = 0 AND prev_n_bound = 0 AND coalesce(snapshot_of_sink, -1) <> snapshot_id")
    moved = ~F.col("most_bound_particle_id").eqNullSafe(F.col("prev_most_bound_particle_id"))
    return j.groupBy("snapshot_id").agg(F.count("*").alias("n_orphans"), F.count_if(moved).alias("n_moved"))


def k4_rederived_hosts(s: SparkSession, d: str) -> DataFrame:
    """Per snapshot: tracks whose catalogued host is not the one voted by their tracers; with orphans: k4_all_hosts."""
    return _rederived(s, d, v1_hosts(s, d))


def k4_all_hosts(s: SparkSession, d: str) -> DataFrame:
    """The same over all tracks that were there one snapshot before, orphans and tracks without a candidate as well."""
    return _rederived(s, d, v1_all_hosts(s, d))


def _rederived(s: SparkSession, d: str, voted: DataFrame) -> DataFrame:
    t = tracks(s, d, ["host_halo_id"]).select("snapshot_index", "track_id", F.coalesce("host_halo_id", F.lit(-1)).alias("h"))
    j = t.join(voted, ["snapshot_index", "track_id"])
    return j.groupBy("snapshot_index").agg(F.count("*").alias("n"), F.count_if(F.col("h") != F.col("host_id")).alias("n_wrong"))


def k5_orphan_hosts(s: SparkSession, d: str) -> DataFrame:
    """Per snapshot: orphans whose host is not their tracer's, and tracers of a type that can't be one."""
    t = tracks(s, d, ["n_bound", "host_halo_id", "most_bound_particle_id"]).where("n_bound = 0")
    p = particles(s, d, ["host_id", "type"]).select("snapshot_id", F.col("particle_id").alias("most_bound_particle_id"), "host_id", "type")
    j = t.join(p, ["snapshot_id", "most_bound_particle_id"])
    return j.groupBy("snapshot_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce("host_halo_id", F.lit(-1)) != F.col("host_id")).alias("n_wrong_host"),
        F.count_if(~TRACER()).alias("n_wrong_type"),
    )


def k6_same_orphans(s: SparkSession, d: str) -> DataFrame:
    """Orphans' particles of one snapshot that the next doesn't follow as often, and the other way round."""
    t = tracks(s, d, ["n_bound", "most_bound_particle_id"]).where("n_bound = 0")
    a = t.select((F.col("snapshot_index") + 1).alias("snapshot_index"), "most_bound_particle_id")
    b = t.select("snapshot_index", "most_bound_particle_id")
    n = lambda df, c: df.groupBy("snapshot_index").agg(F.count("*").alias(c))
    return n(a.exceptAll(b), "n_lost").join(n(b.exceptAll(a), "n_new"), "snapshot_index", "full_outer").na.fill(0)


def k7_rederived_descendants(s: SparkSession, d: str) -> DataFrame:
    """Per snapshot: tracks that died in it whose descendant is not the one voted by their tracers."""
    voted = v2_descendants(s, d)
    t = tracks(s, d, ["snapshot_of_death", "descendant_track_id"]).where("snapshot_of_death = snapshot_id")
    j = t.join(voted, ["snapshot_index", "track_id"], "left")
    return j.groupBy("snapshot_id").agg(
        F.count("*").alias("n_died"), F.count_if(F.coalesce("descendant", F.lit(-1)) != F.coalesce("descendant_track_id", F.lit(-1))).alias("n_other")
    )


def k8_sums(s: SparkSession, d: str) -> DataFrame:
    """Tracks whose counts or masses per type don't add up to their totals."""
    t = tracks(s, d, ["n_bound", "m_bound", "n_bound_type", "m_bound_type"])
    n = F.aggregate("n_bound_type", F.lit(0).cast("long"), lambda a, x: a + x)
    m = F.aggregate("m_bound_type", F.lit(0.0), lambda a, x: a + x)
    wrong_n = n != F.col("n_bound")
    wrong_m = F.abs(m - F.col("m_bound")) > 1e-6 * F.abs(F.col("m_bound"))
    return t.groupBy("snapshot_id").agg(F.count("*").alias("n"), F.count_if(wrong_n).alias("n_wrong_count"), F.count_if(wrong_m & ~F.isnan("m_bound")).alias("n_wrong_mass"))


def g7_progenitors(s: SparkSession, d: str) -> DataFrame:
    """Direct progenitors of every track by sinking and by disruption."""
    return pg.merge_links(_last(s, d)).select("target", "track_id", "kind")


def _last(s: SparkSession, d: str) -> DataFrame:
    cols = ["snapshot_of_death", "snapshot_of_sink", "sink_track_id", "descendant_track_id", "last_max_mass", "snapshot_of_last_max_mass"]
    t = tracks(s, d, cols)
    return t.groupBy("track_id").agg(*[F.max_by(c, "snapshot_index").alias(c) for c in cols])


def g9_all_progenitors(s: SparkSession, d: str) -> DataFrame:
    """All progenitors of every track."""
    return pg.all_progenitors(_last(s, d))


def g10_mass_ratios(s: SparkSession, d: str) -> DataFrame:
    """Peak mass of every merged track over its target's mass at that time."""
    t = _last(s, d)
    r = pg.mass_ratio(pg.merge_links(t), t, tracks(s, d, ["m_bound"]))
    return r.select("track_id", "target", F.round("ratio", 9).alias("ratio"))


QUERIES = {
    f.__name__: f
    for f in (
        j1_lookup, j4_matches, j6_most_bound_positions, j8_properties, j9_group_info, j13_duplicates, j14_exclusive, j15_next_snapshot,
        j16_match, j17_as_of, j18_evolution, j21_edges, v1_hosts, v1_all_hosts, v2_descendants, v3_centrals, k1_shared_particles, k2_interhost,
        k3_orphan_ids, k4_rederived_hosts, k4_all_hosts, k5_orphan_hosts, k6_same_orphans, k7_rederived_descendants, k8_sums,
        g7_progenitors, g9_all_progenitors, g10_mass_ratios,
    )
}

_V1 = f"""{sql("mems", "parts", "subs")},
  carried AS (SELECT s.snapshot_index + 1 AS snapshot_index, m.track_id, m.rank, m.particle_id, p.host_id
    FROM mems m JOIN snapshots s ON s.snapshot_id = m.snapshot_id
    JOIN parts p ON p.snapshot_index = s.snapshot_index + 1 AND p.particle_id = m.particle_id WHERE m.bound AND p.type IN (1, 4)),
  best AS (SELECT *, row_number() OVER (PARTITION BY snapshot_index, track_id ORDER BY rank, particle_id) - 1 AS r FROM carried),
  scores AS (SELECT snapshot_index, track_id, host_id, round(sum(1 / (1 + sqrt(r))), 9) AS score FROM best WHERE r < 10 GROUP BY ALL),
  voted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_index, track_id ORDER BY score DESC, host_id) AS k FROM scores) WHERE k = 1)"""
_V1_ALL = f"""{_V1},
  every AS (SELECT t.snapshot_index + 1 AS snapshot_index, t.track_id, coalesce(v.host_id, p.host_id, -1) AS host_id, v.score FROM subs t
    JOIN snapshots n ON n.snapshot_index = t.snapshot_index + 1
    LEFT JOIN voted v ON v.snapshot_index = t.snapshot_index + 1 AND v.track_id = t.track_id
    LEFT JOIN parts p ON p.snapshot_index = t.snapshot_index + 1 AND p.particle_id = t.most_bound_particle_id AND t.n_bound <= 1)"""
_V2 = f"""{sql("mems", "parts", "subs")},
  held AS (SELECT p.snapshot_index, m.track_id, m.rank, m.particle_id, coalesce(p.type IN (1, 4), false) AS tracer FROM mems m
    JOIN parts p ON p.snapshot_id = m.snapshot_id AND p.particle_id = m.particle_id WHERE m.bound),
  stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_index, track_id ORDER BY tracer DESC, rank, particle_id) AS k FROM held) WHERE k <= 10),
  counts AS (SELECT h.snapshot_index, s.track_id, h.track_id AS descendant, count(*) AS n_matches FROM stored s
    JOIN held h ON h.snapshot_index = s.snapshot_index + 1 AND h.particle_id = s.particle_id GROUP BY ALL),
  voted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_index, track_id ORDER BY n_matches DESC, descendant) AS k FROM counts) WHERE k = 1)"""
_LAST = f"""{sql("subs", recursive=True)},
  latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY snapshot_index DESC) AS k FROM subs) WHERE k = 1),
  merged AS (SELECT track_id, CASE WHEN coalesce(snapshot_of_sink, -1) = snapshot_of_death THEN sink_track_id
      WHEN coalesce(snapshot_of_sink, -1) = -1 OR snapshot_of_sink > snapshot_of_death THEN descendant_track_id END AS target,
    CASE WHEN coalesce(snapshot_of_sink, -1) = snapshot_of_death THEN 'sink' ELSE 'disruption' END AS kind, last_max_mass, snapshot_of_last_max_mass
    FROM latest WHERE coalesce(snapshot_of_death, -1) <> -1),
  links AS (SELECT * FROM merged WHERE target >= 0)"""

ORACLES = {
    "j1_lookup": f"""{sql("mems", "parts")} SELECT m.snapshot_id, m.track_id, m.particle_id, m.rank, coalesce(p.host_id, -1) AS host_id
      FROM mems m LEFT JOIN parts p ON p.snapshot_id = m.snapshot_id AND p.particle_id = m.particle_id""",
    "j4_matches": f"""{sql("mems")}, i AS (SELECT s.snapshot_index, m.track_id, m.particle_id FROM mems m JOIN snapshots s ON s.snapshot_id = m.snapshot_id),
      n AS (SELECT snapshot_index, particle_id, count(*) AS c, sum(track_id) AS t FROM i GROUP BY ALL)
      SELECT i.snapshot_index + 1 AS snapshot_index, i.track_id, coalesce(sum(c), 0)::BIGINT AS n_matches, count(*) FILTER (WHERE c IS NULL) AS n_unmatched,
        coalesce(sum(c), 0)::BIGINT AS n_rows, coalesce(sum(t), 0)::BIGINT AS holders
      FROM i LEFT JOIN n ON n.snapshot_index = i.snapshot_index + 1 AND n.particle_id = i.particle_id GROUP BY ALL""",
    "j6_most_bound_positions": f"""{sql("subs", "parts")} SELECT t.snapshot_id, t.track_id, coalesce(p.x, t.comoving_most_bound_position[1]) AS x,
      coalesce(p.y, t.comoving_most_bound_position[2]) AS y, coalesce(p.z, t.comoving_most_bound_position[3]) AS z
      FROM subs t LEFT JOIN parts p ON p.snapshot_id = t.snapshot_id AND p.particle_id = t.most_bound_particle_id WHERE t.n_bound = 0""",
    "j8_properties": f"""{sql("subs", "parts")} SELECT t.snapshot_id, t.track_id, CASE WHEN p.particle_id IS NULL THEN -1 ELSE p.mass END AS mass,
      coalesce(p.type, -1)::INTEGER AS type FROM subs t LEFT JOIN (SELECT * FROM parts WHERE type < 6) p
      ON p.snapshot_id = t.snapshot_id AND p.particle_id = t.most_bound_particle_id""",
    "j9_group_info": f"""{sql("subs", "fofs")} SELECT t.snapshot_id, t.track_id, coalesce(f.mass, 0) AS group_mass, coalesce(f.n_part, 0) AS group_size
      FROM subs t LEFT JOIN fofs f ON f.snapshot_id = t.snapshot_id AND f.halo_id = t.host_halo_id""",
    "j13_duplicates": f"""{sql("mems")} SELECT snapshot_id, particle_id, count(DISTINCT track_id) AS n_owners FROM mems WHERE bound
      GROUP BY ALL HAVING count(DISTINCT track_id) > 1""",
    "j14_exclusive": f"""{sql("mems", "parts")} SELECT p.snapshot_id, count(*) AS n_free FROM parts p WHERE NOT EXISTS (
      SELECT 1 FROM mems m WHERE m.snapshot_id = p.snapshot_id AND m.particle_id = p.particle_id) GROUP BY p.snapshot_id""",
    "j15_next_snapshot": f"""{sql("subs")} SELECT b.snapshot_id, b.track_id, b.n_bound, a.n_bound AS prev_n_bound FROM subs a
      JOIN subs b ON b.track_id = a.track_id AND b.snapshot_index = a.snapshot_index + 1""",
    "j16_match": f"""{sql("subs")}, t AS (SELECT track_id, max(snapshot_index) AS i, any_value(b) AS snapshot_of_birth, any_value(h) AS birth_host FROM (
        SELECT *, first_value(snapshot_of_birth) OVER (PARTITION BY track_id ORDER BY snapshot_index DESC) AS b,
          first_value(host_halo_id) OVER (PARTITION BY track_id ORDER BY snapshot_index) AS h FROM subs) GROUP BY track_id),
      top AS (SELECT max(snapshot_index) AS m FROM snapshots)
      SELECT a.track_id, min(b.track_id) AS matched FROM t a LEFT JOIN (SELECT * FROM t WHERE i = (SELECT m FROM top) AND birth_host >= 0) b
      ON b.snapshot_of_birth = a.snapshot_of_birth AND b.birth_host = a.birth_host WHERE a.i < (SELECT m FROM top) GROUP BY a.track_id""",
    "j17_as_of": f"""{sql("subs")}, asked AS (SELECT t.snapshot_id, t.track_id AS merged, t.sink_track_id AS target, s.snapshot_index AS peak FROM subs t
        JOIN snapshots s ON s.snapshot_id = t.snapshot_of_last_max_mass WHERE t.sink_track_id >= 0)
      SELECT a.snapshot_id, a.merged, a.target, (SELECT CASE WHEN NOT isnan(h.m_bound) THEN h.m_bound END FROM subs h WHERE h.track_id = a.target
        AND h.snapshot_index <= a.peak ORDER BY h.snapshot_index DESC LIMIT 1) AS target_mass FROM asked a""",
    "j18_evolution": f"""{sql("subs")}, b AS (SELECT DISTINCT track_id, first_value(snapshot_of_birth) OVER (PARTITION BY track_id ORDER BY snapshot_index DESC) AS sb FROM subs),
      w AS (SELECT DISTINCT sink_track_id AS track_id FROM subs WHERE sink_track_id >= 0)
      SELECT t.snapshot_id, t.track_id, t.n_bound FROM subs t JOIN w ON w.track_id = t.track_id JOIN b ON b.track_id = t.track_id
      JOIN snapshots s ON s.snapshot_id = b.sb WHERE t.snapshot_index >= s.snapshot_index""",
    "j21_edges": f"""{sql("subs")} SELECT c.snapshot_id, c.track_id, c.nested_parent_track_id, c.depth, c.n_bound, p.depth AS parent_depth, p.n_bound AS parent_n_bound
      FROM subs c JOIN subs p ON p.snapshot_id = c.snapshot_id AND p.track_id = c.nested_parent_track_id WHERE c.nested_parent_track_id >= 0""",
    "v1_hosts": f"{_V1} SELECT snapshot_index, track_id, host_id, score FROM voted",
    "v1_all_hosts": f"{_V1_ALL} SELECT snapshot_index, track_id, host_id, score FROM every",
    "v2_descendants": f"{_V2} SELECT snapshot_index, track_id, descendant, n_matches FROM voted",
    "v3_centrals": f"""{sql("subs", "fofs")}, j AS (SELECT t.*, s.hz * s.scale_factor AS ha, s.box_size AS l, f.vx AS fvx, f.vy AS fvy, f.vz AS fvz,
        t.comoving_average_position[1] - f.x AS dx, t.comoving_average_position[2] - f.y AS dy, t.comoving_average_position[3] - f.z AS dz
        FROM subs t JOIN fofs f ON f.snapshot_id = t.snapshot_id AND f.halo_id = t.host_halo_id JOIN snapshots s ON s.snapshot_id = t.snapshot_id
        WHERE t.m_bound > 0 AND NOT isnan(t.m_bound)),
      n AS (SELECT *, CASE WHEN dx > l / 2 THEN dx - l WHEN dx < -l / 2 THEN dx + l ELSE dx END AS nx,
        CASE WHEN dy > l / 2 THEN dy - l WHEN dy < -l / 2 THEN dy + l ELSE dy END AS ny,
        CASE WHEN dz > l / 2 THEN dz - l WHEN dz < -l / 2 THEN dz + l ELSE dz END AS nz FROM j),
      k AS (SELECT *, round(pow(physical_average_velocity[1] - fvx + ha * nx, 2) + pow(physical_average_velocity[2] - fvy + ha * ny, 2)
        + pow(physical_average_velocity[3] - fvz + ha * nz, 2), 3) AS d2, max(m_bound) OVER (PARTITION BY snapshot_id, host_halo_id) AS top FROM n)
      SELECT snapshot_id, host_halo_id, track_id FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, host_halo_id
        ORDER BY coalesce(d2, 'inf'::DOUBLE), m_bound DESC, track_id) AS rr FROM k WHERE m_bound >= 0.8::DOUBLE * top) WHERE rr = 1""",
    "k1_shared_particles": f"""{sql("mems")}, dup AS (SELECT snapshot_id, particle_id FROM mems WHERE bound GROUP BY ALL HAVING count(DISTINCT track_id) > 1)
      SELECT d.snapshot_id, count(DISTINCT d.particle_id) AS n_shared, count(DISTINCT m.track_id) AS n_tracks FROM dup d
      JOIN mems m ON m.snapshot_id = d.snapshot_id AND m.particle_id = d.particle_id AND m.bound GROUP BY d.snapshot_id""",
    "k2_interhost": f"""{sql("mems", "parts", "subs")} SELECT m.snapshot_id, m.track_id, count(*) AS n_foreign FROM mems m
      JOIN parts p ON p.snapshot_id = m.snapshot_id AND p.particle_id = m.particle_id JOIN subs t ON t.snapshot_id = m.snapshot_id AND t.track_id = m.track_id
      WHERE p.host_id >= 0 AND p.host_id <> coalesce(t.host_halo_id, -1) GROUP BY ALL""",
    "k3_orphan_ids": f"""{sql("subs")} SELECT b.snapshot_id, count(*) AS n_orphans,
      count(*) FILTER (WHERE a.most_bound_particle_id IS DISTINCT FROM b.most_bound_particle_id) AS n_moved FROM subs a
      JOIN subs b ON b.track_id = a.track_id AND b.snapshot_index = a.snapshot_index + 1
      WHERE a.n_bound = 0 AND b.n_bound = 0 AND coalesce(b.snapshot_of_sink, -1) <> b.snapshot_id GROUP BY b.snapshot_id""",
    "k4_rederived_hosts": f"""{_V1} SELECT v.snapshot_index, count(*) AS n, count(*) FILTER (WHERE coalesce(t.host_halo_id, -1) <> v.host_id) AS n_wrong
      FROM voted v JOIN subs t ON t.snapshot_index = v.snapshot_index AND t.track_id = v.track_id GROUP BY v.snapshot_index""",
    "k4_all_hosts": f"""{_V1_ALL} SELECT v.snapshot_index, count(*) AS n, count(*) FILTER (WHERE coalesce(t.host_halo_id, -1) <> v.host_id) AS n_wrong
      FROM every v JOIN subs t ON t.snapshot_index = v.snapshot_index AND t.track_id = v.track_id GROUP BY v.snapshot_index""",
    "k5_orphan_hosts": f"""{sql("subs", "parts")} SELECT t.snapshot_id, count(*) AS n, count(*) FILTER (WHERE coalesce(t.host_halo_id, -1) <> p.host_id) AS n_wrong_host,
      count(*) FILTER (WHERE p.type NOT IN (1, 4)) AS n_wrong_type FROM subs t JOIN parts p ON p.snapshot_id = t.snapshot_id
      AND p.particle_id = t.most_bound_particle_id WHERE t.n_bound = 0 GROUP BY t.snapshot_id""",
    "k6_same_orphans": f"""{sql("subs")}, o AS (SELECT snapshot_index, most_bound_particle_id AS p, count(*) AS c FROM subs WHERE n_bound = 0 GROUP BY ALL)
      SELECT coalesce(a.i, b.snapshot_index) AS snapshot_index, sum(greatest(0, coalesce(a.c, 0) - coalesce(b.c, 0)))::BIGINT AS n_lost,
        sum(greatest(0, coalesce(b.c, 0) - coalesce(a.c, 0)))::BIGINT AS n_new
      FROM (SELECT snapshot_index + 1 AS i, p, c FROM o) a FULL JOIN o b ON b.snapshot_index = a.i AND b.p IS NOT DISTINCT FROM a.p GROUP BY 1
      HAVING sum(abs(coalesce(b.c, 0) - coalesce(a.c, 0))) > 0""",
    "k7_rederived_descendants": f"""{_V2} SELECT t.snapshot_id, count(*) AS n_died,
      count(*) FILTER (WHERE coalesce(v.descendant, -1) <> coalesce(t.descendant_track_id, -1)) AS n_other
      FROM subs t LEFT JOIN voted v ON v.snapshot_index = t.snapshot_index AND v.track_id = t.track_id WHERE t.snapshot_of_death = t.snapshot_id GROUP BY t.snapshot_id""",
    "k8_sums": f"""{sql("subs")} SELECT snapshot_id, count(*) AS n, count(*) FILTER (WHERE list_sum(n_bound_type) <> n_bound) AS n_wrong_count,
      count(*) FILTER (WHERE NOT isnan(m_bound) AND abs(list_sum(m_bound_type) - m_bound) > 1e-6 * abs(m_bound)) AS n_wrong_mass FROM subs GROUP BY snapshot_id""",
    "g7_progenitors": f"{_LAST} SELECT target, track_id, kind FROM links",
    "g9_all_progenitors": f"""{_LAST}, known AS (SELECT l.track_id, l.target FROM links l JOIN latest p ON p.track_id = l.target WHERE l.track_id <> l.target),
      down AS (SELECT track_id FROM latest WHERE track_id NOT IN (SELECT track_id FROM known)
        UNION ALL SELECT k.track_id FROM known k JOIN down d ON d.track_id = k.target),
      pairs AS (SELECT target AS track_id, track_id AS progenitor, 1::BIGINT AS distance FROM known WHERE track_id IN (SELECT track_id FROM down)
        UNION ALL SELECT k.target, p.progenitor, p.distance + 1 FROM pairs p JOIN known k ON k.track_id = p.track_id)
      SELECT track_id, progenitor, distance FROM pairs""",
    "g10_mass_ratios": f"""{_LAST} SELECT l.track_id, l.target, CASE WHEN NOT isnan(t.m_bound) AND t.m_bound <> 0 THEN round(l.last_max_mass / t.m_bound, 9) END AS ratio
      FROM links l LEFT JOIN subs t ON t.snapshot_id = l.snapshot_of_last_max_mass AND t.track_id = l.target""",
}
