"""The queries p1_ to p5_ over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.operators.changes import snapshot_changes
from trackweave.operators.heavy_keys import per_key_profile
from trackweave.operators.hierarchy import ancestor_pairs, clean_links, cycles, hierarchy
from trackweave.operators.history import history
from trackweave.operators.references import (
    Reference,
    existence_deltas,
    merge_state,
    orphan_references,
    orphans,
    reference_deltas,
    revisions,
)
from trackweave.runtime import cut, small
from trackweave.sources.tables import read, rows_that_count, without_nan


def _group_refs(s: SparkSession, d: str) -> list[Reference]:
    return [
        Reference("particles.host_id", read(s, d, "particles"), "host_id"),
        Reference("subhalos.host_halo_id", read(s, d, "subhalos"), "host_halo_id"),
    ]


def _particle_refs(s: SparkSession, d: str) -> list[Reference]:
    return [
        Reference("source_members.particle_id", read(s, d, "source_members"), "particle_id"),
        Reference("subhalos.most_bound_particle_id", read(s, d, "subhalos"), "most_bound_particle_id"),
    ]


def _first_half(s: SparkSession, d: str) -> Column:
    """Whether a row was delivered in the first half of the time in which snapshots close; the others are a second batch."""
    first, last = read(s, d, "snapshots").agg(F.min(F.unix_micros("closed_at")), F.max(F.unix_micros("closed_at"))).first()
    return F.lit(True) if first is None else F.unix_micros("delivered_at") < (first + last) // 2


def _orphans(s: SparkSession, d: str) -> DataFrame:
    snaps, first = read(s, d, "snapshots"), [_first_half(s, d)]
    groups = orphan_references(_group_refs(s, d), read(s, d, "halos"), "halo_id", snaps, "withdrawn", first)
    members = orphan_references(_particle_refs(s, d), read(s, d, "particles"), "particle_id", snaps, None, first)
    return groups.unionByName(members)


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return _orphans(s, d).select("ref_field", "snapshot_id", "ref_key")


def p1_report(s: SparkSession, d: str) -> DataFrame:
    """Per referring field and snapshot: orphan keys and references by cause, beside all references."""
    by = ["ref_field", "snapshot_id"]
    counts = _orphans(s, d).groupBy(*by).agg(
        F.count("*").alias("orphan_keys"),
        F.sum("n_refs").alias("orphan_refs"),
        *[F.count_if(F.col("cause") == c).alias(f"{c}_keys") for c in ("missing", "late", "withdrawn")],
    )
    every = None
    for refs in (_group_refs(s, d), _particle_refs(s, d)):
        for i, r in enumerate(refs):
            n = reference_deltas(refs, read(s, d, "snapshots")).groupBy("snapshot_id").agg(F.sum(f"refs_{i}").alias("all_refs"))
            n = n.withColumn("ref_field", F.lit(r.name))
            every = n if every is None else every.unionByName(n)
    return every.join(counts, by, "left").na.fill(0)


def p1_current(s: SparkSession, d: str) -> DataFrame:
    """Orphans among the references of the catalogue's current rows: when a row is superseded by the second batch, its
    reference is taken back."""
    snaps, first, subs = read(s, d, "snapshots"), _first_half(s, d), read(s, d, "subhalos")
    fields = {"host_halo_id": ("halos", "halo_id", "withdrawn"), "most_bound_particle_id": ("particles", "particle_id", None)}
    before, after = (cut(rows_that_count(t, list(fields))) for t in (subs.where(first), subs))
    out: DataFrame | None = None
    for field, (table, key, withdrawn) in fields.items():
        name, targets = f"subhalos.{field}", read(s, d, table)
        made = Reference(name, before, field)
        state = merge_state(reference_deltas([made], snaps), existence_deltas(targets.where(first), key, snaps, 1, withdrawn))
        changed = Reference(name, revisions(before, after, ["track_id"], field), field, "sign")
        later = existence_deltas(targets.where(~F.coalesce(first, F.lit(False))), key, snaps, 1, withdrawn)
        rows = orphans(merge_state(state.drop("delta"), reference_deltas([changed], snaps), later), [name])
        out = rows if out is None else out.unionByName(rows)
    return out.select("ref_field", "snapshot_id", "ref_key", "n_refs", "cause")


def p2_found(s: SparkSession, d: str) -> DataFrame:
    hot = per_key_profile(read(s, d, "source_members"), "track_id", "binding_energy", overload_share=0.04)
    return hot.where("overloaded AND track_id >= 0").select("track_id")


def p2_tracks(s: SparkSession, d: str) -> DataFrame:
    """Every track's member rows, exact energy quartiles and last n_bound."""
    profile = per_key_profile(read(s, d, "source_members"), "track_id", "binding_energy").where("track_id >= 0")
    rows = rows_that_count(read(s, d, "subhalos"), ["n_bound"], read(s, d, "snapshots"))
    last = rows.groupBy("track_id").agg(F.max_by("n_bound", "snapshot_index").alias("last_n_bound"))
    return profile.join(last, "track_id", "left").select(
        "track_id",
        "n_rows",
        "n_values",
        F.col("v_sum").alias("energy_sum"),
        F.col("v_min").alias("energy_min"),
        F.col("q0").alias("energy_p25"),
        F.col("q1").alias("energy_p50"),
        F.col("q2").alias("energy_p75"),
        F.col("v_max").alias("energy_max"),
        "overloaded",
        "last_n_bound",
    )


def _changes(s: SparkSession, d: str) -> DataFrame:
    snaps = read(s, d, "snapshots")
    versions = rows_that_count(read(s, d, "subhalos"), ["n_bound"], snaps)
    ids = snaps.select("snapshot_index", F.col("snapshot_id").cast("long").alias("snapshot_id"))
    return snapshot_changes(versions, "track_id", ["n_bound"], snaps).join(ids, "snapshot_index")


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return _changes(s, d).select("snapshot_id", "track_id", "change")


def p3_summary(s: SparkSession, d: str) -> DataFrame:
    """Changes of each kind per snapshot."""
    return _changes(s, d).groupBy("snapshot_id", "change").agg(F.count("*").alias("n_tracks"))


def _links(s: SparkSession, d: str) -> DataFrame:
    rows = rows_that_count(read(s, d, "subhalos"), ["descendant_track_id"], read(s, d, "snapshots"))
    last = rows.groupBy("track_id").agg(F.max_by("descendant_track_id", "snapshot_index").alias("descendant_track_id"))
    return clean_links(last, "track_id", "descendant_track_id")


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return hierarchy(_links(s, d)).select(
        F.col("node").alias("track_id"), F.col("root").alias("root_track_id"), "depth"
    )


def p4_paths(s: SparkSession, d: str) -> DataFrame:
    """Each track's path from its final track to itself, and how many progenitors it has. Null path: a cycle."""
    tree = hierarchy(_links(s, d))
    n = ancestor_pairs(tree).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n_progenitors"))
    return tree.join(n, "node", "left").select(
        F.col("node").alias("track_id"),
        "depth",
        F.col("root").alias("root_track_id"),
        F.array_join(F.col("path").cast("array<string>"), ">").alias("path"),
        F.coalesce("n_progenitors", F.lit(0)).alias("n_progenitors"),
    )


def p4_progenitors(s: SparkSession, d: str) -> DataFrame:
    """Every progenitor of every track with its distance in links."""
    return ancestor_pairs(hierarchy(_links(s, d))).select(
        F.col("ancestor").alias("track_id"), F.col("node").alias("progenitor_track_id"), "distance"
    )


def p4_cycles(s: SparkSession, d: str) -> DataFrame:
    """Tracks whose chain never ends, and whether they lie on the cycle themselves."""
    links = _links(s, d)
    return cycles(links, hierarchy(links, paths=False)).select(F.col("node").alias("track_id"), "on_cycle")


def _history(s: SparkSession, d: str) -> DataFrame:
    snaps = read(s, d, "snapshots")
    indexes = sorted(int(r["snapshot_index"]) for r in snaps.select("snapshot_index").distinct().collect())  # one merge each
    versions = rows_that_count(read(s, d, "subhalos"), ["n_bound", "m_bound"], snaps)
    h = history(versions, "track_id", ["n_bound", "m_bound"], indexes)
    for end in ("from", "to"):
        ids = snaps.select(F.col("snapshot_index").alias(f"valid_{end}"), F.col("snapshot_id").cast("long").alias(f"{end}_snapshot_id"))
        h = h.join(small(ids), f"valid_{end}")
    return h


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return _history(s, d).select("track_id", "from_snapshot_id", "to_snapshot_id")


def p5_history(s: SparkSession, d: str) -> DataFrame:
    """Every version of every track: the values and the snapshots between which they held. NaN is told from null by
    m_bound_is_nan, m_bound being null for both."""
    return _history(s, d).select("track_id", "n_bound", *without_nan("m_bound"), "from_snapshot_id", "to_snapshot_id")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_report, p1_current, p2_found, p2_tracks, p3_found, p3_summary,
        p4_found, p4_paths, p4_progenitors, p4_cycles, p5_found, p5_history,
    )
}

_COUNTING = """
counting AS (
  SELECT s.*, t.snapshot_index FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_id, track_id ORDER BY delivered_at DESC) AS rn
    FROM subhalos WHERE track_id >= 0) s
  JOIN snapshots t ON t.snapshot_id = s.snapshot_id WHERE s.rn = 1)
"""

_ORPHANS = """
refs AS (
  SELECT 'particles.host_id' AS ref_field, snapshot_id, host_id AS ref_key, 'g' AS kind FROM particles
  UNION ALL SELECT 'subhalos.host_halo_id', snapshot_id, host_halo_id, 'g' FROM subhalos
  UNION ALL SELECT 'source_members.particle_id', snapshot_id, particle_id, 'p' FROM source_members
  UNION ALL SELECT 'subhalos.most_bound_particle_id', snapshot_id, most_bound_particle_id, 'p' FROM subhalos),
used AS (
  SELECT r.ref_field, r.snapshot_id, r.ref_key, r.kind, count(*) AS n_refs FROM refs r
  LEFT JOIN snapshots s ON s.snapshot_id = r.snapshot_id
  WHERE r.ref_key >= 0 AND (s.null_group_id IS NULL OR r.ref_key <> s.null_group_id) GROUP BY ALL),
delivered AS (
  SELECT 'g' AS kind, snapshot_id, halo_id AS k, delivered_at, NOT coalesce(withdrawn, false) AS alive FROM halos
  UNION ALL SELECT 'p', snapshot_id, particle_id, delivered_at, true FROM particles),
targets AS (
  SELECT d.kind, d.snapshot_id, d.k, true AS delivered,
    coalesce(max(s.closed_at) >= min(d.delivered_at), false) AS in_time,
    coalesce(arg_max(d.alive, d.delivered_at) FILTER (WHERE d.delivered_at <= s.closed_at), false) AS valid
  FROM delivered d LEFT JOIN snapshots s ON s.snapshot_id = d.snapshot_id GROUP BY ALL),
orphans AS (
  SELECT u.*, CASE WHEN t.delivered IS NULL THEN 'missing' WHEN t.in_time THEN 'withdrawn' ELSE 'late' END AS cause
  FROM used u LEFT JOIN targets t ON t.kind = u.kind AND t.snapshot_id = u.snapshot_id AND t.k = u.ref_key
  WHERE NOT coalesce(t.valid, false))
"""

_CHANGES = f"""
WITH {_COUNTING},
changes AS (
  SELECT b.snapshot_id::BIGINT AS snapshot_id, coalesce(x.track_id, y.track_id) AS track_id,
    CASE WHEN x.track_id IS NULL THEN 'added' WHEN y.track_id IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM (SELECT snapshot_index + 1 AS nxt, track_id, n_bound FROM counting
        WHERE snapshot_index < (SELECT max(snapshot_index) FROM snapshots)) x
  FULL JOIN (SELECT snapshot_index, track_id, n_bound FROM counting
        WHERE snapshot_index > (SELECT min(snapshot_index) FROM snapshots)) y
    ON y.snapshot_index = x.nxt AND y.track_id = x.track_id
  JOIN snapshots b ON b.snapshot_index = coalesce(x.nxt, y.snapshot_index)
  WHERE x.track_id IS NULL OR y.track_id IS NULL OR x.n_bound IS DISTINCT FROM y.n_bound)
"""

_TREE = f"""
WITH RECURSIVE {_COUNTING},
latest AS (SELECT track_id, arg_max(coalesce(descendant_track_id, -1), snapshot_index) AS d FROM counting GROUP BY track_id),
links AS (
  SELECT a.track_id, b.track_id AS parent FROM latest a
  LEFT JOIN latest b ON b.track_id = a.d AND a.d <> a.track_id),
tree AS (
  SELECT track_id, track_id AS root, 0::BIGINT AS depth, track_id::VARCHAR AS path FROM links WHERE parent IS NULL
  UNION ALL
  SELECT l.track_id, t.root, t.depth + 1, t.path || '>' || l.track_id FROM links l JOIN tree t ON l.parent = t.track_id),
pairs AS (
  SELECT track_id AS node, parent AS ancestor, 1::BIGINT AS distance FROM links
    WHERE parent IS NOT NULL AND track_id IN (SELECT track_id FROM tree)
  UNION ALL
  SELECT p.node, l.parent, p.distance + 1 FROM pairs p JOIN links l ON l.track_id = p.ancestor WHERE l.parent IS NOT NULL)
"""

_RUNS = f"""
WITH {_COUNTING},
marked AS (
  SELECT track_id, n_bound, m_bound, snapshot_index, snapshot_id,
    CASE WHEN lag(snapshot_index) OVER w = snapshot_index - 1 AND lag(n_bound) OVER w IS NOT DISTINCT FROM n_bound
      AND lag(m_bound) OVER w IS NOT DISTINCT FROM m_bound THEN 0 ELSE 1 END AS starts
  FROM counting WINDOW w AS (PARTITION BY track_id ORDER BY snapshot_index)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY track_id ORDER BY snapshot_index) AS run FROM marked),
hist AS (
  SELECT track_id, any_value(n_bound) AS n_bound, any_value(m_bound) AS m_bound,
    arg_min(snapshot_id, snapshot_index) AS from_snapshot_id, arg_max(snapshot_id, snapshot_index) AS to_snapshot_id
  FROM runs GROUP BY track_id, run)
"""

ORACLES = {
    "p1_found": f"WITH {_ORPHANS} SELECT ref_field, snapshot_id, ref_key FROM orphans",
    "p1_report": f"""WITH {_ORPHANS},
      every AS (SELECT ref_field, snapshot_id, sum(n_refs)::BIGINT AS all_refs FROM used GROUP BY ALL),
      every_period AS (SELECT f.ref_field, p.snapshot_id FROM (SELECT DISTINCT ref_field, kind FROM used) f
        JOIN (SELECT DISTINCT kind, snapshot_id FROM used) p ON p.kind = f.kind)
      SELECT g.ref_field, g.snapshot_id, coalesce(max(e.all_refs), 0)::BIGINT AS all_refs, count(o.ref_key) AS orphan_keys,
        coalesce(sum(o.n_refs), 0)::BIGINT AS orphan_refs, count(*) FILTER (WHERE o.cause = 'missing') AS missing_keys,
        count(*) FILTER (WHERE o.cause = 'late') AS late_keys, count(*) FILTER (WHERE o.cause = 'withdrawn') AS withdrawn_keys
      FROM every_period g LEFT JOIN every e ON e.ref_field = g.ref_field AND e.snapshot_id = g.snapshot_id
      LEFT JOIN orphans o ON o.ref_field = g.ref_field AND o.snapshot_id = g.snapshot_id
      GROUP BY g.ref_field, g.snapshot_id""",
    "p1_current": f"""WITH {_COUNTING}, {_ORPHANS.replace("FROM subhalos", "FROM current_rows").replace("refs AS (", """
      current_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, track_id ORDER BY delivered_at DESC) AS rn
        FROM subhalos WHERE track_id >= 0) WHERE rn = 1),
      refs AS (""", 1)}
      SELECT ref_field, snapshot_id, ref_key, n_refs, cause FROM orphans WHERE ref_field LIKE 'subhalos.%'""",
    "p2_found": """SELECT track_id FROM source_members WHERE track_id >= 0 GROUP BY track_id
      HAVING count(*) * 25 >= (SELECT count(*) FROM source_members)""",
    "p2_tracks": f"""WITH {_COUNTING},
      v AS (SELECT track_id, CASE WHEN isfinite(binding_energy) THEN binding_energy END AS e FROM source_members WHERE track_id >= 0),
      n AS (SELECT track_id, count(*) AS n_rows, count(e) AS n_values, sum(round(e, 6)::DECIMAL(28,6))::DOUBLE AS energy_sum,
        min(e) AS energy_min, max(e) AS energy_max FROM v GROUP BY track_id),
      r AS (SELECT track_id, e, row_number() OVER (PARTITION BY track_id ORDER BY e) AS k FROM v WHERE e IS NOT NULL),
      q AS (SELECT r.track_id, max(e) FILTER (WHERE k = greatest(1, ceil(0.25 * n_values))) AS energy_p25,
        max(e) FILTER (WHERE k = greatest(1, ceil(0.5 * n_values))) AS energy_p50,
        max(e) FILTER (WHERE k = greatest(1, ceil(0.75 * n_values))) AS energy_p75
        FROM r JOIN n ON n.track_id = r.track_id GROUP BY r.track_id),
      l AS (SELECT track_id, arg_max(coalesce(n_bound, -7), snapshot_index) AS b FROM counting GROUP BY track_id)
      SELECT n.*, energy_p25, energy_p50, energy_p75, n_rows * 25 >= (SELECT count(*) FROM source_members) AS overloaded,
        nullif(b, -7) AS last_n_bound FROM n LEFT JOIN q ON q.track_id = n.track_id LEFT JOIN l ON l.track_id = n.track_id""",
    "p3_found": f"{_CHANGES} SELECT snapshot_id, track_id, change FROM changes",
    "p3_summary": f"{_CHANGES} SELECT snapshot_id, change, count(*) AS n_tracks FROM changes GROUP BY ALL",
    "p4_found": f"""{_TREE} SELECT l.track_id, coalesce(t.root, -1) AS root_track_id, coalesce(t.depth, -1) AS depth
      FROM links l LEFT JOIN tree t ON t.track_id = l.track_id""",
    "p4_paths": f"""{_TREE} SELECT l.track_id, coalesce(t.root, -1) AS root_track_id, coalesce(t.depth, -1) AS depth, t.path,
      (SELECT count(*) FROM pairs p WHERE p.ancestor = l.track_id) AS n_progenitors
      FROM links l LEFT JOIN tree t ON t.track_id = l.track_id""",
    "p4_progenitors": f"{_TREE} SELECT ancestor AS track_id, node AS progenitor_track_id, distance FROM pairs",
    "p4_cycles": f"""{_TREE},
      lost AS (SELECT * FROM links WHERE track_id NOT IN (SELECT track_id FROM tree)),
      reach AS (SELECT track_id, parent AS via FROM lost
        UNION SELECT r.track_id, l.parent FROM reach r JOIN lost l ON l.track_id = r.via)
      SELECT track_id, bool_or(via = track_id) AS on_cycle FROM reach GROUP BY track_id""",
    "p5_found": f"{_RUNS} SELECT track_id, from_snapshot_id, to_snapshot_id FROM hist",
    "p5_history": f"""{_RUNS} SELECT track_id, n_bound, CASE WHEN NOT isnan(m_bound) THEN m_bound END AS m_bound,
      coalesce(isnan(m_bound), false) AS m_bound_is_nan, from_snapshot_id, to_snapshot_id FROM hist""",
}
