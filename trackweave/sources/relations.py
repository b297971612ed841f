"""The clean relations that operators work on: one row per key, from tables with repeated and late deliveries.

Each keeps, per key, the row delivered last; aggregates have fixed-width buffers, so repeated deliveries are reduced
before the shuffle. Snapshot scalars (one row per snapshot, counted) are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions.geometry import wrap
from trackweave.runtime import small
from trackweave.sources.tables import read, rows_that_count

EPOCH = ["snapshot_index", "scale_factor", "hz", "box_size", "softening", "max_physical_softening"]


def snapshots(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "snapshots").withColumn("snapshot_id", F.col("snapshot_id").cast("long"))


def with_epoch(df: DataFrame, s: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    """df with the scalars of its snapshot; rows of unlisted snapshots are left out."""
    return df.join(small(snapshots(s, d).select("snapshot_id", *(columns or EPOCH))), "snapshot_id")


def _latest(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    at = F.coalesce("delivered_at", F.lit(0).cast("timestamp"))
    return df.groupBy(*keys).agg(*[F.max_by(c, at).alias(c) for c in columns])


def particles(s: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    """One row per snapshot and particle: x, y, z wrapped into the box, u 0 for null, host_id -1 for no group."""
    cols = columns or ["x", "y", "z", "vx", "vy", "vz", "mass", "u", "type", "host_id"]
    raw = read(s, d, "particles").where("particle_id >= 0")
    p = with_epoch(_latest(raw, ["snapshot_id", "particle_id"], cols), s, d, [*EPOCH, "null_group_id"])
    none = F.col("host_id").isNull() | (F.col("host_id") < 0) | F.col("host_id").eqNullSafe(F.col("null_group_id"))
    fixes = {c: wrap(c, "box_size") for c in ("x", "y", "z")} | {
        "u": F.coalesce("u", F.lit(0.0)),
        "host_id": F.when(none, -1).otherwise(F.col("host_id")).cast("long"),
    }
    return p.withColumns({c: e for c, e in fixes.items() if c in cols}).drop("null_group_id")


def groups(s: SparkSession, d: str) -> DataFrame:
    """One row per snapshot and group delivered in time and not withdrawn."""
    cols = ["x", "y", "z", "vx", "vy", "vz", "mass", "n_part", "withdrawn"]
    raw = with_epoch(read(s, d, "halos").where("halo_id >= 0"), s, d, ["closed_at"]).where("delivered_at <= closed_at")
    return _latest(raw, ["snapshot_id", "halo_id"], cols).where("NOT coalesce(withdrawn, false)").drop("withdrawn")


def tracks(s: SparkSession, d: str, columns: list[str]) -> DataFrame:
    """The rows that count of the catalogue, with snapshot_index."""
    return rows_that_count(read(s, d, "subhalos"), columns, snapshots(s, d))


def members(s: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    """One row per snapshot, track and member particle, ordered by rank (0 = most bound)."""
    raw = read(s, d, "source_members").where("track_id >= 0 AND particle_id >= 0")
    cols = columns or ["rank", "bound", "binding_energy", "potential_energy"]
    return _latest(raw, ["snapshot_id", "track_id", "particle_id"], cols)


#: The same relations in SQL.
SQL = {
    "parts": """parts AS (
  SELECT r.snapshot_id, r.particle_id, (r.x / s.box_size - floor(r.x / s.box_size)) * s.box_size AS x,
    (r.y / s.box_size - floor(r.y / s.box_size)) * s.box_size AS y, (r.z / s.box_size - floor(r.z / s.box_size)) * s.box_size AS z,
    r.vx, r.vy, r.vz, r.mass, coalesce(r.u, 0) AS u, r.type,
    CASE WHEN r.host_id >= 0 AND r.host_id IS DISTINCT FROM s.null_group_id THEN r.host_id ELSE -1 END AS host_id,
    s.snapshot_index, s.scale_factor, s.hz, s.box_size, s.softening, s.max_physical_softening
  FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, particle_id ORDER BY delivered_at DESC) AS rn
    FROM particles WHERE particle_id >= 0) r JOIN snapshots s ON s.snapshot_id = r.snapshot_id WHERE r.rn = 1)""",
    "fofs": """fofs AS (
  SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY h.snapshot_id, h.halo_id ORDER BY h.delivered_at DESC) AS rn
    FROM halos h JOIN snapshots s ON s.snapshot_id = h.snapshot_id WHERE h.halo_id >= 0 AND h.delivered_at <= s.closed_at)
  WHERE rn = 1 AND NOT coalesce(withdrawn, false))""",
    "subs": """subs AS (
  SELECT s.*, t.snapshot_index FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_id, track_id ORDER BY delivered_at DESC) AS rn
    FROM subhalos WHERE track_id >= 0) s JOIN snapshots t ON t.snapshot_id = s.snapshot_id WHERE s.rn = 1)""",
    "mems": """mems AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, track_id, particle_id ORDER BY delivered_at DESC) AS rn
    FROM source_members WHERE track_id >= 0 AND particle_id >= 0) WHERE rn = 1)""",
}


def sql(*names: str, recursive: bool = False) -> str:
    """A WITH clause of the named relations."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in names)
