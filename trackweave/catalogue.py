"""The catalogue as a user queries it: properties, members, evolution, progenitors, units (section 3.2).

Every method returns a DataFrame; filters and columns reach the Parquet scan. Ids asked for come from the caller's
memory, so they are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.operators import progenitors as pg
from trackweave.sources import relations
from trackweave.sources.catalogue_io import by_track, read_catalogue
from trackweave.sources.tables import read, rows_that_count

DEATHS = ["snapshot_of_death", "snapshot_of_sink", "sink_track_id", "descendant_track_id"]


class Catalogue:
    """tracks: one row per snapshot_id and track_id. members (optional): snapshot_id, track_id, rank, particle_id,
    bound. snapshots: snapshot_id, snapshot_index and the scalars of each snapshot."""

    def __init__(self, tracks: DataFrame, snapshots: DataFrame, members: DataFrame | None = None) -> None:
        self.tracks, self.members = tracks, members
        self.snapshots = snapshots.withColumn("snapshot_id", F.col("snapshot_id").cast("long"))

    @classmethod
    def from_tables(cls, spark: SparkSession, folder: str) -> Catalogue:
        """Over the delivered tables, reduced to the rows that count."""
        raw = read(spark, folder, "subhalos")
        columns = [c for c in raw.columns if c not in ("snapshot_id", "track_id", "delivered_at")]
        return cls(rows_that_count(raw, columns), relations.snapshots(spark, folder), relations.members(spark, folder))

    @classmethod
    def open(cls, spark: SparkSession, path: str, snapshots: DataFrame) -> Catalogue:
        """Over a catalogue written by the pipeline or `write_catalogue`."""
        return cls(read_catalogue(spark, path), snapshots, spark.read.parquet(f"{path}/source"))

    def last(self) -> int:
        """The id of the last snapshot that holds a track."""
        held = self.tracks.select(F.col("snapshot_id").cast("long").alias("snapshot_id")).distinct()
        found = held.join(self.snapshots, "snapshot_id").agg(F.max_by("snapshot_id", "snapshot_index")).first()[0]
        if found is None:
            raise LookupError("the catalogue holds no snapshot")
        return int(found)

    def _at(self, snapshot_id: int | None) -> DataFrame:
        return self.tracks.where(F.col("snapshot_id") == (self.last() if snapshot_id is None else snapshot_id))

    def counts(self) -> DataFrame:
        """(snapshot_id, n_tracks) of every snapshot."""
        return self.tracks.groupBy("snapshot_id").agg(F.count("*").alias("n_tracks"))

    def properties(
        self,
        snapshot_id: int | None = None,
        track_ids: Sequence[int] | None = None,
        columns: Sequence[str] | None = None,
        missing: int | None = None,
    ) -> DataFrame:
        """Columns of all tracks of a snapshot (by default the last), or of those asked for in their order; ids that
        are not there raise unless a fill value is given."""
        at = self._at(snapshot_id)
        names = list(columns) if columns is not None else [c for c in at.columns if c not in ("track_id", "snapshot_id")]
        if track_ids is None:
            return at.select("track_id", *[c for c in names if c != "track_id"])
        return by_track(at, track_ids, [c for c in names if c != "track_id"], missing)

    def member_ids(self, snapshot_id: int | None = None, track_ids: Sequence[int] | None = None, source: bool = False) -> DataFrame:
        """(track_id, rank, particle_id) of bound members, or of whole sources, most bound first within a track."""
        if self.members is None:
            raise LookupError("this catalogue has no members")
        m = self.members.where(F.col("snapshot_id") == (self.last() if snapshot_id is None else snapshot_id))
        m = m if source else m.where("bound")
        m = m if track_ids is None else m.where(F.col("track_id").isin(*track_ids))
        return m.select("track_id", "rank", "particle_id")

    def evolution(self, track_ids: Sequence[int], columns: Sequence[str], birth: str = "snapshot_of_birth") -> DataFrame:
        """The rows of the tracks asked for in all snapshots since their birth, with snapshot_index."""
        own = self.tracks.where(F.col("track_id").isin(*track_ids)).join(self.snapshots.select("snapshot_id", "snapshot_index"), "snapshot_id")
        born = own.groupBy("track_id").agg(F.max_by(birth, "snapshot_index").cast("long").alias("snapshot_id"))
        births = born.join(self.snapshots.select("snapshot_id", F.col("snapshot_index").alias("birth_index")), "snapshot_id").drop("snapshot_id")
        return pg.evolution(own, births.select("track_id"), births).select("track_id", "snapshot_id", "snapshot_index", *columns)

    def _ended(self) -> DataFrame:
        t = self.tracks.select("snapshot_id", "track_id", *DEATHS).join(self.snapshots.select("snapshot_id", "snapshot_index"), "snapshot_id")
        return t.groupBy("track_id").agg(*[F.max_by(c, "snapshot_index").alias(c) for c in DEATHS])

    def progenitors(self, track_id: int, kind: str | None = None, direct: bool = False) -> DataFrame:
        """(progenitor) of one track, ascending: those that sank into it (`sink`), that disrupted into it (`disruption`)
        or both, and with direct=False also theirs. kind stands for direct ones only."""
        ended = self._ended()
        if kind is not None or direct:
            links = pg.merge_links(ended).where(F.col("target") == track_id)
            links = links if kind is None else links.where(F.col("kind") == kind)
            return links.select(F.col("track_id").alias("progenitor")).orderBy("progenitor")
        asked = ended.where(F.col("track_id") == track_id).select(F.col("track_id").alias("node"))
        return pg.all_progenitors(ended, asked).where(F.col("track_id") == track_id).select("progenitor").orderBy("progenitor")

    def scale_factors(self) -> dict[int, float]:
        """Scale factor by snapshot id."""
        return {int(r["snapshot_id"]): r["scale_factor"] for r in self.snapshots.select("snapshot_id", "scale_factor").collect()}

    def units(self) -> dict[str, float]:
        """Mass in solar masses / h, length in Mpc / h and velocity in km/s of the catalogue's numbers."""
        names = ["mass_in_msunh", "length_in_mpch", "vel_in_kms"]
        row = self.snapshots.select(*names).first()
        return {n: row[n] for n in names}
