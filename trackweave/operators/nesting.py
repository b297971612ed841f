"""Nested tracks: parents, heads, depth, visiting order and who keeps a shared member."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.operators.hierarchy import clean_links, hierarchy
from trackweave.operators.votes import first_tracers

#: Tracks of different snapshots are nodes of one forest under snapshot_index * SHIFT + track_id.
SHIFT = 1 << 44
_LAST = 2**31 - 1


def node(index: str = "snapshot_index", track: str = "track_id") -> Column:
    return F.when(F.col(track) >= 0, F.col(index).cast("long") * SHIFT + F.col(track))


def parents_from_lists(tracks: DataFrame, by: Sequence[str], children: str = "nested_subhalos") -> DataFrame:
    """(by, track_id, parent, nest_order): each child listed by a track, with its place in the list.

    A child listed twice keeps its first parent by (parent, place); empty and null lists name none.
    """
    listed = tracks.select(*by, F.col("track_id").alias("parent"), F.posexplode(children).alias("nest_order", "child"))
    first = F.min(F.struct("parent", "nest_order"))
    return (
        listed.where("child >= 0 AND child <> parent")
        .groupBy(*by, F.col("child").alias("track_id"))
        .agg(first.alias("p"))
        .select(*by, "track_id", F.col("p.parent").alias("parent"), F.col("p.nest_order").alias("nest_order"))
    )


def level_up(tracks: DataFrame, by: Sequence[str], host: str = "host_id", parent: str = "parent", rank: str = "rank") -> DataFrame:
    """tracks with `parent` null where the track leaves its nest: its parent is gone, is in another host, or it is
    itself a head, of rank 0 or without a host (G3, G4)."""
    up = tracks.select(*by, F.col("track_id").alias(parent), F.col(host).alias("_h"))
    stays = F.col("_h").isNotNull() & (F.col("_h") == F.col(host)) & (F.col(host) >= 0) & (F.coalesce(F.col(rank), F.lit(0)) != 0)
    joined = tracks.join(up, [*by, parent], "left")
    return joined.withColumn(parent, F.when(stays, F.col(parent))).drop("_h").select(*tracks.columns)


def extend_central(tracks: DataFrame, by: Sequence[str], centrals: DataFrame, host: str = "host_id", parent: str = "parent") -> DataFrame:
    """tracks with the heads of each host nested under its central; the central itself becomes a head.

    centrals: (by, host, central). Tracks without a host stay heads.
    """
    c = centrals.select(*by, host, F.col("central").alias("_c"))
    joined = tracks.join(c, [*by, host], "left")
    head = F.col(parent).isNull()
    under = F.when(F.col("_c") == F.col("track_id"), F.lit(None)).when(head & (F.col(host) >= 0), F.col("_c")).otherwise(F.col(parent))
    return joined.withColumn(parent, under).drop("_c").select(*tracks.columns)


def nest_tree(tracks: DataFrame, parent: str = "parent", index: str = "snapshot_index") -> DataFrame:
    """(node, root, depth, path) of all snapshots' nests in one pass (G1); see `hierarchy`. depth -1: a cycle."""
    n = tracks.select(node(index).alias("node"), node(index, parent).alias("parent"))
    return hierarchy(clean_links(n, "node", "parent"))


def visiting_key(tree: DataFrame, orders: DataFrame) -> DataFrame:
    """(node, visit): a key that sorts a nest's tracks depth first, children before their parent, siblings in order.

    orders: (node, nest_order). The key is the list of the ancestors' places, ended by a value after all others.
    """
    steps = tree.where("depth >= 0").select("node", F.posexplode("path").alias("at", "step"))
    named = steps.join(orders.select(F.col("node").alias("step"), "nest_order"), "step", "left")
    place = F.struct("at", F.coalesce("nest_order", F.lit(_LAST - 1)).alias("o"), F.col("step").alias("s"))
    paths = named.groupBy("node").agg(F.sort_array(F.collect_list(place)).alias("p"))  # one entry per level of depth
    key = F.transform("p", lambda x: F.struct(x["o"].cast("long").alias("o"), x["s"].alias("s")))
    end = F.array(F.struct(F.lit(_LAST).cast("long").alias("o"), F.lit(0).cast("long").alias("s")))
    return paths.select("node", F.concat(key, end).alias("visit"))


def mask(members: DataFrame, by: Sequence[str], visit: str, skip: Column | None = None) -> DataFrame:
    """The members that stay: of tracks of one host that share a particle, the one visited first keeps it.

    Tracks for which `skip` holds (orphans, newborn centrals) neither lose nor claim. The claim is a min per host and
    particle, so no group is gathered.
    """
    claims = members if skip is None else members.where(~skip)
    first = claims.groupBy(*by, "particle_id").agg(F.min(F.struct(F.col(visit), F.col("track_id"))).alias("_f"))
    joined = claims.join(first, [*by, "particle_id"]).where(F.col("track_id") == F.col("_f.track_id")).drop("_f")
    return joined if skip is None else joined.unionByName(members.where(skip))


def clean_tracks(members: DataFrame, by: Sequence[str], visit: str, depth: str, tracer: Column, n_reserved: int) -> DataFrame:
    """The members that stay when tracks of one host share particles: first every track's n_reserved best tracers,
    those of upper tracks before those of lower ones, then the others to the track visited first (D2, D3)."""
    keys = [*by, "track_id"]
    reserved = first_tracers(members, keys, n_reserved, tracer, spill=False).select(*keys, "particle_id", F.lit(0).alias("_turn"))
    marked = members.join(reserved, [*keys, "particle_id"], "left").withColumn("_turn", F.coalesce("_turn", F.lit(1)))
    place = F.struct(F.col("_turn"), F.when(F.col("_turn") == 0, F.col(depth)).otherwise(0).alias("d"), F.col(visit).alias("v"), F.col("track_id"))
    first = marked.groupBy(*by, "particle_id").agg(F.min(place).alias("_f"))
    return marked.join(first, [*by, "particle_id"]).where(F.col("track_id") == F.col("_f.track_id")).drop("_f", "_turn")


def promoted(members: DataFrame, by: Sequence[str], place: str = "member_rank", rank: str = "rank") -> DataFrame:
    """(by, track_id, particle_id): the most bound member of each track that no lesser track of the group holds.

    `place` is the track's rank in its group, 0 the most massive; lesser tracks have greater ones. A track whose members
    all belong to lesser ones as well gets no row and keeps its own most bound member.
    """
    least = members.groupBy(*by, "particle_id").agg(F.max(place).alias("_least"))
    own = members.join(least, [*by, "particle_id"]).where(F.col(place) == F.col("_least"))
    return own.groupBy(*by, "track_id").agg(F.min_by("particle_id", F.struct(rank, "particle_id")).alias("particle_id"))


def pass_up(members: DataFrame, nests: DataFrame, by: Sequence[str], bound: str = "bound") -> DataFrame:
    """members with the unbound ones of nested tracks handed to the parent's source (D5). nests: (by, track_id, parent)."""
    up = members.join(nests.where("parent IS NOT NULL"), [*by, "track_id"], "left")
    moves = F.col("parent").isNotNull() & ~F.coalesce(F.col(bound), F.lit(False))
    return up.withColumn("track_id", F.when(moves, F.col("parent")).otherwise(F.col("track_id"))).drop("parent")


def seeds(groups: DataFrame, tracks: DataFrame, by: Sequence[str]) -> DataFrame:
    """The hosts (by, host_id) without any track, each of which starts a new one."""
    return groups.join(tracks.select(*by, "host_id").distinct(), [*by, "host_id"], "left_anti")
