"""Merger trees: progenitors, mass ratios, splits of particles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.operators.hierarchy import ancestor_pairs, clean_links, hierarchy


def merge_links(tracks: DataFrame) -> DataFrame:
    """(track_id, target, kind) of every dead track: `sink` if it sank when it died, into the track it sank into;
    `disruption` if it died unsunk or sank later, into its descendant (G7, G8). Targets of -1 and null are left out."""
    dead = F.coalesce(F.col("snapshot_of_death"), F.lit(-1)) != -1
    sink = F.coalesce(F.col("snapshot_of_sink"), F.lit(-1))
    sunk = sink == F.col("snapshot_of_death")
    disrupted = (sink == -1) | (sink > F.col("snapshot_of_death"))
    kind = F.when(sunk, "sink").when(disrupted, "disruption")
    target = F.when(sunk, F.col("sink_track_id")).when(disrupted, F.col("descendant_track_id"))
    return tracks.where(dead).select("track_id", target.alias("target"), kind.alias("kind")).where("target >= 0")


def all_progenitors(tracks: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(track_id, progenitor, distance): direct progenitors at distance 1 and theirs beyond.

    Tracks that lead into a cycle have none. One row per pair, which is the result asked for. With `of` (node) only the
    trees below these tracks are walked, for a track on a cycle all that lead to it; pairs below them come along.
    """
    links = tracks.select("track_id").join(merge_links(tracks), "track_id", "left")
    tree = hierarchy(clean_links(links, "track_id", "target"), start=of)
    return ancestor_pairs(tree).select(F.col("ancestor").alias("track_id"), F.col("node").alias("progenitor"), "distance")


def mass_ratio(links: DataFrame, tracks: DataFrame, history: DataFrame) -> DataFrame:
    """(track_id, target, ratio): the peak mass of each merged track over its target's mass in the same snapshot.

    tracks: track_id, last_max_mass, snapshot_of_last_max_mass. history: snapshot_id, track_id, m_bound. Targets
    without a row there or without mass give null.
    """
    peak = links.join(tracks.select("track_id", "last_max_mass", F.col("snapshot_of_last_max_mass").cast("long").alias("snapshot_id")), "track_id")
    main = history.select("snapshot_id", F.col("track_id").alias("target"), F.col("m_bound").alias("_m"))
    joined = peak.join(main, ["snapshot_id", "target"], "left")
    return joined.select("track_id", "target", F.try_divide("last_max_mass", F.when(~F.isnan("_m"), F.col("_m"))).alias("ratio"))


def encode_splits(children: DataFrame) -> DataFrame:
    """(key, value) links p -> c0, c0 -> c1, ... from rows (parent, child) with children in ascending order.

    Repeated rows count once. A child of two parents or one that is its own parent is an error of the table and raises
    at run time, as keys and values must each be unique.
    """
    from pyspark.sql import Window

    pairs = children.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child").distinct()
    w = Window.partitionBy("parent").orderBy("child")
    links = pairs.select(F.coalesce(F.lag("child").over(w), F.col("parent")).alias("key"), F.col("child").alias("value"))
    per_value = Window.partitionBy("value")
    wrong = (F.count("*").over(per_value) > 1) | (F.col("key") == F.col("value"))
    checked = F.when(wrong, F.raise_error(F.lit("a value occurs twice in the split links"))).otherwise(F.col("value"))
    return links.withColumn("value", checked.cast("long"))


def split_closure(links: DataFrame) -> DataFrame:
    """(particle_id, child, distance) for each particle and all that follow it along the links."""
    nodes = links.select(F.col("key").alias("n"), F.lit(None).cast("long").alias("p")).unionByName(
        links.select(F.col("value").alias("n"), F.col("key").alias("p"))
    )
    one = nodes.groupBy("n").agg(F.max("p").alias("p"))
    return ancestor_pairs(hierarchy(clean_links(one, "n", "p"))).select(
        F.col("ancestor").alias("particle_id"), F.col("node").alias("child"), "distance"
    )


def with_splits(members: DataFrame, closure: DataFrame, keys: Sequence[str] = ("track_id",)) -> DataFrame:
    """members (keys, particle_id) with the split-off particles appended to the track that holds their parent."""
    extra = members.join(closure, "particle_id").select(*keys, F.col("child").alias("particle_id"))
    return members.select(*keys, "particle_id").unionByName(extra).distinct()


def split_descendants(old: DataFrame, new: DataFrame) -> DataFrame:
    """(particle_id, child): new particles that stem from an old one by their binary split trees.

    Rows hold particle_id, root, count (bits used) and tree (the path as bits, lowest first). A tree may also be text of
    0 and 1, the first split first, for paths longer than 63 bits; count is then its length and need not be given. A
    child shares the root and the path of its parent and has split further, so each new particle asks once for every
    beginning of its own path: rows grow with the depth of a tree, not with the particles of a root. Null roots and trees
    match nothing.
    """
    if dict(new.dtypes)["tree"] == "string":
        upto = lambda n: F.substring(F.col("tree"), F.lit(1), n)
        length = F.length("tree")
        known = old.select(F.col("particle_id").alias("parent"), "root", F.length("tree").alias("_n"), F.col("tree").alias("_path"))
    else:
        upto = lambda n: F.col("tree").cast("long").bitwiseAND(F.when(n < 63, F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1).otherwise((1 << 63) - 1))
        length = F.col("count").cast("int")
        known = old.select(F.col("particle_id").alias("parent"), "root", length.alias("_n"), upto(length).alias("_path"))
    parts = F.transform(F.sequence(F.lit(0), length - 1), lambda n: F.struct(n.alias("_n"), upto(n).alias("_path")))
    asks = new.where(length > 0).select("particle_id", "root", F.explode(parts).alias("p")).select("particle_id", "root", "p.*")
    kin = asks.join(known, ["root", "_n", "_path"]).where(F.col("particle_id") != F.col("parent"))
    return kin.select(F.col("parent").alias("particle_id"), F.col("particle_id").alias("child"))


def match_tracks(a: DataFrame, b: DataFrame) -> DataFrame:
    """(track_id, matched): tracks of two catalogues born in the same snapshot and host.

    Both hold track_id, snapshot_of_birth, birth_host. Where several match, the lowest is taken; none gives null;
    births without a host match nothing.
    """
    keys = ["snapshot_of_birth", "birth_host"]
    first = b.where("birth_host >= 0").groupBy(*keys).agg(F.min("track_id").alias("matched"))
    return a.join(first, keys, "left").select("track_id", "matched")


def evolution(history: DataFrame, wanted: DataFrame, births: DataFrame) -> DataFrame:
    """The rows of the wanted tracks from their birth on (J18); `births`: track_id, birth_index. Order by snapshot_index."""
    w = wanted.select("track_id").distinct().join(births, "track_id")
    return history.join(w, "track_id").where(F.col("snapshot_index") >= F.col("birth_index")).drop("birth_index")


def alive(death: Column) -> Column:
    return F.coalesce(death, F.lit(-1)) == -1
