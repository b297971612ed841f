"""Queries of nests, neighbours, splits, gravity and the catalogue on disk (D*, G1-G13, J7, J10-J12, J19, A19, A20, P*, IO*)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.config import Config
from trackweave.functions import geometry as g
from trackweave.functions import physics as ph
from trackweave.operators import gravity as gr
from trackweave.operators import nesting as nest
from trackweave.operators import positions as pos
from trackweave.operators import progenitors as pg
from trackweave.operators import spatial as sp
from trackweave.operators.aggregates import mean_motion
from trackweave.operators.properties import track_properties
from trackweave.operators.ranking import positions_within
from trackweave.plans.aggregates import KEYS, TRACER, bound_members
from trackweave.plans.aggregates import ORACLES as _AG
from trackweave.runtime import cut, ensure_checkpoint_dir
from trackweave.sources import catalogue_io as cio
from trackweave.sources.relations import groups, members, particles, snapshots, sql, tracks

CONFIG = Config()
LINK, RADIUS = 1.5, 4.0
MOVES = ("x", "y", "z", "vx", "vy", "vz")


def _box(s: SparkSession, d: str) -> float:
    return float(snapshots(s, d).agg(F.max("box_size")).first()[0] or 1.0)


def _nests(s: SparkSession, d: str) -> DataFrame:
    t = tracks(s, d, ["host_halo_id", "rank", "n_bound", "snapshot_of_birth", "nested_parent_track_id"])
    return t.select(
        *KEYS, "snapshot_index", F.coalesce("host_halo_id", F.lit(-1)).alias("host_id"), "rank", "n_bound", "snapshot_of_birth", F.col("nested_parent_track_id").alias("parent")
    )


def _visits(s: SparkSession, d: str, t: DataFrame) -> DataFrame:
    """Tracks with the depth and visiting order of their nest; siblings in order of their track id."""
    tree = nest.nest_tree(t).select("node", "depth", "path")
    orders = t.select(nest.node().alias("node"), F.col("track_id").alias("nest_order"))
    keys = nest.visiting_key(tree, orders)
    return t.withColumn("node", nest.node()).join(tree.select("node", F.col("depth").alias("nest_depth")), "node").join(keys, "node")


def d1_mask(s: SparkSession, d: str) -> DataFrame:
    """Members left to every track after shared ones went to the deepest track of the group."""
    t = _visits(s, d, _nests(s, d)).select(*KEYS, "host_id", "n_bound", "snapshot_of_birth", "visit")
    m = members(s, d, ["rank"]).join(t, KEYS)
    skip = (F.coalesce("n_bound", F.lit(0)) <= 1) | (F.coalesce("snapshot_of_birth", F.lit(-1)) == F.col("snapshot_id"))
    return nest.mask(m, ["snapshot_id", "host_id"], "visit", skip).groupBy(*KEYS).agg(F.count("*").alias("n_left"))


def d2_clean(s: SparkSession, d: str) -> DataFrame:
    """Members left to every track when first its ten best tracers are reserved, then depth decides (also D3)."""
    t = _visits(s, d, _nests(s, d)).select(*KEYS, "host_id", "nest_depth", "visit")
    p = particles(s, d, ["type"]).select("snapshot_id", "particle_id", "type")
    m = members(s, d, ["rank"]).join(t, KEYS).join(p, ["snapshot_id", "particle_id"])
    out = nest.clean_tracks(m, ["snapshot_id", "host_id"], "visit", "nest_depth", TRACER(), CONFIG.MinNumTracerPartOfSub)
    return out.groupBy(*KEYS).agg(F.count("*").alias("n_left"))


def d4_promoted(s: SparkSession, d: str) -> DataFrame:
    """The most bound member of every track that no less massive track of its group holds."""
    from trackweave.operators.ranking import member_ranks

    t = tracks(s, d, ["host_halo_id", "n_bound", "m_bound"]).where("n_bound > 1 AND host_halo_id >= 0")
    mass = F.coalesce(F.when(~F.isnan("m_bound"), F.col("m_bound")), F.lit(-1.0))
    placed = member_ranks(t, ["snapshot_id", "host_halo_id"], [mass.desc(), F.col("track_id").desc()])
    m = members(s, d, ["rank", "bound"]).where("bound").join(placed.select(*KEYS, "host_halo_id", "member_rank"), KEYS)
    return nest.promoted(m, ["snapshot_id", "host_halo_id"])


def d5_pass_up(s: SparkSession, d: str) -> DataFrame:
    """Members of every track after unbound ones of nested tracks were handed to the parent."""
    t = _nests(s, d).select(*KEYS, F.when(F.col("parent") >= 0, F.col("parent")).alias("parent"))
    m = members(s, d).select(*KEYS, "particle_id", "bound")
    return nest.pass_up(m, t, ["snapshot_id"]).groupBy(*KEYS).agg(F.count("*").alias("n_members"))


def d10_fakes(s: SparkSession, d: str) -> DataFrame:
    """Tracks without those that were born and never bound, counted per snapshot, and the number of the latter."""
    t = tracks(s, d, ["n_bound", "snapshot_of_birth"])
    fake = (F.coalesce("n_bound", F.lit(0)) <= 1) & F.col("snapshot_of_birth").eqNullSafe(F.col("snapshot_id"))
    return t.groupBy("snapshot_id").agg(F.count_if(~fake).alias("n_kept"), F.count_if(fake).alias("n_fake"))


def d10_kept(s: SparkSession, d: str) -> DataFrame:
    """The tracks left when those that were born and never bound are removed."""
    t = tracks(s, d, ["n_bound", "snapshot_of_birth"])
    fake = (F.coalesce("n_bound", F.lit(0)) <= 1) & F.col("snapshot_of_birth").eqNullSafe(F.col("snapshot_id"))
    return t.where(~fake).select(*KEYS)


def d11_seeds(s: SparkSession, d: str) -> DataFrame:
    """Groups without a track, each of which starts one."""
    h = groups(s, d).select("snapshot_id", F.col("halo_id").alias("host_id"))
    return nest.seeds(h, _nests(s, d), ["snapshot_id"])


def g1_depths(s: SparkSession, d: str) -> DataFrame:
    """Depth and head of every track's nest."""
    tree = nest.nest_tree(_nests(s, d))
    return _nests(s, d).select(*KEYS, nest.node().alias("node")).join(tree, "node").select(
        *KEYS, "depth", F.when(F.col("root") >= 0, F.col("root") % nest.SHIFT).otherwise(-1).alias("head")
    )


def g2_parents(s: SparkSession, d: str) -> DataFrame:
    """Every track's parent as its parent lists it, with its place in the list."""
    return nest.parents_from_lists(tracks(s, d, ["nested_subhalos"]), ["snapshot_id"])


def g3_level_up(s: SparkSession, d: str) -> DataFrame:
    """Parents left after detached tracks left their nests."""
    out = nest.level_up(_nests(s, d), ["snapshot_id"])
    return out.select(*KEYS, "parent")


def g5_nest(s: SparkSession, d: str) -> DataFrame:
    """Parents after the heads of every group were nested under its central, the most massive head by members."""
    t = nest.level_up(_nests(s, d), ["snapshot_id"])
    best = F.max(F.struct(F.coalesce("n_bound", F.lit(0)).alias("n"), (-F.col("track_id")).alias("t")))
    c = t.where("host_id >= 0").groupBy("snapshot_id", "host_id").agg(best.alias("b")).select("snapshot_id", "host_id", (-F.col("b.t")).alias("central"))
    return nest.extend_central(t, ["snapshot_id"], c).select(*KEYS, "parent")


def g11_split_trees(s: SparkSession, d: str) -> DataFrame:
    """Particles that stem from others by their ids read as split trees: root id >> 3, path in the low three bits."""
    p = particles(s, d, ["type"]).select(
        "snapshot_index", "particle_id", F.shiftright("particle_id", 3).alias("r"), F.col("particle_id").bitwiseAND(F.lit(7)).alias("low")
    )
    count = F.when(F.col("low") < 2, 1).when(F.col("low") < 4, 2).otherwise(3)
    t = p.select("particle_id", F.struct("snapshot_index", "r").alias("root"), count.alias("count"), F.col("low").alias("tree"))
    old = t.withColumn("root", F.struct((F.col("root.snapshot_index") + 1).alias("snapshot_index"), F.col("root.r").alias("r")))
    return pg.split_descendants(old, t)


def g13_split_links(s: SparkSession, d: str) -> DataFrame:
    """Tracks that ended in one track, linked parent -> first -> second ... in order of their ids."""
    t = tracks(s, d, ["descendant_track_id"])
    last = t.groupBy("track_id").agg(F.max_by("descendant_track_id", "snapshot_index").alias("d")).where("d >= 0 AND d <> track_id")
    return pg.encode_splits(last.select(F.col("d").alias("parent"), F.col("track_id").alias("child")))


def j7_with_splits(s: SparkSession, d: str) -> DataFrame:
    """Members with the particles split off from them, by a map of ids to the next higher id of the same octet."""
    p = particles(s, d, ["type"]).select(F.shiftright("particle_id", 3).alias("o"), "particle_id").distinct()
    first = p.groupBy("o").agg(F.min("particle_id").alias("parent"))
    kids = p.join(first, "o").where("particle_id > parent").select("parent", F.col("particle_id").alias("child"))
    closure = pg.split_closure(pg.encode_splits(kids)).select("particle_id", "child")
    m = members(s, d, ["rank"]).select(*KEYS, "particle_id")
    return pg.with_splits(m, closure, KEYS).groupBy(*KEYS).agg(F.count("*").alias("n_members"))


def _located(s: SparkSession, d: str) -> DataFrame:
    return particles(s, d, ["x", "y", "z", "type", "host_id"])


def _centres(s: SparkSession, d: str) -> DataFrame:
    """Group centres as queries; those without a position ask for nothing."""
    h = groups(s, d).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    return h.select("snapshot_id", F.col("halo_id").alias("centre_id"), *[g.wrap(c, _box(s, d)).alias(c) for c in "xyz"])


def j10_neighbours(s: SparkSession, d: str) -> DataFrame:
    """The ten nearest tracers of every other particle of a group."""
    p = _located(s, d).where("host_id >= 0")
    q = p.where(~TRACER()).withColumnRenamed("particle_id", "query_id")
    near = sp.nearest_neighbours(q, p.where(TRACER()), ["snapshot_id", "host_id"], 10, _box(s, d))
    return near.select("snapshot_id", "query_id", "place", "particle_id", F.round("r", 6).alias("r"))


def v4_reassign(s: SparkSession, d: str) -> DataFrame:
    """Non-tracers that move to the track of their nearest tracer, as none of the ten nearest is of their own."""
    own = members(s, d, ["rank"]).groupBy("snapshot_id", "particle_id").agg(F.min("track_id").alias("track_id"))
    p = _located(s, d).where("host_id >= 0").join(own, ["snapshot_id", "particle_id"])
    q = p.where(~TRACER()).withColumnRenamed("particle_id", "query_id")
    out = sp.reassign(q, p.where(TRACER()), ["snapshot_id", "host_id"], CONFIG.NumNeighboursForReassignment, _box(s, d))
    return out.where("track_id <> new_track_id").select("snapshot_id", F.col("query_id").alias("particle_id"), "track_id", "new_track_id")


def j11_sphere(s: SparkSession, d: str) -> DataFrame:
    """Particles within a radius of every group's centre."""
    near = sp.within_radius(_centres(s, d), _located(s, d), ["snapshot_id"], RADIUS, _box(s, d))
    return near.select("snapshot_id", "centre_id", "particle_id", F.round("r", 6).alias("r"))


def j11_shell(s: SparkSession, d: str) -> DataFrame:
    """Particles per group centre in the shell between half the radius and the radius."""
    near = sp.within_radius(_centres(s, d), _located(s, d), ["snapshot_id"], RADIUS, _box(s, d), RADIUS / 2)
    return near.groupBy("snapshot_id", "centre_id").agg(F.count("*").alias("n"))


def j11_cylinder(s: SparkSession, d: str) -> DataFrame:
    """Particles per group centre in a cylinder along z."""
    near = sp.within_cylinder(_centres(s, d), _located(s, d), ["snapshot_id"], 5.0, 2.0, _box(s, d))
    return near.groupBy("snapshot_id", "centre_id").agg(F.count("*").alias("n"))


def w8_nearest(s: SparkSession, d: str) -> DataFrame:
    """The particle nearest to every group's centre."""
    q = _centres(s, d).withColumnRenamed("centre_id", "query_id")
    near = sp.nearest_neighbours(q, _located(s, d), ["snapshot_id"], 1, _box(s, d))
    return near.select("snapshot_id", F.col("query_id").alias("halo_id"), "particle_id", F.round("r", 6).alias("r"))


def j12_linked(s: SparkSession, d: str) -> DataFrame:
    """Friends-of-friends groups of the particles of every snapshot."""
    return sp.friends_of_friends(_located(s, d), ["snapshot_id"], LINK, _box(s, d))


def j19_painted(s: SparkSession, d: str) -> DataFrame:
    """The group that covers every particle's id, if groups in order of their ids cover as many positions as they
    have members (also IO8)."""
    h = pos.offsets(groups(s, d).select("snapshot_id", "halo_id", "n_part"), ["snapshot_id"], "halo_id", "n_part")
    p = particles(s, d, ["type"]).select("snapshot_id", "particle_id")
    return pos.paint(p, "particle_id", h, ["snapshot_id"], "halo_id")


def a19_multipoles(s: SparkSession, d: str) -> DataFrame:
    """Count, mass and centre of mass of every octree cell of five levels, per snapshot."""
    p = particles(s, d, ["x", "y", "z", "mass"])
    m = sp.multipoles(p, ["snapshot_id"], 4)
    return m.select("snapshot_id", "level", "cx", "cy", "cz", "n", F.round("mass", 8).alias("mass"), F.round("x", 5).alias("x"))


def a20_density(s: SparkSession, d: str) -> DataFrame:
    """Smoothed number density at every group's centre from its 64 nearest particles."""
    q = _centres(s, d).withColumnRenamed("centre_id", "query_id")
    rho = sp.sph_density(q, _located(s, d), ["snapshot_id"], 64, _box(s, d))
    return rho.select("snapshot_id", F.col("query_id").alias("halo_id"), F.round("h", 6).alias("h"), F.round("density", 9).alias("density"))


def _selves(s: SparkSession, d: str) -> DataFrame:
    """Bound members of each snapshot's tracks as groups of one gravity run."""
    soft = ph.softening("softening", "max_physical_softening", "scale_factor")
    return bound_members(s, d).withColumns({"g": nest.node(), "soft": soft}).drop("bound", "binding_energy", "potential_energy")


def phys1_potential(s: SparkSession, d: str) -> DataFrame:
    """Softened potential of every bound member from the members of its track."""
    m = _selves(s, d)
    phi = gr.potentials(m, 0)
    return phi.select((F.col("g") % nest.SHIFT).alias("track_id"), F.floor(F.col("g") / nest.SHIFT).cast("int").alias("snapshot_index"), "particle_id", F.round("phi", 6).alias("phi"))


def phys2_energy(s: SparkSession, d: str) -> DataFrame:
    """Binding energy of every bound member in the mean frame of its track."""
    m = cut(_selves(s, d))
    frames = mean_motion(m, ["g"], "rank").where("mass > 0")
    e = gr.energies(m, gr.potentials(m, 0), frames, ph.GRAVITY)
    return e.select("snapshot_id", "track_id", "particle_id", F.round("energy", 2).alias("energy"))


def _unbound(s: SparkSession, d: str, max_sources: int) -> DataFrame:
    m = _selves(s, d).select("g", "particle_id", *MOVES, "mass", "type", "u", "soft", "hz", "scale_factor", "box_size")
    out = gr.unbind(m, max_sources=max_sources, with_energies=False)[1]
    return out.select((F.col("g") % nest.SHIFT).alias("track_id"), F.floor(F.col("g") / nest.SHIFT).cast("int").alias("snapshot_index"), "n_bound", F.round("m_bound", 8).alias("m_bound"), "disrupted")


def phys3_unbind(s: SparkSession, d: str) -> DataFrame:
    """Every track after iterative unbinding by all of its members: bound members and mass, or disrupted."""
    return _unbound(s, d, 0)


def phys3_sampled(s: SparkSession, d: str) -> DataFrame:
    """The same with potentials from a sample of the sources of tracks above its size (P5)."""
    return _unbound(s, d, CONFIG.MaxSampleSizeOfPotentialEstimate)


def w6_refined_order(s: SparkSession, d: str) -> DataFrame:
    """Bound members of every track by energy, the innermost of tracks with sampled sources by their own potential."""
    m = _selves(s, d)
    frames = mean_motion(m, ["g"], "rank").where("mass > 0")
    e = cut(gr.energies(m, gr.potentials(m, CONFIG.MaxSampleSizeOfPotentialEstimate, CONFIG.keep_mask), frames, ph.GRAVITY))
    places = gr.refined(e, CONFIG.MaxSampleSizeOfPotentialEstimate, CONFIG.BoundFractionCenterRefinement)
    plain = positions_within(e, ["g"], [F.col("energy"), F.col("particle_id")]).withColumnRenamed("position", "_p")
    return plain.join(places, ["g", "particle_id"], "left").select(*KEYS, "particle_id", F.coalesce("place", "_p").alias("place"))


def phys7_overlaps(s: SparkSession, d: str) -> DataFrame:
    """Every nested track not yet trapped beside each of its ancestors that has bound members (`parent`, so many levels
    up), and whether it sinks into it: into the deepest one that it overlaps in phase space (P7, P8)."""
    from trackweave.operators.aggregates import core
    from trackweave.operators.hierarchy import ancestor_pairs
    from trackweave.operators.votes import first_tracers

    best = first_tracers(bound_members(s, d), KEYS, CONFIG.SubCoreSizeMin, TRACER())
    times = snapshots(s, d).select(F.col("snapshot_id").alias("snapshot_of_sink"), F.col("snapshot_index").alias("_sunk"))
    t = tracks(s, d, ["snapshot_of_sink", "comoving_most_bound_position", "physical_most_bound_velocity"])
    t = t.join(F.broadcast(times), "snapshot_of_sink", "left").withColumn("node", nest.node())
    return _sinks(core(best, KEYS, "order"), t, ancestor_pairs(nest.nest_tree(_nests(s, d))), _box(s, d))


def _sinks(cores: DataFrame, t: DataFrame, pairs: DataFrame, box: float) -> DataFrame:
    """Rows of phys7_overlaps. t: node, keys, snapshot_index, _sunk (index of the sink, null for none) and the place of the
    most bound particle, which stands for a track without bound members."""
    at = {x: F.get("comoving_most_bound_position" if x in "xyz" else "physical_most_bound_velocity", F.lit(i % 3)) for i, x in enumerate(MOVES)}
    c = cut(t.join(cores, KEYS, "left").withColumns({x: F.when(F.col("n") > 0, F.col(x)).otherwise(e) for x, e in at.items()}))
    own = c.where("n > 1 OR _sunk IS NULL OR _sunk >= snapshot_index").select("node", *KEYS, *MOVES)  # a resolved track is free again
    ref = c.where("n > 1").select(F.col("node").alias("ancestor"), F.col("track_id").alias("parent"), *[F.col(x).alias(f"p{x}") for x in MOVES], "sigma_r", "sigma_v")
    j = own.join(pairs, "node").join(ref, "ancestor")
    dist = ph.phase_space_distance(g.distance2(g.vec(""), g.vec("p"), box), g.distance2(g.vec("v"), g.vec("pv")), F.col("sigma_r"), F.col("sigma_v"))
    near = j.select(*KEYS, "parent", F.col("distance").alias("levels"), dist.alias("distance")).withColumn("_near", F.coalesce(F.col("distance") < 2, F.lit(False)))
    first = F.min(F.when(F.col("_near"), F.col("levels"))).over(Window.partitionBy(*KEYS))  # a row per level
    sinks = F.coalesce(F.col("_near") & (F.col("levels") == first), F.lit(False))
    return near.select(*KEYS, "parent", "levels", F.round("distance", 4).alias("distance"), sinks.alias("sinks"))


def io14_catalogue(s: SparkSession, d: str) -> DataFrame:
    """Rows and members per snapshot of the catalogue written sorted by track and read again (also IO16, IO19)."""
    ensure_checkpoint_dir(s)
    path = f"{s.sparkContext.getCheckpointDir()}/catalogue-{uuid.uuid4().hex}"
    cio.write_catalogue(tracks(s, d, ["n_bound", "m_bound", "host_halo_id"]), path)
    back = cio.read_catalogue(s, path, ["track_id", "n_bound"])
    return back.groupBy(F.col("snapshot_id").cast("long").alias("snapshot_id")).agg(F.count("*").alias("n"), F.sum("n_bound").alias("n_bound"))


def io14_properties(s: SparkSession, d: str) -> DataFrame:
    """The properties of every track with bound members, as the catalogue written with them gives them back."""
    soft = ph.softening("softening", "max_physical_softening", "scale_factor")
    b = bound_members(s, d).withColumns({"soft": soft, "density": ph.virial_density(200.0, "hz", "scale_factor")})
    ensure_checkpoint_dir(s)
    path = f"{s.sparkContext.getCheckpointDir()}/catalogue-{uuid.uuid4().hex}"
    cio.write_catalogue(track_properties(b, KEYS, TRACER(), "binding_energy"), path)
    back = cio.read_catalogue(s, path)
    digits = {"n_bound_type": 0, "m_bound_type": 8, "comoving_average_position": 5, "physical_average_velocity": 4, "specific_angular_momentum": 2}
    digits |= {"inertial_tensor": 4, "inertial_tensor_weighted": 6}
    names = {"n_bound_type": "n", "m_bound_type": "m", "comoving_average_position": "p", "physical_average_velocity": "v", "specific_angular_momentum": "l"}
    names |= {"inertial_tensor": "i", "inertial_tensor_weighted": "w"}
    sizes = {"n": 6, "m": 6, "p": 3, "v": 3, "l": 3, "i": 6, "w": 6}
    flat = [
        (F.round(F.get(c, F.lit(k)), n) if n else F.get(c, F.lit(k))).alias(f"{names[c]}_{k}") for c, n in digits.items() for k in range(sizes[names[c]])
    ]
    return back.select(
        F.col("snapshot_id").cast("long").alias("snapshot_id"),
        "track_id",
        "tracer_index",
        *flat,
        F.round("specific_self_potential_energy", 2).alias("potential"),
        F.round("specific_self_kinetic_energy", 2).alias("kinetic"),
        F.round("bound_m200_crit", 6).alias("m200"),
        F.round("bound_r200_crit_comoving", 6).alias("r200"),
    )


def phys3_round(s: SparkSession, d: str) -> DataFrame:
    """What one round of unbinding leaves of every track, by all of its members: bound members, tracers and mass."""
    m = cut(_selves(s, d))
    frames = mean_motion(m, ["g"], "rank").where("mass > 0")
    e = gr.energies(m, gr.potentials(m, 0), frames, ph.GRAVITY).where(F.abs("energy") > 0.01)  # rounding decides nothing
    bound = ph.is_bound("energy")
    return e.groupBy(*KEYS).agg(
        F.count("*").alias("n"),
        F.count_if(bound).alias("n_bound"),
        F.count_if(bound & TRACER()).alias("n_tracers"),
        F.round(F.coalesce(F.sum(F.when(bound, F.col("mass"))), F.lit(0.0)), 8).alias("m_bound"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        d1_mask, d2_clean, d4_promoted, d5_pass_up, d10_fakes, d10_kept, d11_seeds, g1_depths, g2_parents, g3_level_up, g5_nest, g11_split_trees, g13_split_links,
        j7_with_splits, j10_neighbours, v4_reassign, j11_sphere, j11_shell, j11_cylinder, w8_nearest, j12_linked, j19_painted,
        a19_multipoles, a20_density, phys1_potential, phys2_energy, phys3_unbind, phys3_round, phys3_sampled, w6_refined_order, phys7_overlaps, io14_catalogue, io14_properties,
    )
}

_N = f"""{sql("subs", "mems", "parts", recursive=True)},
  nests AS (SELECT t.snapshot_id, t.snapshot_index, t.track_id, coalesce(t.host_halo_id, -1) AS host_id, t.rank, t.n_bound, t.snapshot_of_birth,
    t.nested_parent_track_id AS parent, p.track_id AS up, coalesce(p.host_halo_id, -1) AS up_host FROM subs t LEFT JOIN subs p
    ON p.snapshot_id = t.snapshot_id AND p.track_id = t.nested_parent_track_id AND p.track_id <> t.track_id),
  tree AS (SELECT snapshot_id, track_id, 0::BIGINT AS depth, track_id AS head, [track_id] AS path FROM nests WHERE up IS NULL
    UNION ALL SELECT n.snapshot_id, n.track_id, t.depth + 1, t.head, list_append(t.path, n.track_id) FROM nests n
      JOIN tree t ON t.snapshot_id = n.snapshot_id AND t.track_id = n.up),
  lev AS (SELECT snapshot_id, track_id, host_id, n_bound, CASE WHEN up IS NOT NULL AND up_host = host_id AND host_id >= 0 AND coalesce(rank, 0) <> 0 THEN parent END AS parent FROM nests),
  vis AS (SELECT n.*, t.depth, list_append(t.path, 9223372036854775807) AS visit FROM nests n JOIN tree t ON t.snapshot_id = n.snapshot_id AND t.track_id = n.track_id)"""


def _near(e: str, box: str = "100.0") -> str:
    return f"CASE WHEN {e} > {box} / 2 THEN {e} - {box} WHEN {e} < -{box} / 2 THEN {e} + {box} ELSE {e} END"


def _pairs(a: str, b: str, box: str = "(SELECT max(box_size) FROM snapshots)") -> str:
    return " + ".join(f"pow({_near(f'({a}.{c} - {b}.{c})', 'bx.l')}, 2)" for c in "xyz")


_BX = "bx AS (SELECT max(box_size) AS l FROM snapshots)"
_CEN = "cen AS (SELECT snapshot_id, halo_id, (x / l - floor(x / l)) * l AS x, (y / l - floor(y / l)) * l AS y, (z / l - floor(z / l)) * l AS z FROM fofs, bx)"
_KERNEL = """CASE WHEN r >= h THEN -1 / r WHEN r / h < 0.5 THEN (-2.8::DOUBLE + pow(r / h, 2) * (5.333333333333::DOUBLE + pow(r / h, 2) * (6.4::DOUBLE * r / h - 9.6::DOUBLE))) / h
  ELSE (-3.2::DOUBLE + 0.066666666667::DOUBLE / (r / h) + pow(r / h, 2) * (10.666666666667::DOUBLE + r / h * (-16.0::DOUBLE + r / h * (9.6::DOUBLE - 2.133333333333::DOUBLE * r / h)))) / h END"""
_PHI = f"""{sql("mems", "parts")}, {_BX},
  b AS (SELECT m.track_id, m.rank, p.*, 2.8::DOUBLE * CASE WHEN max_physical_softening < 0 THEN softening ELSE least(softening, max_physical_softening / scale_factor) END AS h
    FROM mems m JOIN parts p ON p.snapshot_id = m.snapshot_id AND p.particle_id = m.particle_id WHERE m.bound),
  prs AS (SELECT i.snapshot_id, i.snapshot_index, i.track_id, i.particle_id, i.h, j.mass AS mj, sqrt({_pairs("i", "j")}) AS r FROM b i
    JOIN b j ON j.snapshot_id = i.snapshot_id AND j.track_id = i.track_id AND j.particle_id <> i.particle_id, bx),
  phi AS (SELECT snapshot_id, snapshot_index, track_id, particle_id, sum(mj * ({_KERNEL})) AS phi FROM prs GROUP BY ALL)"""
_KNN = f"""{sql("parts")}, {_BX},
  knn AS (SELECT q.snapshot_id, q.host_id, q.particle_id AS query_id, p.particle_id, sqrt({_pairs("q", "p")}) AS r FROM parts q
    JOIN parts p ON p.snapshot_id = q.snapshot_id AND p.host_id = q.host_id, bx WHERE q.host_id >= 0 AND NOT coalesce(q.type IN (1, 4), false) AND p.type IN (1, 4)),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, query_id ORDER BY r, particle_id) AS place FROM knn) WHERE place <= 10)"""
_BALL = f"""{sql("fofs", "parts")}, {_BX}, {_CEN},
  ball AS (SELECT c.snapshot_id, c.halo_id AS centre_id, p.particle_id, sqrt({_pairs("c", "p")}) AS r FROM cen c JOIN parts p ON p.snapshot_id = c.snapshot_id, bx WHERE c.x IS NOT NULL)"""

ORACLES = {
    "d1_mask": f"""{_N}, m AS (SELECT v.*, x.particle_id, coalesce(v.n_bound, 0) <= 1 OR coalesce(v.snapshot_of_birth, -1) = v.snapshot_id AS skip
        FROM mems x JOIN vis v ON v.snapshot_id = x.snapshot_id AND v.track_id = x.track_id),
      k AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, host_id, particle_id, skip ORDER BY visit, track_id) AS k FROM m)
      SELECT snapshot_id, track_id, count(*) AS n_left FROM k WHERE skip OR k = 1 GROUP BY ALL""",
    "d2_clean": f"""{_N}, m AS (SELECT v.snapshot_id, v.host_id, v.track_id, v.depth, v.visit, x.particle_id, x.rank, coalesce(p.type IN (1, 4), false) AS tracer
        FROM mems x JOIN vis v ON v.snapshot_id = x.snapshot_id AND v.track_id = x.track_id JOIN parts p ON p.snapshot_id = x.snapshot_id AND p.particle_id = x.particle_id),
      r AS (SELECT *, CASE WHEN tracer AND row_number() OVER (PARTITION BY snapshot_id, track_id, tracer ORDER BY rank, particle_id) <= 10 THEN 0 ELSE 1 END AS turn FROM m),
      k AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, host_id, particle_id ORDER BY turn, CASE WHEN turn = 0 THEN depth ELSE 0 END, visit, track_id) AS k FROM r)
      SELECT snapshot_id, track_id, count(*) AS n_left FROM k WHERE k = 1 GROUP BY ALL""",
    "d4_promoted": f"""{sql("subs", "mems")}, t AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, host_halo_id
        ORDER BY coalesce(CASE WHEN NOT isnan(m_bound) THEN m_bound END, -1) DESC, track_id DESC) AS place FROM subs WHERE n_bound > 1 AND host_halo_id >= 0),
      m AS (SELECT t.snapshot_id, t.host_halo_id, t.track_id, x.particle_id, x.rank, t.place, max(t.place) OVER (PARTITION BY t.snapshot_id, t.host_halo_id, x.particle_id) AS least
        FROM mems x JOIN t ON t.snapshot_id = x.snapshot_id AND t.track_id = x.track_id WHERE x.bound)
      SELECT snapshot_id, host_halo_id, track_id, particle_id FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, track_id ORDER BY rank, particle_id) AS k
        FROM m WHERE place = least) WHERE k = 1""",
    "d5_pass_up": f"""{sql("subs", "mems")} SELECT m.snapshot_id, CASE WHEN t.nested_parent_track_id >= 0 AND NOT coalesce(m.bound, false) THEN t.nested_parent_track_id
      ELSE m.track_id END AS track_id, count(*) AS n_members FROM mems m LEFT JOIN subs t ON t.snapshot_id = m.snapshot_id AND t.track_id = m.track_id GROUP BY 1, 2""",
    "d10_fakes": f"""{sql("subs")} SELECT snapshot_id, count(*) FILTER (WHERE NOT (coalesce(n_bound, 0) <= 1 AND snapshot_of_birth IS NOT DISTINCT FROM snapshot_id)) AS n_kept,
      count(*) FILTER (WHERE coalesce(n_bound, 0) <= 1 AND snapshot_of_birth IS NOT DISTINCT FROM snapshot_id) AS n_fake FROM subs GROUP BY snapshot_id""",
    "d10_kept": f"""{sql("subs")} SELECT snapshot_id, track_id FROM subs
      WHERE NOT (coalesce(n_bound, 0) <= 1 AND snapshot_of_birth IS NOT DISTINCT FROM snapshot_id)""",
    "d11_seeds": f"""{sql("subs", "fofs")} SELECT snapshot_id, halo_id AS host_id FROM fofs f WHERE NOT EXISTS (
      SELECT 1 FROM subs t WHERE t.snapshot_id = f.snapshot_id AND t.host_halo_id = f.halo_id)""",
    "g1_depths": f"""{_N} SELECT n.snapshot_id, n.track_id, coalesce(t.depth, -1) AS depth, coalesce(t.head, -1) AS head FROM nests n
      LEFT JOIN tree t ON t.snapshot_id = n.snapshot_id AND t.track_id = n.track_id""",
    "g2_parents": f"""{sql("subs")}, l AS (SELECT snapshot_id, track_id AS parent, unnest(nested_subhalos) AS track_id, generate_subscripts(nested_subhalos, 1) - 1 AS nest_order FROM subs)
      SELECT snapshot_id, track_id, parent, nest_order::INTEGER AS nest_order FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, track_id ORDER BY parent, nest_order) AS k
      FROM l WHERE track_id >= 0 AND track_id <> parent) WHERE k = 1""",
    "g3_level_up": f"{_N} SELECT snapshot_id, track_id, parent FROM lev",
    "g5_nest": f"""{_N}, c AS (SELECT *, first_value(track_id) OVER (PARTITION BY snapshot_id, host_id ORDER BY coalesce(n_bound, 0) DESC, track_id) AS central FROM lev)
      SELECT snapshot_id, track_id, CASE WHEN host_id >= 0 AND central = track_id THEN NULL WHEN host_id >= 0 AND parent IS NULL THEN central ELSE parent END AS parent FROM c""",
    "g11_split_trees": f"""{sql("parts")}, t AS (SELECT snapshot_index, particle_id, particle_id >> 3 AS r, particle_id & 7 AS tree,
        CASE WHEN particle_id & 7 < 2 THEN 1 WHEN particle_id & 7 < 4 THEN 2 ELSE 3 END AS n FROM parts)
      SELECT a.particle_id, b.particle_id AS child FROM t a JOIN t b ON b.snapshot_index = a.snapshot_index + 1 AND b.r = a.r
      WHERE b.n > a.n AND (b.tree & ((1 << a.n) - 1)) = (a.tree & ((1 << a.n) - 1)) AND a.particle_id <> b.particle_id""",
    "g13_split_links": f"""{sql("subs")}, l AS (SELECT track_id, arg_max(coalesce(descendant_track_id, -1), snapshot_index) AS d FROM subs GROUP BY track_id)
      SELECT coalesce(lag(track_id) OVER (PARTITION BY d ORDER BY track_id), d) AS key, track_id AS value FROM l WHERE d >= 0 AND d <> track_id""",
    "j7_with_splits": f"""{sql("mems", "parts")}, p AS (SELECT DISTINCT particle_id FROM parts),
      m AS (SELECT snapshot_id, track_id, particle_id FROM mems),
      e AS (SELECT m.snapshot_id, m.track_id, p.particle_id FROM m JOIN p ON p.particle_id >> 3 = m.particle_id >> 3 AND p.particle_id > m.particle_id
        WHERE m.particle_id IN (SELECT particle_id FROM p))
      SELECT snapshot_id, track_id, count(*) AS n_members FROM (SELECT * FROM m UNION SELECT * FROM e) GROUP BY ALL""",
    "j10_neighbours": f"{_KNN} SELECT snapshot_id, query_id, place::INTEGER AS place, particle_id, round(r, 6) AS r FROM best",
    "v4_reassign": f"""{sql("parts", "mems")}, {_BX}, own AS (SELECT snapshot_id, particle_id, min(track_id) AS track_id FROM mems GROUP BY ALL),
      o AS (SELECT p.*, own.track_id FROM parts p JOIN own ON own.snapshot_id = p.snapshot_id AND own.particle_id = p.particle_id WHERE p.host_id >= 0),
      knn AS (SELECT q.snapshot_id, q.particle_id, q.track_id, p.track_id AS t, p.particle_id AS nid, sqrt({_pairs("q", "p")}) AS r FROM o q
        JOIN o p ON p.snapshot_id = q.snapshot_id AND p.host_id = q.host_id, bx WHERE NOT coalesce(q.type IN (1, 4), false) AND p.type IN (1, 4)),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, particle_id ORDER BY r, nid) AS place FROM knn) WHERE place <= 10)
      SELECT snapshot_id, particle_id, track_id, any_value(t) FILTER (WHERE place = 1) AS new_track_id FROM best GROUP BY ALL HAVING NOT bool_or(t = track_id)""",
    "j11_sphere": f"{_BALL} SELECT snapshot_id, centre_id, particle_id, round(r, 6) AS r FROM ball WHERE r < {RADIUS}",
    "j11_shell": f"{_BALL} SELECT snapshot_id, centre_id, count(*) AS n FROM ball WHERE r < {RADIUS} AND r > {RADIUS / 2} GROUP BY ALL",
    "j11_cylinder": f"""{sql("fofs", "parts")}, {_BX}, {_CEN}, d AS (SELECT c.snapshot_id, c.halo_id AS centre_id, {_near("(p.x - c.x)", "bx.l")} AS dx,
        {_near("(p.y - c.y)", "bx.l")} AS dy, {_near("(p.z - c.z)", "bx.l")} AS dz FROM cen c JOIN parts p ON p.snapshot_id = c.snapshot_id, bx)
      SELECT snapshot_id, centre_id, count(*) AS n FROM d WHERE abs(dz) < 5.0 AND dx * dx + dy * dy < 4.0 GROUP BY ALL""",
    "w8_nearest": f"""{_BALL} SELECT snapshot_id, centre_id AS halo_id, particle_id, round(r, 6) AS r FROM (SELECT *, row_number() OVER (
      PARTITION BY snapshot_id, centre_id ORDER BY r, particle_id) AS k FROM ball) WHERE k = 1""",
    "j12_linked": f"""{sql("parts", recursive=True)}, {_BX},
      e AS (SELECT a.snapshot_id AS s, a.particle_id AS a, b.particle_id AS b FROM parts a JOIN parts b ON b.snapshot_id = a.snapshot_id, bx WHERE {_pairs("a", "b")} < {LINK * LINK}),
      r AS (SELECT s, a, b FROM e UNION SELECT r.s, r.a, e.b FROM r JOIN e ON e.s = r.s AND e.a = r.b),
      t AS (SELECT s AS snapshot_id, a AS particle_id, min(b) AS tag, count(*) AS length FROM r GROUP BY ALL) SELECT * FROM t""",
    "j19_painted": f"""{sql("fofs", "parts")}, o AS (SELECT snapshot_id, halo_id, coalesce(n_part, 0) AS n, sum(coalesce(n_part, 0)) OVER (PARTITION BY snapshot_id ORDER BY halo_id) AS e FROM fofs)
      SELECT p.snapshot_id, p.particle_id, coalesce(o.halo_id, -1) AS halo_id FROM parts p LEFT JOIN o ON o.snapshot_id = p.snapshot_id
      AND p.particle_id >= o.e - o.n AND p.particle_id < o.e""",
    "a19_multipoles": f"""{sql("parts")}, l AS (SELECT *, unnest(range(5)) AS level FROM parts),
      c AS (SELECT *, {", ".join(f"greatest(0, least(15, floor({a} / (box_size / 16))))::BIGINT >> (4 - level) AS c{a}" for a in "xyz")} FROM l)
      SELECT snapshot_id, level::INTEGER AS level, cx::INTEGER AS cx, cy::INTEGER AS cy, cz::INTEGER AS cz, count(*) AS n, round(sum(mass), 8) AS mass,
        CASE WHEN sum(mass) <> 0 THEN round(sum(mass * x) / sum(mass), 5) END AS x FROM c GROUP BY ALL""",
    "a20_density": f"""{_BALL}, k AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, centre_id ORDER BY r, particle_id) AS k FROM ball),
      h AS (SELECT *, max(r) OVER (PARTITION BY snapshot_id, centre_id) AS h FROM k WHERE k <= 64)
      SELECT snapshot_id, centre_id AS halo_id, round(h, 6) AS h, round(sum(CASE WHEN r / h < 0.5 THEN 2.546479089470::DOUBLE + 15.278874536822::DOUBLE * (r / h - 1) * pow(r / h, 2)
        ELSE 5.092958178941::DOUBLE * pow(1 - r / h, 3) END) / pow(h, 3), 9) AS density FROM h GROUP BY snapshot_id, centre_id, h.h HAVING count(*) = 64 AND h.h > 0""",
    "phys1_potential": f"""{_PHI} SELECT b.track_id, b.snapshot_index, b.particle_id, round(coalesce(p.phi, 0), 6) AS phi FROM b
      LEFT JOIN phi p ON p.snapshot_id = b.snapshot_id AND p.track_id = b.track_id AND p.particle_id = b.particle_id""",
    "phys2_energy": f"""{_PHI}, f AS (SELECT *, {", ".join(f"first_value({a}) OVER (PARTITION BY snapshot_id, track_id ORDER BY rank, particle_id) AS o{a}" for a in "xyz")} FROM b),
      c AS (SELECT *, {", ".join(f"{_near(f'({a} - o{a})', 'box_size')} AS d{a}" for a in "xyz")} FROM f),
      m AS (SELECT snapshot_id, track_id, {", ".join(f"sum(mass * d{a}) / sum(mass) + any_value(o{a}) AS m{a}, sum(mass * v{a}) / sum(mass) AS mv{a}" for a in "xyz")}
        FROM c GROUP BY ALL HAVING sum(mass) > 0),
      w AS (SELECT c.*, {", ".join(f"v{a} - mv{a} + hz * scale_factor * ({_near(f'({a} - m{a})', 'box_size')}) AS w{a}" for a in "xyz")} FROM c JOIN m
        ON m.snapshot_id = c.snapshot_id AND m.track_id = c.track_id)
      SELECT w.snapshot_id, w.track_id, w.particle_id, round(0.5 * (wx * wx + wy * wy + wz * wz) + coalesce(p.phi, 0) * 43.0071::DOUBLE / scale_factor, 2) AS energy
      FROM w LEFT JOIN phi p ON p.snapshot_id = w.snapshot_id AND p.track_id = w.track_id AND p.particle_id = w.particle_id""",
    "phys3_round": f"""{_PHI}, f AS (SELECT *, {", ".join(f"first_value({a}) OVER (PARTITION BY snapshot_id, track_id ORDER BY rank, particle_id) AS o{a}" for a in "xyz")} FROM b),
      c AS (SELECT *, {", ".join(f"{_near(f'({a} - o{a})', 'box_size')} AS d{a}" for a in "xyz")} FROM f),
      m AS (SELECT snapshot_id, track_id, {", ".join(f"sum(mass * d{a}) / sum(mass) + any_value(o{a}) AS m{a}, sum(mass * v{a}) / sum(mass) AS mv{a}" for a in "xyz")}
        FROM c GROUP BY ALL HAVING sum(mass) > 0),
      w AS (SELECT c.*, {", ".join(f"v{a} - mv{a} + hz * scale_factor * ({_near(f'({a} - m{a})', 'box_size')}) AS w{a}" for a in "xyz")} FROM c JOIN m
        ON m.snapshot_id = c.snapshot_id AND m.track_id = c.track_id),
      e AS (SELECT w.*, 0.5 * (wx * wx + wy * wy + wz * wz) + coalesce(p.phi, 0) * 43.0071::DOUBLE / scale_factor AS energy
        FROM w LEFT JOIN phi p ON p.snapshot_id = w.snapshot_id AND p.track_id = w.track_id AND p.particle_id = w.particle_id)
      SELECT snapshot_id, track_id, count(*) AS n, count(*) FILTER (WHERE energy < 0) AS n_bound, count(*) FILTER (WHERE energy < 0 AND type IN (1, 4)) AS n_tracers,
        round(coalesce(sum(mass) FILTER (WHERE energy < 0), 0), 8) AS m_bound FROM e WHERE abs(energy) > 0.01 GROUP BY ALL""",
    "io14_properties": f"""SELECT k.snapshot_id, k.track_id, x.tracer_index, {", ".join(f"k.n_{i}, k.m_{i}" for i in range(6))},
      {", ".join(f"a.{c} AS p_{i}, a.v{c} AS v_{i}, e.l{c} AS l_{i}" for i, c in enumerate("xyz"))},
      {", ".join(f"t.i{p} AS i_{i}, t.w_i{p} AS w_{i}" for i, p in enumerate(("xx", "xy", "xz", "yy", "yz", "zz")))},
      e.potential, e.kinetic, r.m_over AS m200, r.r_over AS r200
      FROM ({_AG["a3_types"]}) k JOIN ({_AG["a4_tracer_index"]}) x USING (snapshot_id, track_id) JOIN ({_AG["a1_mean_motion"]}) a USING (snapshot_id, track_id)
      JOIN ({_AG["a7_kinematics"]}) e USING (snapshot_id, track_id) JOIN ({_AG["a10_inertia"]}) t USING (snapshot_id, track_id)
      JOIN ({_AG["a8_profiles"]}) r USING (snapshot_id, track_id)""",
    "io14_catalogue": f"{sql('subs')} SELECT snapshot_id, count(*) AS n, sum(n_bound)::BIGINT AS n_bound FROM subs GROUP BY snapshot_id",
}
