"""Following tracks from one snapshot to the next (sections 2.11 and 3.1): state + snapshot -> state.

The state is two tables: `tracks`, one row per track ever found, and `members`, the source of every living track in
order of binding. A step is a sequence of joins, votes and grouped aggregates over whole tables; only the unbinding
loops until it settles. Every stage that is read more than once is cut from the lineage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.config import Config
from trackweave.functions import geometry as g
from trackweave.functions import physics as ph
from trackweave.operators import aggregates as ag
from trackweave.operators import gravity as gr
from trackweave.operators import nesting as nest
from trackweave.operators import profiles as pr
from trackweave.operators import ranking as rk
from trackweave.operators import spatial as sp
from trackweave.operators import votes
from trackweave.operators.hierarchy import ancestor_pairs
from trackweave.operators.properties import track_properties
from trackweave.runtime import cut
from trackweave.sources import catalogue_io as cio
from trackweave.sources import formats

#: New tracks carry this plus their host's id until they are known to be bound.
NEW = 1 << 42
TRACKS = (
    "track_id long, host_id long, parent long, nest_order long, rank long, depth int, n_bound long, m_bound double, "
    "most_bound_particle_id long, birth long, death long, sink long, sink_track_id long, descendant_track_id long, "
    "last_max_mass double, at_max_mass long, vmax double, rmax double, r_half double, r_enclose double, "
    "last_max_vmax double, at_max_vmax long, last_isolation long, "
    "x double, y double, z double, vx double, vy double, vz double, sigma_r double, sigma_v double"
)
MEMBERS = "track_id long, rank long, particle_id long, bound boolean"
MOTION = ["x", "y", "z", "vx", "vy", "vz"]


@dataclass(frozen=True)
class Snapshot:
    """One output: particles (particle_id, x, y, z, vx, vy, vz, mass, u, type, host_id; -1 for no group) and scalars."""

    index: int
    id: int
    particles: DataFrame
    scale_factor: float
    hz: float
    splits: DataFrame | None = None


@dataclass(frozen=True)
class State:
    """tracks and members go on into the next step; properties are what the catalogue adds for tracks with bound members."""

    tracks: DataFrame
    members: DataFrame
    properties: DataFrame | None = None

    @staticmethod
    def empty(spark: SparkSession) -> State:
        return State(spark.createDataFrame([], TRACKS), spark.createDataFrame([], MEMBERS))


def _vote_hosts(tracks: DataFrame, members: DataFrame, particles: DataFrame, c: Config) -> DataFrame:
    """(track_id, host_id): by the best bound tracers, or by the one particle an orphan follows; -1 if unknown."""
    tracer = ph.is_tracer("type", c.tracer_mask)
    best = votes.first_tracers(members.where("bound"), ["track_id"], c.NumTracerHostFinding, tracer, spill=False)
    voted = votes.weighted_host(best, ["track_id"]).select("track_id", "host_id")
    orphans = tracks.where("n_bound <= 1").select("track_id", F.col("most_bound_particle_id").alias("particle_id"))
    followed = orphans.join(particles.select("particle_id", "host_id"), "particle_id").select("track_id", "host_id")
    every = voted.unionByName(followed.join(voted, "track_id", "left_anti"))
    return tracks.select("track_id").join(every, "track_id", "left").withColumn("host_id", F.coalesce("host_id", F.lit(-1)))


def _centrals(tracks: DataFrame, members: DataFrame, particles: DataFrame, snap: Snapshot, c: Config) -> DataFrame:
    """(host_id, track_id) of the central of each host with living tracks."""
    by_host = particles.where("host_id >= 0").withColumn("rank", F.lit(0))
    hosts = ag.mean_motion(by_host, ["host_id"], "rank").select("host_id", *[F.col(x).alias(f"h{x}") for x in MOTION])
    own = ag.mean_motion(members.where("bound"), ["track_id"], "rank").select("track_id", *MOTION)
    j = tracks.where("host_id >= 0 AND n_bound > 1").select("track_id", "host_id", "m_bound").join(own, "track_id").join(hosts, "host_id")
    dv = g.relative_velocity(g.vec(""), g.vec("v"), g.vec("h"), g.vec("hv"), F.lit(snap.hz), F.lit(snap.scale_factor), _box(c))
    return votes.central(j.withColumn("d2", g.norm2(dv)), ["host_id"], "m_bound", "d2", "track_id", c.MajorProgenitorMassRatio)


def _box(c: Config):
    return F.lit(c.BoxSize) if c.PeriodicBoundaryOn else F.lit(None).cast("double")


def _visits(nests: DataFrame) -> DataFrame:
    """nests (track_id, host_id, parent, nest_order) with depth and the depth-first visiting key."""
    n = nests.withColumn("snapshot_index", F.lit(0))
    tree = nest.nest_tree(n).select("node", "depth", "path")
    keys = nest.visiting_key(tree, n.select(nest.node().alias("node"), F.coalesce("nest_order", "track_id").alias("nest_order")))
    found = tree.select("node", F.col("depth").cast("int").alias("depth")).join(keys, "node")
    return nests.join(found.withColumnRenamed("node", "track_id"), "track_id", "left")


def _unbind_levels(members: DataFrame, nests: DataFrame, c: Config, places: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unbind nests from the deepest level up (P6): (members with bound and energy, verdicts per track, mergers).

    What a nested track loses goes to its parent. Every track not yet trapped is tested against each of its ancestors,
    the deepest first, and sinks into the first one that it overlaps in phase space; with MergeTrappedSubhalos its
    members go there, and the ancestor is unbound once more (P8). places: track_id, the position and velocity of the
    most bound particle, which stand for tracks without members, and whether the track is `trapped` already.
    mergers: (track_id, parent: the one sunk into, handed: whether the members went there).
    """
    depth = nests.agg(F.coalesce(F.max("depth"), F.lit(-1))).first()[0]
    up = nests.where("parent IS NOT NULL").select("track_id", "parent")
    pool = members  # what is still to be unbound, under its present owner
    done: list[DataFrame] = []
    verdicts: list[DataFrame] = []
    mergers: list[DataFrame] = []
    options = dict(
        gravity=c.gravity, precision=c.BoundMassPrecision, min_members=c.MinNumPartOfSub, min_tracers=c.MinNumTracerPartOfSub,
        tracer_mask=c.tracer_mask, max_sources=c.MaxSampleSizeOfPotentialEstimate, keep_mask=c.keep_mask, per_type=c.PotentialEstimateUpscaleMassesPerType, thermal=c.ThermalEnergy,
        strip=not c.NoStripping,
    )
    hands = c.MergeTrappedSubhalos and not c.NoStripping
    above = cut(ancestor_pairs(nest.nest_tree(nests.withColumn("snapshot_index", F.lit(0)))).select(F.col("node").alias("track_id"), F.col("ancestor").alias("parent")))
    loose: DataFrame | None = None  # where the deeper tracks are that may merge
    columns = members.columns
    union = lambda xs: xs[0] if len(xs) == 1 else union([xs[0].unionByName(xs[1]), *xs[2:]])
    for level in range(int(depth), -1, -1):
        ids = nests.where(F.col("depth") == level).select("track_id")
        here = cut(pool.join(ids, "track_id", "left_semi"))
        rest = pool.join(ids, "track_id", "left_anti")
        if here.isEmpty():
            pool = rest
            loose = _loose(loose, None, ids, places)
            continue
        kept, verdict = gr.unbind(here.withColumn("g", F.col("track_id")), **options)
        kept, verdict = cut(kept), cut(verdict)
        if loose is not None:
            merged = _overlapping(kept, loose, above, c).withColumn("handed", F.lit(hands))
            mergers.append(merged)
            loose = loose.join(merged, "track_id", "left_anti")
            if hands and done:
                held = union(done).where("bound").select(*columns)
                moved = cut(held.join(merged, "track_id").select(*[F.col("parent").alias("track_id") if x == "track_id" else F.col(x) for x in columns]))
                again = moved.select("track_id").distinct()
                if not moved.isEmpty():  # the references that took members in, once more
                    twice = here.join(again, "track_id", "left_semi").unionByName(moved)
                    kept2, verdict2 = gr.unbind(twice.withColumn("g", F.col("track_id")), **options)
                    kept = cut(kept.join(again, "track_id", "left_anti").unionByName(kept2))
                    verdict = cut(verdict.join(again.withColumnRenamed("track_id", "g"), "g", "left_anti").unionByName(verdict2))
                    done = [x.join(merged.select("track_id"), "track_id", "left_anti") for x in done]
        loose = _loose(loose, _core(kept.where("bound"), c, "energy"), ids, places)
        flows = kept.where("NOT bound").join(up, "track_id").select(*[F.col("parent").alias("track_id") if x == "track_id" else F.col(x) for x in columns])
        pool = cut(rest.unionByName(flows.select(*columns)))
        stays = kept.join(up.select("track_id", F.lit(True).alias("_up")), "track_id", "left").where("bound OR _up IS NULL").drop("_up")
        done.append(cut(stays))
        verdicts.append(verdict)
    spark = members.sparkSession
    if not done:
        none = members.limit(0).withColumns({"bound": F.lit(False), "energy": F.lit(0.0), "potential_energy": F.lit(0.0)})
        return none, spark.createDataFrame([], "g long, n_bound long, m_bound double, disrupted boolean, n_rounds int"), spark.createDataFrame([], "track_id long, parent long, handed boolean")
    merged = union(mergers) if mergers else spark.createDataFrame([], "track_id long, parent long, handed boolean")
    return union([x.select(*columns, "bound", "energy", "potential_energy") for x in done]), union(verdicts), merged


def _core(bound: DataFrame, c: Config, order: str) -> DataFrame:
    tracer = ph.is_tracer("type", c.tracer_mask)
    sizes = bound.groupBy("track_id").agg(ag.core_size(F.count("*"), c.SubCoreSizeFactor, c.SubCoreSizeMin).alias("_size"))
    placed = rk.positions_within(bound, ["track_id"], [~tracer, F.col(order), F.col("particle_id")]).withColumnRenamed("position", "order")
    ranked = placed.join(sizes, "track_id").where(F.col("order") < F.col("_size"))
    return ag.core(ranked, ["track_id"], "order", "box_size")


def _loose(deeper: DataFrame | None, cores: DataFrame | None, ids: DataFrame, places: DataFrame) -> DataFrame:
    """(track_id, position, velocity) of the deeper tracks and those in ids that may merge: the core of those with bound
    members, which are free again, or else the place of those not yet trapped."""
    own = ids.join(places, "track_id", "left")
    free = own.where("NOT coalesce(trapped, false)").select("track_id", *MOTION)
    if cores is not None:
        resolved = cores.join(ids, "track_id", "left_semi").select("track_id", *MOTION)
        free = free.join(resolved, "track_id", "left_anti").unionByName(resolved)
    return cut(free if deeper is None else deeper.unionByName(free))


def _overlapping(kept: DataFrame, loose: DataFrame, above: DataFrame, c: Config) -> DataFrame:
    """(track_id, parent) of the tracks in loose within two spreads of the core of an ancestor in kept.

    above: (track_id, parent) of every track and each of its ancestors. The ancestors in kept are of one level.
    """
    ref = _core(kept.where("bound"), c, "energy").where("n > 1")
    ref = ref.select(F.col("track_id").alias("parent"), *[F.col(x).alias(f"p{x}") for x in MOTION], "sigma_r", "sigma_v")
    j = loose.select("track_id", *MOTION).join(above, "track_id").join(ref, "parent")
    dx2 = g.distance2(g.vec(""), g.vec("p"), _box(c))
    near = ph.phase_space_distance(dx2, g.distance2(g.vec("v"), g.vec("pv")), F.col("sigma_r"), F.col("sigma_v")) < 2
    return cut(j.where(near).select("track_id", "parent"))


def _in_box(m: DataFrame, c: Config) -> tuple[DataFrame, float]:
    """m and the side of the box its positions lie in: the periodic one, or one so wide that nothing meets across its edges."""
    if c.PeriodicBoundaryOn:
        return m, c.BoxSize
    ends = m.agg(*[f(x) for x in "xyz" for f in (F.min, F.max)]).first()
    low, high = [v or 0.0 for v in ends[::2]], [v or 0.0 for v in ends[1::2]]
    side = max(h - a for a, h in zip(low, high))
    return m.withColumns({x: F.col(x) - F.lit(a) for x, a in zip("xyz", low)}), 2 * side or 1.0


def step(state: State, snap: Snapshot, c: Config) -> State:
    """One snapshot. Rows of `tracks` and `members` in the result are those of the snapshot's end."""
    soft = ph.softening(F.lit(c.SofteningHalo), F.lit(c.MaxPhysicalSofteningHalo), F.lit(snap.scale_factor))
    p = snap.particles.withColumns({"box_size": _box(c), "soft": soft, "hz": F.lit(snap.hz), "scale_factor": F.lit(snap.scale_factor)})
    p = cut(p.withColumn("host_id", F.coalesce("host_id", F.lit(-1))))
    tracer = ph.is_tracer("type", c.tracer_mask)
    source = state.members.select(*[x.split()[0] for x in MEMBERS.split(", ")])
    if snap.splits is not None:  # split particles join their parent's track, at the end
        closure = nest_splits(snap.splits)
        extra = source.join(closure, "particle_id").select("track_id", F.lit(1 << 40).alias("rank"), F.col("child").alias("particle_id"), "bound")
        source = source.unionByName(extra)
    m = cut(source.join(p, "particle_id"))  # vanished particles drop out
    # shared particles: reserved tracers first, then the deeper track
    nests = _visits(state.tracks.select("track_id", F.col("host_id").alias("old_host"), "parent", "nest_order"))
    m = cut(nest.clean_tracks(m.join(nests.select("track_id", "old_host", "depth", "visit"), "track_id"), ["old_host"], "visit", "depth", tracer, c.MinNumTracerPartOfSub))
    m = m.drop("old_host", "depth", "visit")
    tracks = state.tracks.drop("host_id").join(_vote_hosts(state.tracks, m, p, c), "track_id")
    stored = cut(votes.first_tracers(m.where("bound"), ["track_id"], c.NumTracersForDescendants, tracer).select("track_id", "particle_id"))
    home = tracks.select("track_id", F.col("host_id").alias("_home"))
    m = m.join(home, "track_id").where("host_id = _home OR host_id = -1").drop("_home")
    # centrals take all of their host's particles; hosts without living tracks start a new one
    tracks = cut(tracks)
    central = cut(_centrals(tracks, m, p, snap, c).select("host_id", F.col("track_id").alias("central")))
    groups = p.where("host_id >= 0").select("host_id").distinct()
    fresh = groups.join(central, "host_id", "left_anti").select(F.lit(NEW).cast("long").alias("_n"), "host_id")
    blank = {x.split()[0]: x.split()[1] for x in TRACKS.split(", ")}
    news = fresh.select((F.col("_n") + F.col("host_id")).alias("track_id"), "host_id", *[F.lit(None).cast(t).alias(n) for n, t in blank.items() if n not in ("track_id", "host_id")])
    minus = {n: F.lit(-1).cast("long") for n in ("death", "sink", "sink_track_id", "descendant_track_id", "last_isolation")}
    news = news.withColumns({**minus, "birth": F.lit(snap.id).cast("long"), "n_bound": F.lit(0).cast("long"), "m_bound": F.lit(0.0)})
    heads = central.unionByName(news.select("host_id", F.col("track_id").alias("central")))
    every = cut(nest.extend_central(nest.level_up(tracks.unionByName(news), []), [], heads))
    fed = p.where("host_id >= 0").join(heads, "host_id").select(
        F.col("central").alias("track_id"), F.lit(1 << 41).alias("rank"), *[x for x in m.columns if x not in ("track_id", "rank", "bound")], F.lit(False).alias("bound")
    )
    old = m.join(heads.select(F.col("central").alias("track_id"), F.lit(True).alias("_c")), "track_id", "left")
    m = old.where("_c IS NULL").drop("_c").unionByName(fed)
    # hostless tracks keep their members; a shared particle stays with the deepest track of the host
    shape = cut(_visits(every.select("track_id", F.col("host_id").alias("new_host"), "parent", "nest_order")))
    m = m.join(shape.select("track_id", "new_host", "visit"), "track_id")
    alone = F.col("new_host") < 0
    m = m.withColumn("_room", F.when(alone, -F.col("track_id") - 2).otherwise(F.col("new_host")))
    m = cut((m if c.InclusiveMass else nest.mask(m, ["_room"], "visit")).drop("_room", "visit", "new_host"))
    if c.ReassignParticles and not c.DmOnly:
        inside, box = _in_box(m.where("host_id >= 0"), c)
        moved = sp.reassign(inside.where(~tracer).withColumnRenamed("particle_id", "query_id"), inside.where(tracer), ["host_id"], c.NumNeighboursForReassignment, box)
        to = moved.where("track_id <> new_track_id").select(F.col("query_id").alias("particle_id"), "track_id", "new_track_id")
        m = cut(m.join(to, ["particle_id", "track_id"], "left").withColumn("track_id", F.coalesce("new_track_id", "track_id")).drop("new_track_id"))
    work = m.select("track_id", "particle_id", *MOTION, "mass", "type", "u", "soft", "hz", "scale_factor", "box_size")
    levels = shape.select("track_id", "parent", "depth")
    if c.InclusiveMass:  # every track by itself, with all that it shares
        levels = levels.withColumns({"parent": F.lit(None).cast("long"), "depth": F.lit(0)})
    now = p.select(F.col("particle_id").alias("most_bound_particle_id"), F.struct(*MOTION).alias("_f"))
    at = every.join(now, "most_bound_particle_id", "left")
    places = cut(at.select("track_id", *[F.coalesce(F.col("_f")[x], F.col(x)).alias(x) for x in MOTION], (F.coalesce("sink", F.lit(-1)) != -1).alias("trapped")))
    kept, verdict, mergers = _unbind_levels(work, levels, c, places)
    return _finish(every, kept, verdict, mergers, stored, shape, p, snap, c)


def nest_splits(splits: DataFrame) -> DataFrame:
    from trackweave.operators.progenitors import split_closure

    return split_closure(splits).select("particle_id", "child")


def _finish(every, kept, verdict, mergers, stored, shape, p, snap: Snapshot, c: Config) -> State:
    """New ids, properties, milestones, ranks, descendants and the truncated source."""
    sid = F.lit(snap.id).cast("long")
    v = verdict.select(F.col("g").alias("track_id"), F.col("n_bound").alias("_n"), F.col("m_bound").alias("_m"))
    gone = mergers.select("track_id", F.col("parent").alias("_into"), F.col("handed").alias("_handed"))
    t = every.join(v, "track_id", "left").join(gone, "track_id", "left")
    n = F.when(F.col("_handed"), 0).otherwise(F.coalesce("_n", F.lit(0))).cast("long")
    t = t.withColumns({"n_bound": n, "m_bound": F.when(n > 0, F.col("_m")).otherwise(0.0)})
    t = cut(t.where((F.col("track_id") < NEW) | (F.col("n_bound") > 0)))  # never bound: not a track
    start = t.where(F.col("track_id") < NEW).agg(F.coalesce(F.max("track_id"), F.lit(-1))).first()[0] + 1
    ids = rk.global_positions(t.where(F.col("track_id") >= NEW).select("track_id"), "track_id")
    ids = cut(ids.select("track_id", (F.col("position") + start).alias("_id")))

    def renamed(df: DataFrame, column: str = "track_id") -> DataFrame:
        names = ids.select(F.col("track_id").alias(column), "_id")
        return df.join(names, column, "left").withColumn(column, F.coalesce("_id", column)).drop("_id")

    t = renamed(renamed(t), "parent")
    t = renamed(t, "_into")
    m = renamed(kept.join(mergers.where("handed").select("track_id"), "track_id", "left_anti"))
    living = t.where("n_bound > 0").select("track_id")
    by_energy = [~F.col("bound"), F.col("energy").isNull(), F.col("energy"), F.col("particle_id")]
    m = cut(rk.positions_within(m.join(living, "track_id", "left_semi").drop("rank"), ["track_id"], by_energy).withColumnRenamed("position", "rank"))
    if c.RefineMostBoundParticle and c.MaxSampleSizeOfPotentialEstimate:
        m = _refined(m, c)
    if c.InclusiveMass:
        m = cut(_purged(m, t))
    b = m.where("bound")
    first = b.groupBy("track_id").agg(
        F.min_by(F.struct(*MOTION), "rank").alias("c"), F.min_by("particle_id", F.when(ph.is_tracer("type", c.tracer_mask), F.col("rank")).otherwise(F.col("rank") + (1 << 40))).alias("_best")
    )
    radius = g.distance(g.vec(""), tuple(F.col(f"c.{x}") for x in "xyz"), _box(c))
    profile = pr.cumulative(b.join(first.select("track_id", "c"), "track_id").select("track_id", "particle_id", "mass", radius.alias("r"), "soft", ph.virial_density(200.0, F.lit(snap.hz), F.lit(snap.scale_factor), c.gravity).alias("density")), ["track_id"], "r")
    s = pr.summary(profile, ["track_id"], "r", "soft", "density").select(
        "track_id", F.sqrt(F.col("v2_max") * c.gravity / snap.scale_factor).alias("_v"), F.col("r_max").alias("_r"), F.col("r_half").alias("_h"), F.col("r_enclose").alias("_e")
    )
    core = _core(b, c, "rank").select("track_id", F.col("sigma_r").alias("_sr"), F.col("sigma_v").alias("_sv"))
    t = t.join(first, "track_id", "left").join(s, "track_id", "left").join(core, "track_id", "left")
    follow = p.select(F.col("particle_id").alias("most_bound_particle_id"), F.struct(*MOTION).alias("_f"))
    t = t.join(follow, "most_bound_particle_id", "left")
    alive, was_dead = F.col("n_bound") > 0, F.col("death") != -1
    heavier = alive & (F.col("m_bound") >= F.coalesce("last_max_mass", F.lit(0.0)))
    faster = alive & (F.col("_v") >= F.coalesce("last_max_vmax", F.lit(0.0)))
    where = F.coalesce(F.when(alive, F.col("c")), F.col("_f"))
    lives = alive & F.col("_into").isNull()  # one that sinks without handing its members over keeps them, but counts as dead
    new_sink = F.col("_into").isNotNull() & (alive | (F.col("sink") == -1))
    t = t.withColumns(
        {
            "death": F.when(lives, -1).when(was_dead & ~alive, F.col("death")).otherwise(sid),
            "_died": ~lives & ~(was_dead & ~alive),
            "descendant_track_id": F.when(alive & was_dead, -1).otherwise(F.col("descendant_track_id")),
            "sink_track_id": F.when(new_sink, F.col("_into")).when(alive, -1).otherwise(F.col("sink_track_id")),
            "sink": F.when(new_sink, sid).when(alive, -1).otherwise(F.col("sink")),
            "most_bound_particle_id": F.when(alive, F.col("_best")).otherwise(F.col("most_bound_particle_id")),
            "last_max_mass": F.when(heavier, F.col("m_bound")).otherwise(F.col("last_max_mass")),
            "at_max_mass": F.when(heavier, sid).otherwise(F.col("at_max_mass")),
            "vmax": F.coalesce("_v", F.lit(0.0)),
            "rmax": F.coalesce("_r", F.lit(0.0)),
            "r_half": F.coalesce("_h", F.lit(0.0)),
            "r_enclose": F.coalesce("_e", F.lit(0.0)),
            "last_max_vmax": F.when(faster, F.col("_v")).otherwise(F.col("last_max_vmax")),
            "at_max_vmax": F.when(faster, sid).otherwise(F.col("at_max_vmax")),
            "sigma_r": F.coalesce("_sr", F.lit(0.0)),
            "sigma_v": F.coalesce("_sv", F.lit(0.0)),
            **{x: F.coalesce(where[x], x) for x in MOTION},
        }
    )
    t = cut(t)
    order = [F.col("m_bound").desc(), F.col("vmax").desc(), F.col("most_bound_particle_id").desc(), F.col("track_id").desc()]
    nested_before = F.coalesce(F.col("rank"), F.lit(0)) > 0
    t = rk.member_ranks(t.withColumn("_was", nested_before), ["host_id"], order, F.col("host_id") < 0)
    t = t.withColumn("rank", F.col("member_rank").cast("long"))
    top = t.where("rank = 0 AND host_id >= 0").select("host_id", F.col("track_id").alias("central"))
    t = nest.extend_central(t, [], top)
    shape2 = _visits(t.select("track_id", F.col("host_id").alias("h"), "parent", "nest_order")).select("track_id", F.col("depth").alias("_d"))
    turned = (F.col("rank") > 0) & ~F.col("_was")
    t = t.join(shape2, "track_id", "left").withColumns(
        {"depth": F.col("_d"), "last_isolation": F.when(turned, F.lit(snap.index - 1)).otherwise(F.col("last_isolation")), "nest_order": F.col("rank")}
    )
    wanted = t.where("_died").select("track_id")
    found = votes.descendant(stored.join(wanted, "track_id"), b.select("particle_id", F.col("track_id").alias("_desc")), ["track_id"], "particle_id", "_desc")
    t = t.join(found.select("track_id", "_desc"), "track_id", "left").withColumn(
        "descendant_track_id", F.when(F.col("_died") & (F.col("descendant_track_id") == -1), F.coalesce("_desc", F.lit(-1))).otherwise(F.col("descendant_track_id"))
    )
    columns = [x.split() for x in TRACKS.split(", ")]
    t = cut(t.select(*[F.col(n).cast(k).alias(n) for n, k in columns]))
    saved = [n for n, on in (("energy", c.SaveBoundParticleBindingEnergies), ("potential_energy", c.SaveBoundParticlePotentialEnergies)) if on]
    saved += [*MOTION, "mass", "u", "type"] if c.SaveBoundParticleProperties else []
    kept_members = rk.truncated(m.select("track_id", "rank", "particle_id", "bound", *saved), t.select("track_id", "n_bound"), ["track_id"], c.SourceSubRelaxFactor)
    density = ph.virial_density(200.0, F.lit(snap.hz), F.lit(snap.scale_factor), c.gravity)
    extra = cut(track_properties(b.withColumn("density", density), ["track_id"], ph.is_tracer("type", c.tracer_mask), thermal=c.ThermalEnergy))
    return State(t, cut(kept_members), extra)


def _refined(m: DataFrame, c: Config) -> DataFrame:
    """m with the ranks of the innermost bound members of tracks with sampled sources taken by their own potential."""
    b = m.where("bound").withColumn("g", F.col("track_id"))
    places = gr.refined(b, c.MaxSampleSizeOfPotentialEstimate, c.BoundFractionCenterRefinement, c.gravity)
    places = places.select(F.col("g").alias("track_id"), "particle_id", F.col("place").alias("_place"))
    ranked = m.join(places, ["track_id", "particle_id"], "left").withColumn("rank", F.coalesce("_place", "rank").cast("long"))
    return cut(ranked.select(*m.columns))


def _purged(m: DataFrame, t: DataFrame) -> DataFrame:
    """Members with the ranks of each track's most bound member and the one promoted instead of it exchanged."""
    order = [F.col("m_bound").desc(), F.col("track_id").desc()]
    places = rk.member_ranks(t.where("n_bound > 1").select("track_id", F.col("host_id").alias("_room"), "m_bound"), ["_room"], order)
    shared = m.where("bound").join(places.select("track_id", "_room", "member_rank"), "track_id")
    first = nest.promoted(shared, ["_room"]).select("track_id", F.col("particle_id").alias("_first"))
    old = m.join(first, "track_id", "left").join(m.select("track_id", F.col("particle_id").alias("_first"), F.col("rank").alias("_rank")), ["track_id", "_first"], "left")
    rank = F.when(F.col("particle_id") == F.col("_first"), 0).when((F.col("rank") == 0) & F.col("_rank").isNotNull(), F.col("_rank")).otherwise(F.col("rank"))
    return old.withColumn("rank", rank.cast("long")).select(*m.columns)


def run(spark: SparkSession, snapshots: list[Snapshot], c: Config, path: str, resume_from: State | None = None) -> State:
    """All snapshots in order; each step's catalogue and state are written under path, from where a run resumes."""
    state = resume_from or State.empty(spark)
    for snap in snapshots:
        state = step(state, snap, c)
        full = state.tracks.join(state.properties, "track_id", "left")
        cio.write_catalogue(full.withColumn("snapshot_id", F.lit(snap.id)), path, {snap.id: {"scale_factor": snap.scale_factor, "hz": snap.hz}})
        cio.write_state(state.members.withColumn("snapshot_id", F.lit(snap.id)), path)
    return state


def open_snapshots(spark: SparkSession, c: Config, epochs: dict[int, tuple[float, float]]) -> list[Snapshot]:
    """The outputs that a configuration names, from MinSnapshotIndex to MaxSnapshotIndex. epochs: scale factor and expansion
    rate by snapshot id.

    Output k lies in SnapshotPath[/SnapshotDirBase_k]/SnapshotFileBase_k*. Where its particles don't name their groups,
    these are read from HaloPath/groups_k* and, for formats that keep them apart, the members' ids from HaloPath/ids_k*.
    With ParticlesSplit above 0, HaloPath/splits_k.parquet holds the splits since the output before; none means no splits.
    """
    out = []
    for index in range(c.MinSnapshotIndex, c.MaxSnapshotIndex + 1):
        k = c.SnapshotIdList[index] if c.SnapshotIdList else index
        name = f"{k:03d}"
        folder = f"{c.SnapshotPath}/{c.SnapshotDirBase}_{name}" if c.SnapshotDirBase else c.SnapshotPath
        options = {"periodic": c.PeriodicBoundaryOn, "ids": c.SnapshotHasIdBlock, "unsigned": c.SnapshotIdUnsigned}
        p = formats.load_snapshot(spark, c.SnapshotFormat, f"{folder}/{c.SnapshotFileBase}_{name}*", **{n: str(v).lower() for n, v in options.items()})
        if "host_id" not in p.columns:
            more = {} if c.GroupFileFormat == "parquet" else {"ids": f"{c.HaloPath}/ids_{name}*", "mask": c.GroupParticleIdMask}
            named = formats.load_groups(spark, c.GroupFileFormat, f"{c.HaloPath}/groups_{name}*", **more)
            p = p.join(named.groupBy("particle_id").agg(F.min("group_id").alias("host_id")), "particle_id", "left")
        none = F.col("host_id").isNull() | (F.col("host_id") < 0) | (F.col("host_id") == c.ParticleNullGroupId)
        p = p.withColumn("host_id", F.when(none, -1).otherwise(F.col("host_id")).cast("long"))
        splits = formats.read_splits(spark, f"{c.HaloPath}/splits_{name}.parquet") if c.ParticlesSplit > 0 else None
        out.append(Snapshot(index, k, p, *epochs[k], splits))
    return out


def run_configured(spark: SparkSession, c: Config, epochs: dict[int, tuple[float, float]]) -> State:
    """All outputs that a configuration names, written under its SubhaloPath; a run that starts later than output 0 resumes."""
    before = c.MinSnapshotIndex - 1
    start = None if before < 0 else resume(spark, c.SubhaloPath, c.SnapshotIdList[before] if c.SnapshotIdList else before)
    return run(spark, open_snapshots(spark, c, epochs), c, c.SubhaloPath, start)


def resume(spark: SparkSession, path: str, snapshot_id: int) -> State:
    """The state after a snapshot, as it was written."""
    t = spark.read.parquet(f"{path}/tracks").where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")
    m = spark.read.parquet(f"{path}/source").where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")
    return State(t.select(*[x.split()[0] for x in TRACKS.split(", ")]), m.select(*[x.split()[0] for x in MEMBERS.split(", ")]))
