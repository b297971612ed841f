"""Neighbours in a periodic box: radius searches, nearest neighbours, linked groups, densities.

Points meet only through grid cells, by equi-joins on cell numbers; no join compares all points of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions.geometry import cell, distance2, nearest, vec
from trackweave.functions.physics import sph_kernel
from trackweave.operators import linking
from trackweave.runtime import cut, small

#: Points of a group up to which every query of the group looks at all of them.
FEW = 128


def _cells(n: Column | int, box: str = "box_size", names: str = "xyz", shift: str = "") -> list[Column]:
    n = F.lit(n) if isinstance(n, int) else n
    return [cell(F.col(c), F.col(box) / n, n).alias(f"{shift}c{c}") for c in names]


def _around(df: DataFrame, n: int, reach: int = 1) -> DataFrame:
    """df once per cell within `reach` of its own cell, cells wrapped around the box and not repeated."""
    width = min(n, 2 * reach + 1)
    for c in ("cx", "cy", "cz"):
        near = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.pmod(F.col(c) + i - min(reach, width // 2), F.lit(n)).cast("int"))
        df = df.withColumn(c, F.explode(near))
    return df


def within_radius(
    centres: DataFrame, points: DataFrame, by: Sequence[str], radius: float, box: float, inner: float = 0.0
) -> DataFrame:
    """(by, centre_id, particle_id, r): the points strictly within radius (and beyond inner, if given) of each centre.

    Both sides hold by, x, y, z; distances are periodic. The cells are at least as wide as the radius, so 27 hold all.
    """
    n = max(1, int(box / radius))
    c = _around(centres.select(*by, "centre_id", *[F.col(a).alias(f"q{a}") for a in "xyz"], *_cells_of(n, box)), n)
    p = points.select(*by, "particle_id", "x", "y", "z", *_cells_of(n, box))
    d2 = distance2(vec("q"), vec(""), box)
    near = c.join(p, [*by, "cx", "cy", "cz"]).withColumn("r", F.sqrt(d2)).where(F.col("r") < radius)
    near = near.where(F.col("r") > inner) if inner else near
    return near.select(*by, "centre_id", "particle_id", "r")


def _cells_of(n: int, box: float) -> list[Column]:
    return [cell(F.col(a), F.lit(box / n), n).alias(f"c{a}") for a in "xyz"]


def within_cylinder(centres: DataFrame, points: DataFrame, by: Sequence[str], rz: float, rp: float, box: float) -> DataFrame:
    """(by, centre_id, particle_id): points within rz of a centre along z and within rp across it."""
    radius = (rz * rz + rp * rp) ** 0.5
    near = within_radius(centres, points, by, radius * (1 + 1e-9), box)
    q = centres.select(*by, "centre_id", *[F.col(a).alias(f"q{a}") for a in "xyz"])
    d = near.join(q, [*by, "centre_id"]).join(points.select(*by, "particle_id", "x", "y", "z"), [*by, "particle_id"])
    dx, dy, dz = (nearest(F.col(a) - F.col(f"q{a}"), box) for a in "xyz")
    return d.where((F.abs(dz) < rz) & (dx * dx + dy * dy < rp * rp)).select(*by, "centre_id", "particle_id")


def nearest_neighbours(
    queries: DataFrame, points: DataFrame, by: Sequence[str], k: int, box: float
) -> DataFrame:
    """(by, query_id, particle_id, r, place): the k nearest points of each query, place from 1, ties by id.

    Groups of at most FEW points need no grid: each query looks at all of them. The others form an octree over the box,
    split as long as cells hold k points or more (LEAF at least), so the cells adapt to every group and to its crowded
    places. A query's level is that of the finest such cell around it: these lie within 1.74 of its side, so the 27 cells a level above
    hold all k nearest. Most queries are settled two levels below that, where 27 cells hold few points, by a k-th
    neighbour that is no farther than a cell is wide. Of points in one place only the k of least id are looked at, and
    queries in one place ask once. A query's own row is a neighbour unless it is left out of the points. Queries with
    fewer than k points in their group get all of them; without any they get no row. Null positions have no neighbours.
    """
    keys, place = [*by, "query_id"], ["x", "y", "z"]
    somewhere = " AND ".join(f"{c} IS NOT NULL" for c in place)
    asked = queries.where(somewhere).select(*keys, *[F.col(c).alias(f"q{c}") for c in place])
    here = points.where(somewhere).select(*by, "particle_id", *place)
    sizes = here.groupBy(*by).agg(F.count("*").alias("_n"))
    few = sizes.where(F.col("_n") <= FEW).select(*by)
    near = asked.join(here.join(few, list(by), "left_semi"), list(by))
    direct = _nearest(near.select(*keys, "particle_id", F.sqrt(distance2(vec("q"), vec(""), box)).alias("r")), keys, k)
    many = sizes.where(F.col("_n") > FEW).select(*by)
    mine = cut(asked.join(many, list(by), "left_semi"))
    if mine.isEmpty():
        return direct
    w = Window.partitionBy(*by, *place).orderBy("particle_id")
    kept = here.join(many, list(by), "left_semi").withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= k).drop("_i")
    kept = cut(kept.withColumns({d: cell(F.col(c), F.lit(box / (1 << DEEPEST)), 1 << DEEPEST) for c, d in zip(place, _AXES)}))
    at = ["qx", "qy", "qz"]
    todo = mine.select(*by, *at).distinct().withColumns({f"d{c}": cell(F.col(c), F.lit(box / (1 << DEEPEST)), 1 << DEEPEST) for c in at})
    todo = cut(_own_levels(todo, _full_cells(kept, by, max(k, LEAF)), by))
    done: list[DataFrame] = []
    for offset in (1, 0, -1):
        best = cut(_search(todo, kept, by, k, box, offset))
        side = F.lit(box) / F.expr("shiftleft(1, _level)")
        sure = (F.col("_level") <= 1) if offset >= 0 else F.lit(True)
        settled = best.where(sure | ((F.col("place") == k) & (F.col("r") < side))).select(*by, *at).distinct()
        done.append(best.join(settled, [*by, *at], "left_semi").select(*by, *at, "particle_id", "r", "place"))
        todo = cut(todo.join(settled, [*by, *at], "left_anti"))
        if todo.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return direct.unionByName(mine.join(out, [*by, *at]).select(*keys, "particle_id", "r", "place"))


#: Halvings of the box at the finest cells of an octree, and levels counted in one pass.
DEEPEST, PASS = 20, 4
#: Points a cell must hold to be split, at least.
LEAF = 8
_AXES = ("dx", "dy", "dz")


def _full_cells(points: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """(by, _level, cx, cy, cz) of the octree's cells that hold at least k points."""
    alive, found = points.select(*by, *_AXES), []
    for first in range(1, DEEPEST + 1, PASS):
        last = min(first + PASS - 1, DEEPEST)
        each = alive.withColumn("_level", F.explode(F.sequence(F.lit(first), F.lit(last))))
        cells = each.select(*by, "_level", *[F.expr(f"shiftright({c}, {DEEPEST} - _level)").alias(f"c{c[1]}") for c in _AXES])
        full = cut(cells.groupBy(*by, "_level", "cx", "cy", "cz").agg(F.count("*").alias("_n")).where(F.col("_n") >= k).drop("_n"))
        found.append(full)
        lowest = full.where(F.col("_level") == last).drop("_level")
        if last == DEEPEST or lowest.isEmpty():
            break
        deeper = alive.withColumns({f"c{c[1]}": F.shiftright(c, DEEPEST - last) for c in _AXES}).join(small(lowest), [*by, "cx", "cy", "cz"], "left_semi")
        alive = cut(deeper.select(*by, *_AXES))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _own_levels(asked: DataFrame, full: DataFrame, by: Sequence[str]) -> DataFrame:
    """asked with `_own`, the finest level whose cell around it is full (0, the box, where none is)."""
    levels = F.explode(F.sequence(F.lit(1), F.lit(DEEPEST))).alias("_level")
    used = full.select(*by, "_level").distinct()
    each = asked.select("*", levels).join(small(used), [*by, "_level"], "left_semi")
    cells = each.select(*asked.columns, "_level", *[F.expr(f"shiftright(d{c}, {DEEPEST} - _level)").alias(f"c{c[1]}") for c in ("qx", "qy", "qz")])
    hit = cells.join(small(full), [*by, "_level", "cx", "cy", "cz"], "left_semi")
    own = hit.groupBy(*by, "qx", "qy", "qz").agg(F.max("_level").alias("_own"))
    return asked.join(own, [*by, "qx", "qy", "qz"], "left").withColumn("_own", F.coalesce("_own", F.lit(0)))


def _search(asked: DataFrame, points: DataFrame, by: Sequence[str], k: int, box: float, offset: int) -> DataFrame:
    """(by, qx, qy, qz, _level, particle_id, r, place): the k nearest in the 27 cells around, `offset` levels below the own one."""
    at = ["qx", "qy", "qz"]
    q = asked.withColumn("_level", F.greatest(F.lit(0), F.least(F.lit(DEEPEST), F.col("_own") + offset)))
    for c in at:
        n = F.expr("shiftleft(1, _level)")
        mid = F.expr(f"shiftright(d{c}, {DEEPEST} - _level)")
        near = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(3)) - 1), lambda i: F.pmod(mid + i - F.least(F.lit(1), n - 1), n))
        q = q.withColumn(f"c{c[1]}", F.explode(near))
    used = q.select(*by, "_level").distinct()
    p = points.join(small(used), list(by)).withColumns({f"c{c[1]}": F.expr(f"shiftright({c}, {DEEPEST} - _level)") for c in _AXES})
    cells = [*by, "_level", "cx", "cy", "cz"]
    r = F.sqrt(distance2(vec("q"), vec(""), box)).alias("r")
    pairs = q.select(*cells, *at).join(p.select(*cells, "particle_id", "x", "y", "z"), cells)
    return _nearest(pairs.select(*by, *at, "_level", "particle_id", r), [*by, *at, "_level"], k)


def _nearest(pairs: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The k nearest of each query with their place; Spark keeps k rows per query and task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy("r", "particle_id")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def reassign(queries: DataFrame, tracers: DataFrame, by: Sequence[str], k: int, box: float) -> DataFrame:
    """(by, query_id, track_id, new_track_id) of non-tracers: their own track if it holds one of the k nearest tracers
    of the host, else the track of the nearest (V4). Hosts without tracers change nothing."""
    near = nearest_neighbours(queries, tracers, by, k, box)
    owned = near.join(tracers.select(*by, "particle_id", F.col("track_id").alias("_t")), [*by, "particle_id"])
    votes = owned.join(queries.select(*by, "query_id", "track_id"), [*by, "query_id"])
    best = votes.groupBy(*by, "query_id").agg(
        F.bool_or(F.col("_t") == F.col("track_id")).alias("own"), F.min_by("_t", "place").alias("first")
    )
    moved = queries.select(*by, "query_id", "track_id").join(best, [*by, "query_id"], "left")
    keep = F.coalesce(F.col("own"), F.lit(True))
    return moved.select(*by, "query_id", "track_id", F.when(keep, F.col("track_id")).otherwise(F.col("first")).alias("new_track_id"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component; edges (a, b) in either direction.

    Every round a node takes the least label around it and then that label's own label, so long chains shrink fast.
    Rounds are cut from the lineage. Nodes without edges keep themselves.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_l"))
        step = labels.join(seen, "node", "left").select("node", "label", F.least("label", F.coalesce("_l", "label")).alias("_n"))
        jump = step.select(F.col("node").alias("_n"), F.col("_n").alias("_j"))
        after = step.join(jump, "_n", "left").select("node", F.col("label").alias("_old"), F.least("_n", F.coalesce("_j", "_n")).alias("label"))
        after = cut(after)
        labels = after.select("node", "label")
        if after.where("_old <> label").isEmpty():
            return labels


#: Points of a block that one task links, about and at most, and edges between blocks that one task joins, at most.
BLOCK, MOST, JOINED = 10_000, 500_000, 2_000_000


def friends_of_friends(points: DataFrame, by: Sequence[str], link: float, box: float) -> DataFrame:
    """(by, particle_id, tag, length): groups of points chained by separations below `link`, single points too.

    The box is split into blocks. A pair is in reach of the block that holds the lower of either coordinate, so a block
    gets its points and those up to `link` beyond its upper faces, and links them in one task (`linking.local_groups`).
    Points of several blocks then join the blocks' groups. Where blocks can't be as wide as twice the link and hold MOST
    points at most, cells and pairs of them are rows instead. `by` must be one column, that holds integers. The tag is
    the least particle_id of the group. Points without a place have no group.
    """
    one = by[0]
    somewhere = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz")
    p = cut(points.select(F.col(one).cast("long").alias("_s"), "particle_id", "x", "y", "z").where(somewhere))
    back = lambda df: df.select(F.col("_s").cast(points.schema[one].dataType).alias(one), "particle_id", "tag", "length")
    finest = int(box / link / 2)
    most = p.groupBy("_s").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    side = min(finest, max(2, ceil((most / BLOCK) ** (1 / 3))))
    while 2 <= side:
        held = p.groupBy("_s", *_cells_of(side, box)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if held <= MOST or side == finest:
            break
        side = min(finest, 2 * side)
    if side < 2 or held > MOST:
        return back(_linked_by_cells(p, ["_s"], link, box))
    width, near = F.lit(box / side), link * (1 + 1e-9)
    own = p.select("*", *_cells_of(side, box)).withColumn("own", F.array(F.lit(0), F.lit(-1)))
    copies = own
    for c in "xyz":  # one block lower too where the lower face is in reach
        low = F.col(c) - F.col(f"c{c}") * width < near
        copies = copies.withColumn(f"o{c}", F.explode(F.when(low, F.col("own")).otherwise(F.array(F.lit(0)))))
    shift = {f"c{c}": F.pmod(F.col(f"c{c}") + F.col(f"o{c}"), F.lit(side)) for c in "xyz"}
    copies = copies.withColumn("own", F.expr("ox = 0 AND oy = 0 AND oz = 0")).withColumns(shift).drop("ox", "oy", "oz")
    local = lambda rows: linking.local_groups(rows, link, box, box / side)
    found = cut(copies.groupBy("_s", "cx", "cy", "cz").applyInPandas(local, "_s long, particle_id long, tag long, own boolean, shared boolean"))
    shared = found.where("shared").select("_s", "particle_id", F.col("tag").alias("a")).distinct()
    least = shared.groupBy("_s", "particle_id").agg(F.min("a").alias("b"), F.max("a").alias("_m")).where("b < _m")
    edges = cut(shared.join(least, ["_s", "particle_id"]).where("a > b").select("_s", "a", "b").distinct())
    if (edges.groupBy("_s").count().agg(F.max("count")).first()[0] or 0) <= JOINED:
        joined = edges.groupBy("_s").applyInPandas(linking.joined, "_s long, tag long, to long")
    else:
        code = lambda c: F.struct("_s", F.col(c).alias("p"))
        ends = edges.select(code("a").alias("node")).unionByName(edges.select(code("b").alias("node"))).distinct()
        joined = components(ends, edges.select(code("a").alias("a"), code("b").alias("b"))).select("node._s", F.col("node.p").alias("tag"), F.col("label.p").alias("to"))
    tagged = found.where("own").join(joined, ["_s", "tag"], "left").select("_s", "particle_id", F.coalesce("to", "tag").alias("tag"))
    tagged = cut(tagged)
    return back(tagged.join(tagged.groupBy("_s", "tag").agg(F.count("*").alias("length")), ["_s", "tag"]))


def _linked_by_cells(points: DataFrame, by: Sequence[str], link: float, box: float) -> DataFrame:
    """`friends_of_friends` without blocks: cells and pairs of them are rows.

    Points of one cell of side link / sqrt(3) are linked by the cell itself, so a crowded cell emits no pairs. Pairs of
    cells near each other become edges if any of their points are close: see `_near_pairs`.
    """
    n = 2 * max(1, ceil(box / (link * 0.999 / 3**0.5) / 2))  # no cell is wider than that
    one = by[0]
    p = cut(points.select(one, "particle_id", "x", "y", "z", *_cells_of(n, box)))
    cells = cut(p.groupBy(one, "cx", "cy", "cz").agg(F.min("particle_id").alias("rep")))
    # pairs of occupied cells up to two cells apart, found through blocks of 2 x 2 x 2 cells and half of the directions
    ways = [(i, j, k) for i in range(-1, 2) for j in range(-1, 2) for k in range(-1, 2) if (i, j, k) >= (0, 0, 0)]
    way = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(w, "ijk")]) for w in ways])).alias("w")
    block = lambda c: F.shiftright(c, 1).alias(f"b{c}")
    shift = lambda c, d: F.pmod(F.shiftright(f"o{c}", 1) + F.col(f"w.{d}"), F.lit(n // 2)).cast("int").alias(f"b{c}")
    axes = ("cx", "cy", "cz")
    here = cells.select(one, "rep", *axes, *[block(c) for c in axes])
    near = cells.select(one, F.col("rep").alias("_a"), *[F.col(c).alias(f"o{c}") for c in axes], way)
    near = near.select(one, "_a", *[f"o{c}" for c in axes], *[shift(c, d) for c, d in zip(axes, "ijk")])
    close_by = F.lit(True)
    for c in axes:
        gap = F.pmod(F.col(c) - F.col(f"o{c}") + 2, F.lit(n))  # 0 .. 4 for cells up to two apart
        close_by = close_by & (gap <= 4)
    pairs = near.join(here, [one, *[f"b{c}" for c in axes]]).where(close_by & (F.col("_a") != F.col("rep")))
    pairs = pairs.select(one, F.least("_a", "rep").alias("a"), F.greatest("_a", "rep").alias("b")).distinct()
    own = cut(p.join(cells.select(one, "cx", "cy", "cz", "rep"), [one, "cx", "cy", "cz"]).select(one, "rep", "particle_id", "x", "y", "z"))
    edges = _near_pairs(cut(pairs), own, one, n, link, box)
    code = lambda c: F.struct(F.col(one).cast("long").alias("s"), F.col(c).alias("p"))
    comp = components(
        cells.select(code("rep").alias("node")), edges.select(code("a").alias("a"), code("b").alias("b"))
    ).select(F.col("node.s").alias(one), F.col("node.p").alias("rep"), F.col("label.p").alias("tag"))
    tagged = own.select(one, "rep", "particle_id").join(comp, [one, "rep"])
    sizes = tagged.groupBy(one, "tag").agg(F.count("*").alias("length"))
    return tagged.join(sizes, [one, "tag"]).select(one, "particle_id", "tag", "length")


#: Comparisons of points up to which a pair of cells, or of parts of them, is compared point by point.
COMPARED = 256
#: Splits after which parts are as small as the resolution of positions; what is left then is compared.
SPLITS = 40


def _near_pairs(pairs: DataFrame, points: DataFrame, one: str, n: int, link: float, box: float) -> DataFrame:
    """(one, a, b) of the pairs of cells with two points closer than `link`; points: one, rep (their cell), x, y, z.

    First the extents of the cells are compared: pairs that can't or must be near are decided. Of the others those with
    few points are compared point by point; crowded ones are split into the eight parts of either cell, and pairs of
    these are decided likewise. A pair leaves as soon as one pair of its parts is near, so crowded cells never meet
    point by point.
    """
    parts = points.withColumn("part", F.lit(""))
    open_ = pairs.select(one, "a", "b", F.lit("").alias("pa"), F.lit("").alias("pb"))
    edges: list[DataFrame] = []
    for depth in range(1, SPLITS + 1):
        extent = [f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max)]
        boxes = cut(parts.groupBy(one, "rep", "part").agg(F.count("*").alias("n"), *extent))
        side = lambda s: boxes.select(one, F.col("rep").alias(s), F.col("part").alias(f"p{s}"), *[F.col(c).alias(f"{s}_{c}") for c in boxes.columns[3:]])
        j = open_.join(side("a"), [one, "a", "pa"]).join(side("b"), [one, "b", "pb"])
        least, most, size = F.lit(0.0), F.lit(0.0), F.lit(0.0)
        for c in "xyz":
            mid = F.abs(nearest((F.col(f"a_min_{c}") + F.col(f"a_max_{c}")) / 2 - (F.col(f"b_min_{c}") + F.col(f"b_max_{c}")) / 2, box))
            half = (F.col(f"a_max_{c}") - F.col(f"a_min_{c}") + F.col(f"b_max_{c}") - F.col(f"b_min_{c}")) / 2
            least = least + F.pow(F.greatest(F.lit(0.0), mid - half), F.lit(2))
            most = most + F.pow(mid + half, F.lit(2))
            size = size + half
        # a hair of room, so that rounding decides nothing
        state = F.when(least > link * link * (1 + 1e-9), 0).when(most < link * link * (1 - 1e-9), 1)
        state = state.when(size == 0, (least < link * link).cast("int"))  # points in one place each
        state = state.when((F.col("a_n") * F.col("b_n") <= COMPARED) | F.lit(depth == SPLITS), 2).otherwise(3)
        judged = cut(j.select(one, "a", "b", "pa", "pb", state.alias("state")).where("state > 0"))
        sure = judged.where("state = 1").select(one, "a", "b").distinct()
        left = judged.where("state > 1").join(sure, [one, "a", "b"], "left_anti")
        q = parts.select(one, F.col("rep").alias("a"), F.col("part").alias("pa"), *[F.col(c).alias(f"q{c}") for c in "xyz"])
        p = parts.select(one, F.col("rep").alias("b"), F.col("part").alias("pb"), "x", "y", "z")
        close = distance2(vec("q"), vec(""), box) < link * link
        met = left.where("state = 2").join(q, [one, "a", "pa"]).join(p, [one, "b", "pb"]).where(close).select(one, "a", "b").distinct()
        hit = cut(sure.unionByName(met).distinct())
        edges.append(hit)
        crowded = cut(left.where("state = 3").join(hit, [one, "a", "b"], "left_anti").select(one, "a", "b", "pa", "pb"))
        if crowded.isEmpty():
            break
        wanted = crowded.select(one, F.col("a").alias("rep")).unionByName(crowded.select(one, F.col("b").alias("rep"))).distinct()
        fine = n << depth
        eighth = sum((F.pmod(F.floor(F.col(c) / F.lit(box / fine)), F.lit(2)) * (1 << i) for i, c in enumerate("xyz")), F.lit(0))
        parts = cut(parts.join(wanted, [one, "rep"], "left_semi").withColumn("part", F.concat("part", eighth.cast("string"))))
        filled = parts.select(one, "rep", "part").distinct()
        for s in "ab":
            kids = filled.select(one, F.col("rep").alias(s), F.col("part").alias(f"_{s}"), F.substring("part", 1, depth - 1).alias(f"p{s}"))
            crowded = crowded.join(kids, [one, s, f"p{s}"])
        open_ = cut(crowded.select(one, "a", "b", F.col("_a").alias("pa"), F.col("_b").alias("pb")))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.distinct()


def multipoles(points: DataFrame, by: Sequence[str], levels: int, box: str = "box_size") -> DataFrame:
    """(by, level, cx, cy, cz, n, mass, x, y, z): count, mass and centre of mass of every cell of every level of an
    octree over the box, level 0 being the box itself (A19). Sums merge before the shuffle. Massless cells have null
    centres."""
    finest = points.select(*by, "x", "y", "z", "mass", *_cells(1 << levels, box))
    m = F.col("mass")
    leaf = finest.groupBy(*by, "cx", "cy", "cz").agg(
        F.count("*").alias("n"), F.sum(m).alias("mass"), *[F.sum(m * F.col(a)).alias(f"s{a}") for a in "xyz"]
    )
    shifts = leaf.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    up = {c: F.expr(f"shiftright({c}, {levels} - level)") for c in ("cx", "cy", "cz")}
    sums = shifts.withColumns(up).groupBy(*by, "level", "cx", "cy", "cz").agg(
        F.sum("n").alias("n"), F.sum("mass").alias("mass"), *[F.sum(f"s{a}").alias(f"s{a}") for a in "xyz"]
    )
    return sums.select(*by, "level", "cx", "cy", "cz", "n", "mass", *[F.try_divide(f"s{a}", "mass").alias(a) for a in "xyz"])


def sph_density(queries: DataFrame, points: DataFrame, by: Sequence[str], k: int, box: float) -> DataFrame:
    """(by, query_id, h, density): the k-th nearest distance and the number density by a cubic spline of that extent.

    Queries with fewer than k points or k of them in one place get no row.
    """
    near = nearest_neighbours(queries, points, by, k, box)
    h = near.where(F.col("place") == k).where("r > 0").select(*by, "query_id", F.col("r").alias("h"))
    return near.join(h, [*by, "query_id"]).groupBy(*by, "query_id", "h").agg(F.sum(sph_kernel(F.col("r"), F.col("h"))).alias("density"))
