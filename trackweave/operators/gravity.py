"""Potentials and unbinding of tracks.

A track's gravity sources are all of its bound members or, beyond `max_sources`, a sample of them in order of a hash
of their ids, with masses scaled up per type; types in `keep_mask` come first. Tasks hold at most about `TASK_ROWS` of
a track's members and as many of its sources: a hot track is spread over many tasks and no task holds a track, nor are
pairs of members ever rows. Small tracks share tasks. `max_sources` 0 takes all members, whatever their number; then
every pair is looked at once for both of its members. Where only who is bound is asked for, bounds of the potentials
decide for the members of large tracks whose energy is far from 0; only the others' potentials are summed up.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions import physics as ph
from trackweave.functions.geometry import relative_velocity, vec
from trackweave.operators.aggregates import mean_motion, upscale
from trackweave.operators.ranking import positions_within
from trackweave.runtime import cut, small

TASK_ROWS = 8192
#: Members of a track and sources that `_mutual_potentials` compares at once, so that its arrays stay in a core's cache.
ROWS, COLUMNS = 128, 1024
#: Members of a cell of sources, least, and cells of a track, at most, in bounds of potentials; cells taken for each member apart.
CELL_ROWS, CELLS, CLOSE_CELLS = 32, 32_768, 256


def _kernel(r: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The potential kernel of `physics.potential_kernel` on arrays."""
    u = r / h
    with np.errstate(divide="ignore", invalid="ignore"):
        far = -1.0 / r
        inner, outer = ph.polynomial(ph.INNER, u) / h, (ph.polynomial(ph.OUTER, u) + 1 / (15 * u)) / h
    return np.where(r >= h, far, np.where(u < 0.5, inner, outer))


def _blocks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points x (3, n) and the bounds of blocks in it, each of at most ROWS points near each other."""
    n = x.shape[1]
    side = max(1, round((n / ROWS) ** (1 / 3)))
    part = np.zeros(n, dtype=np.int64)
    for c in (0, 1):  # slabs of equal counts, then columns of equal counts in each
        order = np.lexsort((x[c], part))
        count = np.bincount(part)
        place = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
        part[order] = part[order] * side + place * side // np.repeat(count, count)
    order = np.lexsort((x[2], part))
    count = np.bincount(part)
    bounds = [b + np.arange(k) * m // k for b, m in zip(np.cumsum(count) - count, count) if m for k in (-(-m // ROWS),)]
    return order, np.append(np.concatenate(bounds), n)


def _add_pairs(t: tuple, s: tuple, box: float, room: list[np.ndarray]) -> None:
    """Add the potentials of all pairs of a point of t and one of s to both. Either is (places (3, n), masses, kernel extents, sums).

    t is a small block, so that most sources have one and the same image nearest to all of it. From its middle squared
    distances are a product of matrices, but for the axes along which the image differs within t. Pairs so close that
    this loses digits, or within the kernel, are taken one by one.
    """
    (x, mx, hx, out), (y, my, hy, back) = t, s
    lo, hi = x.min(axis=1), x.max(axis=1)
    mid = (lo + hi) / 2
    moved, kind = y - mid[:, None], np.zeros(y.shape[1], dtype=np.int64)
    if not np.isnan(box):
        image = lambda e: box * ((e[:, None] - y > box / 2).astype(float) - (e[:, None] - y < -box / 2))
        first = image(lo)
        kind = np.array([1, 2, 4]) @ (first != image(hi))
        moved += first
    own = x - mid[:, None]
    extent = max(hx.max(), hy.max())
    close = np.inf if np.isnan(extent) else max(extent * extent * (1 + 1e-9), ((hi - lo) ** 2).sum() / 16384)
    for k in np.flatnonzero(np.bincount(kind)):
        plain, mixed = ([c for c in range(3) if (k >> c & 1) == bit] for bit in (0, 1))
        left = np.column_stack([*(-2 * own[plain]), (own[plain] ** 2).sum(axis=0), np.ones(len(mx))])
        of = np.flatnonzero(kind == k)
        for a in range(0, len(of), COLUMNS):
            at = of[a : a + COLUMNS]
            there, shape = moved[:, at], (len(mx), len(at))
            r2, d, e = (b[: shape[0] * shape[1]].reshape(shape) for b in room)
            np.matmul(left, np.vstack([there[plain], np.ones(len(at)), (there[plain] ** 2).sum(axis=0)]), out=r2)
            for c in mixed:
                np.abs(np.subtract(x[c][:, None], y[c][at][None], out=d), out=d)
                np.minimum(d, np.subtract(box, d, out=e), out=d)
                np.add(r2, np.multiply(d, d, out=d), out=r2)
            near = np.flatnonzero(r2 < close)
            np.sqrt(r2, out=r2)
            np.divide(-1.0, r2, out=r2)
            if len(near):
                r2.flat[near] = 0.0
                i, col = np.divmod(near, shape[1])
                j = at[col]
                way = np.abs(x[:, i] - y[:, j])
                r = np.sqrt((np.fmin(way, box - way) ** 2).sum(axis=0))
                out += np.bincount(i, _kernel(r, hx[i]) * my[j], shape[0])
                back[at] += np.bincount(col, _kernel(r, hy[j]) * mx[i], shape[1])
            out += r2 @ my[at]
            back[at] += mx @ r2


def _direct(x: np.ndarray, mass: np.ndarray, h: np.ndarray, box: np.ndarray) -> np.ndarray:
    """The potentials (k, n) of k groups of n points each: x (3, k, n), box (k, 1, 1)."""
    way = np.abs(x[:, :, :, None] - x[:, :, None, :])
    r = np.sqrt((np.fmin(way, box - way) ** 2).sum(axis=0))
    phi = _kernel(r, h[:, :, None]) * mass[:, None, :]
    i = np.arange(x.shape[2])
    phi[:, i, i] = 0.0
    return phi.sum(axis=2)


def _mutual_potentials(rows: pd.DataFrame) -> pd.DataFrame:
    """Potentials of the members of one task by each other: of all in a group `g` where its parts a and b are one, else
    of those of one part by those of the other, both ways at once. Rows that aren't `wanted` are sources only."""
    key = np.lexsort([rows[c].to_numpy() for c in ("part", "b", "a", "g")])
    rows = rows.iloc[key]
    x, out = np.ascontiguousarray(rows[["x", "y", "z"]].to_numpy(dtype=float).T), np.zeros(len(rows))
    mass, h, box = rows["mass"].to_numpy(dtype=float), ph.KERNEL * rows["soft"].to_numpy(dtype=float), rows["box_size"].to_numpy(dtype=float)
    a, b, part, ids = (rows[c].to_numpy() for c in ("a", "b", "part", "g"))
    new = np.flatnonzero((ids[1:] != ids[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
    begin, end = np.append(0, new), np.append(new, len(rows))
    sizes, alone = end - begin, a[begin] == b[begin]
    with np.errstate(all="ignore"):
        for n in np.unique(sizes[alone & (sizes <= ROWS) & (sizes > 1)]):  # groups of like size at once
            of = begin[alone & (sizes == n)]
            for some in np.array_split(of, -(-len(of) * n * n // 500_000)):
                at = some[:, None] + np.arange(n)
                out[at] = _direct(x[:, at], mass[at], h[at], box[some][:, None, None])
        room = [np.empty(ROWS * COLUMNS) for _ in range(3)]
        for lo, hi, one in zip(begin, end, alone):
            if one and hi - lo <= ROWS:
                continue
            cut_at = hi if one else lo + np.searchsorted(part[lo:hi], b[lo])
            order, bounds = _blocks(x[:, lo:cut_at])
            order += lo
            first = [x[:, order], mass[order], h[order], np.zeros(len(order))]
            other = [x[:, cut_at:hi], mass[cut_at:hi], h[cut_at:hi], out[cut_at:hi]]
            for i, j in zip(bounds[:-1], bounds[1:]):
                block, rest = ([v[..., s] for v in first] for s in (slice(i, j), slice(j, None)))
                if one:
                    block[3] += _direct(block[0][:, None], block[1][None], block[2][None], box[[lo]][:, None, None])[0]
                for s in (rest if one else other,):
                    if len(s[1]):
                        _add_pairs(tuple(block), tuple(s), box[lo], room)
            out[order] += first[3]
    done = rows[["g", "particle_id"]].assign(phi=out)
    return done[rows["wanted"].to_numpy()] if "wanted" in rows else done


def _reach(lo: np.ndarray, hi: np.ndarray, cell_lo: np.ndarray, cell_hi: np.ndarray, box: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest distance of any point of a box lo to hi (3, n) from any of a cell (3, c), as (n, c); box: the
    period, infinite for none, which no two points are further apart than along an axis."""
    a, b = cell_lo[:, None] - hi[:, :, None], cell_hi[:, None] - lo[:, :, None]
    fa, fb = (np.minimum(np.abs(d), np.abs(box - np.abs(d))) for d in (a, b))
    near = np.where(((a <= 0) & (b >= 0)) | (b >= box) | (a <= -box), 0.0, np.minimum(fa, fb))
    half = ((a <= box / 2) & (b >= box / 2)) | ((a <= -box / 2) & (b >= -box / 2))
    far = np.where(half, box / 2, np.maximum(fa, fb))
    return np.sqrt((near * near).sum(axis=0)), np.sqrt((far * far).sum(axis=0))


def _decide(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """For members of one group, in a part of its order of places, whether bounds of their potential show that they are bound
    (-1) or not (1), else 0. right: all cells of the group.

    The kernel rises with the distance and with its extent h: a source at r counts between -1 / r, or -2.8 / h within h,
    and -1 over the greater of r and h. What blocks of members leave open is looked at member by member in the cells
    whose bounds lie furthest apart. Groups with masses, places or extents that bounds don't hold for stay open.
    """
    left = left.sort_values("position")
    sure = np.zeros(len(left), dtype=np.int32)
    out = left[["g", "particle_id"]].assign(sure=sure)
    cells = right.rename(columns=lambda c: c.removeprefix("_")).sort_values("cell")
    c_lo, c_hi = (np.ascontiguousarray(cells[[f"{e}_{c}" for c in "xyz"]].to_numpy(dtype=float).T) for e in ("lo", "hi"))
    box = float(left["box_size"].iloc[0])
    box = np.inf if np.isnan(box) else box
    if cells["bad"].sum() or not box > 0 or ((c_hi.max(axis=1) - c_lo.min(axis=1)) > box).any():
        return out
    h_lo, h_hi, mass = ph.KERNEL * cells["lo_soft"].min(), ph.KERNEL * cells["hi_soft"].max(), cells["mass"].to_numpy(dtype=float)
    x, own = np.ascontiguousarray(left[["x", "y", "z"]].to_numpy(dtype=float).T), np.searchsorted(cells["cell"].to_numpy(), left["cell"].to_numpy())
    m, kinetic, factor = (left[c].to_numpy(dtype=float) for c in ("mass", "kinetic", "factor"))

    def bounds(lo: np.ndarray, hi: np.ndarray, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        near, far = _reach(lo, hi, c_lo[:, at], c_hi[:, at], box)
        return np.where(near >= h_lo, -1.0 / near, -2.8 / h_lo), -1.0 / np.maximum(far, h_hi)

    def decided(rows: np.ndarray, low: np.ndarray | float, high: np.ndarray) -> np.ndarray:
        gap = 1e-9 * (np.abs(kinetic[rows]) + factor[rows] * np.abs(low))  # rounding decides nothing
        bound, free = kinetic[rows] + factor[rows] * high < -gap, kinetic[rows] + factor[rows] * low > gap
        return np.where(factor[rows] > 0, free.astype(np.int32) - bound, 0)

    with np.errstate(all="ignore"):
        for a in range(0, len(left), ROWS):
            rows = np.arange(a, min(a + ROWS, len(left)))
            low, high = (k[0] for k in bounds(x[:, rows].min(axis=1)[:, None], x[:, rows].max(axis=1)[:, None], slice(None)))
            sure[rows] = decided(rows, low @ mass, high @ mass - m[rows] * high[own[rows]])  # without the member itself
            rows = rows[sure[rows] == 0]
            if len(rows):
                close = np.argpartition(mass * (low - high), min(CLOSE_CELLS, len(mass) - 1))[:CLOSE_CELLS]
                rest = mass.copy()
                rest[close] = 0.0
                near, far = bounds(x[:, rows], x[:, rows], close)
                place = np.full(len(mass), -1)
                place[close] = np.arange(len(close))
                k = place[own[rows]]
                self_ = np.where(k >= 0, far[np.arange(len(rows)), k], high[own[rows]])
                sure[rows] = decided(rows, near @ mass[close] + low @ rest, far @ mass[close] + high @ rest - m[rows] * self_)
    return out.assign(sure=sure)


def _spread(v: Column) -> Column:
    """The bits of a number below 1024, two zeros between each."""
    for shift, mask in ((16, 0x30000FF), (8, 0x300F00F), (4, 0x30C30C3), (2, 0x9249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def decisions(members: DataFrame, large: DataFrame) -> DataFrame:
    """(g, particle_id, sure): for the members of the groups in large (g, _n) -1 if they are bound, 1 if not, 0 where bounds of
    the potential by all members don't tell. members have besides kinetic, their energy without the potential, factor,
    by which it comes in, and the extents lo_x to hi_z of their group.

    Members are put in order of places along a curve through the group; runs of them are the cells of sources. A task holds
    some 4 TASK_ROWS members and the cells of their group, CELLS at most.
    """
    bits = [F.coalesce(F.least(F.lit(1023), F.floor(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")) * 1024)), F.lit(0)).cast("long") for c in "xyz"]
    curve = sum((F.shiftleft(_spread(b), k) for k, b in enumerate(bits[1:], 1)), _spread(bits[0]))
    rows = members.select("g", "particle_id", "x", "y", "z", "mass", "soft", "box_size", "kinetic", "factor", "_n", curve.alias("_curve"))
    order = ["g", "_curve", "particle_id"]
    n_parts = -(-large.agg(F.sum("_n")).first()[0] // (4 * TASK_ROWS))
    placed = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(CELL_ROWS), F.col("_n") / CELLS))))
    # numbers rise by 1 within a partition, and each has its own range of them
    placed = placed.withColumns({"part": F.spark_partition_id(), "position": F.monotonically_increasing_id()})
    placed = cut(placed.withColumn("cell", F.floor(F.col("position") / size)).drop("_curve", "_n"))
    good = (F.col("mass") >= 0) & (F.col("mass") < 1e300) & (F.col("soft") > 0) & (F.col("soft") < 1e300)
    for c in "xyz":
        good &= F.abs(c) < 1e300
    cells = placed.groupBy("g", "cell").agg(
        F.sum("mass").alias("mass"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("bad"),
        *[f(c).alias(f"{n}_{c}") for c in ("x", "y", "z", "soft") for n, f in (("lo", F.min), ("hi", F.max))],
    )
    cells = cells.join(placed.select("g", "part").distinct(), "g")
    cells = cells.select(*[F.col(c).alias(f"_{c}") for c in cells.columns])  # new names, as both sides stem from the same rows
    return placed.groupBy("g", "part").cogroup(cells.groupBy("_g", "_part")).applyInPandas(_decide, "g long, particle_id long, sure int")


def _sum_potentials(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Potential of every member of left from the sources in right of the same group `g`, its own row left out."""
    out = np.zeros(len(left))
    right = right.rename(columns=lambda c: c.removeprefix("_"))
    if len(right):
        at, src = left["g"].to_numpy(), right.sort_values("g", kind="stable")
        order = np.argsort(at, kind="stable")
        names, first = np.unique(src["g"].to_numpy(), return_index=True)
        ends = np.append(first[1:], len(src))
        begin, stop = (np.searchsorted(at[order], names, side) for side in ("left", "right"))
        xyz, ids = src[["x", "y", "z"]].to_numpy(), src["particle_id"].to_numpy()
        mass = src["mass"].to_numpy()
        mine, own = left[["x", "y", "z"]].to_numpy(), left["particle_id"].to_numpy()
        for a, b, c, d in zip(first, ends, begin, stop):
            rows = order[c:d]
            for part in np.array_split(rows, max(1, len(rows) * (b - a) // 1_000_000)):  # blocks of bounded size
                if not len(part):
                    continue
                way = xyz[None, a:b] - mine[part][:, None]
                box = left["box_size"].to_numpy()[part][:, None, None]
                way = np.where(np.isnan(box), way, way - np.where(way > box / 2, box, 0) + np.where(way < -box / 2, box, 0))
                h = ph.KERNEL * left["soft"].to_numpy()[part][:, None]
                phi = _kernel(np.sqrt((way * way).sum(axis=2)), h) * mass[None, a:b]
                phi[own[part][:, None] == ids[None, a:b]] = 0.0
                out[part] = phi.sum(axis=1)
    return left[["g", "particle_id"]].assign(phi=out)


def sources(members: DataFrame, max_sources: int, keep_mask: int = 0, per_type: bool = True) -> DataFrame:
    """(g, particle_id, x, y, z, mass) of the gravity sources of every group g; 0 for max_sources takes all members.

    Of the types in keep_mask none is sampled away as long as there are fewer than max_sources of them.
    """
    columns = ["g", "particle_id", "x", "y", "z"]
    if not max_sources:
        return members.select(*columns, "mass")
    keep = ph.is_tracer("type", keep_mask)
    w = Window.partitionBy("g").orderBy(keep.desc(), F.xxhash64("particle_id"), "particle_id")
    picked = members.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_sources)
    sizes = members.groupBy("g").agg(F.count("*").alias("_n"))
    big = sizes.where(F.col("_n") > max_sources).select("g")
    flags = picked.select("g", "particle_id", F.lit(True).alias("_picked"))
    open_ = members.join(big, "g", "left_semi").where(~keep).join(flags, ["g", "particle_id"], "left")
    kind = "type" if per_type else "_all"
    factors = upscale(open_.withColumn("_all", F.lit(0)), ["g"], F.coalesce("_picked", F.lit(False)), kind)
    scaled = picked.withColumn("_all", F.lit(0)).join(factors, ["g", kind], "left")
    factor = F.when(keep, 1.0).otherwise(F.coalesce("factor", F.lit(1.0)))
    return scaled.select(*columns, (F.col("mass") * factor).alias("mass"))


def potentials(members: DataFrame, max_sources: int = 1000, keep_mask: int = 0, per_type: bool = True, source_rows: DataFrame | None = None) -> DataFrame:
    """(g, particle_id, phi): softened specific potential of every member from its group's sources, for G = a = 1.

    members: g (long), particle_id, x, y, z, mass, type, soft (comoving softening) and box_size (null: not periodic).
    A member adds nothing to its own potential. Groups of one member have 0. Where the sources aren't a sample of at
    most TASK_ROWS, they are split into blocks of that size as well, whose parts of the potential are summed up.
    """
    if source_rows is None and not max_sources:
        return _all_potentials(members)
    pieces = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / TASK_ROWS)).cast("int")
    sizes = members.groupBy("g").agg(F.count("*").alias("_n"))
    given = sources(members, max_sources, keep_mask, per_type) if source_rows is None else source_rows
    few = source_rows is None and 0 < max_sources <= TASK_ROWS
    if source_rows is not None:
        sizes = sizes.join(given.groupBy("g").agg(F.count("*").alias("_s")), "g", "left").withColumn("_s", F.coalesce("_s", F.lit(0)))
    blocks = F.lit(1) if few else pieces("_n" if source_rows is None else "_s")
    plan = sizes.select("g", pieces("_n").alias("_parts"), blocks.alias("_blocks"))
    small_rows = plan.join(sizes.select("g", "_n"), "g").where("_parts = 1 AND _blocks = 1").agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    n_tasks = max(members.sparkSession.sparkContext.defaultParallelism * 4, -(-small_rows // TASK_ROWS))
    # a task: part k of a large group with block b of its sources, or one of the bins of small groups, as many as their rows need
    task = lambda k, b: F.when((F.col("_parts") > 1) | (F.col("_blocks") > 1), F.xxhash64("g", k, b)).otherwise(F.pmod(F.xxhash64("g"), F.lit(n_tasks)))
    piece = lambda n: F.pmod(F.xxhash64("particle_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(plan, "g").withColumn("_b", F.lit(0) if few else each("_blocks")).withColumn("task", task(piece("_parts"), F.col("_b")))
    right = given.join(plan, "g").withColumn("_k", each("_parts")).withColumn("task", task(F.col("_k"), piece("_blocks")))
    targets = left.select("task", "g", "particle_id", "x", "y", "z", "soft", "box_size")
    # new names, as both sides stem from the same rows
    pulls = right.select(*[F.col(c).alias(f"_{c}") for c in ("task", "g", "particle_id", "x", "y", "z", "mass")])
    phi = targets.groupBy("task").cogroup(pulls.groupBy("_task")).applyInPandas(_sum_potentials, "g long, particle_id long, phi double")
    return phi if few else phi.groupBy("g", "particle_id").agg(F.sum("phi").alias("phi"))


def _all_potentials(members: DataFrame, wanted: Column | None = None) -> DataFrame:
    """`potentials` by all members. Every pair of parts of a group of more than TASK_ROWS members is one task, which sums
    up either part's potentials by the other from the same distances; groups share the box and a member's own softening.

    With `wanted` only these members have rows in groups above TASK_ROWS: the others are in parts of their own, which
    are sources to the parts of wanted ones, but not to each other.
    """
    rows = members.select("g", "particle_id", "x", "y", "z", "mass", "soft", "box_size", (F.lit(True) if wanted is None else wanted).alias("wanted"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("_n"), F.count_if("wanted").alias("_k"))
    large, pieces = F.col("_n") > TASK_ROWS, lambda n: F.ceil(n / TASK_ROWS).cast("int")
    plan = sizes.select("g", F.when(large, pieces(F.col("_k"))).otherwise(1).alias("_first"), F.when(large, pieces(F.col("_n") - F.col("_k"))).otherwise(0).alias("_rest"))
    small_rows = sizes.where(~large).agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    n_tasks = max(members.sparkSession.sparkContext.defaultParallelism * 4, -(-small_rows // TASK_ROWS))
    own = F.col("wanted") | (F.col("_rest") == 0)
    place = F.when(own, F.pmod(F.xxhash64("particle_id"), F.col("_first"))).otherwise(F.col("_first") + F.pmod(F.xxhash64("particle_id"), F.greatest("_rest", F.lit(1))))
    split = rows.join(plan, "g").where("_first > 0").withColumn("part", place.cast("int"))
    split = split.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_first") + F.when(own, F.col("_rest")).otherwise(0) - 1)))
    split = split.withColumns({"a": F.least("part", "_q"), "b": F.greatest("part", "_q")})
    task = F.when(F.col("_first") + F.col("_rest") > 1, F.xxhash64("g", "a", "b")).otherwise(F.pmod(F.xxhash64("g"), F.lit(n_tasks)))
    phi = split.withColumn("task", task).drop("_first", "_rest", "_q").groupBy("task").applyInPandas(_mutual_potentials, "g long, particle_id long, phi double")
    return phi.groupBy("g", "particle_id").agg(F.sum("phi").alias("phi"))


def energies(members: DataFrame, phi: DataFrame, frames: DataFrame, gravity: Column | float, thermal: bool = False, also: Sequence[str] = ()) -> DataFrame:
    """members with energy: kinetic in the group's frame plus G phi / a, plus u if thermal.

    frames: (g, x, y, z, vx, vy, vz). members carry hz, scale_factor and box_size. also: columns of phi to keep.
    """
    j = _in_frames(members, frames).join(phi, ["g", "particle_id"])
    grav = _potential(gravity)
    e = ph.binding_energy(_motion(), grav, F.col("u") if thermal else None)
    return j.select(*members.columns, *also, (grav).alias("potential_energy"), e.alias("energy"))


def _in_frames(members: DataFrame, frames: DataFrame) -> DataFrame:
    return members.join(frames.select("g", *[F.col(c).alias(f"f{c}") for c in ("x", "y", "z", "vx", "vy", "vz")]), "g")


def _motion() -> tuple[Column, Column, Column]:
    return relative_velocity(vec(""), vec("v"), vec("f"), vec("fv"), "hz", "scale_factor", "box_size")


def _potential(gravity: Column | float, phi: Column | str = "phi") -> Column:
    return (F.col(phi) if isinstance(phi, str) else phi) * (gravity if isinstance(gravity, Column) else F.lit(gravity)) / F.col("scale_factor")


def bound_flags(members: DataFrame, frames: DataFrame, gravity: Column | float, thermal: bool = False) -> DataFrame:
    """members with potential_energy, energy and bound as by `energies` from all members, but both energies null where bounds
    of the potential decide. They are taken for groups of more than TASK_ROWS members."""
    sizes = members.groupBy("g").agg(F.count("*").alias("_n"), *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    large = cut(_in_frames(sizes.where(F.col("_n") > TASK_ROWS), frames))
    if large.isEmpty():
        e = energies(members, _all_potentials(members), frames, gravity, thermal)
        return e.withColumn("bound", ph.is_bound("energy"))
    kinetic = ph.binding_energy(_motion(), F.lit(0.0), F.col("u") if thermal else None)
    moving = members.join(small(large), "g").withColumns({"kinetic": kinetic, "factor": _potential(gravity, F.lit(1.0))})
    sure = cut(decisions(moving, large))
    open_ = sure.where("sure = 0").select("g", "particle_id", F.lit(True).alias("_open"))
    # large groups without open members take no part in sums
    left = cut(large.select("g").join(open_.select("g").distinct().withColumn("_some", F.lit(True)), "g", "left"))
    rows = members.join(small(left.withColumn("_large", F.lit(True))), "g", "left").where("_large IS NULL OR _some").join(small(open_), ["g", "particle_id"], "left")
    phi = _all_potentials(rows, F.col("_large").isNull() | F.coalesce("_open", F.lit(False)))
    known = phi.withColumn("sure", F.lit(0)).unionByName(sure.where("sure <> 0").withColumn("phi", F.lit(None).cast("double")))
    e = energies(members, known, frames, gravity, thermal, ["sure"])
    return e.withColumn("bound", F.when(F.col("sure") == 0, ph.is_bound("energy")).otherwise(F.col("sure") < 0)).drop("sure")


def unbind(
    members: DataFrame,
    gravity: float = ph.GRAVITY,
    precision: float = 0.995,
    min_members: int = 20,
    min_tracers: int = 10,
    tracer_mask: int = 18,
    max_sources: int = 1000,
    keep_mask: int = 32,
    per_type: bool = True,
    thermal: bool = False,
    strip: bool = True,
    with_energies: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Iterative unbinding of all groups at once (P3): (members with bound, energy, potential_energy; groups with
    n_bound, m_bound, disrupted, n_rounds).

    members: g, particle_id, x, y, z, vx, vy, vz, mass, type, u, soft, hz, scale_factor, box_size. Every round takes
    the energies of the members still bound in the frame of their mean motion, drops those at or above 0 and goes on with
    the groups that lost more than 1 - precision of them; settled and disrupted groups leave the loop. A group of
    fewer than min_members bound members or min_tracers bound tracers disrupts: nothing of it is bound (P9). Members
    that never were in a bound set keep the energy of the round that dropped them. Groups in which one mean is
    undefined (no mass) disrupt. With strip=False every member counts as bound (P11), and one round gives the energies.
    With with_energies=False both energies may be null, and sums over all members are only made for those that bounds
    leave open (`bound_flags`); who is bound is the same.
    """
    rows = cut(members.withColumn("_order", F.xxhash64("particle_id")))
    active = rows
    settled: list[DataFrame] = []
    verdicts: list[DataFrame] = []
    tracer = ph.is_tracer("type", tracer_mask)
    for n in count(1):  # ends, as every group that stays loses a member a round
        frames = mean_motion(active, ["g"], "_order").where("mass > 0")
        if strip and not (with_energies or max_sources):
            e = cut(bound_flags(active, cut(frames), gravity, thermal))
        else:
            phi = potentials(active, max_sources, keep_mask, per_type)
            e = cut(energies(active, phi, frames, gravity, thermal).withColumn("bound", ph.is_bound("energy") if strip else F.lit(True)))
        counts = e.groupBy("g").agg(
            F.count("*").alias("_last"),
            F.count_if("bound").alias("n_bound"),
            F.coalesce(F.sum(F.when(F.col("bound"), F.col("mass"))), F.lit(0.0)).alias("m_bound"),
            F.count_if(F.col("bound") & tracer).alias("_tracers"),
        )
        gone = (F.col("n_bound") < min_members) | (F.col("_tracers") < min_tracers)
        calm = F.col("n_bound") >= F.col("_last") * precision
        state = cut(counts.select("g", "n_bound", "m_bound", gone.alias("disrupted"), (gone | calm).alias("_done"), F.lit(n).alias("n_rounds")))
        ended = state.where("_done").select("g", "disrupted")
        out = e.join(state.select("g", "disrupted", "_done"), "g")
        settled.append(out.where("_done OR NOT bound").withColumn("bound", F.col("bound") & ~F.col("disrupted") & F.col("_done")).drop("disrupted", "_done", "_order"))
        none = F.when(F.col("disrupted"), 0)
        verdicts.append(
            state.where("_done").select("g", F.coalesce(none.cast("long"), "n_bound").alias("n_bound"), F.coalesce(none.cast("double"), "m_bound").alias("m_bound"), "disrupted", "n_rounds")
        )
        del ended
        active = cut(out.where("NOT _done AND bound").select(*rows.columns))
        if active.isEmpty():
            break
    kept, groups = settled[0], verdicts[0]
    for a, b in zip(settled[1:], verdicts[1:]):
        kept, groups = kept.unionByName(a), groups.unionByName(b)
    # groups without any mean never got an energy: they are disrupted
    lost = rows.join(kept.select("g", "particle_id"), ["g", "particle_id"], "left_anti").drop("_order")
    null = F.lit(None).cast("double")
    kept = kept.unionByName(lost.withColumns({"potential_energy": null, "energy": null, "bound": F.lit(False)}))
    none = rows.select("g").distinct().join(groups, "g", "left_anti")
    groups = groups.unionByName(
        none.select("g", F.lit(0).cast("long").alias("n_bound"), F.lit(0.0).alias("m_bound"), F.lit(True).alias("disrupted"), F.lit(0).alias("n_rounds"))
    )
    return kept, groups


def refine_order(bound: DataFrame, size: Column, max_sources: int = 0) -> DataFrame:
    """(g, particle_id, place): members by energy, the first `size` of them reordered by their own potential.

    bound: members with energy, potential columns of `potentials` and frame velocities as dv2 (kinetic part).
    """
    ranked = cut(positions_within(bound, ["g"], [F.col("energy"), F.col("particle_id")]).withColumnRenamed("position", "_p"))
    inner = cut(ranked.where(F.col("_p") < size))
    own = potentials(inner, max_sources).withColumnRenamed("phi", "_phi")
    again = inner.join(own, ["g", "particle_id"]).withColumn("_e", F.col("dv2") * 0.5 + F.col("_phi"))
    first = positions_within(again, ["g"], [F.col("_e"), F.col("particle_id")]).select("g", "particle_id", F.col("position").alias("place"))
    return first.unionByName(ranked.where(F.col("_p") >= size).select("g", "particle_id", F.col("_p").alias("place")))


def centre_sample(n_bound: Column, max_sources: int, fraction: float) -> Column:
    return F.greatest(F.lit(max_sources), F.floor(n_bound * fraction))


def refined(bound: DataFrame, max_sources: int, fraction: float, gravity: float = ph.GRAVITY) -> DataFrame:
    """(g, particle_id, place) of the bound members of groups above max_sources, whose energies come from a sample, the
    innermost reordered by their own potential (W6). bound: members with energy and potential_energy, as of `unbind`."""
    sizes = bound.groupBy("g").agg(F.count("*").alias("_n")).where(F.col("_n") > max_sources)
    big = bound.join(sizes, "g").withColumn("dv2", (F.col("energy") - F.col("potential_energy")) * 2 * F.col("scale_factor") / gravity)
    return refine_order(big, centre_sample(F.col("_n"), max_sources, fraction))
