"""Neighbour searches, linked groups, densities and gravity against brute force, periodic and not."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackweave.functions import geometry as g
from trackweave.functions import physics as ph
from trackweave.operators import aggregates as ag
from trackweave.operators import gravity as gr
from trackweave.operators import profiles as pr
from trackweave.operators import spatial as sp

BOX = 1.0


def points(n, seed, clumps=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 3))
    if clumps:
        x[: n // 2] = (0.98 + rng.normal(size=(n // 2, 3)) * 0.01) % 1.0  # crowded, across the box edge
        x[0] = x[1]  # coincident
    return x


def dist(a, b, box=BOX):
    d = np.abs(a[:, None] - b[None])
    return np.sqrt((np.minimum(d, box - d) ** 2).sum(axis=2))


def frame(spark, x, name="particle_id", **more):
    df = pd.DataFrame({"s": 0, name: np.arange(len(x)), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2], **more})
    return spark.createDataFrame(df)


@pytest.mark.parametrize("k", [1, 4, 10])
def test_nearest_neighbours(spark, k):
    x, q = points(400, 1, clumps=1), points(60, 2, clumps=1)
    got = sp.nearest_neighbours(frame(spark, q, "query_id"), frame(spark, x), ["s"], k, BOX).collect()
    d = dist(q, x)
    for i in range(len(q)):
        own = sorted((r["place"], r["particle_id"], r["r"]) for r in got if r["query_id"] == i)
        assert [p for p, _, _ in own] == list(range(1, k + 1))
        assert len({p for _, p, _ in own}) == k  # distinct neighbours
        assert np.allclose([r for _, _, r in own], np.sort(d[i])[:k])


def test_fewer_points_than_neighbours(spark):
    for n in range(1, 10):
        x = points(n, n)
        got = sp.nearest_neighbours(frame(spark, points(3, 50), "query_id"), frame(spark, x), ["s"], 12, BOX).count()
        assert got == 3 * n
        if n > 2:
            break
    none = frame(spark, points(1, 1)).limit(0)
    assert sp.nearest_neighbours(frame(spark, points(2, 3), "query_id"), none, ["s"], 3, BOX).count() == 0


def test_a_small_crowded_group_is_searched_in_linear_rows(spark, monkeypatch):
    n, k = 4000, 5
    rng = np.random.default_rng(11)
    x = 0.5 + (rng.random((n, 3)) - 0.5) * 1e-3  # a thousandth of the box
    x[: n // 4] = 0.5 + rng.normal(size=(n // 4, 3)) * 1e-6  # and a core far denser yet
    x[:50] = 0.5  # in one place
    pairs = []
    nearest = sp._nearest
    monkeypatch.setattr(sp, "_nearest", lambda p, keys, k: pairs.append(p) or nearest(p, keys, k))
    got = sp.nearest_neighbours(frame(spark, x, "query_id"), frame(spark, x), ["s"], k, BOX).toPandas()
    assert len(got) == n * k
    for i in [*range(0, 60, 20), *range(100, n, 331)]:
        own = got[got.query_id == i].sort_values("place")
        d = dist(x[i : i + 1], x)[0]
        want = np.lexsort((np.arange(n), d))[:k]
        assert np.allclose(own.r, d[want], atol=1e-12) and (i >= 50 or own.particle_id.tolist() == want.tolist())
    assert sum(p.count() for p in pairs) < 200 * n


def test_radius_shell_and_cylinder(spark):
    x, q = points(500, 3, clumps=1), points(40, 4)
    d = dist(q, x)
    near = sp.within_radius(frame(spark, q, "centre_id"), frame(spark, x), ["s"], 0.2, BOX).collect()
    assert {(r["centre_id"], r["particle_id"]) for r in near} == set(zip(*np.nonzero(d < 0.2)))
    assert len(near) == (d < 0.2).sum()
    shell = sp.within_radius(frame(spark, q, "centre_id"), frame(spark, x), ["s"], 0.2, BOX, 0.1).count()
    assert shell == ((d < 0.2) & (d > 0.1)).sum()
    wide = sp.within_radius(frame(spark, q, "centre_id"), frame(spark, x), ["s"], 0.45, BOX).count()
    assert wide == (d < 0.45).sum()
    e = np.abs(q[:, None] - x[None])
    e = np.minimum(e, 1 - e)
    inside = (e[..., 2] < 0.2) & (e[..., 0] ** 2 + e[..., 1] ** 2 < 0.01)
    assert sp.within_cylinder(frame(spark, q, "centre_id"), frame(spark, x), ["s"], 0.2, 0.1, BOX).count() == inside.sum()


def test_linked_groups(spark):
    x = points(300, 5, clumps=1)
    link = 0.06
    near = dist(x, x) < link
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    got = {r["particle_id"]: (r["tag"], r["length"]) for r in sp.friends_of_friends(frame(spark, x), ["s"], link, BOX).collect()}
    assert got == {i: (label[i], (label == label[i]).sum()) for i in range(len(x))}


def linked(x, link):
    near, label = dist(x, x) < link, np.arange(len(x))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            return {i: (label[i], (label == label[i]).sum()) for i in range(len(x))}
        label = new


@pytest.mark.parametrize("way", ["blocks", "many edges", "cells"])
def test_groups_are_linked_in_blocks_whatever_their_size(spark, monkeypatch, way):
    x, link = points(1500, 14, clumps=1), 0.055
    if way == "cells":  # no block may hold that many
        monkeypatch.setattr(sp, "MOST", 1)
    else:  # pairs of cells are no rows
        monkeypatch.setattr(sp, "_near_pairs", lambda *a: pytest.fail("pairs of cells are rows"))
        monkeypatch.setattr(sp, "BLOCK", 40)
        if way == "many edges":
            monkeypatch.setattr(sp, "JOINED", 0)
    got = {r["particle_id"]: (r["tag"], r["length"]) for r in sp.friends_of_friends(frame(spark, x), ["s"], link, BOX).collect()}
    assert got == linked(x, link)


@pytest.mark.parametrize("most", [10**6, 1])
def test_points_of_one_cell_are_close(spark, monkeypatch, most):
    monkeypatch.setattr(sp, "MOST", most, raising=False)
    a = np.array([[0.001] * 3, [0.873] * 3, [50.0] * 3, [50.86] * 3])  # 1.510 and 1.490 apart
    got = {r["particle_id"]: r["tag"] for r in sp.friends_of_friends(frame(spark, a), ["s"], 1.5, 100.0).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2}


@pytest.mark.parametrize("gap", [0.0499, 0.0501])
def test_crowded_cells_are_linked_by_their_parts(spark, gap):
    rng = np.random.default_rng(7)
    a = np.c_[0.300 - rng.random(800) * 0.02, 0.5 + rng.random((800, 2)) * 0.02]
    b = np.c_[0.300 + gap + rng.random(800) * 0.02, 0.5 + rng.random((800, 2)) * 0.02]
    a[0], b[0] = (0.300, 0.51, 0.51), (0.300 + gap, 0.51, 0.51)
    x = np.concatenate([a, b, np.full((30, 3), 0.9)])
    got = {r["particle_id"]: r["tag"] for r in sp.friends_of_friends(frame(spark, x), ["s"], 0.05, BOX).collect()}
    linked = (dist(a, b) < 0.05).any()
    assert linked == (gap < 0.05)
    assert {got[i] for i in range(800)} == {0} and {got[i] for i in range(800, 1600)} == {0 if linked else 800}
    assert {got[i] for i in range(1600, 1630)} == {1600}


def test_components_of_a_chain(spark):
    nodes = spark.range(50).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 39)] + [(45, 44), (45, 45)], "a long, b long")
    got = {r["node"]: r["label"] for r in sp.components(nodes, edges).collect()}
    assert got == {i: 0 if i < 40 else 44 if i in (44, 45) else i for i in range(50)}


def test_density_and_multipoles(spark):
    x = points(300, 6)
    rho = sp.sph_density(frame(spark, x[:5], "query_id"), frame(spark, x), ["s"], 32, BOX).collect()
    for r in rho:
        d = np.sort(dist(x[:5], x)[r["query_id"]])[:32]
        u = d / d[-1]
        w = np.where(u < 0.5, 2.546479089470 + 15.278874536822 * (u - 1) * u * u, 5.092958178941 * (1 - u) ** 3) / d[-1] ** 3
        assert r["density"] == pytest.approx(w.sum())
    m = sp.multipoles(frame(spark, x, mass=np.arange(300.0), box_size=1.0), ["s"], 3)
    per = {r["level"]: (r["n"], r["m"]) for r in m.groupBy("level").agg(F.sum("n").alias("n"), F.sum("mass").alias("m")).collect()}
    assert per == {k: (300, pytest.approx(np.arange(300.0).sum())) for k in range(4)}
    top = m.where("level = 0").first()
    assert top["x"] == pytest.approx((x[:, 0] * np.arange(300)).sum() / np.arange(300).sum())


def test_reassign_to_the_nearest_track(spark):
    t = spark.createDataFrame([(0, i, 0.1 + 0.001 * i, 0.5, 0.5, 1) for i in range(5)] + [(0, 10 + i, 0.9 - 0.001 * i, 0.5, 0.5, 2) for i in range(5)], "s long, particle_id long, x double, y double, z double, track_id long")
    q = spark.createDataFrame([(0, 100, 0.12, 0.5, 0.5, 1), (0, 101, 0.95, 0.5, 0.5, 1), (0, 102, 0.02, 0.5, 0.5, 2), (1, 103, 0.5, 0.5, 0.5, 9)], "s long, query_id long, x double, y double, z double, track_id long")
    got = {r["query_id"]: r["new_track_id"] for r in sp.reassign(q, t, ["s"], 3, BOX).collect()}
    assert got == {100: 1, 101: 2, 102: 1, 103: 9}


def members(spark, groups, box=None):
    """groups: {g: (x, v, m)}."""
    out, start = [], 0
    for k, (x, v, m) in groups.items():
        n = len(x)
        out.append(pd.DataFrame({"g": k, "particle_id": np.arange(start, start + n), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2], "vx": v[:, 0], "vy": v[:, 1], "vz": v[:, 2], "mass": m}))
        start += n
    df = pd.concat(out, ignore_index=True).assign(type=1, u=0.0, soft=0.01, hz=0.0, scale_factor=1.0)
    s = spark.createDataFrame(df).withColumn("type", F.col("type").cast("int"))
    return s.withColumn("box_size", F.lit(box).cast("double"))


def kernel(r, h):
    u = r / h
    inner = np.where(u < 0.5, (-2.8 + u**2 * (5.333333333333 + u**2 * (6.4 * u - 9.6))) / h, (-3.2 + 0.066666666667 / np.maximum(u, 1e-9) + u**2 * (10.666666666667 + u * (-16 + u * (9.6 - 2.133333333333 * u)))) / h)
    return np.where(r >= h, -1 / np.maximum(r, 1e-12), inner)


def test_potentials_equal_direct_sums(spark, monkeypatch):
    monkeypatch.setattr(gr, "TASK_ROWS", 64)  # the larger group is split over tasks
    rng = np.random.default_rng(8)
    gs = {1: (rng.random((300, 3)), np.zeros((300, 3)), rng.random(300)), 2: (rng.random((7, 3)), np.zeros((7, 3)), np.ones(7)), 3: (rng.random((1, 3)), np.zeros((1, 3)), np.ones(1))}
    got = {r["particle_id"]: r["phi"] for r in gr.potentials(members(spark, gs, 1.0), 0).collect()}
    start = 0
    for x, _, m in gs.values():
        k = kernel(dist(x, x), 0.028) * m[None]
        np.fill_diagonal(k, 0)
        assert np.allclose([got[start + i] for i in range(len(x))], k.sum(axis=1))
        start += len(x)


@pytest.mark.parametrize("shape", ["box", "edge", "open", "place"])
def test_pairs_of_a_large_group_are_compared_once_and_cheaply(monkeypatch, shape):
    n, rng, seen, direct = 3000, np.random.default_rng(13), [], gr._kernel
    monkeypatch.setattr(gr, "_kernel", lambda r, h: seen.append(r.size) or direct(r, h))
    x = {"box": rng.random((n, 3)), "edge": rng.normal(size=(n, 3)) * 0.02 % 1, "open": rng.normal(size=(n, 3)), "place": np.full((n, 3), 0.4)}[shape]
    m, soft, part = rng.random(n), rng.choice([0.0005, 0.002], n), rng.integers(0, 2, n)
    rows = pd.DataFrame({"g": 1, "particle_id": np.arange(n), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2], "mass": m, "soft": soft, "box_size": np.nan if shape == "open" else 1.0, "part": part})
    tasks = [rows[part == 0].assign(a=0, b=0), rows[part == 1].assign(a=1, b=1), rows.assign(a=0, b=1)]
    got = pd.concat([gr._mutual_potentials(t.sample(frac=1, random_state=1)) for t in tasks]).groupby("particle_id").phi.sum()
    if shape != "place":  # the full kernel, many steps a pair, is for close pairs only
        assert sum(seen) < n * n / 8
    k = kernel(dist(x, x, 1e9 if shape == "open" else 1.0), 2.8 * soft[:, None]) * m[None]
    np.fill_diagonal(k, 0)
    assert len(got) == n and np.allclose(got, k.sum(axis=1), rtol=1e-9)


def test_sampled_sources_keep_the_mass(spark):
    rng = np.random.default_rng(9)
    gs = {1: (rng.normal(size=(3000, 3)), np.zeros((3000, 3)), rng.random(3000)), 2: (rng.normal(size=(50, 3)), np.zeros((50, 3)), np.ones(50))}
    m = members(spark, gs)
    s = gr.sources(m, 200).groupBy("g").agg(F.count("*").alias("n"), F.sum("mass").alias("m"))
    got = {r["g"]: (r["n"], r["m"]) for r in s.collect()}
    assert got[1] == (200, pytest.approx(gs[1][2].sum())) and got[2] == (50, pytest.approx(50))
    exact = gr.potentials(m, 0).withColumnRenamed("phi", "e")
    both = gr.potentials(m, 1000).join(exact, ["g", "particle_id"]).where("g = 1")
    assert both.agg(F.avg(F.abs(F.col("phi") / F.col("e") - 1))).first()[0] < 0.05


def test_unbinding(spark):
    rng = np.random.default_rng(10)
    clump = rng.normal(size=(100, 3)) * 0.1
    cold, fast = rng.normal(size=(100, 3)) * 2, rng.normal(size=(100, 3)) * 2
    fast[:20, 0] += np.where(np.arange(20) % 2, -1, 1) * 4000  # intruders from both sides
    hot = rng.normal(size=(60, 3)) * 5000
    gs = {1: (clump, cold, np.full(100, 0.5)), 2: (clump, fast, np.full(100, 0.5)), 3: (clump[:60], hot, np.full(60, 0.5)), 4: (clump[:5], cold[:5], np.full(5, 0.5)), 5: (clump[:30], cold[:30], np.zeros(30))}
    m = members(spark, gs)
    kept, groups = gr.unbind(m)
    v = {r["g"]: r for r in groups.collect()}
    assert (v[1]["n_bound"], v[1]["disrupted"]) == (100, False) and v[1]["m_bound"] == pytest.approx(50)
    assert (v[2]["n_bound"], v[2]["disrupted"]) == (80, False)
    assert all(v[k]["disrupted"] and v[k]["n_bound"] == 0 for k in (3, 4, 5))
    rows = kept.collect()
    assert len(rows) == m.count() == len({r["particle_id"] for r in rows})
    assert {r["particle_id"] - 100 for r in rows if r["g"] == 2 and not r["bound"]} == set(range(20))
    tracers, _ = gr.unbind(m.where("g = 1").withColumn("type", F.lit(0)))
    assert tracers.where("bound").count() == 0  # no bound tracers
    whole = {r["g"]: r["n_bound"] for r in gr.unbind(m.where("g < 4"), strip=False)[1].collect()}
    assert whole == {1: 100, 2: 100, 3: 60}


def test_refined_order(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(40, 3))
    m = members(spark, {1: (x, np.zeros((40, 3)), np.ones(40))}).withColumns({"energy": F.col("particle_id").cast("double"), "dv2": F.lit(0.0)})
    got = {r["particle_id"]: r["place"] for r in gr.refine_order(m, F.lit(10)).collect()}
    assert sorted(got.values()) == list(range(40)) and all(got[i] == i for i in range(10, 40))
    k = kernel(dist(x[:10], x[:10], 1e9), 0.028)
    np.fill_diagonal(k, 0)
    assert sorted(range(10), key=got.get) == np.argsort(k.sum(1)).tolist()
    assert spark.range(1).select(gr.centre_sample(F.lit(50_000), 1000, 0.1)).first()[0] == 5000


def test_profile_core_and_tensor(spark):
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(500, 3)) * 0.02 + [0.0, 0.5, 0.99]) % 1
    v, m = rng.normal(size=(500, 3)), rng.random(500) + 0.5
    df = members(spark, {1: (x, v, m)}, 1.0).withColumn("order", F.col("particle_id"))
    d = x - x[0]
    d = d - np.round(d)
    mean = ag.mean_motion(df, ["g"], "order").first()
    assert np.allclose([mean["x"], mean["y"], mean["z"]], x[0] + (d * m[:, None]).sum(0) / m.sum(), atol=1e-9)
    c = ag.core(df, ["g"], "order").first()
    var = (d**2 * m[:, None]).sum(0) / m.sum() - ((d * m[:, None]).sum(0) / m.sum()) ** 2
    assert c["sigma_r"] == pytest.approx(np.sqrt(var.sum()))
    r = np.sqrt((d**2).sum(1))
    rows = df.withColumn("r", g.distance(g.vec(""), tuple(F.lit(float(a)) for a in x[0]), 1.0)).withColumn("rho", F.lit(1e4))
    p = pr.cumulative(rows, ["g"], "r", bins=16)
    o = np.argsort(r, kind="stable")
    got = {q["particle_id"]: (q["n_in"], q["m_in"]) for q in p.collect()}
    assert all(got[i][0] == k + 1 and got[i][1] == pytest.approx(m[o][: k + 1].sum()) for k, i in enumerate(o.tolist()))
    s = pr.summary(p, ["g"], "r", "soft", "rho").first()
    rr, mm = np.maximum(r[o], 0.01), np.cumsum(m[o])
    assert s["v2_max"] == pytest.approx((mm / rr).max()) and s["r_half"] == pytest.approx(rr[250]) and s["r_enclose"] == pytest.approx(rr[-1])
    over = np.flatnonzero(mm > 1e4 * rr**3)
    assert s["m_over"] == pytest.approx(mm[over[-1]]) if len(over) else s["m_over"] is None


def test_scalar_functions(spark):
    df = spark.createDataFrame([(0.7, 1.0), (-0.7, 1.0), (0.5, 1.0), (0.2, None)], "d double, l double")
    assert [round(r[0], 9) for r in df.select(g.nearest("d", "l")).collect()] == [-0.3, 0.3, 0.5, 0.2]
    assert [round(r[0], 9) for r in df.limit(2).select(g.wrap("d", "l")).collect()] == [0.7, 0.3]
    row = spark.range(1).select(
        ph.softening(F.lit(0.01), F.lit(-1.0), F.lit(0.5)), ph.softening(F.lit(0.01), F.lit(0.002), F.lit(0.5)),
        ph.hubble(F.lit(1.0), F.lit(0.3), F.lit(0.7), F.lit(100.0)), ph.is_tracer(F.lit(4), 18), ph.is_tracer(F.lit(None), 18), ph.is_bound(F.lit(0.0)),
    ).first()
    assert tuple(row) == (0.01, 0.004, pytest.approx(100.0), True, False, False)
    assert ph.type_mask((1, 4)) == 18 and ph.type_mask((-1,)) == 0
