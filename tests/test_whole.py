"""Whole results where a cap, a sample or a subset would show."""

import inspect
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_pipeline import ball

from trackweave import pipeline as pl
from trackweave.config import Config
from trackweave.functions import physics as ph
from trackweave.operators import gravity as gr
from trackweave.operators import ranking as rk
from trackweave.plans import joins as jn
from trackweave.plans import structures as st


def test_every_member_gets_its_place_by_energy(spark):
    rng = np.random.default_rng(1)
    e = np.round(rng.normal(size=700), 1)  # many ties
    e[:300] = -0.5
    df = pd.DataFrame({"track_id": np.where(np.arange(700) < 600, 1, 2), "particle_id": rng.permutation(700), "e": e})
    rows = [(int(t), int(p), None if i % 50 == 0 else float(x)) for i, (t, p, x) in enumerate(df.itertuples(index=False))]
    m = spark.createDataFrame(rows, "track_id long, particle_id long, binding_energy double").repartition(7)
    got = {(r["track_id"], r["particle_id"]): r["place"] for r in rk.energy_places(m, ["track_id"]).collect()}
    want = {}
    for t in (1, 2):
        own = sorted((not (x is not None and x < 0), x is None, x or 0.0, p) for k, p, x in rows if k == t)
        want |= {(t, p): i + 1 for i, (_, _, _, p) in enumerate(own)}
    assert got == want and max(got.values()) == 600


def cloud(spark, n, seed=2):
    """One track of n members in a large box, as groups of gravity."""
    rng = np.random.default_rng(seed)
    x, v, m = rng.normal(size=(n, 3)), rng.normal(size=(n, 3)), rng.random(n)
    df = pd.DataFrame(
        {"g": 7, "snapshot_id": 5, "track_id": 7, "particle_id": rng.permutation(n), "rank": np.arange(n), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2],
         "vx": v[:, 0], "vy": v[:, 1], "vz": v[:, 2], "mass": m, "type": 1, "u": 0.0, "soft": 0.01, "box_size": 1e9, "hz": 0.0, "scale_factor": 1.0}
    )
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    phi = gr._kernel(d, 0.028) * m[None]
    np.fill_diagonal(phi, 0)
    mean = (v * m[:, None]).sum(axis=0) / m.sum()
    phi = dict(zip(df.particle_id, phi.sum(axis=1)))
    return spark.createDataFrame(df), phi, {p: 0.5 * w + ph.GRAVITY * phi[p] for p, w in zip(df.particle_id, ((v - mean) ** 2).sum(axis=1))}


@pytest.mark.parametrize("rows", [8192, 500])
def test_large_tracks_have_exact_potentials_and_energies(spark, monkeypatch, rows):
    m, phi, energy = cloud(spark, 1300)
    monkeypatch.setattr(gr, "TASK_ROWS", rows)  # 500: three parts and three blocks of sources
    monkeypatch.setattr(st, "_selves", lambda s, d: m)
    got = {r["particle_id"]: r["phi"] for r in st.phys1_potential(spark, "").collect()}
    assert got.keys() == phi.keys() and all(got[p] == pytest.approx(phi[p], rel=1e-6) for p in phi)
    got = {r["particle_id"]: r["energy"] for r in st.phys2_energy(spark, "").collect()}
    assert got.keys() == energy.keys() and all(got[p] == pytest.approx(energy[p], abs=0.006) for p in energy)


def test_unbinding_by_all_members_looks_at_every_pair_once(spark, monkeypatch):
    m, phi, energy = cloud(spark, 900)
    monkeypatch.setattr(gr, "TASK_ROWS", 300)  # three parts
    rounds, mutual = [], gr._all_potentials
    monkeypatch.setattr(gr, "_all_potentials", lambda rows: rounds.append(1) or mutual(rows))
    kept, groups = gr.unbind(m, max_sources=0)
    out = groups.first()
    assert len(rounds) == out["n_rounds"] >= 1 and not out["disrupted"]
    bound = sum(e < 0 for e in energy.values())
    assert out["n_bound"] == bound and kept.count() == 900
    rows = kept.select("particle_id", F.col("energy") - F.col("potential_energy"), "potential_energy").collect()
    assert out["n_rounds"] > 1 or all(r[2] == pytest.approx(ph.GRAVITY * phi[r[0]], rel=1e-9) for r in rows)


@pytest.mark.parametrize("query", [st.phys2_energy, st.phys3_round])
def test_members_are_read_once_and_every_pair_is_looked_at_once(spark, monkeypatch, query):
    m, phi, energy = cloud(spark, 300)
    kept, cut = [], st.cut
    monkeypatch.setattr(st, "_selves", lambda s, d: m.withColumn("snapshot_index", F.lit(0)))
    monkeypatch.setattr(st, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    out = query(spark, "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(kept) == 1 and "FlatMapGroupsInPandas" in plan and "FlatMapCoGroups" not in plan and "LogicalRDD" not in plan
    assert out.count() == (300 if query is st.phys2_energy else 1)


def test_tracks_sink_into_the_deepest_ancestor_that_they_overlap(spark):
    # 1 holds 2, 2 holds 3 and 5, 3 holds 4: 3 overlaps 1 only, 4 is an orphan at 3, 5 one that sank before
    core = "snapshot_id long, track_id long, x double, y double, z double, vx double, vy double, vz double, sigma_r double, sigma_v double, n long"
    cores = spark.createDataFrame([(0, 1, *[0.0] * 6, 1.0, 1.0, 20), (0, 2, 9.0, *[0.0] * 5, 1.0, 1.0, 20), (0, 3, 0.5, *[0.0] * 5, 1.0, 1.0, 20)], core)
    rest = "snapshot_id long, track_id long, node long, snapshot_index int, _sunk int, comoving_most_bound_position array<double>, physical_most_bound_velocity array<double>"
    t = spark.createDataFrame([(0, k, k, 4, 2 if k == 5 else None, [0.5, 0.0, 0.0], [0.0] * 3) for k in range(1, 6)], rest)
    links = [(1, 2, 1), (2, 3, 1), (1, 3, 2), (3, 4, 1), (2, 4, 2), (1, 4, 3), (2, 5, 1), (1, 5, 2)]
    pairs = spark.createDataFrame(links, "ancestor long, node long, distance long")
    rows = st._sinks(cores, t, pairs, 100.0).collect()
    assert sorted((r["track_id"], r["parent"]) for r in rows) == [(2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3)]
    assert {r["track_id"]: r["parent"] for r in rows if r["sinks"]} == {3: 1, 4: 3}


@pytest.mark.parametrize("merge", [True, False])
def test_the_pipeline_sinks_orphans_and_grandchildren(spark, merge):
    rng = np.random.default_rng(6)
    a = ball(60, (50, 50, 50), (0, 0, 0), 0, rng)
    b = ball(40, (70, 70, 70), (0, 0, 0), 1000, rng)
    c = ball(30, (50, 50, 50), (0, 0, 0), 2000, rng)  # nested below b, but lies in a
    work = pd.concat([a.assign(track_id=1), b.assign(track_id=2), c.assign(track_id=3)]).assign(soft=0.01, hz=0.0, scale_factor=1.0, box_size=100.0)
    work["type"] = work["type"].astype("int32")
    nests = spark.createDataFrame([(1, None, 0), (2, 1, 1), (3, 2, 2), (4, 2, 2), (5, 2, 2)], "track_id long, parent long, depth int")
    spot = lambda k, x, trapped: (k, x, x, x, 0.0, 0.0, 0.0, trapped)
    places = spark.createDataFrame([spot(1, 50.0, False), spot(2, 70.0, False), spot(3, 50.0, False), spot(4, 70.0, False), spot(5, 70.0, True)], "track_id long, x double, y double, z double, vx double, vy double, vz double, trapped boolean")
    out = pl._unbind_levels(spark.createDataFrame(work), nests, replace(Config(BoxSize=100.0, SofteningHalo=0.01), MergeTrappedSubhalos=merge), places)
    assert sorted((r["track_id"], r["parent"], r["handed"]) for r in out[2].collect()) == [(3, 1, merge), (4, 2, merge)]
    n = {r["track_id"]: r["count"] for r in out[0].where("bound").groupBy("track_id").count().collect()}
    assert n == ({1: 90, 2: 40} if merge else {1: 60, 2: 40, 3: 30})


def test_positions_and_offsets_start_anew_in_every_group(spark):
    rng = np.random.default_rng(3)
    rows = [(s, int(k), int(w)) for s in (4, 5, 9) for k, w in zip(rng.permutation(50 * (s - 3)), rng.integers(0, 9, 50 * (s - 3)))]
    df = spark.createDataFrame(rows, "s long, k long, w long").repartition(5)
    got = {(r["s"], r["k"]): (r["position"], r["offset"]) for r in rk.positions_within(df, ["s"], [F.col("k")], "w").collect()}
    want = {}
    for s in (4, 5, 9):
        at = 0
        for i, (k, w) in enumerate(sorted((k, w) for t, k, w in rows if t == s)):
            want[s, k], at = (i, at), at + w
    assert got == want


def test_orphans_vote_and_every_track_has_a_host(spark, monkeypatch):
    snaps = spark.createDataFrame([(10, 0), (11, 1)], "snapshot_id long, snapshot_index int")
    t = spark.createDataFrame([(10, 0, 1, 20, 100), (10, 0, 2, 0, 200), (10, 0, 3, 0, 300), (11, 1, 1, 20, 100)], "snapshot_id long, snapshot_index int, track_id long, n_bound long, most_bound_particle_id long")
    p = spark.createDataFrame([(1, 100, 7), (1, 200, 8)], "snapshot_index int, particle_id long, host_id long")
    voted = spark.createDataFrame([(1, 1, 7, 1.0)], "snapshot_index int, track_id long, host_id long, score double")
    for name, df in (("snapshots", snaps), ("tracks", t), ("particles", p), ("v1_hosts", voted)):
        monkeypatch.setattr(jn, name, lambda s, d, columns=None, df=df: df)
    assert sorted(map(tuple, jn.v1_all_hosts(spark, "").collect())) == [(1, 1, 7, 1.0), (1, 2, 8, None), (1, 3, -1, None)]


def test_the_pipeline_refines_the_innermost_members(spark):
    m, _, _ = cloud(spark, 80)
    by_id = m.toPandas().sort_values("particle_id")
    c = Config(BoxSize=1e9, SofteningHalo=0.01, MaxSampleSizeOfPotentialEstimate=20, BoundFractionCenterRefinement=0.5)
    rows = m.withColumns({"bound": F.lit(True), "potential_energy": F.col("particle_id") - 1e6, "rank": F.col("particle_id").cast("long")})
    rows = rows.withColumn("energy", F.col("potential_energy"))  # no kinetic part
    got = {r["particle_id"]: r["rank"] for r in pl._refined(rows, c).collect()}
    x, w = by_id[["x", "y", "z"]].to_numpy()[:40], by_id.mass.to_numpy()[:40]
    phi = gr._kernel(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 0.028) * w[None]
    np.fill_diagonal(phi, 0)
    assert sorted(range(40), key=got.get) == np.argsort(phi.sum(axis=1)).tolist()
    assert all(got[i] == i for i in range(40, 80))


def test_unbinding_goes_on_until_every_group_has_settled(spark):
    m, _, _ = cloud(spark, 40)
    assert "rounds" not in inspect.signature(gr.unbind).parameters  # no round is the last one but by settling
    out = {r["g"]: r["n_rounds"] for r in gr.unbind(m, gravity=1e6, min_members=1, min_tracers=1)[1].collect()}
    assert out[7] >= 1


@pytest.mark.parametrize("box", [20.0, None])
def test_bounds_of_the_potential_spare_unbinding_most_sums(spark, monkeypatch, box):
    rng = np.random.default_rng(21)
    clump, cold = rng.normal(size=(1500, 3)), rng.normal(size=(1500, 3)) * 5
    cold[:300] *= 60  # some leave at once, some are near the edge
    hot = rng.normal(size=(700, 3)) * 900
    gs = {1: (clump, cold, 0.2), 2: (clump[:700] * 3, hot, 0.2), 3: (clump[:60], cold[-60:], 1.0), 4: (clump[:700], cold[:700], 0.0), 5: (np.full((500, 3), 1.0), hot[:500], 0.2), 6: (clump[:500], cold[:500], -0.2)}
    rows = [np.column_stack([np.full(len(x), k), np.arange(len(x)) + 10_000 * k, x % box if box else x, v, np.full(len(x), m)]) for k, (x, v, m) in gs.items()]
    df = pd.DataFrame(np.concatenate(rows), columns=["g", "particle_id", "x", "y", "z", "vx", "vy", "vz", "mass"]).astype({"g": int, "particle_id": int})
    m = spark.createDataFrame(df.assign(u=0.0, soft=0.01, hz=0.0, scale_factor=1.0)).withColumns({"type": F.lit(1), "box_size": F.lit(box).cast("double")}).cache()
    monkeypatch.setattr(gr, "TASK_ROWS", 400)
    monkeypatch.setattr(st, "_selves", lambda s, d: m)
    want = {r["g"]: (r["n_bound"], pytest.approx(r["m_bound"]), r["disrupted"]) for r in gr.unbind(m, max_sources=0)[1].collect()}
    summed, sums = [], gr._all_potentials

    def count(rows, wanted=F.lit(True)):
        summed.append(rows.where("g < 3").where(wanted).count())
        return sums(rows, wanted)

    monkeypatch.setattr(gr, "_all_potentials", count)
    got = {r["track_id"]: (r["n_bound"], r["m_bound"], r["disrupted"]) for r in st.phys3_unbind(spark, "").collect()}
    assert got == want and 1000 < got[1][0] < 1300 and got[2][2] and len(got) == 6
    assert summed[0] < 2200 / 3  # before: all of them


def test_bounds_never_contradict_the_sums():
    rng = np.random.default_rng(22)
    for shape in range(12):
        n, box = 700, np.nan if shape % 3 == 0 else 1.0
        x = rng.random((n, 3)) if shape % 2 else rng.normal(size=(n, 3)) * 0.03 + 0.02
        x[:40] = x[0]  # in one place
        x = x if np.isnan(box) else x % 1.0
        order = np.lexsort(np.floor(x * 5).T)  # an order of cells, not a good one
        x, mass, soft = x[order], rng.random(n) * (rng.random(n) < 0.9), rng.choice([0.002, 0.01], n)
        way = np.abs(x[:, None] - x[None])
        phi = gr._kernel(np.sqrt((np.fmin(way, box - way) ** 2).sum(axis=2)), 2.8 * soft[:, None]) * mass[None]
        np.fill_diagonal(phi, 0.0)
        phi, factor = phi.sum(axis=1), 3.0
        kinetic = -factor * phi * rng.choice([0.0, 0.5, 0.9, 1 - 1e-6, 1.0, 1 + 1e-6, 1.1, 2.0, 20.0], n)
        at = np.arange(n)
        left = pd.DataFrame({"g": 1, "particle_id": at, "x": x[:, 0], "y": x[:, 1], "z": x[:, 2], "mass": mass, "soft": soft, "box_size": box, "kinetic": kinetic, "factor": factor, "position": at, "cell": at // 16})
        by = left.groupby("cell")
        right = pd.DataFrame({f"_{e}_{c}": by[c].agg("min" if e == "lo" else "max") for c in ("x", "y", "z", "soft") for e in ("lo", "hi")}).assign(_mass=by.mass.sum(), _bad=0).reset_index().rename(columns={"cell": "_cell"})
        sure = gr._decide(left.sample(frac=1, random_state=1), right).set_index("particle_id").sure.loc[at].to_numpy()
        energy = kinetic + factor * phi
        assert (energy[sure == -1] < 0).all() and (energy[sure == 1] > 0).all() and (sure != 0).mean() > 0.1
        assert not gr._decide(left, right.assign(_bad=1)).sure.any()
