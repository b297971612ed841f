from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackweave import pipeline as pl
from trackweave.config import Config, parse

CONFIG = Config(BoxSize=100.0, SofteningHalo=0.01, NumNeighboursForReassignment=3)


def ball(n, centre, velocity, first_id, rng, radius=0.05, sigma=5.0, mass=0.1, gas=0):
    """A compact self-bound clump: its potential is far deeper than its velocities."""
    x = rng.normal(size=(n, 3)) * radius + centre
    v = rng.normal(size=(n, 3)) * sigma + velocity
    kind = np.where(np.arange(n) < gas, 0, 1)
    return pd.DataFrame(
        {"particle_id": np.arange(first_id, first_id + n), "x": x[:, 0] % 100, "y": x[:, 1] % 100, "z": x[:, 2] % 100,
         "vx": v[:, 0], "vy": v[:, 1], "vz": v[:, 2], "mass": mass, "u": 0.0, "type": kind}
    )


def snap(spark, index, parts):
    rows = pd.concat([p.assign(host_id=h) for p, h in parts], ignore_index=True)
    rows["host_id"] = rows["host_id"].astype("int64")
    rows["type"] = rows["type"].astype("int32")
    return pl.Snapshot(index, 100 + index, spark.createDataFrame(rows).drop("index"), 1.0, 0.0)


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    a0 = ball(60, (99.99, 50, 50), (0, 0, 0), 0, rng, gas=10)  # across the box edge
    b0 = ball(40, (20, 20, 20), (100, 0, 0), 1000, rng)
    hot = ball(30, (60, 60, 60), (0, 0, 0), 2000, rng, radius=5, sigma=5000)
    second = [(a0, 1), (b0.assign(x=b0.x + 70), 1), (hot, -1)]  # b falls into a's host
    third = [(a0, 7), (b0.assign(particle_id=b0.particle_id + 10**6, x=b0.x + 70)[:5], 7)]  # b is gone but for strangers
    snaps = [snap(spark, 0, [(a0, 3), (b0, 9), (hot, 4)]), snap(spark, 1, second), snap(spark, 2, third)]
    path = str(tmp_path_factory.mktemp("run"))
    return snaps, path, pl.run(spark, snaps, CONFIG, path)


def rows(state):
    return {r["track_id"]: r for r in state.tracks.collect()}


def test_births_are_dense_and_unbound_groups_are_dropped(spark, outputs):
    t = rows(pl.resume(spark, outputs[1], 100))
    assert sorted(t) == [0, 1]
    assert (t[0]["host_id"], t[0]["n_bound"], t[1]["host_id"], t[1]["n_bound"]) == (3, 60, 9, 40)
    assert all(r["rank"] == 0 and r["depth"] == 0 and r["birth"] == 100 and r["death"] == -1 for r in t.values())


def test_infall_nests_the_smaller_track(spark, outputs):
    t = rows(pl.resume(spark, outputs[1], 101))
    assert t[0]["host_id"] == t[1]["host_id"] == 1
    assert t[0]["rank"] == 0 and t[1]["rank"] == 1 and t[1]["parent"] == 0 and t[1]["depth"] == 1
    assert t[1]["n_bound"] == 40 and t[1]["last_isolation"] == 0
    assert t[0]["last_max_mass"] == pytest.approx(6.0) and t[0]["at_max_mass"] == 101


def test_a_track_without_members_dies_and_stays_known(outputs):
    t = rows(outputs[2])
    assert t[1]["n_bound"] == 0 and t[1]["death"] == 102 and t[1]["last_max_mass"] == pytest.approx(4.0)
    assert t[0]["n_bound"] >= 60 and t[0]["host_id"] == 7


def test_invariants(spark, outputs):
    for sid in (100, 101):
        s = pl.resume(spark, outputs[1], sid)
        bound = s.members.where("bound")
        assert bound.count() == bound.select("particle_id").distinct().count()  # no particle is bound twice
        counts = {r["track_id"]: r["count"] for r in bound.groupBy("track_id").count().collect()}
        assert all(counts.get(k, 0) == r["n_bound"] for k, r in rows(s).items())


def test_a_resumed_run_equals_an_unbroken_one(spark, outputs, tmp_path):
    snaps, path, whole = outputs
    again = pl.run(spark, snaps[2:], CONFIG, str(tmp_path), pl.resume(spark, path, 101))
    keep = ["track_id", "host_id", "n_bound", "death", "descendant_track_id", "rank", "depth"]
    assert sorted(map(tuple, again.tracks.select(*keep).collect())) == sorted(map(tuple, whole.tracks.select(*keep).collect()))


def test_inclusive_masses_keep_shared_members(spark, outputs):
    snaps, path, _ = outputs
    c = replace(CONFIG, InclusiveMass=True, ReassignParticles=False)
    t = rows(pl.step(pl.resume(spark, path, 100), snaps[1], c))
    assert t[0]["n_bound"] >= 60 and t[1]["n_bound"] == 40
    dm = replace(CONFIG, DmOnly=True, NoStripping=True, ReassignParticles=False)
    t = rows(pl.step(pl.resume(spark, path, 100), snaps[1], dm))
    assert t[0]["n_bound"] >= 60 and t[1]["n_bound"] == 40


def test_an_empty_snapshot_leaves_orphans(spark, outputs):
    snaps, path, _ = outputs
    none = pl.Snapshot(2, 102, snaps[0].particles.limit(0), 1.0, 0.0)
    t = rows(pl.step(pl.resume(spark, path, 101), none, CONFIG))
    assert len(t) == 2 and all(r["n_bound"] == 0 and r["death"] == 102 and r["host_id"] == -1 for r in t.values())


def test_a_configured_run_equals_one_by_hand(spark, outputs, tmp_path):
    snaps, path, _ = outputs
    for s in snaps[:2]:
        p = s.particles.withColumn("host_id", F.when(F.col("host_id") < 0, 77).otherwise(F.col("host_id")))
        p.drop("host_id").write.parquet(f"{tmp_path}/out_{s.id}.parquet")
        p.select(F.col("host_id").alias("group_id"), "particle_id").write.parquet(f"{tmp_path}/groups_{s.id}.parquet")
    text = f"""SnapshotPath {tmp_path}
        HaloPath {tmp_path}
        SubhaloPath {tmp_path}/cat
        SnapshotFileBase out  # and its number
        MinSnapshotIndex 0
        MaxSnapshotIndex 1
        SnapshotIdList 100 101
        BoxSize 100
        SofteningHalo 0.01
        NumNeighboursForReassignment 3
        ParticleNullGroupId 77
        ParticlesSplit 1
        SaveBoundParticleBindingEnergies 1
        MaxConcurrentIO 4"""
    with pytest.warns(UserWarning, match="MaxConcurrentIO"):
        c = parse(text)
    pl.run_configured(spark, c, {100: (1.0, 0.0), 101: (1.0, 0.0)})
    keep = ["snapshot_id", "track_id", "host_id", "n_bound", "death", "rank", "depth"]
    mine, other = (spark.read.parquet(f"{x}/tracks").where("snapshot_id < 102").select(*keep).collect() for x in (f"{tmp_path}/cat", path))
    assert sorted(map(tuple, mine)) == sorted(map(tuple, other))
    source = spark.read.parquet(f"{tmp_path}/cat/source").where("bound")
    assert "energy" in source.columns and source.where("energy IS NULL OR energy >= 0").count() == 0


def test_the_catalogue_holds_the_properties(spark, outputs):
    t = {r["track_id"]: r for r in spark.read.parquet(f"{outputs[1]}/tracks").where("snapshot_id = 100").collect()}
    assert t[0]["n_bound_type"] == [10, 50, 0, 0, 0, 0] and t[0]["m_bound_type"][1] == pytest.approx(5.0)
    assert t[0]["comoving_average_position"][0] % 100 == pytest.approx(99.99, abs=0.05) or t[0]["comoving_average_position"][0] % 100 < 0.05
    assert t[0]["specific_self_potential_energy"] < 0 < t[0]["specific_self_kinetic_energy"] and len(t[1]["inertial_tensor"]) == 6
