"""Config files, binary snapshots and group tables (exact round trips), formats, the catalogue on disk."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F

from trackweave import config as cf
from trackweave.sources import blocks, catalogue_io, formats

TEXT = """
SnapshotPath /in   # a comment
HaloPath /in
SubhaloPath /out
SnapshotFileBase snap
MaxSnapshotIndex 2
BoxSize 62.5
SofteningHalo 5e-5
[section]
SnapshotIdList 3 7 11
TracerParticleTypes 1
MinNumPartOfSub 30
PeriodicBoundaryOn 0
"""


def test_config():
    c = cf.parse(TEXT)
    assert (c.BoxSize, c.SnapshotIdList, c.TracerParticleTypes, c.MinNumPartOfSub, c.PeriodicBoundaryOn) == (62.5, (3, 7, 11), (1,), 30, False)
    assert c.NumTracerHostFinding == 10 and c.tracer_mask == 2 and c.keep_mask == 32
    assert cf.parse(cf.dump(c)) == c
    assert cf.Config(DoNotSubsampleParticleTypes=(-1,)).keep_mask == 0
    assert cf.Config().gravity == pytest.approx(43.0071)


@pytest.mark.parametrize(
    "change",
    ["Nonsense 1", "SnapshotIdList 3 3 11", "SnapshotIdList 11 7 3", "SnapshotIdList 3 7", "MaxSampleSizeOfPotentialEstimate -1", "SubCoreSizeMin 0",
     "SubCoreSizeFactor 1.5", "DoNotSubsampleParticleTypes 0 1 2 3 4 5", "BoxSize large", "BoxSize"],
)
def test_wrong_configs(change):
    with pytest.raises(ValueError):
        cf.parse(TEXT + change + "\n")


def test_missing_keys():
    with pytest.raises(ValueError, match="SofteningHalo"):
        cf.parse(TEXT.replace("SofteningHalo 5e-5", ""))


def record(f, a, order):
    raw = a.astype(a.dtype.newbyteorder(order)).tobytes()
    mark = np.array(len(raw), f"{order}u4").tobytes()
    f.write(mark + raw + mark)


def write_snapshot(path, order, real, npart, fixed, rng, first_id, n_files=1, total=None, with_ids=True):
    n = sum(npart)
    head = np.zeros(1, blocks.HEADER.newbyteorder(order))
    head["npart"], head["mass"], head["time"], head["box_size"] = npart, fixed, 0.25, 10.0
    head["npart_total"], head["num_files"] = total or npart, n_files
    pos, vel = rng.random((n, 3)) * 14 - 2, rng.normal(size=(n, 3)) * 100
    ids = np.arange(first_id, first_id + n)
    masses = rng.random(sum(k for k, m in zip(npart, fixed) if m == 0))
    u = rng.random(npart[0])
    with open(path, "wb") as f:
        raw = head.tobytes().ljust(blocks.HEADER_BYTES, b"\0")
        mark = np.array(blocks.HEADER_BYTES, f"{order}i4").tobytes()
        f.write(mark + raw + mark)
        record(f, pos.astype(f"f{real}"), order)
        record(f, vel.astype(f"f{real}"), order)
        if with_ids:
            record(f, ids.astype("i8" if real == 8 else "i4"), order)
        if len(masses):
            record(f, masses.astype(f"f{real}"), order)
        record(f, u.astype(f"f{real}"), order)
    return ids, pos, vel, masses, u


@pytest.mark.parametrize("order,real", [("<", 4), (">", 8)])
def test_binary_snapshots(spark, tmp_path, order, real):
    rng = np.random.default_rng(1)
    npart, fixed = [5, 7, 0, 0, 3, 1], [0.0, 0.5, 0.0, 0.0, 0.0, 0.0]
    want = [write_snapshot(tmp_path / f"snap.{i}", order, real, npart, fixed, rng, 100 * i, 2, [2 * k for k in npart]) for i in range(2)]
    df = formats.load_snapshot(spark, "blocks", f"{tmp_path}/snap.*", slice="3")
    rows = {r["particle_id"]: r for r in df.collect()}
    assert len(rows) == 32
    for ids, pos, vel, masses, u in want:
        for i, k in enumerate(ids.tolist()):
            r = rows[k]
            kind = 0 if i < 5 else 1 if i < 12 else 4 if i < 15 else 5
            assert r["type"] == kind and r["vx"] == pytest.approx(vel[i, 0] * 0.5, rel=1e-6)
            assert r["x"] == pytest.approx(pos[i, 0] % 10.0, abs=1e-5) and 0 <= r["x"] < 10
            own = masses[i] if i < 5 else 0.5 if i < 12 else masses[i - 7]
            assert r["mass"] == pytest.approx(own, rel=1e-6) and r["u"] == pytest.approx(u[i] if i < 5 else 0, rel=1e-6)
    for i in range(2):
        write_snapshot(tmp_path / f"bare.{i}", order, real, npart, fixed, rng, 0, 2, [2 * k for k in npart], with_ids=False)
    implicit = formats.load_snapshot(spark, "blocks", f"{tmp_path}/bare.*", ids="false")
    assert sorted(r["particle_id"] for r in implicit.select("particle_id").collect()) == list(range(32))


def test_broken_files(spark, tmp_path):
    (tmp_path / "bad").write_bytes(b"nothing here")
    with pytest.raises((PythonException, ValueError, Exception)):
        formats.load_snapshot(spark, "blocks", f"{tmp_path}/bad").count()
    with pytest.raises(ValueError):
        formats.load_snapshot(spark, "unheard", str(tmp_path))
    formats.register("mine", snapshot=lambda s, path, **_: s.range(3).withColumnRenamed("id", "particle_id"))
    assert formats.load_snapshot(spark, "mine", "").count() == 3


@pytest.mark.parametrize("version,width", [(2, 4), (3, 8)])
def test_group_tables(spark, tmp_path, version, width):
    lengths, ids = [[3, 0, 2], [4]], [np.arange(10, 15), np.array([100, 101, 102, 103, 777])]
    for i in range(2):
        n, k = len(lengths[i]), len(ids[i])
        head = np.array([(n, 4, k, 10, 2)], "<i4,<i4,<i4,<i8,<i4") if version == 3 else np.array([(n, k, 4, 2)], "<i4,<i4,<i4,<i4")
        (tmp_path / f"tab.{i}").write_bytes(head.tobytes() + np.array(lengths[i] * 2, "<i4").tobytes())
        raw = (ids[i] | (1 << 20)).astype(f"<i{width}").tobytes()
        (tmp_path / f"ids.{i}").write_bytes(head.tobytes() + (b"\0" * 4 if version == 3 else b"") + raw)
    name = f"groups{version}_{'long' if width == 8 else 'int'}"
    got = formats.load_groups(spark, name, f"{tmp_path}/tab.*", ids=f"{tmp_path}/ids.*", mask=(1 << 20) - 1)
    pairs = sorted(map(tuple, got.collect()))
    assert pairs == [(0, 10), (0, 11), (0, 12), (2, 13), (2, 14), (3, 100), (3, 101), (3, 102), (3, 103)]


def test_catalogue(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([(s, t, t * 10, None if t == 3 else 1.5) for s in (1, 2) for t in range(5)], "snapshot_id long, track_id long, n_bound long, m double")
    catalogue_io.write_catalogue(rows, path, {1: {"a": 0.5}, 2: {"a": 0.75}})
    catalogue_io.write_catalogue(rows.where("snapshot_id = 2").limit(3), path, {2: {"a": 1.0}})  # one snapshot anew, the other stays
    assert catalogue_io.read_metadata(spark, path) == {1: {"a": 0.5}, 2: {"a": 1.0}}
    assert catalogue_io.read_catalogue(spark, path, ["track_id"], 1, expected=5).columns == ["snapshot_id", "track_id"]
    with pytest.raises(ValueError):
        catalogue_io.read_catalogue(spark, path, expected=99)
    one = catalogue_io.read_catalogue(spark, path, snapshot_id=1)
    got = [tuple(r) for r in catalogue_io.by_track(one, [3, 0, 3], ["n_bound", "m"]).orderBy("ordinal").collect()]
    assert got == [(0, 3, 30, None), (1, 0, 0, 1.5), (2, 3, 30, None)]
    with pytest.raises(KeyError):
        catalogue_io.by_track(one, [3, 77], ["n_bound"])
    assert catalogue_io.by_track(one, [77], ["n_bound"], -9999).first()["n_bound"] == -9999
    m = rows.select("snapshot_id", "track_id", F.lit(0).alias("rank"))
    catalogue_io.write_state(m, path)
    assert catalogue_io.read_state(spark, path, 2, m.schema).count() == 5
    assert catalogue_io.read_state(spark, path, None, m.schema).count() == 0
    assert catalogue_io.drop_states(spark, path, 2) == [1] and catalogue_io.read_state(spark, path, 2, m.schema).count() == 5


def test_splits_missing(spark, tmp_path):
    assert formats.read_splits(spark, str(tmp_path / "none")).count() == 0
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(AnalysisException):  # a file of other columns isn't a missing one
        formats.read_splits(spark, str(tmp_path / "other")).count()
