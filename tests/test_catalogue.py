import pytest

from trackweave.catalogue import Catalogue

TRACKS = "snapshot_id long, track_id long, n_bound long, snapshot_of_birth int, snapshot_of_death int, snapshot_of_sink int, sink_track_id long, descendant_track_id long"
NONE = (-1, -1, -1, -1)


@pytest.fixture(scope="module")
def cat(spark):
    snaps = [(0, 3, 0.5), (1, 7, 0.8), (2, 9, 1.0)]
    rows = [(3, 0, 50, 3, *NONE), (3, 1, 30, 3, *NONE), (7, 0, 60, 3, *NONE), (7, 1, 0, 3, 7, 7, 0, -1), (7, 2, 20, 7, *NONE), (7, 3, 20, 7, *NONE)]
    rows += [(9, 0, 70, 3, *NONE), (9, 1, 0, 3, 7, 7, 0, -1), (9, 2, 0, 7, 9, -1, -1, 1), (9, 3, 0, 7, 9, 9, 0, 0)]
    members = [(9, 0, 1, 11, True), (9, 0, 0, 10, True), (9, 0, 2, 12, False), (7, 2, 0, 20, True)]
    s = spark.createDataFrame([(*x, 1e10, 1.0, 1.0) for x in snaps], "snapshot_index int, snapshot_id int, scale_factor double, mass_in_msunh double, length_in_mpch double, vel_in_kms double")
    m = spark.createDataFrame(members, "snapshot_id long, track_id long, rank int, particle_id long, bound boolean")
    return Catalogue(spark.createDataFrame(rows, TRACKS), s, m)


def test_properties(cat):
    assert cat.last() == 9 and {tuple(r) for r in cat.counts().collect()} == {(3, 2), (7, 4), (9, 4)}
    assert {tuple(r) for r in cat.properties(3, columns=["n_bound"]).collect()} == {(0, 50), (1, 30)}
    got = cat.properties(7, [2, 0, 2], ["n_bound"]).orderBy("ordinal").collect()
    assert [(r["track_id"], r["n_bound"]) for r in got] == [(2, 20), (0, 60), (2, 20)]
    with pytest.raises(KeyError):
        cat.properties(3, [2], ["n_bound"])
    assert cat.properties(3, [2], ["n_bound"], -9999).first()["n_bound"] == -9999
    assert cat.properties().count() == 4


def test_members_and_evolution(cat):
    assert [r["particle_id"] for r in cat.member_ids(9, [0]).orderBy("rank").collect()] == [10, 11]
    assert cat.member_ids(9, [0], source=True).count() == 3
    got = cat.evolution([2, 0], ["n_bound"]).orderBy("track_id", "snapshot_index").collect()
    assert [(r["track_id"], r["snapshot_id"], r["n_bound"]) for r in got] == [(0, 3, 50), (0, 7, 60), (0, 9, 70), (2, 7, 20), (2, 9, 0)]
    with pytest.raises(LookupError):
        Catalogue(cat.tracks, cat.snapshots).member_ids()


def test_progenitors(cat):
    ids = lambda df: [r["progenitor"] for r in df.collect()]
    assert ids(cat.progenitors(0, "sink")) == [1, 3] and ids(cat.progenitors(1, "disruption")) == [2]
    assert ids(cat.progenitors(0, direct=True)) == [1, 3] and ids(cat.progenitors(0)) == [1, 2, 3]
    assert cat.scale_factors() == {3: 0.5, 7: 0.8, 9: 1.0} and cat.units()["mass_in_msunh"] == 1e10


def test_over_delivered_tables(spark):
    c = Catalogue.from_tables(spark, "/root/testdata/sf0.001")
    assert c.last() == 41 and c.counts().count() == 12 and c.properties(columns=["m_bound"]).columns == ["track_id", "m_bound"]


def test_empty(cat):
    with pytest.raises(LookupError):
        Catalogue(cat.tracks.limit(0), cat.snapshots).last()
