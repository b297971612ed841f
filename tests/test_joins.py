"""Lookups, votes, nests, splits and ranks on hand-checked fixtures: ties, nulls, repeated rows, empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trackweave.operators import aggregates as ag
from trackweave.operators import catalogue, nesting, positions, progenitors, ranking, votes
from trackweave.operators import lookups as lk


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_lookup_keeps_order_and_fills_misses(spark):
    q = df(spark, [(0, 5), (1, None), (2, 7), (3, 5), (4, -1)], "ordinal int, id long")
    t = df(spark, [(5, 50, "x"), (6, None, "y")], "id long, host long, ordinal string")
    assert [tuple(r) for r in lk.lookup(q, t, ["id"], ["host"]).orderBy("ordinal").collect()] == [(0, 5, 50), (1, None, -1), (2, 7, -1), (3, 5, 50), (4, -1, -1)]
    assert lk.lookup(q.limit(0), t, ["id"], ["host"]).count() == 0
    assert {r["host"] for r in lk.lookup(q, t.limit(0), ["id"], ["host"]).collect()} == {-1}


@pytest.mark.parametrize("seed", range(3))
def test_located_counts_equal_the_histogram(spark, seed):
    rng = random.Random(seed)
    have = [rng.randint(0, 20) for _ in range(rng.randint(0, 100))]
    ask = [rng.randint(0, 25) for _ in range(rng.randint(0, 100))]
    q = df(spark, [(i, k) for i, k in enumerate(ask)], "ordinal int, id long")
    t = df(spark, [(k, i) for i, k in enumerate(have)], "id long, value long")
    counted, matches = lk.locate(q, t, "id", "value")
    hist = Counter(have)
    assert {r["ordinal"]: r["n_found"] for r in counted.collect()} == {i: hist[k] for i, k in enumerate(ask)}
    assert matches.count() == sum(hist[k] for k in ask)


def test_as_of_and_carry_over(spark):
    hist = df(spark, [(1, 1, 10), (1, 3, None), (1, 5, 50), (2, 4, 40)], "k long, t int, v long")
    ask = df(spark, [(1, 0, "a"), (1, 2, "b"), (1, 3, "c"), (1, 9, "d"), (1, 9, "e"), (2, 3, "f"), (3, 3, "g")], "k long, t int, name string")
    got = {r["name"]: r["v"] for r in lk.as_of(ask, hist, "k", "t", ["v"]).collect()}
    assert got == {"a": None, "b": 10, "c": None, "d": 50, "e": 50, "f": None, "g": None}
    rows = df(spark, [(1, 1.0), (2, 2.0)], "id long, x double")
    assert {tuple(r) for r in lk.carry_over(rows, df(spark, [(1, 9.0)], "id long, x double"), ["id"], ["x"]).collect()} == {(1, 9.0), (2, 2.0)}


def test_duplicates(spark):
    m = df(spark, [(1, 10), (1, 10), (1, 11), (2, 10)], "particle_id long, track_id long")
    assert [tuple(r) for r in lk.duplicates(m, ["particle_id"], "track_id").collect()] == [(1, 2)]


def test_host_votes(spark):
    rows = [(1, 0, 7), (1, 1, 8), (1, 2, 8), (1, 3, 8), (2, 0, 5), (2, 1, 4), (2, 2, 4), (3, 0, -1), (3, 1, -1), (3, 2, 9), (4, 0, None)]
    # track 5 has equal scores for two hosts
    rows += [(5, 3, 6), (5, 3, 2)]
    got = {r["t"]: r["host_id"] for r in votes.weighted_host(df(spark, rows, "t long, order int, host_id long"), ["t"]).collect()}
    assert got == {1: 8, 2: 5, 3: -1, 5: 2}


def test_first_tracers_fill_up(spark):
    rows = [(1, i, 100 + i, i % 3 == 0) for i in range(9)]
    m = df(spark, rows, "t long, rank int, particle_id long, tr boolean")
    got = [r["particle_id"] for r in votes.first_tracers(m, ["t"], 5, F.col("tr")).orderBy("order").collect()]
    assert got == [100, 103, 106, 101, 102]
    assert votes.first_tracers(m, ["t"], 5, F.col("tr"), spill=False).count() == 3


def test_descendant_ties_go_to_the_lowest(spark):
    stored = df(spark, [(1, p) for p in range(4)] + [(2, 50)], "t long, p long")
    held = df(spark, [(0, 9), (1, 9), (2, 3), (3, 3), (3, 8)], "p long, d long")
    assert [tuple(r) for r in votes.descendant(stored, held, ["t"], "p", "d").collect()] == [(1, 3, 2)]


def test_every_track_descends_into_itself(spark):
    parts = df(spark, [(t, t * 100 + j) for t in range(50) for j in range(100)], "t long, p long")
    held = parts.select("p", F.col("t").alias("d"))
    got = votes.descendant(parts.where("p % 100 < 5"), held, ["t"], "p", "d").collect()
    assert len(got) == 50 and all(r["t"] == r["d"] and r["n_matches"] == 5 for r in got)


def test_central(spark):
    rows = [(1, 1, 10.0, 5.0), (1, 2, 8.0, 1.0), (1, 3, 7.9, 0.0), (2, 4, 1.0, None), (2, 5, 1.0, 3.0), (3, 6, None, 1.0), (4, 7, 2.0, 1.0), (4, 8, 2.0, 1.0)]
    got = {tuple(r) for r in votes.central(df(spark, rows, "h long, t long, m double, d double"), ["h"], "m", "d", "t", 0.8).collect()}
    assert got == {(1, 2), (2, 5), (4, 7)}


def test_masks(spark):
    tree = df(spark, [(1, 0, None), (2, 1, 1), (3, 2, 2), (4, 1, 1)], "track_id long, nest_order long, parent long")
    n = tree.withColumn("snapshot_index", F.lit(0))
    t = nesting.nest_tree(n)
    visits = nesting.visiting_key(t, n.select(nesting.node().alias("node"), "nest_order"))
    order = [r["node"] for r in visits.orderBy("visit").collect()]
    assert order == [3, 2, 4, 1]  # children before their parent, siblings in order, the head last
    m = df(spark, [(1, 7), (2, 7), (3, 7), (4, 8), (1, 8), (1, 9)], "track_id long, particle_id long").withColumn("h", F.lit(1))
    m = m.join(visits.withColumnRenamed("node", "track_id"), "track_id")
    assert {tuple(r) for r in nesting.mask(m, ["h"], "visit").select("track_id", "particle_id").collect()} == {(3, 7), (4, 8), (1, 9)}
    skip = nesting.mask(m, ["h"], "visit", F.col("track_id") == 3).select("track_id", "particle_id")
    assert {tuple(r) for r in skip.collect()} == {(2, 7), (3, 7), (4, 8), (1, 9)}
    ranked = m.join(t.select(F.col("node").alias("track_id"), "depth"), "track_id").withColumn("rank", F.col("particle_id"))
    clean = nesting.clean_tracks(ranked, ["h"], "visit", "depth", F.lit(True), 1).select("track_id", "particle_id")
    assert {tuple(r) for r in clean.collect()} == {(1, 7), (4, 8), (1, 9)}  # the head's best tracer is reserved


def test_promoted_members(spark):
    rows = [(1, 0, 0, 7), (1, 0, 1, 8), (1, 0, 2, 9), (2, 1, 0, 7), (2, 1, 1, 6), (3, 2, 0, 6), (4, 1, 0, 6)]
    m = df(spark, rows, "track_id long, member_rank int, rank int, particle_id long").withColumn("h", F.lit(1))
    assert {(r["track_id"], r["particle_id"]) for r in nesting.promoted(m, ["h"]).collect()} == {(1, 8), (2, 7), (3, 6)}


def test_nests(spark):
    t = df(spark, [(1, 5, 0, None), (2, 5, 1, 1), (3, 6, 1, 1), (4, 5, 0, 1), (5, -1, 1, 3), (6, 5, 1, 99)], "track_id long, host_id long, rank long, parent long")
    up = nesting.level_up(t, [])
    assert {r["track_id"]: r["parent"] for r in up.collect()} == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: None}
    c = df(spark, [(5, 4)], "host_id long, central long")
    assert {r["track_id"]: r["parent"] for r in nesting.extend_central(up, [], c).collect()} == {1: 4, 2: 1, 3: None, 4: None, 5: None, 6: 4}
    lists = df(spark, [(1, [2, 3, 2]), (9, [3]), (7, None), (8, [])], "track_id long, nested_subhalos array<long>")
    assert {tuple(r) for r in nesting.parents_from_lists(lists, []).collect()} == {(2, 1, 0), (3, 1, 1)}


def test_merges_and_ratios(spark):
    cols = "track_id long, snapshot_of_death long, snapshot_of_sink long, sink_track_id long, descendant_track_id long, last_max_mass double, snapshot_of_last_max_mass long"
    t = df(spark, [(1, -1, -1, -1, -1, 9.0, 5), (2, 7, 7, 1, 3, 2.0, 4), (3, 6, -1, -1, 1, 1.0, 4), (4, 6, 8, 1, 3, 1.0, 5), (5, 6, None, None, -1, 1.0, 5), (6, None, 3, 1, 1, 1.0, 5)], cols)
    links = progenitors.merge_links(t)
    assert {tuple(r) for r in links.collect()} == {(2, 1, "sink"), (3, 1, "disruption"), (4, 3, "disruption")}
    assert {tuple(r) for r in progenitors.all_progenitors(t).collect()} == {(1, 2, 1), (1, 3, 1), (1, 4, 2), (3, 4, 1)}
    hist = df(spark, [(4, 1, 8.0), (5, 3, float("nan"))], "snapshot_id long, track_id long, m_bound double")
    got = {(r["track_id"]): r["ratio"] for r in progenitors.mass_ratio(links, t, hist).collect()}
    assert got == {2: 0.25, 3: 0.125, 4: None}


def test_splits(spark):
    kids = df(spark, [(1, 11), (1, 10), (1, 12), (1, 12), (10, 20), (None, 3), (4, None)], "parent long, child long")
    links = progenitors.encode_splits(kids)
    assert {tuple(r) for r in links.collect()} == {(1, 10), (10, 11), (11, 12), (10, 20)}
    one = progenitors.encode_splits(kids.where("parent = 1"))
    closure = progenitors.split_closure(one).select("particle_id", "child")
    m = df(spark, [(5, 1), (6, 11), (7, 99)], "track_id long, particle_id long")
    got = {tuple(r) for r in progenitors.with_splits(m, closure).collect()}
    assert got == {(5, 1), (5, 10), (5, 11), (5, 12), (6, 11), (6, 12), (7, 99)}
    with pytest.raises(Exception, match="occurs twice"):
        progenitors.encode_splits(df(spark, [(1, 10), (2, 10)], "parent long, child long")).collect()
    assert progenitors.encode_splits(kids.limit(0)).count() == 0
    trees = "particle_id long, root long, count int, tree long"
    old = df(spark, [(1, 1, 1, 0b0), (2, 1, 1, 0b1)], trees)
    new = df(spark, [(1, 1, 2, 0b00), (2, 1, 1, 0b1), (3, 1, 2, 0b10), (4, 9, 2, 0b00)], trees)
    assert {tuple(r) for r in progenitors.split_descendants(old, new).collect()} == {(1, 3)}
    long_ = "01" * 50  # too long for a number
    texts = "particle_id long, root long, tree string"
    got = progenitors.split_descendants(df(spark, [(1, 1, long_), (2, 1, "1")], texts), df(spark, [(1, 1, long_ + "0"), (3, 1, long_ + "1"), (4, 1, None), (5, 2, long_ + "1")], texts))
    assert {tuple(r) for r in got.collect()} == {(1, 3)}


def test_painted_positions(spark):
    groups = df(spark, [(0, 3), (1, 0), (2, 2000), (3, None), (4, 1)], "group_id long, n long").withColumn("f", F.lit(0))
    ranges = positions.offsets(groups, ["f"], "group_id", "n")
    rows = spark.range(2010).select(F.col("id").alias("p"), F.lit(0).alias("f"))
    got = {r["p"]: r["group_id"] for r in positions.paint(rows, "p", ranges, ["f"], "group_id").collect()}
    assert got == {p: 0 if p < 3 else 2 if p < 2003 else 4 if p == 2003 else -1 for p in range(2010)}


def test_ranks_and_offsets(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 9)) for i in rng.sample(range(10_000), 500)]
    got = {r["id"]: (r["position"], r["offset"]) for r in ranking.global_positions(df(spark, rows, "id long, n long"), "id", "n").collect()}
    start = 0
    for k, (i, n) in enumerate(sorted(rows)):
        assert got[i] == (k, start)
        start += n
    assert ranking.global_positions(df(spark, [], "id long, n long"), "id").count() == 0
    t = df(spark, [(1, 0, 5.0), (1, 1, None), (1, 2, float("nan")), (1, 3, 5.0), (1, 4, 4.0)], "k long, i int, m double").withColumn("snap", F.col("i") + 100)
    peaks = [(r["peak_m"], r["peak_snap"]) for r in ranking.running_peak(t, "k", "i", "m", ["snap"]).orderBy("i").collect()]
    assert peaks == [(5.0, 100), (5.0, 100), (5.0, 100), (5.0, 103), (5.0, 103)]
    m = df(spark, [(1, r) for r in range(40)] + [(2, 0), (2, 1)], "track_id long, rank int")
    kept = ranking.truncated(m, df(spark, [(1, 10), (2, 1)], "track_id long, n_bound long"), ["track_id"], 3.0)
    assert kept.where("track_id = 1").count() == 30 and kept.where("track_id = 2").count() == 1


def test_chunked_sums_equal_plain_ones(spark):
    rows = [(1, i, float(i % 7)) for i in range(300)] + [(2, 5, 1.0)]
    d = df(spark, rows, "g long, o int, v double").withColumn("chunk", F.floor(F.col("o") / 16))
    got = {(r["g"], r["o"]): r["upto"] for r in ag.running_sum(d, ["g"], [F.col("o")], "v", "chunk").collect()}
    assert all(got[1, i] == sum(float(j % 7) for j in range(i + 1)) for i in range(300)) and got[2, 5] == 1.0


def test_types_and_upscaling(spark):
    m = df(spark, [(1, 0, 1.0), (1, 1, 2.0), (1, 1, 3.0), (1, 6, 9.0), (1, None, 1.0)], "g long, type int, mass double")
    r = ag.type_counts(m, ["g"]).first()
    assert (r["n_0"], r["n_1"], r["n_2"], r["n"], r["m_1"], r["m"]) == (1, 2, 0, 5, 5.0, 16.0)
    sampled = df(spark, [(1, 0, 1.0, True), (1, 0, 3.0, False), (1, 1, 4.0, False)], "g long, type int, mass double, s boolean")
    f = ag.upscale(sampled, ["g"], F.col("s")).collect()
    assert [(x["type"], x["factor"]) for x in f] == [(0, 8.0)]


def test_mass_function_edges(spark):
    t = df(spark, [(1.0,), (9.99,), (10.0,), (100.0,), (100.1,), (None,), (float("nan"),), (0.5,)], "m double").withColumn("k", F.lit(1))
    got = {r["bin"]: (r["centre"], r["n"]) for r in catalogue.mass_function(t, "m", [1.0, 10.0, 100.0], ["k"]).collect()}
    assert got == {0: (pytest.approx(10**0.5), 2), 1: (pytest.approx(10**1.5), 2)}
