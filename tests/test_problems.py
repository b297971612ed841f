"""The operators of problems 1 to 5 against plain Python, with nulls, ties, repeated rows, empty tables and clashing names."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from trackweave.operators import changes, heavy_keys, hierarchy, history
from trackweave.operators import references as ref
from trackweave.runtime import small
from trackweave.sources.tables import rows_that_count
from trackweave.streaming.ledger import Ledger

T0 = dt.datetime(2025, 1, 1)
day = lambda n: T0 + dt.timedelta(days=n)
PERIODS = "snapshot_id long, snapshot_index int, null_group_id long, closed_at timestamp"


@pytest.fixture(scope="module")
def periods(spark):
    return spark.createDataFrame([(3, 0, -1, day(10)), (7, 1, 99, day(20)), (9, 2, None, day(30))], PERIODS)


REFS = "snapshot_id long, k long, key string, change long"  # extra columns with clashing names
TARGETS = "snapshot_id long, id long, withdrawn boolean, delivered_at timestamp, refs_0 int"


def frames(spark, refs, targets):
    r = spark.createDataFrame([(s, k, "x", 1) for s, k in refs], REFS)
    return ref.Reference("t.k", r, "k"), spark.createDataFrame([(*t, 0) for t in targets], TARGETS)


def found(df):
    return {(r["snapshot_id"], r["ref_key"]): (r["n_refs"], r["cause"]) for r in df.collect()}


def test_orphans_by_cause(spark, periods):
    refs = [(3, 1), (3, 1), (3, 2), (3, 3), (3, 4), (3, 5), (3, None), (3, -4), (7, 99), (9, 99), (8, 1), (3, 6), (3, 7)]
    targets = [
        (3, 1, None, day(1)), (3, 2, False, day(1)), (3, 2, True, day(2)), (3, 3, True, day(1)), (3, 3, False, day(2)),
        (3, 4, False, day(11)), (3, 6, False, day(5)), (3, 6, True, day(12)), (3, 7, False, day(10)), (7, 5, False, day(1)),
        (8, 1, False, day(1)), (3, None, False, day(1)), (3, 8, False, None),
    ]
    r, t = frames(spark, refs, targets)
    got = found(ref.orphan_references([r], t, "id", periods, "withdrawn"))
    assert got == {(3, 2): (1, "withdrawn"), (3, 4): (1, "late"), (3, 5): (1, "missing"), (9, 99): (1, "missing"), (8, 1): (1, "late")}


def test_orphans_in_batches_equal_one_pass(spark, periods, tmp_path):
    rng = random.Random(1)
    refs = [(rng.choice([3, 7, 9]), rng.choice([1, 1, 1, rng.randint(0, 30)])) for _ in range(400)]
    targets = [(rng.choice([3, 7, 9]), rng.randint(0, 30), rng.random() < 0.3, day(rng.randint(0, 40))) for _ in range(150)]
    r, t = frames(spark, refs, targets)
    whole = ref.orphan_references([r], t, "id", periods, "withdrawn")
    halves = ref.orphan_references([r.part(F.lit(True))], t.withColumn("k", F.lit(0)), "id", periods, "withdrawn", [F.col("k") > 3, F.col("k") >= 0])
    assert found(halves) == found(whole)
    ledger = Ledger(spark, str(tmp_path))
    existing = ref.existence_deltas(t, "id", periods, 1, "withdrawn")
    ledger.apply(existing.where("key % 2 = 0"), 0)  # in any order
    ledger.apply(ref.reference_deltas([r], periods), 1)
    before = ledger.state(1)
    ledger.apply(existing.where("key % 2 = 1"), 2)
    ledger.apply(existing.where("key % 2 = 1"), 2)  # a repeated batch
    state = ledger.state(2)
    assert found(ref.orphans(state, ["t.k"])) == found(whole)
    deltas = {(x["snapshot_id"], x["key"]): x["delta"] for x in ref.existence_changes(before, state).collect()}
    assert deltas and set(deltas.values()) == {1}

    def alive(s, k):
        close = {3: 10, 7: 20, 9: 30}[s]
        own = [(d, not w) for a, b, w, d in targets if (a, b) == (s, k) and d <= day(close)]
        return bool(own) and max(own)[1]

    null = {7: 99}
    want = {}
    for s, k in refs:
        if k != null.get(s) and not alive(s, k):
            want[s, k] = want.get((s, k), 0) + 1
    assert {k: v[0] for k, v in found(whole).items()} == want


def test_references_are_taken_back(spark, periods):
    columns = "snapshot_id long, track_id long, k long"
    before = spark.createDataFrame([(3, 1, 5), (3, 2, 5), (3, 3, 6), (3, 4, None)], columns)
    after = spark.createDataFrame([(3, 1, 5), (3, 2, 7), (3, 4, None), (3, 5, 8)], columns)
    changes = ref.revisions(before, after, ["track_id"], "k")
    assert sorted((r["k"], r["sign"]) for r in changes.collect()) == [(5, -1), (6, -1), (7, 1), (8, 1)]
    first = ref.merge_state(ref.reference_deltas([ref.Reference("t.k", before, "k")], periods))
    _, t = frames(spark, [], [(3, 8, False, day(1)), (3, 7, False, day(1)), (3, 7, True, day(2))])
    second = ref.merge_state(first.drop("delta"), ref.reference_deltas([ref.Reference("t.k", changes, "k", "sign")], periods), ref.existence_deltas(t, "id", periods, 1, "withdrawn"))
    assert {r["ref_key"]: (r["n_refs"], r["cause"]) for r in ref.orphans(second, ["t.k"]).collect()} == {5: (1, "missing"), 7: (1, "withdrawn")}
    third = ref.merge_state(second.drop("delta"), ref.existence_deltas(frames(spark, [], [(3, 8, True, day(3)), (3, 5, False, day(4))])[1], "id", periods, 1, "withdrawn"))
    assert {r["key"]: r["delta"] for r in third.where("delta <> 0").collect()} == {8: -1, 5: 1}


def test_no_references_or_targets(spark, periods):
    r, t = frames(spark, [(3, 1)], [])
    assert found(ref.orphan_references([r], t, "id", periods, "withdrawn")) == {(3, 1): (1, "missing")}
    r, t = frames(spark, [], [(3, 1, False, day(1))])
    assert ref.orphan_references([r], t, "id", periods).count() == 0


def quantile(values, p):
    values = sorted(values)
    return values[max(1, math.ceil(round(p * len(values), 9))) - 1] if values else None


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_quantiles_equal_sorting(spark, broadcast_rows):
    rng = random.Random(7)
    rows = []
    for k in range(60):
        rows += [(k, rng.choice([rng.gauss(0, 1e3), float(rng.randint(0, 3)), rng.expovariate(1e-12), -0.0])) for _ in range(rng.randint(1, 40))]
    rows += [(1, rng.expovariate(1) ** 9) for _ in range(4000)]  # a hot key over many magnitudes
    rows += [(None, 1.0)] * 50 + [(2, None)] * 5 + [(2, math.nan)] * 5 + [(2, math.inf), (2, -math.inf)] + [(99, None)] * 3
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], "key long, energy double, v int, bin int")
    got = {r["key"]: r for r in heavy_keys.per_key_profile(df, "key", "energy", (0.0, 0.25, 0.5, 0.9, 1.0), 0.5, broadcast_rows).collect()}
    for k in {k for k, _ in rows if k is not None}:
        own = [v for q, v in rows if q == k]
        finite = [v for v in own if v is not None and math.isfinite(v)]
        assert (got[k]["n_rows"], got[k]["n_values"]) == (len(own), len(finite))
        for i, p in enumerate((0.0, 0.25, 0.5, 0.9, 1.0)):
            assert got[k][f"q{i}"] == quantile(finite, p), (k, p)
    assert [k for k, r in got.items() if r["overloaded"]] == [1] and None not in got


def test_overload_counts_all_rows(spark):
    df = spark.createDataFrame([(1, 1.0)] * 4 + [(None, 1.0)] * 90 + [(i, 1.0) for i in range(2, 8)], "k long, v double")
    got = {r["k"]: r["overloaded"] for r in heavy_keys.per_key_profile(df, "k", "v", overload_share=0.04).collect()}
    assert got[1] and not got[2]
    assert heavy_keys.per_key_profile(df.limit(0), "k", "v").count() == 0


@pytest.mark.parametrize("values", [[1e30, 2.0, 3.0], [1e-9, 2e-9, 3e-9], [5e-324, 0.0], [1.7e308, -1.7e308, 1.0], [0.1, 0.2, 0.3], [1e15, 1.0]])
def test_values_of_any_size(spark, values):
    df = spark.createDataFrame([(1, v) for v in values], "k long, v double")
    got = heavy_keys.per_key_profile(df, "k", "v", (0.0, 0.5, 1.0)).first()
    assert [got[f"q{i}"] for i in range(3)] == [quantile(values, p) for p in (0.0, 0.5, 1.0)]
    assert got["v_sum"] == pytest.approx(math.fsum(values), rel=1e-12, abs=1e-18 * max(values))


def test_a_missing_version_is_an_error(spark, periods, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    deltas = ref.reference_deltas([frames(spark, [(3, 1)], [])[0]], periods)
    ledger.apply(deltas, 4)  # the first there is
    with pytest.raises(ValueError, match="batch 7"):
        ledger.apply(deltas, 7)
    ledger.apply(deltas, 5)
    assert ledger.versions() == [4, 5] and ledger.state(5).first()["refs_0"] == 2


VERSIONS = "snapshot_index int, track_id long, n long, m double, first int, change int"


def versions(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], VERSIONS)


def random_versions(rng, n=40, steps=6):
    rows = []
    for t in range(n):
        for i in range(steps):
            if rng.random() < 0.7:
                rows.append((i, t, rng.choice([None, 1, 2]), rng.choice([None, math.nan, 0.5])))
    return rows


def same(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)) for x, y in zip(a, b))


def test_changes(spark, periods):
    rng = random.Random(5)
    rows = random_versions(rng)
    snaps = spark.createDataFrame([(i,) for i in range(6)], "snapshot_index int")
    got = {tuple(r) for r in changes.snapshot_changes(versions(spark, rows), "track_id", ["n", "m"], snaps).collect()}
    by = {(t, i): (n, m) for i, t, n, m in rows}
    want = set()
    for t in range(40):
        for i in range(1, 6):
            a, b = by.get((t, i - 1)), by.get((t, i))
            if a is None and b is not None:
                want.add((i, t, "added"))
            elif b is None and a is not None:
                want.add((i, t, "removed"))
            elif a is not None and not same(a, b):
                want.add((i, t, "changed"))
    assert got == want
    assert changes.snapshot_changes(versions(spark, []), "track_id", ["n"], snaps).count() == 0
    assert changes.snapshot_changes(versions(spark, []), "track_id", ["n"], snaps.limit(0)).count() == 0


def test_a_snapshot_without_rows_removes_all(spark):
    snaps = spark.createDataFrame([(i,) for i in range(3)], "snapshot_index int")
    got = {tuple(r) for r in changes.snapshot_changes(versions(spark, [(0, 1, 5, 1.0), (2, 1, 5, 1.0), (2, None, 1, 1.0)]), "track_id", ["n"], snaps).collect()}
    assert got == {(1, 1, "removed"), (2, 1, "added")}


def test_history(spark):
    rows = random_versions(random.Random(9))
    got = history.history(versions(spark, rows), "track_id", ["n", "m"], range(6)).collect()
    by = {(t, i): (n, m) for i, t, n, m in rows}
    covered = set()
    for r in got:
        for i in range(r["valid_from"], r["valid_to"] + 1):
            assert same(by[r["track_id"], i], (r["n"], r["m"]))
            assert (r["track_id"], i) not in covered
            covered.add((r["track_id"], i))
        for edge in (r["valid_from"] - 1, r["valid_to"] + 1):  # runs are as long as they can be
            assert (r["track_id"], edge) not in by or not same(by[r["track_id"], edge], (r["n"], r["m"]))
    assert covered == set(by)
    v = history.history(versions(spark, rows), "track_id", ["n", "m"], range(6))
    assert {r["track_id"] for r in history.as_of(v, 2).collect()} == {t for t, i in by if i == 2}
    assert history.history(versions(spark, []), "track_id", ["n", "m"], range(6)).count() == 0
    assert history.history(versions(spark, []), "track_id", ["n"], []).count() == 0


def walk(parent):
    out = {}
    for n in parent:
        path, x = [n], n
        while parent[x] is not None and len(path) <= len(parent):
            x = parent[x]
            path.append(x)
        out[n] = (-1, -1, None) if parent[x] is not None else (x, len(path) - 1, path[::-1])
    return out


@pytest.mark.parametrize("broadcast_rows", [0, 120, 100_000])
def test_hierarchy(spark, broadcast_rows):
    rng = random.Random(2)
    parent = {i: rng.choice([None, rng.randint(0, 199)]) for i in range(200)}
    parent |= {1000 + i: 999 + i for i in range(1, 60)} | {1000: None}  # a long chain
    parent |= {2000: 2001, 2001: 2002, 2002: 2000, 2003: 2000, 2004: 2003}  # a cycle and what leads into it
    rows = [(n, p, "x") for n, p in parent.items()]
    rows += [(3000, 3000, "x"), (3001, -1, "x"), (3002, 77777, "x"), (None, 1, "x")]
    links = hierarchy.clean_links(spark.createDataFrame(rows, "id long, up long, root string"), "id", "up")
    trace = []
    tree = hierarchy.hierarchy(links, broadcast_rows=broadcast_rows, levels=8, trace=trace)
    got = {r["node"]: (r["root"], r["depth"], r["path"]) for r in tree.collect()}
    want = walk({n: None if p == n else p for n, p in parent.items()} | {3000: None, 3001: None, 3002: None})
    assert got == want
    deepest = max(d for _, d, _ in want.values())
    assert [n for n, _ in trace] == sorted({n for n, _ in trace}) and deepest <= trace[-1][0] < deepest + 8 + 1
    assert len(trace) == (deepest + 1 if broadcast_rows == 0 else len(trace))  # a level each, and the empty one at the end
    for (before, _), (upto, n) in zip([(0, 0), *trace], trace):  # every job finds just the nodes of its levels
        assert n == sum(before < d <= upto for _, d, _ in want.values())
    pairs = {tuple(r) for r in hierarchy.ancestor_pairs(tree).collect()}
    assert pairs == {(a, n, d - i) for n, (_, d, path) in want.items() if path for i, a in enumerate(path[:-1])}
    on = {r["node"]: r["on_cycle"] for r in hierarchy.cycles(links, tree).collect()}
    assert {n for n in on} == {n for n, (r, _, _) in want.items() if r == -1}
    assert on[2000] and on[2001] and on[2002] and not on[2003] and not on[2004]
    empty = hierarchy.hierarchy(hierarchy.clean_links(spark.createDataFrame([], "id long, up long"), "id", "up"))
    assert empty.count() == 0


def test_only_cycles(spark):
    links = hierarchy.clean_links(spark.createDataFrame([(1, 2), (2, 1)], "id long, up long"), "id", "up")
    assert {tuple(r)[:3] for r in hierarchy.hierarchy(links).collect()} == {(1, -1, -1), (2, -1, -1)}


def test_rows_that_count(spark, periods):
    rows = [
        (3, 1, 5, day(1)), (3, 1, 6, day(2)), (3, 1, 6, day(2)), (3, 1, None, day(40)), (3, None, 1, day(1)), (3, -2, 1, day(1)),
        (7, 1, 8, None), (5, 1, 9, day(1)),
    ]
    df = spark.createDataFrame(rows, "snapshot_id long, track_id long, n long, delivered_at timestamp")
    got = {(r["snapshot_index"], r["track_id"]): r["n"] for r in rows_that_count(df, ["n"], periods).collect()}
    assert got == {(0, 1): None, (1, 1): 8}


def test_small_checks_the_size(spark):
    df = spark.range(10)
    assert small(df, 5) is df
    assert "broadcast" in small(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert df.agg(F.count("*")).first()[0] == 10
