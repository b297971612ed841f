import itertools
from bisect import bisect_left, insort

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trackweave.llm import packing as pk


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=60), st.integers(100, 300))
def test_blocks_hold_every_item_within_the_capacity(sizes, capacity):
    sizes = np.array(sizes)
    window = pk.pack_block(sizes, capacity)
    assert len(window) == len(sizes) and (window >= 0).all()
    assert (np.bincount(window, weights=sizes) <= capacity).all()


def test_differencing_is_near_equal():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 1000, 400)
    sums = np.bincount(pk.differencing(sizes, 8), weights=sizes)
    assert sums.max() - sums.min() <= 2
    known = np.array([8, 7, 6, 5, 4])  # the textbook case: two windows that differ by 2
    sums = np.bincount(pk.differencing(known, 2), weights=known)
    assert abs(sums[0] - sums[1]) == 2


def test_many_tiny_items_fill_few_windows():
    window = pk.pack_block(np.full(40_000, 10), 65_536)
    assert len(np.unique(window)) == 7
    assert np.bincount(window).max() * 10 <= 65_536


def test_full_pieces_stand_alone():
    sizes = np.array([100, 100, 40, 60, 0, 100])
    window = pk.pack_block(sizes, 100)
    assert len(np.unique(window[[0, 1, 5, 2]])) == 4 and np.bincount(window, weights=sizes).tolist() == [100.0] * 4


def test_the_count_rises_until_the_capacity_holds():
    window = pk.pack_block(np.full(9, 60), 100)  # six windows would do by tokens, nine are needed
    assert np.bincount(window).tolist() == [1] * 9


def best_fit_decreasing(sizes, capacity):
    room, n = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect_left(room, s)
        if i == len(room):
            n += 1
            insort(room, capacity - s)
        else:
            insort(room, room.pop(i) - s)
    return n


def test_room_left_is_near_that_of_best_fit():
    rng = np.random.default_rng(6)
    for low, high, capacity in itertools.product((1, 50), (400, 1000), (1000, 4000)):
        sizes = rng.integers(low, high, 500)
        used = len(np.unique(pk.pack_block(sizes, capacity)))
        assert used <= 1.03 * best_fit_decreasing(sizes, capacity) + 1


def test_frame(spark):
    rows = [(i, "x" * n, 7) for i, n in enumerate([0, 1, 99, 100, 101, 250, 300, 60, 60, 60, 40, 40])] + [(50, None, 1), (51, "é" * 30, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, window long")  # a clashing extra column
    packed = pk.pack(docs, [(1, 100), (2, 280)])
    got = packed.collect()
    sizes = {d: len(t.encode()) for d, t, _ in rows if t is not None}
    for kind, capacity in ((1, 100), (2, 280)):
        own = [r for r in got if r["container_id"] == kind]
        fill = {}
        for r in own:
            fill[r["block"], r["window"]] = fill.get((r["block"], r["window"]), 0) + r["n_tokens"]
        assert max(fill.values()) <= capacity
        for d, size in sizes.items():
            pieces = sorted((r["piece_no"], r["start_token"], r["n_tokens"]) for r in own if r["doc_id"] == d)
            assert len(pieces) == max(1, -(-size // capacity)) and sum(p[2] for p in pieces) == size
            assert [p[1] for p in pieces] == [i * capacity for i in range(len(pieces))]
    cut = {tuple(r) for r in pk.cut_documents(packed).collect()}
    assert cut == {(k, d) for k, c in ((1, 100), (2, 280)) for d, s in sizes.items() if s > c}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pk.pack(none, [(1, 100)]).count() == 0
    assert pk.pack(spark.createDataFrame([(1, "a")], none.schema), []).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "x" * 50), (1, "x" * 50), (None, "y" * 150), (2, "")], "doc_id long, text string")
    got = pk.pack(docs, [(1, 100)]).collect()
    assert sum(r["n_tokens"] for r in got) == 250 and len(got) == 5
    fill = {}
    for r in got:
        fill[r["block"], r["window"]] = fill.get((r["block"], r["window"]), 0) + r["n_tokens"]
    assert max(fill.values()) <= 100
