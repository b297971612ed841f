import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackweave.llm import splitting as sp

LIMITS = [(1, 60, 10), (2, 150, 20)]


def bounds_of(*raw: bytes) -> sp.Boundaries:
    return sp.Boundaries([np.frombuffer(r, np.uint8) for r in raw])


def cuts(b: sp.Boundaries, most: int, overlap: int):
    """Starts, ends and kinds by text, positions within the text."""
    chosen = np.flatnonzero(b.sizes > most)
    t, s, e, k = sp.cut_texts(b, chosen, most, overlap)
    return {i: (s[t == i] - b.first[i], e[t == i] - b.first[i], k[t == i]) for i in chosen.tolist()}


def check(raw: bytes, most: int, overlap: int):
    s, e, k = cuts(bounds_of(raw), most, overlap)[0]
    assert s[0] == 0 and e[-1] == len(raw) and k[-1] == -1 and (k[:-1] >= 0).all()
    assert ((e - s) <= most).all() and ((e - s) > 0).all()
    shared = e[:-1] - s[1:]
    assert (shared >= overlap).all() and (shared <= overlap + 3).all()
    assert (np.diff(e) > 0).all() and (np.diff(s) > 0).all()
    return s, e, k


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n=é漢😀\r!。", min_size=70, max_size=800), st.sampled_from([(60, 10), (40, 24), (16, 0), (60, 0)]))
def test_pieces_cover_the_text_within_the_limits(text, limit):
    raw = text.encode()
    s, e, _ = check(raw, *limit)
    for a, z in zip(s, e):
        raw[a:z].decode()  # no character is broken


def test_any_bytes_are_cut():
    rng = np.random.default_rng(1)
    for n in (61, 100, 5000, 40_000):
        check(rng.integers(0, 256, n, np.uint8).tobytes(), 60, 10)
        check(bytes([0x82]) * n, 60, 10)
        check(b"x" * n, 60, 10)


def least_cost(b: sp.Boundaries, text: int, most: int, overlap: int) -> float:
    """Over all chains of all candidates, whatever the lengths of the pieces."""
    longest, n, first = most - overlap, b.sizes[text], b.first[text]
    at, kinds, _ = b.candidates(np.array([text]), longest, overlap)
    extra = at - overlap - b.snap(at - overlap)
    price = np.concatenate([[0.0], sp.PENALTIES[kinds] + sp.UNEVEN_OVERLAP * (extra > 0), [0.0]])
    base = np.concatenate([[overlap], at - first - extra, [n]])
    at = np.concatenate([[overlap], at - first, [n]])
    even = (n - overlap) / -(-(n - overlap) // longest)
    cost = np.full(len(at), np.inf)
    cost[0] = 0.0
    for j in range(1, len(at)):
        i = np.flatnonzero((at[j] - base[:j] <= longest) & (at[j] - at[:j] >= sp.LEAST))
        if len(i):
            cost[j] = (cost[i] + ((at[j] - base[i]) / even - 1) ** 2).min() + price[j]
    return cost[-1]


STYLES = {
    "prose": ["word ", "a ", "longer ", "end. ", "line\n", "\n\n", "== h ==\n"],
    "words": ["word ", "a ", "longerword ", "x" * 30 + " "],
    "mixed": ["word ", "end. ", "line\n", "\n\n", "== h ==\n", "x", "é", "漢字", "y" * 40],
    "wide": ["漢", "字。", "é ", "😀", "a ", "\n", "zz. "],
}


@pytest.mark.parametrize("style", STYLES)
def test_cuts_are_optimal_over_all_boundaries(style):
    rng = random.Random(3)
    for _ in range(80):
        texts = ["".join(rng.choice(STYLES[style]) for _ in range(rng.randint(80, 700))).encode() for _ in range(rng.randint(1, 4))]
        most, overlap = rng.choice([(60, 10), (400, 30), (200, 0), (900, 100), (300, 120), (16, 0)])
        b = bounds_of(*texts)
        for i, (s, e, k) in cuts(b, most, overlap).items():
            extra = e[:-1] - s[1:] - overlap
            base = np.concatenate([[overlap], e[:-1] - extra])
            longest, n = most - overlap, len(texts[i])
            even = (n - overlap) / -(-(n - overlap) // longest)
            cost = (((e - base) / even - 1) ** 2).sum() + sp.PENALTIES[k[:-1]].sum() + sp.UNEVEN_OVERLAP * (extra > 0).sum()
            assert cost == pytest.approx(least_cost(b, i, most, overlap))


def test_texts_of_a_chunk_do_not_meet():
    rng = random.Random(4)
    texts = ["".join(rng.choice(STYLES["mixed"]) for _ in range(rng.randint(1, 300))).encode() for _ in range(40)] + [b"", b"\n", "é".encode()]
    together = cuts(bounds_of(*texts), 200, 20)
    for i, got in together.items():
        for x, y in zip(got, cuts(bounds_of(texts[i]), 200, 20)[0]):
            assert x.tolist() == y.tolist()


def test_every_long_line_is_broken_by_a_cut():
    rng = random.Random(6)
    for _ in range(60):
        texts = ["".join(rng.choice(["word ", "end. ", "\n", "x" * 30, "é"]) for _ in range(rng.randint(50, 300))).encode() for _ in range(3)]
        b = bounds_of(*texts)
        chosen = np.flatnonzero(b.sizes > 90)
        t, _, e, k = sp.cut_texts(b, chosen, 90, 20)
        owner, number, length = b.lines_of(e[k >= 0], t[k >= 0])
        got = sorted(zip(owner[length > 90].tolist(), number[length > 90].tolist()))
        assert got == [(i, j) for i in chosen.tolist() for j, line in enumerate(texts[i].split(b"\n"), 1) if len(line) > 90]


def test_natural_boundaries_are_preferred():
    text = (b"a" * 30 + b"\n") * 2 + b"== head ==\n" + b"b" * 40
    s, e, k = check(text, 80, 0)
    assert sp.KINDS[k[0]] == "section" and text[e[0] :].startswith(b"== head")


def test_frame(spark):
    long_line = "y" * 200
    docs = spark.createDataFrame(
        [
            (1, "short", "x"), (2, None, "x"), (3, "", "x"), (4, "a b. " * 20, None),
            (5, f"one\n{long_line}\r\ntwo\n\n{'z' * 61}", "x"), (6, "漢" * 100, "x"),
        ],
        "doc_id long, text string, cuts string",
    )  # fmt: skip  # an extra column with a clashing name
    cut = sp.split(docs, LIMITS)
    found = {tuple(r) for r in sp.oversized(cut, LIMITS).collect()}
    assert found == {(1, 4, 0), (1, 4, 1), (1, 5, 0), (1, 5, 2), (1, 5, 5), (2, 5, 0), (2, 5, 2), (1, 6, 0), (1, 6, 1), (2, 6, 0), (2, 6, 1)}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = sp.pieces(cut, LIMITS).collect()
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert raw[r["start_token"] : r["end_token"]].decode() == r["piece"]
    for limit in (1, 2):
        for d in (5, 6):
            own = sorted((r["piece_no"], r["start_token"], r["end_token"]) for r in rows if (r["limit_id"], r["doc_id"]) == (limit, d))
            assert [x[0] for x in own] == list(range(len(own))) and own[0][1] == 0 and own[-1][2] == len(texts[d].encode())


def test_empty_and_wrong_limits(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sp.pieces(sp.split(none, LIMITS), LIMITS).count() == 0
    some = spark.createDataFrame([(1, "a" * 500)], "doc_id long, text string")
    assert sp.split(some, []).count() == 0
    with pytest.raises(ValueError):
        sp.split(some, [(1, 100, 90)])


def test_very_long_texts_and_repeated_rows(spark):
    rng = random.Random(8)
    text = "".join(rng.choice(["word ", "end. ", "line\n", "\n\n", "x" * 40]) for _ in range(300_000))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "z" * 500)], "doc_id long, text string")
    limits = [(1, 1500, 120), (2, 6000, 500)]
    rows = sp.pieces(sp.split(docs, limits), limits).where("doc_id = 1").select("limit_id", "piece_no", "start_token", "end_token").collect()
    for limit, most, overlap in limits:
        own = sorted((r["piece_no"], r["start_token"], r["end_token"]) for r in rows if r["limit_id"] == limit)
        once = own[::2]
        assert own[1::2] == once and once[0][1] == 0 and once[-1][2] == len(text)
        assert all(e - s <= most for _, s, e in once) and all(a[2] - b[1] == overlap for a, b in zip(once, once[1:]))
    assert sp.split(docs, [(1, 100, 10)]).where("doc_id IS NULL").count() == 1
