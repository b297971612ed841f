"""Cutting oversized texts at natural boundaries, by dynamic programming over boundary positions.

A text is a sequence of tokens, one per UTF-8 byte. The cuts chosen minimise the sum of a penalty per cut (by the kind
of boundary) and the squared relative deviation of every piece from equal sizes, over all boundaries of the text and
under the hard limits: no piece is larger than max_tokens, and each piece starts overlap_tokens before the cut that ends
the one before. Where that place lies within a character, the piece starts up to three tokens earlier, so no character
is broken; such cuts cost a little more. Stretches without any boundary longer than a quarter of a piece get forced
places as well, 64 to a piece.

Most boundaries are between words, dear ones beside a cheaper one close by. To move a cut there can only be impossible
because the piece that grows would be too large, on either side; so such a place needs to be looked at only between
two nearly full pieces. The minimum stays exact, and the work in proportion to the text. Texts are treated in chunks, all
texts of a chunk at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.tokens import size

#: Kinds of boundaries, best first, and the penalty of a cut at each.
KINDS = ("section", "paragraph", "line", "sentence", "word", "character")
PENALTIES = np.array([0.0, 0.05, 0.15, 0.4, 1.0, 4.0])
UNEVEN_OVERLAP = 0.02
#: Kinds up to this one are near enough to each other to be compared with all others.
STRONG = 3
#: Every piece adds this many tokens at least, one character of any length.
LEAST = 4
#: Bytes of text treated at once, and the blank bytes between two texts.
CHUNK, SPACE = 1 << 22, 4

_RESULT = (
    "struct<limit:array<int>,start:array<long>,end:array<long>,kind:array<tinyint>,long_limit:array<int>,long_line:array<long>>"
)


class Boundaries:
    """The boundary positions of some texts (bytes), laid out behind each other: a position p lies before byte p."""

    def __init__(self, texts: Sequence[np.ndarray]) -> None:
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.first = SPACE + np.concatenate([[0], np.cumsum(self.sizes[:-1] + SPACE)]).astype(np.int64)[: len(texts)]
        self.last = self.first + self.sizes
        gap = np.zeros(SPACE, np.uint8)
        b = np.concatenate([gap, *[x for t in texts for x in (t, gap)]])
        cont = (b & 0xC0) == 0x80
        self.whole = ~cont
        self.whole[3:] |= cont[3:] & cont[2:-1] & cont[1:-2] & cont[:-3]  # no character has four continuation bytes
        self.whole[self.first] = True
        feed = np.flatnonzero(b == 10)
        bare = np.flatnonzero((b[:-1] == 13) & (b[1:] != 10))  # a carriage return alone also ends a line
        after = np.sort(np.concatenate([feed, bare])) + 1
        kind = np.full(len(after), 2, np.int8)
        kind[(b[after - 2] == 10) | ((b[after - 2] == 13) & (b[after - 3] == 10))] = 1
        kind[b[after] == 61] = 0  # a heading follows
        blank = np.flatnonzero((b == 32) | (b == 9)) + 1
        mark = b[blank - 2]
        kind_of_blank = np.where((mark == 46) | (mark == 33) | (mark == 63), 3, 4).astype(np.int8)
        wide = np.flatnonzero(
            ((b[:-2] == 0xE3) & (b[1:-1] == 0x80) & (b[2:] == 0x82))
            | ((b[:-2] == 0xEF) & (b[1:-1] == 0xBC) & ((b[2:] == 0x81) | (b[2:] == 0x9F)))
        ) + 3
        at = np.concatenate([after, blank, wide])
        kinds = np.concatenate([kind, kind_of_blank, np.full(len(wide), 3, np.int8)])
        order = np.lexsort((kinds, at))
        at, kinds = at[order], kinds[order]
        keep = np.ones(len(at), bool)
        keep[1:] = at[1:] != at[:-1]
        text = self.text_of(at)
        keep &= self.whole[at] & (at > self.first[text]) & (at < self.last[text])
        self.at, self.kinds, self.text = at[keep], kinds[keep], text[keep]
        # lines: every line feed, and the ends of the texts
        self.line_ends = np.sort(np.concatenate([feed, self.first - 1, self.last]))

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(self.first, at, "right") - 1, 0)

    def snap(self, spots: np.ndarray) -> np.ndarray:
        """Each spot, or the nearest place before it that breaks no character."""
        spots = spots.copy()
        for _ in range(3):
            spots -= ~self.whole[spots]
        return spots

    def candidates(self, chosen: np.ndarray, longest: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, kinds and texts of all places to cut the texts in `chosen`, with forced ones in long stretches."""
        wanted = np.zeros(len(self.sizes), bool)
        wanted[chosen] = True
        mine = wanted[self.text] & (self.at - self.first[self.text] >= overlap + LEAST)
        at, kinds, text = self.at[mine], self.kinds[mine], self.text[mine]
        edges = np.concatenate([at, self.first[chosen] + overlap, self.last[chosen]])
        owner = np.concatenate([text, chosen, chosen])
        order = np.argsort(edges, kind="stable")
        edges, owner = edges[order], owner[order]
        wide = np.flatnonzero((np.diff(edges) > longest // 4) & (owner[1:] == owner[:-1]))
        step = max(1, longest // 64)
        n = (edges[wide + 1] - edges[wide] - 1) // step
        forced = np.repeat(edges[wide], n) + step * (_ramp(n) + 1)
        where = np.repeat(owner[wide], n)
        forced = self.snap(forced)
        fine = (forced - self.first[where] >= overlap + LEAST) & (forced < self.last[where])
        fine[1:] &= forced[1:] != forced[:-1]
        at = np.concatenate([at, forced[fine]])
        order = np.argsort(at, kind="stable")  # of a natural and a forced place the natural one comes first
        order = order[np.concatenate([[True], np.diff(at[order]) > 0])] if len(order) else order
        kinds = np.concatenate([kinds, np.full(int(fine.sum()), 5, np.int8)])
        return at[order], kinds[order], np.concatenate([text, where[fine]])[order]

    def lines_of(self, cuts: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, number (from 1) and size of each line that a cut breaks."""
        i = np.searchsorted(self.line_ends, cuts)
        inside = (self.line_ends[i - 1] + 1 < cuts) & (cuts < self.line_ends[i])
        i, pick = np.unique(i[inside], return_index=True)
        owner = text[inside][pick]
        number = i - np.searchsorted(self.line_ends, self.first[owner] - 1)
        return owner, number, self.line_ends[i] - self.line_ends[i - 1] - 1


def _ramp(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n)


class _Nodes:
    """Places to cut, in order: position, base (where the tokens counted for the next piece begin), cost of the best way;
    `goal` and `start` are position and base in even pieces of their text, so that goal - start is a piece's deviation."""

    def __init__(self, at, base, text, price, kind, first: np.ndarray, even: np.ndarray) -> None:
        self.at, self.base, self.text, self.price, self.kind = at, base, text, price, kind
        self.goal = (at - first[text]) / even[text] - 1
        self.start = (base - first[text]) / even[text]
        self.cost = np.full(len(at), np.inf)


def _ways(lo: np.ndarray, hi: np.ndarray, source: _Nodes, goal: np.ndarray):
    """Costs of all ways from source[lo:hi] to each goal, flat, where each goal's begin, and what source each is from."""
    n = hi - lo
    begin = np.cumsum(n) - n
    i = np.repeat(lo - begin, n)
    i += np.arange(len(i))
    off = np.repeat(goal, n)
    off -= source.start[i]
    off *= off
    off += source.cost[i]
    return off, begin, n, i


def _least(lo: np.ndarray, hi: np.ndarray, source: _Nodes, goal: np.ndarray) -> np.ndarray:
    """The least cost of reaching each goal from source[lo:hi]."""
    out = np.full(len(goal), np.inf)
    some = np.flatnonzero(hi > lo)
    if len(some):
        costs, begin, _, _ = _ways(lo[some], hi[some], source, goal[some])
        out[some] = np.minimum.reduceat(costs, begin)
    return out


def cut_texts(bounds: Boundaries, chosen: np.ndarray, max_tokens: int, overlap: int):
    """Texts, starts, ends and kinds of the pieces of the texts in `chosen`, all larger than max_tokens, in order.

    The last piece of a text has kind -1. Positions are those of `bounds`.
    """
    if not len(chosen):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.int8)
    longest = max_tokens - overlap
    total = bounds.sizes[chosen] - overlap
    even_of = np.zeros(len(bounds.sizes))
    even_of[chosen] = total / -(-total // longest)
    at, kinds, text = bounds.candidates(chosen, longest, overlap)
    extra = (at - overlap) - bounds.snap(at - overlap)
    price = PENALTIES[kinds] + UNEVEN_OVERLAP * (extra > 0)

    # the cheaper places around each word or forced place; the ends of the texts stand in where there is none
    strong = np.flatnonzero(kinds <= STRONG)
    far = 1 << 40
    s_at = np.concatenate([[-far], at[strong], [far]])
    s_text = np.concatenate([[-1], text[strong], [-1]])
    s_price = np.concatenate([[0.0], price[strong], [0.0]])
    s_base = np.concatenate([[-far], at[strong] - extra[strong], [far]])
    right = np.searchsorted(s_at, at, "right")
    left = np.searchsorted(s_at, at, "left") - 1
    even = even_of[text]
    need = lambda d: 2 * d * (longest + 3) / even**2 + 6 / even + 27 / even**2
    beside = (kinds > STRONG) & (s_text[left] == text) & (s_text[right] == text) & (s_at[right] - s_at[left] <= longest // 2 - 8)
    for q, d in ((left, at - s_at[left]), (right, s_at[right] - at)):
        beside &= price - s_price[q] > need(np.where(beside, d, 0))
    b = _Nodes(*[x[beside] for x in (at, at - extra, text, price, kinds)], bounds.first, even_of)
    b_left, b_right = s_base[left[beside]], s_at[right[beside]]
    # all others, with a first node (where the first piece's tokens count from) and a last one per text
    first, last = bounds.first[chosen] + overlap, bounds.last[chosen]
    m, zero = len(chosen), np.zeros(len(chosen))
    joined = [
        np.concatenate(x)
        for x in (
            (first, at[~beside], last), (first, (at - extra)[~beside], last), (chosen, text[~beside], chosen),
            (zero, price[~beside], zero), (np.full(m, -2), kinds[~beside], np.full(m, -1)),
        )
    ]
    order = np.argsort(joined[0], kind="stable")
    a = _Nodes(*[x[order] for x in joined], bounds.first, even_of)
    a.cost[a.kind == -2] = 0.0

    first_a, first_b = (np.searchsorted(x.at, bounds.first) for x in (a, b))
    reach = lambda x, source, begin: np.maximum(np.searchsorted(source.base, x.at - longest), begin[x.text])
    # ways into a: from all of a within reach, and from b only where its left neighbour is beyond reach
    a_lo, a_hi = reach(a, a, first_a), np.searchsorted(a.at, a.at - LEAST, "right")
    ab_lo, ab_hi = reach(a, b, first_b), np.searchsorted(b_left, a.at - longest)
    # ways into b: only from where its right neighbour is beyond reach
    ba_lo, ba_hi = reach(b, a, first_a), np.searchsorted(a.base, b_right - longest)
    bb_lo, bb_hi = reach(b, b, first_b), np.minimum(np.searchsorted(b.base, b_right - longest), np.searchsorted(b_left, b.at - longest))

    # blocks of positions so short that a way through b always begins in an earlier one
    width = max(LEAST, longest // 2 - 8)
    block = lambda x: (x.at - bounds.first[x.text] - overlap) // width
    block_a, block_b = block(a), block(b)
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(block_a) != 0) | (np.diff(a.text) != 0)]))
    begin = np.repeat(starts, np.diff(np.append(starts, len(block_a))))
    rank = np.arange(len(begin)) - begin
    order_a, order_b = np.lexsort((rank, block_a)), np.argsort(block_b, kind="stable")
    n_blocks = int(block_a.max()) + 1 if len(block_a) else 0
    edges_a = np.searchsorted(block_a[order_a], np.arange(n_blocks + 1))
    edges_b = np.searchsorted(block_b[order_b], np.arange(n_blocks + 1))
    for k in range(n_blocks):
        j = order_b[edges_b[k] : edges_b[k + 1]]
        if len(j):
            ways = _least(ba_lo[j], ba_hi[j], a, b.goal[j]), _least(bb_lo[j], bb_hi[j], b, b.goal[j])
            b.cost[j] = np.minimum(*ways) + b.price[j]
        j = order_a[edges_a[k] : edges_a[k + 1]]
        ways = _least(a_lo[j], np.minimum(a_hi[j], begin[j]), a, a.goal[j]), _least(ab_lo[j], ab_hi[j], b, a.goal[j])
        a.cost[j] = np.minimum(a.cost[j], np.minimum(*ways) + a.price[j])
        ranks = rank[j]
        turns = np.searchsorted(ranks, np.arange(1, (ranks[-1] if len(ranks) else 0) + 2))
        for x, y in zip(turns[:-1], turns[1:]):  # within the block one after the other, all texts at once
            t = j[x:y]
            t = t[a_hi[t] > begin[t]]
            if len(t):
                near = _least(np.maximum(a_lo[t], begin[t]), a_hi[t], a, a.goal[t])
                a.cost[t] = np.minimum(a.cost[t], near + a.price[t])

    # back from the ends, all texts at once
    where, in_a = np.flatnonzero(a.kind == -1), np.ones(m, bool)
    if not np.isfinite(a.cost[where]).all():
        raise ValueError("no way to cut within the limits")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(where):
        pick = lambda x, y: np.where(in_a, x[np.where(in_a, where, 0)], y[np.where(in_a, 0, where)] if len(y) else 0)
        found.append((pick(a.text, b.text), pick(a.at, b.at), pick(a.kind, b.kind)))
        goal = pick(a.goal, b.goal)
        via_a = _best(pick(a_lo, ba_lo), pick(a_hi, ba_hi), a, goal)
        via_b = _best(pick(ab_lo, bb_lo), pick(ab_hi, bb_hi), b, goal)
        in_a = via_a[0] <= via_b[0]
        where = np.where(in_a, via_a[1], via_b[1])
        go_on = ~in_a | (a.kind[np.where(in_a, where, 0)] != -2)
        where, in_a = where[go_on], in_a[go_on]
    text, ends, kinds = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.argsort(ends, kind="stable")
    text, ends, kinds = text[order], ends[order], kinds[order]
    begins = bounds.first[text]
    later = np.flatnonzero(text[1:] == text[:-1]) + 1
    begins[later] = bounds.snap(ends[later - 1] - overlap)
    return text, begins, ends, kinds.astype(np.int8)


def _best(lo: np.ndarray, hi: np.ndarray, source: _Nodes, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least cost of reaching each goal from source[lo:hi], and from where."""
    out, origin = np.full(len(goal), np.inf), np.zeros(len(goal), np.int64)
    some = np.flatnonzero(hi > lo)
    if len(some):
        costs, begin, n, i = _ways(lo[some], hi[some], source, goal[some])
        out[some] = np.minimum.reduceat(costs, begin)
        hit = np.flatnonzero(costs == np.repeat(out[some], n))
        origin[some] = i[hit[np.searchsorted(hit, begin)]]
    return out, origin


def _cutter(limits: Sequence[tuple[int, int]]):
    """An Arrow function from texts (binary) to their pieces for each limit; a limit a text doesn't exceed gives none."""

    def cut_batch(texts: pa.Array) -> pa.Array:
        raw = [np.frombuffer(t.as_buffer() if t.is_valid else b"", np.uint8) for t in texts]
        sizes = np.array([len(t) for t in raw], np.int64)
        order = np.argsort(sizes, kind="stable")  # texts of like size take like many steps
        raw, sizes = [raw[i] for i in order], sizes[order]
        chunk = (np.cumsum(sizes) - sizes) // CHUNK
        none = np.zeros(0, np.int64)
        parts: list[list[tuple]] = [[], []]  # rows of (text, limit, ...) of pieces and of long lines
        for first in np.flatnonzero(np.diff(chunk, prepend=-1)):
            own = raw[first : first + int(np.searchsorted(chunk[first:], chunk[first], "right"))]
            bounds = Boundaries(own)
            for i, (most, overlap) in enumerate(limits):
                chosen = np.flatnonzero(bounds.sizes > most)
                if not len(chosen):
                    continue
                text, s, e, k = cut_texts(bounds, chosen, most, overlap)
                base = bounds.first[text]
                parts[0].append((order[text + first], np.full(len(text), i), s - base, e - base, k))
                inner = k >= 0
                owner, number, length = bounds.lines_of(e[inner], text[inner])
                long = length > most
                parts[1].append((order[owner[long] + first], np.full(int(long.sum()), i), number[long]))
        arrays = []
        for rows, types in zip(parts, ((pa.int32(), pa.int64(), pa.int64(), pa.int8()), (pa.int32(), pa.int64()))):
            cols = [np.concatenate(c) for c in zip(*rows)] if rows else [none] * (len(types) + 1)
            by_text = np.lexsort((cols[1], cols[0]))
            offsets = pa.array(np.searchsorted(cols[0][by_text], np.arange(len(raw) + 1)), pa.int32())
            arrays += [pa.ListArray.from_arrays(offsets, pa.array(c[by_text], t)) for c, t in zip(cols[1:], types)]
        return pa.StructArray.from_arrays(arrays, ["limit", "start", "end", "kind", "long_limit", "long_line"])

    return F.arrow_udf(cut_batch, _RESULT)


def split(
    documents: DataFrame, limits: Sequence[tuple[int, int, int]], doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, text, cuts) of the documents larger than the smallest limit of `limits` (limit_id, max, overlap).

    cuts holds, for each limit the document exceeds, its pieces in order and, of the lines that a cut breaks, those
    that alone are larger than the limit (no piece can hold such a line, so a cut breaks each of them); `pieces` and
    `oversized` unfold it. The text itself stays on the JVM side. A null or small text is not cut.
    max - overlap must be at least 16 tokens and overlap not negative. No limits give no rows.
    """
    for _, most, overlap in limits:
        if overlap < 0 or most - overlap < 16:
            raise ValueError("pieces need an overlap of at least 0 and 16 tokens beside it")
    smallest = min((most for _, most, _ in limits), default=None)
    over = F.lit(False) if smallest is None else size(text) > smallest
    cutter = _cutter([(most, overlap) for _, most, overlap in limits])
    return (
        documents.where(over)
        .select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
        .withColumn("cuts", cutter(F.col("text").cast("binary")))
    )


def _limit_id(limits: Sequence[tuple[int, int, int]], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k).cast("long") for k, _, _ in limits]), i + 1)


def pieces(cut_documents: DataFrame, limits: Sequence[tuple[int, int, int]]) -> DataFrame:
    """(limit_id, doc_id, piece_no, start_token, end_token, boundary, piece) of documents cut by `split`.

    piece_no counts from 0; boundary is the kind at the piece's end, `end` for the last one; piece is its text.
    """
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.posexplode(F.arrays_zip("cuts.limit", "cuts.start", "cuts.end", "cuts.kind")).alias("at", "c")
    raw = F.col("text").cast("binary")
    first = F.array_position("cuts.limit", F.col("c.limit")) - 1
    return cut_documents.select("doc_id", "text", "cuts", one).select(
        _limit_id(limits, F.col("c.limit")).alias("limit_id"),
        "doc_id",
        (F.col("at") - first).alias("piece_no"),
        F.col("c.start").alias("start_token"),
        F.col("c.end").alias("end_token"),
        F.when(F.col("c.kind") < 0, "end").otherwise(F.get(names, F.col("c.kind").cast("int"))).alias("boundary"),
        F.substring(raw, F.col("c.start").cast("int") + 1, (F.col("c.end") - F.col("c.start")).cast("int"))
        .cast("string")
        .alias("piece"),
    )


def oversized(cut_documents: DataFrame, limits: Sequence[tuple[int, int, int]]) -> DataFrame:
    """(limit_id, doc_id, line_no): line_no 0 for each document cut for a limit, k for its k-th line above the limit."""
    whole = F.transform(F.array_distinct("cuts.limit"), lambda i: F.struct(i.alias("i"), F.lit(0).cast("long").alias("line")))
    lines = F.transform(
        F.arrays_zip("cuts.long_limit", "cuts.long_line"),
        lambda x: F.struct(x["long_limit"].alias("i"), x["long_line"].alias("line")),
    )
    return cut_documents.select("doc_id", F.explode(F.concat(whole, lines)).alias("r")).select(
        _limit_id(limits, F.col("r.i")).alias("limit_id"), "doc_id", F.col("r.line").alias("line_no")
    )
