"""Filling containers of fixed capacity: Karmarkar-Karp multiway differencing within blocks of items.

Items are hashed into blocks of about `windows` containers' worth of tokens, so no source, page or group of copies
makes a block larger than the others, and only ids and sizes are shuffled. Within a block the partial partitions with
the largest imbalance are merged so that their imbalances oppose each other, giving near-equal windows; the window
count rises whenever the capacity is exceeded.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.tokens import size

#: Containers' worth of tokens in a block.
WINDOWS = 128
#: From which fill on a window is closed where others exceed the capacity.
FULL = 0.97
#: Items smaller than the capacity over FINEST are bundled before differencing.
FINEST = 512


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0..k-1) of each item after multiway differencing into k windows."""
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    sums = {i: np.concatenate([[s], np.zeros(k - 1, np.int64)]) for i, s in enumerate(sizes)}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums.pop(a) + sums.pop(b)[::-1]  # the largest of one beside the smallest of the other
        order = np.argsort(-both, kind="stable")
        both = both[order] - both[order[-1]]
        sums[n + len(merges)] = both
        heapq.heappush(heap, (-int(both[0]), n + len(merges)))
        merges.append((a, b, order))
    window = np.empty(n, np.int64)
    todo = [(heap[0][1], np.arange(k))]
    while todo:  # from the last merge back to the items
        node, slots = todo.pop()
        if node < n:
            window[node] = slots[0]
            continue
        a, b, order = merges[node - n]
        left = np.empty(k, np.int64)
        left[order] = slots
        todo += [(a, left), (b, left[::-1])]
    return window


def _bundles(sizes: np.ndarray, unit: float) -> np.ndarray:
    """The bundle of each item: items smaller than `unit` are put together, in order of size, to bundles below twice it.

    Differencing then starts from the bundles as from items, so a block of very many tiny items stays small.
    """
    tiny = np.flatnonzero(sizes < unit)
    bundle = np.empty(len(sizes), np.int64)
    order = tiny[np.argsort(-sizes[tiny], kind="stable")]
    before = np.cumsum(sizes[order]) - sizes[order]
    numbers = (before // unit).astype(np.int64)
    _, bundle[order] = np.unique(numbers, return_inverse=True)
    rest = np.setdiff1d(np.arange(len(sizes)), tiny, assume_unique=True)
    bundle[rest] = (bundle[order].max() + 1 if len(order) else 0) + np.arange(len(rest))
    return bundle


def pack_block(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item of a block; no item is larger than the capacity.

    The items are differenced into as many windows as their tokens need. Where some exceed the capacity, the windows
    that are at least FULL are closed and the items of all others differenced anew; closed windows hold less than their
    capacity, so the whole count rises, and it rises by one more whenever no window is full enough to be closed.
    """
    out = np.empty(len(sizes), np.int64)
    whole = sizes == capacity
    closed = int(whole.sum())
    out[whole] = np.arange(closed)  # nothing fits beside these
    part = np.flatnonzero(~whole)
    bundle = _bundles(sizes[part], capacity / FINEST)
    own = np.bincount(bundle, weights=sizes[part]).astype(np.int64)
    at = np.empty(len(own), np.int64)
    left, extra = np.arange(len(own)), 0
    while len(left):
        k = max(1, -(-int(own[left].sum()) // capacity)) + extra
        window = differencing(own[left], k)
        sums = np.bincount(window, weights=own[left], minlength=k)
        if sums.max() <= capacity:
            at[left] = closed + window
            break
        full = (sums <= capacity) & (sums >= FULL * capacity)
        if full.any():
            number = np.cumsum(full) - 1 + closed
            inside = full[window]
            at[left[inside]] = number[window[inside]]
            left, closed = left[~inside], closed + int(full.sum())
        else:
            extra += 1
    out[part] = at[bundle]
    return out


def items(documents: DataFrame, capacities: Sequence[tuple[int, int]], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(container_id, capacity, doc_id, piece_no, n_pieces, start_token, n_tokens): what is to be packed.

    A document above the capacity is cut into full pieces and a rest; any other is one item. Texts of null are none;
    empty texts are items of size 0.
    """
    kinds = F.explode(
        F.array(*[F.struct(F.lit(k).cast("long").alias("container_id"), F.lit(c).cast("long").alias("capacity")) for k, c in capacities])
    )
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity"))).cast("int")
    return (
        documents.select(F.col(doc).alias("doc_id"), size(text).alias("size"))
        .where("size IS NOT NULL")
        .select("doc_id", "size", kinds.alias("k"))
        .select("doc_id", "size", "k.*")
        .withColumn("n_pieces", n)
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .withColumn("start_token", F.col("piece_no") * F.col("capacity"))
        .withColumn("n_tokens", F.least("capacity", F.col("size") - F.col("start_token")))
        .select("container_id", "capacity", "doc_id", "piece_no", "n_pieces", "start_token", "n_tokens")
    )


def pack(
    documents: DataFrame,
    capacities: Sequence[tuple[int, int]],
    doc: str = "doc_id",
    text: str = "text",
    windows: int = WINDOWS,
) -> DataFrame:
    """Which item lies in which container, for each kind of container in `capacities` (container_id, capacity).

    Columns: container_id, block, window, doc_id, piece_no, n_pieces, start_token, n_tokens; (container_id, block,
    window) names one container. Every item, full pieces of a cut document too, is placed by `pack_block`, comes out
    once, and no container exceeds its capacity. The number of blocks follows from the tokens beside full pieces, so a
    block is `windows` containers' worth of them on average, however many items they are. doc_id is unique; capacities are positive. Repeated sizes
    and empty texts are ordinary items; no kinds or no documents give no rows.
    """
    if any(c <= 0 for _, c in capacities):
        raise ValueError("capacities must be positive")
    if not capacities:
        capacities, documents = [(0, 1)], documents.limit(0)
    every = items(documents, capacities, doc, text)
    part = F.when(F.col("n_tokens") < F.col("capacity"), F.col("n_tokens"))
    totals = every.groupBy("container_id", "capacity").agg(F.coalesce(F.sum(part), F.lit(0)).alias("t")).collect()
    blocks = F.lit(1)
    for r in totals:  # one row per kind of container
        n_blocks = max(1, int(r["t"] // (windows * r["capacity"])))
        blocks = F.when(F.col("container_id") == r["container_id"], n_blocks).otherwise(blocks)
    columns = ["container_id", "block", "window", "doc_id", "piece_no", "n_pieces", "start_token", "n_tokens"]
    blocked = every.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no"), blocks).cast("long"))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece_no"], kind="stable")
        group["window"] = pack_block(group["n_tokens"].to_numpy(np.int64), int(group["capacity"].iloc[0]))
        return group[columns]

    schema = "container_id long, block long, window long, doc_id long, piece_no int, n_pieces int, start_token long, n_tokens long"
    return blocked.groupBy("container_id", "block").applyInPandas(fill, schema)


def cut_documents(packed: DataFrame) -> DataFrame:
    """(container_id, doc_id) of the documents that had to be cut: those of which several pieces lie in containers."""
    pieces = packed.where("n_pieces > 1").groupBy("container_id", "doc_id").agg(F.count_distinct("piece_no").alias("n"))
    return pieces.where("n > 1").select("container_id", "doc_id")


def containers(packed: DataFrame) -> DataFrame:
    """(container_id, block, window, n_items, n_tokens): the fill of every container."""
    return packed.groupBy("container_id", "block", "window").agg(
        F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens")
    )
