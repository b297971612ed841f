"""Linked groups of the points of one block, in one task.

Cells of side link / sqrt(3) link their points by themselves, so work grows with the cells; pairs of near cells are
decided by their extents, by some of their points, by what is linked already, and only then by splitting them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Comparisons of points made at once, and those up to which a pair of cells is compared point by point.
AT_ONCE, COMPARED = 1_000_000, 64
#: Half of the ways to cells up to two apart.
_WAYS = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]


def roots(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """The least node of each node's component, with edges a, b beside those in parent."""
    parent = np.arange(n) if parent is None else parent
    while True:
        a, b = parent[a], parent[b]
        open_ = a != b
        if not open_.any():
            return parent
        a, b = a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def joined(edges: pd.DataFrame) -> pd.DataFrame:
    """(_s, tag, to): the least tag that every tag of one snapshot's edges (a, b) is joined with."""
    tags, at = np.unique(edges[["a", "b"]].to_numpy(), return_inverse=True)
    at = at.reshape(-1, 2)
    return pd.DataFrame({"_s": edges["_s"].iloc[0], "tag": tags, "to": tags[roots(len(tags), at[:, 0], at[:, 1])]})


def _wrapped(d: np.ndarray, box: float) -> np.ndarray:
    d = np.abs(d)
    return np.minimum(d, box - d)


def _close(x: np.ndarray, i: np.ndarray, j: np.ndarray, link: float, box: float) -> np.ndarray:
    d = [_wrapped(c[i] - c[j], box) for c in x]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < link * link


def _meet(x: np.ndarray, box: float, link: float, first: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, step: np.ndarray | None = None) -> np.ndarray:
    """Whether any point of cell a is close to one of cell b, for each pair; with step only every step-th point is looked at."""
    by = np.ones(len(size), dtype=np.int64) if step is None else step
    na, nb = -(-size[a] // by[a]), -(-size[b] // by[b])
    out, total = np.zeros(len(a), dtype=bool), np.cumsum(na * nb)
    begin = 0
    while begin < len(a):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + AT_ONCE, "right")))
        of = np.repeat(np.arange(begin, end), (na * nb)[begin:end])
        k = np.arange(len(of)) - (total[of] - (na * nb)[of] - (total[begin - 1] if begin else 0))
        i, j = first[a[of]] + k // nb[of] * by[a[of]], first[b[of]] + k % nb[of] * by[b[of]]
        out[of[_close(x, i, j, link, box)]] = True
        begin = end
    return out


def _reach(lo: np.ndarray, hi: np.ndarray, a, b) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the least and the greatest distance that points of extents a and b can have."""
    gap = np.maximum(0.0, np.maximum(lo[:, a] - hi[:, b], lo[:, b] - hi[:, a]))
    most = np.maximum(hi[:, a] - lo[:, b], hi[:, b] - lo[:, a])
    return (gap * gap).sum(axis=0), (most * most).sum(axis=0)


def _near(x: np.ndarray, u: np.ndarray, p: np.ndarray, q: np.ndarray, link: float, box: float) -> bool:
    """Whether any of the points p is close to one of q; sets are split at the middle of the wider one, near halves first."""
    todo = [(p, q)]
    while todo:
        p, q = todo.pop()
        lo, hi = (np.column_stack([f(u[:, p], axis=1), f(u[:, q], axis=1)]) for f in (np.min, np.max))
        least, most = _reach(lo, hi, 0, 1)
        if least > link * link * (1 + 1e-9):
            continue
        if most < link * link * (1 - 1e-9):
            return True
        extent = hi - lo
        if len(p) * len(q) <= 4096 or not extent.any():
            i, j = np.repeat(p, len(q)), np.tile(q, len(p))
            if not extent.any():  # one place each
                i, j = i[:1], j[:1]
            if _close(x, i, j, link, box).any():
                return True
            continue
        if extent[:, 1].max() > extent[:, 0].max():
            p, q, lo, hi = q, p, lo[:, ::-1], hi[:, ::-1]
        c = int(np.argmax(hi[:, 0] - lo[:, 0]))
        lower = u[c, p] <= (lo[c, 0] + hi[c, 0]) / 2
        if lower.all():
            lower = u[c, p] < hi[c, 0]
        halves = [p[lower], p[~lower]]
        halves.sort(key=lambda h: -abs(u[c, h].mean() - (lo[c, 1] + hi[c, 1]) / 2))
        todo += [(h, q) for h in halves]
    return False


def local_groups(rows: pd.DataFrame, link: float, box: float, width: float) -> pd.DataFrame:
    """(_s, particle_id, tag, own, shared) of the points of one block: the least particle_id of those each is linked with here;
    shared points are in other blocks too."""
    origin = rows[["cx", "cy", "cz"]].iloc[0].to_numpy(dtype=float) * width
    x = np.ascontiguousarray(rows[["x", "y", "z"]].to_numpy(dtype=float).T)
    u = x - origin[:, None]
    u = np.where(u < -link / 2, u + box, u)  # points beyond the upper face of the last block
    step = link * 0.999 / 3**0.5
    at = np.maximum(0, np.floor(u / step)).astype(np.int64) + 2
    n = at.max(axis=1) + 3
    code = (at[0] * n[1] + at[1]) * n[2] + at[2]
    order = np.argsort(code, kind="stable")
    x, u, ids, own = x[:, order], u[:, order], rows["particle_id"].to_numpy()[order], rows["own"].to_numpy()[order]
    codes, first, cell, size = np.unique(code[order], return_index=True, return_inverse=True, return_counts=True)
    lo, hi = (np.column_stack([f.reduceat(c, first) for c in u]).T for f in (np.minimum, np.maximum))
    dense = None
    if n.prod() <= 2_000_000:
        dense = np.full(n.prod(), -1, dtype=np.int32)
        dense[codes] = np.arange(len(codes))
    parent, hard = np.arange(len(codes)), []
    for i, j, k in _WAYS:
        want = codes + (i * n[1] + j) * n[2] + k
        if dense is None:
            b = np.minimum(np.searchsorted(codes, want), len(codes) - 1)
            a = np.flatnonzero(codes[b] == want)
            b = b[a]
        else:
            b = dense[want]
            a = np.flatnonzero(b >= 0)
            b = b[a]
        open_ = parent[a] != parent[b]  # linked already by other ways
        a, b = a[open_], b[open_]
        least, most = _reach(lo, hi, a, b)
        sure = most < link * link * (1 - 1e-9)
        some = ~sure & (least <= link * link * (1 + 1e-9))
        few = some & (size[a] * size[b] <= COMPARED)
        met = np.flatnonzero(few)
        met = met[_meet(x, box, link, first, size, a[met], b[met])]
        edge = np.concatenate([np.flatnonzero(sure), met])
        parent = roots(len(codes), a[edge], b[edge], parent)
        hard.append(np.column_stack([a, b])[some & ~few])
    a, b = np.concatenate(hard).T
    a, b = (v[parent[a] != parent[b]] for v in (a, b))
    hit = _meet(x, box, link, first, size, a, b, -(-size // 8))  # eight points of either
    parent = roots(len(codes), a[hit], b[hit], parent)
    for p, q in zip(a[~hit], b[~hit]):
        if parent[p] != parent[q] and _near(x, u, np.arange(first[p], first[p] + size[p]), np.arange(first[q], first[q] + size[q]), link, box):
            parent = roots(len(codes), np.array([p]), np.array([q]), parent)
    least = np.full(len(codes), np.iinfo(np.int64).max)
    np.minimum.at(least, parent[cell], ids)
    return pd.DataFrame({"_s": rows["_s"].iloc[0], "particle_id": ids, "tag": least[parent[cell]], "own": own, "shared": ~own | (u < link * (1 + 1e-9)).any(axis=0)})
