"""The k nearest of many vectors for every one of others, exactly, in tiles of bounded size.

Scores come as products of tiles in 32-bit floats with a proven bound of their error; whatever may be among the k
nearest within that bound is measured again in double precision, component by component.  Of a tile only the rows
whose least score is within the bound are looked through.  Tiles follow the vectors' lengths, so that one whose lengths
alone put it too far is skipped.  Vectors that are equal in every bit are measured
once, and of equal candidates the k of smallest keys stand for all.  Rows out of the range of 32-bit floats, such as
those with components that are not finite or without a direction, are measured against everything.
"""

from __future__ import annotations

import numpy as np

from ..functions.metrics import RANKINGS, exact_pairs

#: Pairs in a tile and its least width, which stay in a core's cache.
TILE, WIDTH = 1 << 18, 512
#: Candidates of a tile of queries that are held before they are narrowed, components measured at once.
HELD, EXACT = 1 << 20, 1 << 21
#: One candidate of so many is tried before a tile of queries is, to see which tiles of candidates come first.
PROBE = 32
#: Lengths of vectors that the products serve, and how much longer than all candidates a query may be.
SHORT, LONG, RATIO = 1e-140, 1e140, 1e15


def alike(m: np.ndarray) -> np.ndarray:
    """Numbers of the groups of rows that are equal in every bit."""
    if not m.size:
        return np.zeros(len(m), np.int64)
    bits = np.ascontiguousarray(m).view(np.uint64)
    mixed = np.zeros(len(m), np.uint64)
    for c in range(bits.shape[1]):
        mixed = (mixed ^ bits[:, c] ^ (bits[:, c] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    order = np.argsort(mixed, kind="stable")
    fresh = np.ones(len(m), np.int64)
    maybe = 1 + np.flatnonzero(mixed[order[1:]] == mixed[order[:-1]])
    # a hash may repeat by chance: the bits decide
    for at in range(0, len(maybe), 4096):
        part = maybe[at : at + 4096]
        fresh[part] = ~(bits[order[part]] == bits[order[part - 1]]).all(axis=1)
    out = np.empty(len(m), np.int64)
    out[order] = np.cumsum(fresh) - 1
    return out


def _lengths(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.einsum("ij,ij->i", m, m))


class Candidates:
    """The vectors ``x`` (null where not ``given``) with whole-numbered ``keys``, ready for ``nearest``."""

    def __init__(self, metric: str, x: np.ndarray, given: np.ndarray, keys: np.ndarray, k: int):
        self.metric, self.k, self.dim = metric, k, x.shape[1]
        self.sign = -1.0 if RANKINGS[metric].descending else 1.0
        self.l2, self.cosine = metric == "l2", metric.startswith("cosine")
        self.given = bool(given.any())
        self.null_keys = np.sort(keys[~given])[:k]
        if not given.all():
            x, keys = x[given], keys[given]
        group = alike(x)
        order = np.lexsort((keys, group))
        first = np.r_[True, np.diff(group[order]) > 0] if len(order) else np.zeros(0, bool)
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
        chosen = order[place < k]
        size = _lengths(x[chosen])
        even = self._even(size, x[chosen])
        # regular rows by length, the longest first where it isn't a distance
        regular = np.flatnonzero(even)[np.argsort(size[even] if self.l2 else -size[even], kind="stable")]
        odd = np.flatnonzero(~even)
        chosen = chosen[np.r_[regular, odd]]
        self.x, self.keys, self.n = x[chosen], keys[chosen], len(regular)
        size = size[regular]
        self.scale = 2.0 ** np.ceil(np.log2(size.max())) if self.n and size.max() > 0 else 1.0
        self.kind = np.float32 if self.dim <= 1024 else np.float64
        #: Twice the bound of a product's error, as a share of the product of both lengths.
        self.error = (self.dim + 16) * float(np.finfo(self.kind).eps)
        unit = self.x[: self.n] / (size[:, None] if self.cosine else self.scale)
        self.size = np.ones(self.n) if self.cosine else size / self.scale
        extra = [0.5 * self.size[:, None] ** 2] if self.l2 else []
        self.right = np.hstack([unit, *extra]).astype(self.kind)
        self.width = max(WIDTH, 8 * k)
        self.height = max(8, TILE // self.width)
        #: Room for the scores of a tile, used again for every tile.
        self.room = np.empty(0, self.kind)

    def _even(self, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
        even = np.isfinite(size) & (size > SHORT) & (size < LONG)
        if not self.cosine:
            even |= ~rows.any(axis=1)
        return even & (self.dim > 0)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, values, which are null) of the k nearest of every row of ``q``, nearest first."""
        if len(q) and self.given and q.shape[1] != self.dim:
            raise ValueError("vectors must have the same dimension")
        group = alike(q)
        first = np.unique(group, return_index=True)[1]
        count = min(self.k, len(self.x))
        places, values = np.zeros((len(first), count), np.int64), np.zeros((len(first), count))
        if count:
            size = _lengths(q[first])
            even = self._even(size, q[first])
            if not self.cosine:
                even &= size <= RATIO * self.scale
            regular = np.flatnonzero(even)
            regular = regular[np.argsort(size[regular], kind="stable")]
            for rows, near in ((regular, self._near), (np.flatnonzero(~even), None)):
                for at in range(0, len(rows), self.height):
                    part = rows[at : at + self.height]
                    mine = q[first[part]]
                    found = near(mine, size[part]) if near and self.n else (np.empty(0, np.int64), np.empty(0, np.int64))
                    found = self._all(mine, *found, self.n if near else 0)
                    own, place, value = self._best(mine, *found)
                    places[part], values[part] = place.reshape(-1, count), value.reshape(-1, count)
        tail = self.null_keys[: self.k - count]
        keys = np.hstack([self.keys[places], np.broadcast_to(tail, (len(first), len(tail)))]) if count else np.broadcast_to(tail, (len(first), len(tail)))
        shown = np.hstack([values, np.full((len(first), len(tail)), np.nan)])
        null = np.broadcast_to(np.arange(shown.shape[1]) >= count, shown.shape)
        return keys[group], shown[group], null[group]

    def _all(self, q: np.ndarray, own: np.ndarray, place: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs found and those with every candidate from ``start`` on, narrowed to the k best as they come."""
        step = max(1, HELD // len(q))
        for at in range(start, len(self.x), step):
            more = np.arange(at, min(at + step, len(self.x)))
            own, place, _ = self._best(q, np.r_[own, np.repeat(np.arange(len(q)), len(more))], np.r_[place, np.tile(more, len(q))])
        return own, place

    def _best(self, q: np.ndarray, own: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query's pairs in order, with their values: numbers, then what is none, ties by key."""
        value = np.empty(len(own))
        step = max(1, EXACT // max(self.dim, 1))
        for at in range(0, len(own), step):
            value[at : at + step] = exact_pairs(self.metric, q[own[at : at + step]], self.x[place[at : at + step]])
        none = np.isnan(value)
        order = np.lexsort((self.keys[place], np.where(none, 0, self.sign * value), none, own))
        start = np.searchsorted(own[order], np.arange(len(q)))
        order = order[np.arange(len(order)) - start[own[order]] < self.k]
        return own[order], place[order], value[order]

    def _near(self, q: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs among which are the k nearest regular candidates of every query."""
        k, m = self.k, len(q)
        size = np.ones(m) if self.cosine else size / self.scale
        left = -(q / (_lengths(q)[:, None] if self.cosine else self.scale))
        left = np.hstack([left, np.ones((m, 1))] if self.l2 else [left]).astype(self.kind)
        best = np.full((m, k), np.inf)  # upper bounds of the k least scores
        held, count = [], 0
        starts = np.arange(0, self.n, self.width)
        ends = np.minimum(starts + self.width, self.n)
        lo, hi = np.minimum(self.size[starts], self.size[ends - 1]), np.maximum(self.size[starts], self.size[ends - 1])
        cells = m * min(self.width, self.n)
        if len(self.room) < cells:
            self.room = np.empty(cells, self.kind)
        turns = np.arange(len(starts))
        if self.l2 and len(starts) > 1:
            # the tile that promises the least scores first, or most later ones would bring better candidates
            probe = np.minimum(starts[:, None] + np.arange(0, self.width, PROBE), self.n - 1)
            seen = (left @ self.right[probe.ravel()].T).reshape(m, *probe.shape).min(axis=2)
            turns = np.argsort(np.median(seen, axis=0), kind="stable")
        for t in turns:
            error = self.error * (size * hi[t] + (0.5 * hi[t] ** 2 if self.l2 else 0)) + 1e-30
            limit = best[:, -1] + error
            # no score is below what the lengths allow
            r = np.clip(size, lo[t], hi[t])
            if ((0.5 * r * r - size * r if self.l2 else -size * hi[t]) > limit + error).all():
                continue
            score = self.room[: m * (ends[t] - starts[t])].reshape(m, -1)
            np.matmul(left, self.right[starts[t] : ends[t]].T, out=score)
            if not np.isfinite(limit).all() and score.shape[1] > k:
                limit = np.minimum(limit, np.partition(score, k - 1, axis=1)[:, k - 1] + 2 * error)
            top = np.nextafter(limit.astype(self.kind), self.kind(np.inf))
            near = np.flatnonzero(score.min(axis=1) <= top)
            if not len(near):
                continue
            flat = np.flatnonzero(score[near] <= top[near, None])
            rows, columns = np.divmod(flat, score.shape[1])
            rows = near[rows]
            value = score[rows, columns].astype(float)
            held.append((rows, columns + starts[t], value - error[rows]))
            self._improve(best, rows, value + error[rows])
            if (count := count + len(rows)) > HELD:
                held = [self._narrow(q, *map(np.concatenate, zip(*held, strict=True)), best)]
                count = len(held[0][0])
        if not held:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        own, place, low = map(np.concatenate, zip(*held, strict=True))
        keep = low <= best[own, -1]
        return own[keep], place[keep]

    def _improve(self, best: np.ndarray, rows: np.ndarray, bound: np.ndarray) -> None:
        """Takes ``bound`` of the ascending ``rows`` into the k least of each."""
        k = self.k
        start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        hit, count = rows[start], np.diff(np.r_[start, len(rows)])
        most = int(count.max())
        if most <= 2 * k + 6:
            new = np.full((len(hit), k + most), np.inf)
            new[:, :k] = best[hit]
            new[np.repeat(np.arange(len(hit)), count), k + np.arange(len(rows)) - np.repeat(start, count)] = bound
            best[hit] = np.sort(new, axis=1)[:, :k]
        else:
            every, bound = np.r_[rows, np.repeat(hit, k)], np.r_[bound, best[hit].ravel()]
            order = np.lexsort((bound, every))
            best[hit] = bound[order][np.searchsorted(every[order], hit)[:, None] + np.arange(k)]

    def _narrow(self, q, own, place, low, best):
        keep = low <= best[own, -1]
        own, place, low = own[keep], place[keep], low[keep]
        if len(own) > HELD // 2:
            # many lie within the error of each other: measured now, the k best stand for all so far
            own, place, _ = self._best(q, own, place)
            low = np.full(len(own), -np.inf)
        return own, place, low
