"""A navigable small-world graph over the vectors of one partition, in NumPy.

Levels come from a hash of the key and rows are added in key order, so a partition always gives the same graph.  Rows
are added, and queries walk, many at a time: a batch's rows see the graph before it and each other.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

#: Rows that are added at once, at most, and as a share of those before them; queries that walk at once, and bytes that
#: they may take.
ADDED, SHARE, WALKERS, ROOM = 256, 8, 512, 64 << 20


def level_of(key: int, m: int) -> int:
    """Geometric level: how often a uniform number, drawn from the key, survives a division by m."""
    x = (key * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & ((1 << 64) - 1)
    x ^= x >> 32
    x = (x * 0xD6E8FEB86659FD93) & ((1 << 64) - 1)
    x ^= x >> 32
    return min(int(-math.log((x + 1) / 2.0**64) / math.log(m)), 30)


def distances(metric: str, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """What an index of the metric ranks by; a zero vector is at distance 0 from zero and 1 from others."""
    if metric == "l2sq":
        d = rows - query
        return np.einsum("ij,ij->i", d, d)
    dot = rows @ query
    if metric == "ip":
        return 1 - dot
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows)) * math.sqrt(float(query @ query))
    out = 1 - dot / np.where(norms == 0, 1, norms)
    if (norms == 0).any():
        both = ~rows.any(axis=1) & (not query.any())
        out = np.where(norms == 0, np.where(both, 0.0, 1.0), out)
    return out


class Graph:
    """``links[level][slot]`` are the neighbours of a slot; slots follow ascending keys."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, metric: str, m: int, m0: int):
        self.keys, self.vectors, self.metric, self.m, self.m0 = keys, vectors, metric, m, m0
        self.levels = np.array([level_of(int(k), m) for k in keys], np.int64)
        self.links: list[dict[int, list[int]]] = [{} for _ in range(int(self.levels.max(initial=0)) + 1)]
        self.entry = -1
        self.base = np.full((len(keys), max(m, m0)), len(keys), np.int32)
        self.uppers: dict[int, np.ndarray] = {}

    @classmethod
    def build(cls, keys: np.ndarray, vectors: np.ndarray, metric: str, m: int = 16, m0: int = 32, ef: int = 128) -> Graph:
        graph = cls(keys, vectors, metric, m, m0)
        slot = 0
        while slot < len(keys):
            batch = np.arange(slot, min(slot + max(1, min(ADDED, slot // SHARE, graph._walkers(ef))), len(keys)))
            graph._add_all(batch, ef)
            slot += len(batch)
        return graph

    def _walkers(self, ef: int) -> int:
        return max(1, min(WALKERS, ROOM // (len(self.keys) + 64 * ef)))

    def _table(self, level: int) -> np.ndarray:
        """The links of a level as rows by slot, filled up with the number of slots."""
        links = self.links[level]
        out = np.full((len(self.keys), max((len(x) for x in links.values()), default=0)), len(self.keys), np.int32)
        for s, own in links.items():
            out[s, : len(own)] = own
        return out

    def _pairs(self, slots: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Distances of single pairs."""
        rows = self.vectors[slots]
        if self.metric == "l2sq":
            rows -= queries
            return np.einsum("ij,ij->i", rows, rows)
        dot = np.einsum("ij,ij->i", rows, queries)
        if self.metric == "ip":
            return 1 - dot
        a, b = np.einsum("ij,ij->i", rows, rows), np.einsum("ij,ij->i", queries, queries)
        norms = np.sqrt(a) * np.sqrt(b)
        return np.where(norms == 0, np.where((a == 0) & (b == 0), 0.0, 1.0), 1 - dot / np.where(norms == 0, 1, norms))

    def _descend_all(self, queries: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """``_descend`` to level 0 for many queries; ``tables`` are those of the levels."""
        n = len(self.keys)
        at = np.full(len(queries), self.entry)
        best = self._pairs(at, queries)
        for level in range(int(self.levels[self.entry]), 0, -1):
            moving = np.arange(len(queries))
            while len(moving) and tables[level].shape[1]:
                around = tables[level][at[moving]]
                r, c = np.nonzero(around < n)
                far = np.full(around.shape, np.inf)
                far[r, c] = self._pairs(around[r, c], queries[moving[r]])
                i = far.argmin(axis=1)
                near = far[np.arange(len(moving)), i]
                better = near < best[moving]
                moving, i, near, around = moving[better], i[better], near[better], around[better]
                at[moving], best[moving] = around[np.arange(len(moving)), i], near
        return at

    def _beam_all(self, queries: np.ndarray, starts: np.ndarray, table: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """``_beam`` for many queries at once: (distances, slots), nearest first, filled up with infinity."""
        n, b = len(self.keys), len(queries)
        far = np.full((b, ef), np.inf)
        slots = np.full((b, ef), n, np.int32)
        far[:, 0], slots[:, 0] = self._pairs(starts, queries), starts
        #: Distances of what is kept and not yet walked from.
        ahead = far.copy()
        worst = far.max(axis=1)
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True
        seen[np.arange(b), starts] = True
        active = np.arange(b)
        while table.shape[1]:
            at = ahead[active].argmin(axis=1)
            on = np.isfinite(ahead[active, at])
            active, at = active[on], at[on]
            if not len(active):
                break
            ahead[active, at] = np.inf
            around = table[slots[active, at]]
            r, c = np.nonzero(~seen[active[:, None], around])
            if not len(r):
                continue
            seen[active[:, None], around] = True
            new = self._pairs(around[r, c], queries[active[r]])
            good = new < worst[active[r]]
            r, c, new = r[good], c[good], new[good]
            rows = np.unique(r)
            if not len(rows):
                continue
            place = np.searchsorted(rows, r)
            more = np.full((len(rows), around.shape[1]), np.inf)
            more[place, c] = new
            mine = active[rows]
            both = np.hstack([far[mine], more])
            keep = np.argpartition(both, ef - 1, axis=1)[:, :ef]
            far[mine] = np.take_along_axis(both, keep, axis=1)
            ahead[mine] = np.take_along_axis(np.hstack([ahead[mine], more]), keep, axis=1)
            slots[mine] = np.take_along_axis(np.hstack([slots[mine], around[rows]]), keep, axis=1)
            worst[mine] = far[mine].max(axis=1)
        order = np.lexsort((slots, far), axis=1)
        return np.take_along_axis(far, order, axis=1), np.take_along_axis(slots, order, axis=1)

    def _far(self, slots: list[int], query: np.ndarray) -> np.ndarray:
        return distances(self.metric, self.vectors[slots], query)

    def _descend(self, query: np.ndarray, stop: int) -> int:
        """The closest slot that greedy steps find on the levels above ``stop``."""
        at = self.entry
        best = float(self._far([at], query)[0])
        for level in range(int(self.levels[at]), stop, -1):
            moved = True
            while moved:
                moved = False
                around = self.links[level].get(at, [])
                if around:
                    d = self._far(around, query)
                    i = int(d.argmin())
                    if d[i] < best:
                        best, at, moved = float(d[i]), around[i], True
        return at

    def _beam(self, query: np.ndarray, start: int, level: int, ef: int, skip: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The ef closest slots reachable on a level, nearest first; skipped slots are walked through, not returned."""
        first = float(self._far([start], query)[0])
        seen = np.zeros(len(self.keys), bool)
        seen[start] = True
        queue, kept = [(first, start)], []
        if skip is None or not skip[start]:
            kept.append((-first, -start))
        while queue:
            d, at = heapq.heappop(queue)
            if len(kept) >= ef and d > -kept[0][0]:
                break
            fresh = [s for s in self.links[level].get(at, ()) if not seen[s]]
            if not fresh:
                continue
            seen[fresh] = True
            for s, far in zip(fresh, self._far(fresh, query).tolist(), strict=True):
                if len(kept) < ef or far < -kept[0][0]:
                    heapq.heappush(queue, (far, s))
                    if skip is None or not skip[s]:
                        heapq.heappush(kept, (-far, -s))
                        if len(kept) > ef:
                            heapq.heappop(kept)
        return sorted((-d, -s) for d, s in kept)

    def _select(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Spread-out neighbours: one that is closer to a kept one than to the centre adds nothing."""
        if len(found) < most:
            return [s for _, s in found]
        kept: list[int] = []
        far, slots = np.array([d for d, _ in found]), [s for _, s in found]
        rows = self.vectors[slots]
        closest, at = np.full(len(far), np.inf), 0
        while at < len(far) and len(kept) < most:
            kept.append(slots[at])
            closest = np.minimum(closest, distances(self.metric, rows, rows[at]))
            free = closest[at + 1 :] > far[at + 1 :]
            at = at + 1 + int(free.argmax()) if free.any() else len(far)
        return kept

    def _add_all(self, batch: np.ndarray, ef: int) -> None:
        """Add slots that follow all others."""
        near: list[list[tuple[float, int]]] = [[] for _ in batch]
        if len(batch) > 1:
            tables, queries = [self.base, *map(self._upper, range(1, int(self.levels[self.entry]) + 1))], self.vectors[batch]
            far, slots = self._beam_all(queries, self._descend_all(queries, tables), self.base, ef)
            for i, slot in enumerate(batch.tolist()):
                found = [(d, s) for d, s in zip(far[i].tolist(), slots[i].tolist(), strict=True) if s < len(self.keys)]
                own = distances(self.metric, queries[:i], queries[i]).tolist() if i else []
                near[i] = sorted(found + [(d, slot - i + j) for j, d in enumerate(own)])[:ef]
        touched: set[int] = set()
        for slot, found in zip(batch.tolist(), near, strict=True):
            self._add(slot, ef, found, touched)
        for s in touched:
            own = self.links[0][s]
            self.base[s, : len(own)], self.base[s, len(own) :] = own, len(self.keys)

    def _upper(self, level: int) -> np.ndarray:
        """``_table`` of an upper level, made anew when the level has changed."""
        held = self.uppers.get(level)
        if held is None:
            held = self.uppers[level] = self._table(level)
        return held

    def _add(self, slot: int, ef: int, near: list[tuple[float, int]], touched: set[int]) -> None:
        """Add a slot whose ``near`` ones on level 0 are known, or none; ``touched`` gets what changes there."""
        level, query = int(self.levels[slot]), self.vectors[slot]
        touched.add(slot)
        if self.entry < 0:
            self.entry = slot
            for lv in range(level + 1):
                self.links[lv][slot] = []
            return
        top = int(self.levels[self.entry])
        for lv in range(level, top, -1):
            self.links[lv][slot] = []
        at = self._descend(query, level) if level or not near else self.entry
        for lv in range(min(level, top), -1, -1):
            found = self._beam(query, at, lv, ef) if lv or not near else near
            chosen = self._select(found, self.m)
            self.links[lv][slot] = list(chosen)
            most = self.m0 if lv == 0 else self.m
            for s in chosen:
                own = self.links[lv][s]
                own.append(slot)
                if len(own) > most:
                    d = self._far(own, self.vectors[s])
                    order = np.argsort(d, kind="stable")
                    self.links[lv][s] = self._select([(float(d[i]), own[i]) for i in order], most)
            if lv:
                self.uppers.pop(lv, None)
            else:
                touched.update(chosen)
            at = found[0][1] if found else at
        if level > top:
            self.entry = slot

    def search(self, query: np.ndarray, k: int, ef: int, skip: np.ndarray | None = None) -> list[tuple[float, int]]:
        """(distance, slot) of the k nearest live slots found."""
        if k <= 0 or self.entry < 0:
            return []
        return self._beam(query, self._descend(query, 0), 0, max(ef, k), skip)[:k]

    def search_all(self, queries: np.ndarray, k: int, ef: int) -> np.ndarray:
        """Slots of the k nearest found for every query, nearest first, filled up with the number of slots."""
        if k <= 0 or self.entry < 0:
            return np.empty((len(queries), 0), np.int32)
        tables = [self._table(level) for level in range(int(self.levels[self.entry]) + 1)]
        found = [np.empty((0, k), np.int32)]
        for at in range(0, len(queries), step := self._walkers(max(ef, k))):
            part = queries[at : at + step]
            found.append(self._beam_all(part, self._descend_all(part, tables), tables[0], max(ef, k))[1][:, :k])
        return np.concatenate(found)

    def nearest_at(self, query: np.ndarray, level: int) -> int:
        """The slot of at least ``level`` that is closest to the query: the cluster a vector falls into."""
        if level > int(self.levels[self.entry]):
            return self.entry
        return self._beam(query, self._descend(query, level), level, 1)[0][1]

    def rows(self):
        """(slot, key, level, neighbour lists by level, vector)."""
        for s in range(len(self.keys)):
            level = int(self.levels[s])
            yield s, int(self.keys[s]), level, [self.links[lv].get(s, []) for lv in range(level + 1)], self.vectors[s]

    @classmethod
    def load(cls, keys, levels, neighbours, vectors, metric: str, m: int, m0: int) -> Graph:
        graph = cls.__new__(cls)
        graph.keys, graph.vectors, graph.metric, graph.m, graph.m0, graph.levels = keys, vectors, metric, m, m0, np.asarray(levels, np.int64)
        graph.links = [{} for _ in range(int(graph.levels.max(initial=0)) + 1)]
        for s, own in enumerate(neighbours):
            for lv, around in enumerate(own):
                graph.links[lv][s] = list(around)
        # the first slot of the top level was the last to become the entry
        graph.entry = int(graph.levels.argmax()) if len(keys) else -1
        return graph
