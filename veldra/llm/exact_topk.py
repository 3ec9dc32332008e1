"""Exact top-k by inner product over an impact-ordered index (operator 6).

Components are quantised to floor(scale * x).  A block's index holds posting segments: for each component and impact
level (magnitudes that share a power of two, highest first) the rows and their values; zeros have no postings.  A
segment that holds a large share of the block is stored as a whole column with zeros elsewhere, which adds faster.

Each query is processed score-at-a-time: its segments are taken by falling |query weight| x highest magnitude, and a
segment adds its products to the accumulators of its rows.  What any row can still gain or lose is bounded by the sum,
over the components, of |weight| x the highest magnitude of the next segment; so a row whose accumulator lies more
than twice that bound below the k-th highest is out.  Processing stops on this proof, when few possible members are
left, or when the segments are exhausted; possible members are rescored exactly in integers.

Cases: vectors that are null or empty, or hold null or non-finite components take no part (zero vectors do), nor do
rows with a null id; repeated rows count once, and rows that share a query's id are never its candidates; vectors
of different length never meet; a score outside 64 bits counts as the nearest 64-bit number; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import best_of, clean, top_k

#: Possible members a query may have, over k, when it stops early.
FEW = 64
#: Impact levels of a component; the last one takes all smaller magnitudes.
LEVELS = 8
#: The share of a block's rows from which a segment is stored as a column, and the rows of a block.
DENSE, BLOCK_ROWS = 0.15, 16384
#: The bound is put to the proof each time it has shrunk by this factor.
PROOF = 0.7
_LONG = (-(2**63), 2**63 - 1)


class ImpactIndex:
    """Posting segments of one block; ``rows`` hold whole numbers as doubles."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.count = rows, len(rows)
        component, high, after, self.segments = [], [], [], []
        for c in range(rows.shape[1] if len(rows) else 0):
            column = np.ascontiguousarray(rows[:, c])
            magnitude = np.abs(column)
            level = np.frexp(magnitude)[1]
            level = np.maximum(level, level.max() - LEVELS + 1)
            own = []
            for value in np.unique(level[magnitude > 0])[::-1].tolist():
                inside = (level == value) & (magnitude > 0)
                places = np.flatnonzero(inside)
                values = np.where(inside, column, 0.0) if len(places) >= DENSE * self.count else column[places]
                own.append((float(magnitude[places].max()), len(places), None if len(values) == self.count else places, values))
            component += [c] * len(own)
            high += [s[0] for s in own]
            after += [s[0] for s in own[1:]] + [0.0] * bool(own)
            self.segments += [s[1:] for s in own]
        self.component, self.high, self.after = np.array(component, np.int64), np.array(high), np.array(after)
        self.postings = sum(s[0] for s in self.segments)

    def members(self, query: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, int]:
        """(places of the rows that can be among the best k, postings added).  ``own``: places that don't count."""
        weight = np.abs(query)[self.component] if len(self.component) else np.empty(0)
        gain = weight * self.high
        order = np.argsort(-gain, kind="stable")
        order = order[gain[order] > 0].tolist()
        falls = (weight * (self.high - self.after)).tolist()
        left = float(sum(falls[s] for s in order))
        # a hair of slack covers rounding in the sums
        slack, proof, kept = 1e-9 * left + 1e-6, PROOF * left, min(k, self.count - len(own))
        sums, touched, signed = np.zeros(self.count), 0, query[self.component].tolist() if len(self.component) else []
        if kept <= 0:
            return np.empty(0, np.int64), 0
        for s in order:
            size, places, values = self.segments[s]
            if places is None:
                sums += signed[s] * values
            else:
                sums[places] += signed[s] * values
            touched += size
            left -= falls[s]
            if left <= proof:
                found = self._possible(sums, own, kept, 2 * left + slack)
                if len(found) <= k + FEW:
                    return found, touched
                proof = PROOF * left
        return self._possible(sums, own, kept, slack), touched

    def _possible(self, sums: np.ndarray, own: np.ndarray, kept: int, reach: float) -> np.ndarray:
        counted = sums
        if len(own):
            counted = sums.copy()
            counted[own] = -np.inf
        least = np.partition(counted, self.count - kept)[self.count - kept]
        return np.flatnonzero(counted >= least - reach)


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    big = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1] >= 2**52
    index, place = ImpactIndex(rows), {}
    for at, i in enumerate(ids.tolist()):
        place.setdefault(i, []).append(at)
    out_q, out_v, out_s = [], [], []
    for name, query in zip(query_ids.tolist(), queries, strict=True):
        members, _ = index.members(query, np.array(place.get(name, []), np.int64), k)
        if big:
            whole = [int(x) for x in query]
            scores = [min(max(sum(int(x) * w for x, w in zip(rows[m], whole, strict=True)), _LONG[0]), _LONG[1]) for m in members.tolist()]
            order = sorted(range(len(members)), key=lambda m: (-scores[m], ids[members[m]]))[:k]
        else:
            scores = rows[members] @ query
            order = best_of(scores, ids[members], k).tolist()
        out_q += [name] * len(order)
        out_v += ids[members[order]].tolist()
        out_s += [int(scores[m]) for m in order]
    return out_q, out_v, out_s


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by ``every``."""
    rows = clean(vectors, id_col, vector_col, zero=True).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    return top_k(rows, F.col("vec_id") % every == 0, k, lambda i, r, qi, q: search(i, r, qi, q, k), "long", BLOCK_ROWS)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
