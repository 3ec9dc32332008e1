"""Approximate nearest neighbours by collision counting (operator 1).

Largest inner product becomes nearest distance: the rows of a block are dealt into bands of like norm, each is
searched on its own, longest first, until the norm of a band rules it out.  Rows are scaled to the largest norm of
their band and padded to unit length, queries are scaled to unit length.  ``PROJECTIONS`` random directions (orthonormal in groups) give one
number per vector each, kept as sorted arrays.  For a query, windows around its own projections are opened on all
arrays at once and widened by virtual rehashing (the radius grows by ``GROWTH``, only the new ends of the windows
are read); every appearance of a vector is a collision.  The first windows hold more than half of an array, so what
lies outside them is counted instead and taken off.  Vectors that collide on ``THRESHOLD`` of the directions
are candidates; widening stops when the band has ``SHARE`` of its vectors, and ``LEAST`` at least, as candidates.
All candidates are then verified with exact double-precision inner products.

Cases: vectors that are null, empty or zero, or hold null or non-finite components take no part, nor do rows with
a null id; repeated rows count once, and rows that share a query's id are never its neighbours; vectors of
different length never meet; with fewer candidates than k all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import best_of, clean, top_k

PROJECTIONS, THRESHOLD = 64, 0.8
#: The first radius in standard deviations of the projections, and its growth.
RADIUS, GROWTH = 1.4, 1.08
SHARE, LEAST = 0.08, 400
#: The largest norm of a band over its smallest.
BAND = 1.15


def directions(dim: int, count: int = PROJECTIONS) -> np.ndarray:
    rng, blocks = np.random.default_rng(20_000 + dim), []
    while sum(map(len, blocks)) < count:
        blocks.append(np.linalg.qr(rng.normal(size=(dim, dim)))[0])
    return np.vstack(blocks)[:count]


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products row by row: equal vectors get equal scores."""
    return (rows * query).sum(axis=1)


def bands(norms: np.ndarray) -> list[np.ndarray]:
    """Places of the rows by falling norm, cut where the norm falls below 1 / ``BAND`` of the band's largest; a band
    takes ``LEAST`` rows whatever their norms, as so few are all verified."""
    falling, out, at = np.argsort(-norms, kind="stable"), [], 0
    while at < len(falling):
        within = int(np.searchsorted(-norms[falling], -norms[falling[at]] / BAND, "right"))
        out.append(falling[at : max(within, at + LEAST)])
        at += len(out[-1])
    return out


def candidates(rows: np.ndarray, q: np.ndarray, k: int):
    """The search of one band: a function from the number of a query to the places of its candidates."""
    n, dim = rows.shape
    enough = min(n, max(LEAST, k + 1, int(SHARE * n)))
    if enough == n:
        return lambda number: np.arange(n)
    rows = rows / np.abs(rows).max()
    norms = np.linalg.norm(rows, axis=1)
    top = norms.max()
    padded = np.hstack([rows / top, np.sqrt(np.maximum(0, 1 - (norms / top) ** 2))[:, None]])
    plane = directions(dim + 1)
    h, hq = padded @ plane.T, np.hstack([q, np.zeros((len(q), 1))]) @ plane.T
    order = np.ascontiguousarray(np.argsort(h, axis=0, kind="stable").T)
    lines = np.take_along_axis(h.T, order, axis=1)
    need = int(np.ceil(THRESHOLD * len(plane)))
    spread = float(h.std()) or 1.0
    radii = [RADIUS * spread * GROWTH**i for i in range(40)]
    lo_all, hi_all = {}, {}

    def of(number: int) -> np.ndarray:
        counts, lo, hi = np.full(n, len(plane)), None, None
        for step, radius in enumerate(radii):
            if step not in lo_all:  # window ends of all queries at this radius
                lo_all[step] = np.stack([np.searchsorted(line, hq[:, j] - radius, "left") for j, line in enumerate(lines)], 1)
                hi_all[step] = np.stack([np.searchsorted(line, hq[:, j] + radius, "right") for j, line in enumerate(lines)], 1)
            new_lo, new_hi = lo_all[step][number].tolist(), hi_all[step][number].tolist()
            if lo is None:
                parts = [line[:a] for line, a in zip(order, new_lo, strict=True)] + [line[b:] for line, b in zip(order, new_hi, strict=True)]
                counts -= np.bincount(np.concatenate(parts), minlength=n)
            else:
                parts = [line[a:b] for line, a, b in zip(order, new_lo, lo, strict=True)] + [line[a:b] for line, a, b in zip(order, hi, new_hi, strict=True)]
                counts += np.bincount(np.concatenate(parts), minlength=n)
            lo, hi = new_lo, new_hi
            chosen = np.flatnonzero(counts >= need)
            if len(chosen) >= enough:
                return chosen
        return np.arange(n)

    return of


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    peaks = np.abs(rows).max(axis=1)
    norms = peaks * np.linalg.norm(rows / peaks[:, None], axis=1)
    q = queries / np.abs(queries).max(axis=1, keepdims=True)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    lengths = np.linalg.norm(queries, axis=1)
    parts = [(own, float(norms[own[0]]), candidates(rows[own], q, k)) for own in bands(norms)]
    out_q, out_v, out_s = [], [], []
    for number in range(len(q)):
        chosen, scores = np.empty(0, np.int64), np.empty(0)
        for own, longest, of in parts:
            # no row of this band or a later one can reach the k-th score
            if len(scores) >= k and np.partition(scores, len(scores) - k)[len(scores) - k] > longest * lengths[number] * (1 + 1e-9):
                break
            more = own[of(number)]
            more = more[ids[more] != query_ids[number]]
            chosen, scores = np.concatenate([chosen, more]), np.concatenate([scores, inner(rows[more], queries[number])])
        best = best_of(scores, ids[chosen], k)
        out_q.append(np.full(len(best), query_ids[number]))
        out_v.append(ids[chosen][best])
        out_s.append(scores[best])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by ``every``."""
    rows = clean(vectors, id_col, vector_col, zero=False)
    return top_k(rows, F.col("vec_id") % every == 0, k, lambda i, r, qi, q: search(i, r, qi, q, k), "double")
