"""Best-fit packing of token sequences (operator 9).

Method: the configuration linear program over the histogram of piece lengths.  A configuration is a multiset of
lengths that fits one sequence; multiplicative weights price the lengths and an unbounded-knapsack dynamic program
finds the dearest configurations, in whole steps, until every length is covered but for ``TOLERANCE`` and what no
configuration without waste can use.  What is left is packed by exact subset-sum fills, longest length first; such fills alone are taken only where they need fewer sequences by more than ``GAP``
(few occurrences of a length).  Only the histogram (at most ``capacity`` rows) and the configurations
come to the driver; both are bounded by the capacity, not by the data.

Pieces then find their places without seeing each other: a piece is the r-th of its length, configurations cover
intervals of r, and the interval gives the sequence and the offset.  r is counted within (length, bucket) groups
plus the sizes of the buckets before, so a length that a third of all pieces share is split over many tasks.

Cases: a null or empty text is a document of the end id alone; every other column may be null; repeated rows are
packed as documents of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import encoder
from .common import materialize, sliced, whole_texts
from .tokens import vocabulary_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: How fast a covered length loses weight, the share of a demand one round covers, the share that the program leaves to
#: the fills, and how far the value of a used configuration is from the dearest.
RATE, STEP, TOLERANCE, NEAR = 8.0, 0.1, 0.07, 0.2
#: The share of sequences that the program may need beyond fills alone: where most pieces are longer than a third of a
#: sequence, so that room is lost whatever is done, its whole steps can need a hundredth more.
GAP = 0.001
#: Pieces that one (length, bucket) group is meant to hold.
GROUP_PIECES = 20_000


def encode_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of at most ``capacity`` ids, with the checksum of its ids."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder("word", vocabulary)
        for part in sliced(batches):
            rows: list[tuple] = []
            for key, ids in zip(part.column(0).to_pylist(), own.encode(part.column(1).to_pylist()), strict=True):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    cut = ids[4 * start : 4 * (start + capacity)]
                    rows.append((key, piece, start, len(cut) // 4, zlib.crc32(cut)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return whole_texts(docs).select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(highest value, its last length) of every capacity from 0 to ``capacity``: an unbounded knapsack."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := upto[c]:
            got = best[c - lengths[:n]] + value[:n]
            i = int(got.argmax())
            if got[i] > best[c]:
                best[c], taken[c] = got[i], lengths[i]
    return best, taken


def traced(taken: list[int], first: int, capacity: int) -> dict[int, int]:
    """The dearest configuration that holds the length ``first``."""
    found, c = {first: 1}, capacity - first
    while c > 0:
        if (n := taken[c]) < 0:
            c -= 1
        else:
            found[n] = found.get(n, 0) + 1
            c -= n
    return found


def tight(config: dict[int, int], capacity: int) -> bool:
    """A configuration that wastes more than half a thousandth of its room is left to the fills."""
    return 2000 * sum(n * m for n, m in config.items()) >= 1999 * capacity


def fractional(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations and how often each is used, covering every length at most once and but for ``TOLERANCE``.

    A round prices the lengths once and uses the dearest configuration and, for each length still open, the dearest
    that holds it, if it wastes no room and its value is within ``NEAR`` of the dearest of all; no length is covered by
    more than ``STEP`` (or one piece) in a round.  There are at most as many rounds as lengths, whatever the counts.
    """
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(n)] for n in lengths], float)
    index = {int(n): i for i, n in enumerate(lengths)}
    goal = np.ceil(demand * (1 - TOLERANCE))
    left = goal.copy()
    # two lengths above half the capacity never share a sequence: each is worth a whole one from the start
    start = np.where(2 * lengths > capacity, 1.0, lengths / capacity)
    used: list[tuple[dict[int, int], int]] = []
    for _ in range(len(lengths)):
        open_ = np.flatnonzero(left)
        if not len(open_):
            break
        value = start[open_] * np.exp(-RATE * (1 - left[open_] / goal[open_]))
        best, taken = price(lengths[open_], value, capacity)
        worth, followed = value + best[capacity - lengths[open_]], taken.tolist()
        room = np.minimum(left, np.maximum(np.floor(STEP * demand), 1.0))
        stuck = True
        for i in np.argsort(-worth, kind="stable").tolist():
            if worth[i] < (1 - NEAR) * best[capacity]:
                break
            config = traced(followed, int(lengths[open_[i]]), capacity)
            if not stuck and not tight(config, capacity):
                continue
            whole = int(min(left[index[n]] // many for n, many in config.items()))
            times = max(int(min(room[index[n]] // many for n, many in config.items())), min(whole, 1))
            if times:
                for n, many in config.items():
                    room[index[n]] -= many * times
                    left[index[n]] -= many * times
                used.append((config, times))
            elif stuck:  # not even the dearest fits once: what is left of its scarce lengths is for the fills
                for n, many in config.items():
                    if left[index[n]] < many:
                        left[index[n]] = 0
            stuck = False
    return used


def fill(lengths: list[int], left: dict[int, int], room: int) -> dict[int, int]:
    """The fullest fill of ``room`` from the counted lengths, by subset sums in one big integer per length."""
    reach, layers = 1, []
    mask = (1 << (room + 1)) - 1
    for n in lengths:
        if n > room:
            continue
        layers.append((n, 0, reach))
        many, chunk = min(left[n], room // n), 1
        while many > 0:  # powers of two of the multiplicity
            step = min(chunk, many)
            layers.append((n, step, reach))
            reach |= (reach << (n * step)) & mask
            many, chunk = many - step, chunk * 2
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, {}
    for n, step, before in reversed(layers):
        if step and not before >> at & 1:
            found[n] = found.get(n, 0) + step
            at -= n * step
    return found


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole configurations and their counts that cover the histogram exactly."""
    histogram = {n: c for n, c in histogram.items() if c > 0}
    program = _rounded(histogram, fractional(histogram, capacity) if histogram else [], capacity)
    fills = _rounded(histogram, [], capacity)
    needed, least = (sum(times for _, times in configs) for configs in (program, fills))
    return program if needed <= (1 + GAP) * least else fills


def _rounded(histogram: dict[int, int], used: list[tuple[dict[int, int], int]], capacity: int) -> list[tuple[dict[int, int], int]]:
    left = dict(histogram)
    out: list[tuple[dict[int, int], int]] = []

    def use(config: dict[int, int], times: int) -> None:
        out.append((config, times))
        for n, many in config.items():
            left[n] -= many * times
            if not left[n]:
                del left[n]

    for config, times in used:
        if all(n in left for n in config):
            whole = min(times, *(left[n] // many for n, many in config.items()))
            if whole > 0 and tight(config, capacity):
                use(config, whole)
    while left:
        order = sorted(left, reverse=True)
        longest = order[0]
        left[longest] -= 1
        config = fill(order, left, capacity - longest)
        left[longest] += 1
        config[longest] = config.get(longest, 0) + 1
        use(config, min(left[n] // many for n, many in config.items()))
    return out


def assign(pieces: DataFrame, configs: list[tuple[dict[int, int], int]], total: int) -> DataFrame:
    """Adds sequence_id and offset.  ``pieces`` is read twice, so it should be a written table."""
    spark = pieces.sparkSession
    buckets = 64 + total // GROUP_PIECES
    per: dict[int, list[tuple]] = {}
    sequence, seen = 0, {}
    for config, times in configs:
        offset = 0
        for n, many in sorted(config.items(), reverse=True):
            lo = seen.get(n, 0)
            per.setdefault(n, []).append((lo, many, sequence, offset))
            seen[n] = lo + many * times
            offset += n * many
        sequence += times
    shared = spark.sparkContext.broadcast({n: np.array(rows, np.int64) for n, rows in per.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence_id, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                table = shared.value[n]
                lo, many, first, at = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1].T
                sequence_id[own] = first + (rank[own] - lo) // many
                offset[own] = at + (rank[own] - lo) % many * n
            kept = [batch.column(c.split()[0]) for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence_id), pa.array(offset)], [*(c.split()[0] for c in PIECES.split(", ")), "sequence_id", "offset"])

    # both windows and the counts share one exchange on (length, bucket)
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("many"))
    before = F.sum("many").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("many")
    counts = counts.select("length", "bucket", before.alias("before"))
    inner = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = rows.withColumn("inner", inner).join(counts, ["length", "bucket"])
    return ranked.select(*(c.split()[0] for c in PIECES.split(", ")), (F.col("before") + F.col("inner") - 1).alias("rank")).mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """The op9 query and the pipeline's last stage."""
    pieces = materialize(encode_pieces(docs, vocabulary_path(vocabulary), end_id, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    return assign(pieces, plan(histogram, capacity), sum(histogram.values()))
