import bisect
import random

import pytest

from veldra.llm import packing
from veldra.llm.common import materialize


def best_fit(histogram):
    """Sequences of best-fit decreasing, piece by piece."""
    rooms, count = [], 0
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            i = bisect.bisect_left(rooms, n)
            count += i == len(rooms)
            bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else 2048) - n)
    return count


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_and_is_tight(seed):
    rng = random.Random(seed)
    histogram = {n: rng.randint(1, 400) for n in rng.sample(range(1, 2049), 150)} | ({2048: 5000} if seed % 2 else {1500: 3000})
    left = dict(histogram)
    configs = packing.plan(histogram, 2048)
    for config, times in configs:
        assert times > 0 and sum(n * m for n, m in config.items()) <= 2048
        for n, m in config.items():
            left[n] -= m * times
    assert not any(left.values())
    assert sum(t for _, t in configs) <= 1.002 * best_fit(histogram)


def test_plan_of_nothing_and_of_one():
    assert packing.plan({}, 2048) == [] and packing.plan({7: 1}, 2048) == [({7: 1}, 1)]


def test_places(spark):
    rng = random.Random(2)
    rows = [(i % 50 if i % 9 else None, i, 0, rng.choice([2048, 1024, 1000, 3, 17]), i) for i in range(600)] + [(1, 1, 0, 5, 5)] * 3
    pieces = materialize(spark.createDataFrame(rows, packing.PIECES), "test")
    histogram = {}
    for r in rows:
        histogram[r[3]] = histogram.get(r[3], 0) + 1
    got = packing.assign(pieces, packing.plan(histogram, 2048), len(rows)).collect()
    assert len(got) == len(rows)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_hard_documents(spark):
    rows = [(None, None, 1), (1, "", 1), (1, "", 1), (2, "word " * 4100, 1)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length int")).collect()
    assert sorted((r["doc_id"] or 0, r["piece"], r["start"], r["length"]) for r in got) == [(0, 0, 0, 1), (1, 0, 0, 1), (1, 0, 0, 1), (2, 0, 0, 2048), (2, 1, 2048, 2048), (2, 2, 4096, 5)]
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_program_places_most_pieces():
    rng = random.Random(9)
    histogram = {n: rng.randint(250, 3000) for n in rng.sample(range(2, 700), 250)}
    left = dict(histogram)
    for config, times in packing.fractional(histogram, 2048):
        room = sum(n * m for n, m in config.items())
        assert room <= 2048
        if 2000 * room >= 1999 * 2048:
            for n, m in config.items():
                left[n] -= m * int(times)
    assert min(left.values()) >= 0
    assert sum(left.values()) <= 0.4 * sum(histogram.values())


@pytest.mark.parametrize("times", [1, 7, 100])
def test_program_places_nine_tenths_of_many_lengths(times):
    """Few pieces of each length, as in a small corpus, or many: the program fills nine tenths of the sequences, and all
    together are within a thousandth of the room that the pieces need."""
    rng = random.Random(10)
    histogram = {n: times * max(1, int(3000 / n * rng.uniform(0.5, 1.5))) for n in range(2, 1500)} | {2048: 40 * times}
    program = sum(t for c, t in packing.fractional(histogram, 2048) if packing.tight(c, 2048))
    needed = sum(t for _, t in packing.plan(histogram, 2048))
    least = -(-sum(n * m for n, m in histogram.items()) // 2048)
    assert program >= 0.9 * needed and needed <= 1.001 * least + 1
