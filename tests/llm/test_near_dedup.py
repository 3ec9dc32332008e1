"""Near duplicates against all pairs, on planted groups and hard rows."""

import random

import numpy as np
import pytest

from veldra.llm import near_dedup as N


def brute(rows):
    sets = {}
    for key, text in rows:
        words = (text or "").encode().lower().split()
        sets[key] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in keys}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(3000)] + ["É", "ß.", "Ab", "aB"]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, passage = [], make(40)
    for _ in range(60):
        rows.append(make(rng.randint(1, 60)) + passage * rng.randint(0, 1))
    for size in (3, 30, 250):
        first = make(rng.randint(40, 120))
        for _ in range(size):
            copy = list(first)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(copy)
    for n in (1, 4, 5, 6, 8):
        rows += [make(n)] * 2
        rows.append(rows[-1] + ["x"])
    chain = make(60)
    for i in range(12):
        rows.append(chain[i * 2 :] + make(2 * i))
    texts = [rng.choice([" ", "\n", "\t "]).join(r) for r in rows] + ["", None, " \n", "ONE two Three", "one TWO three", "É é", "é é"]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "STAR_ROUNDS", seed)
    rows = corpus(seed)
    want = brute(rows)
    got = N.near_duplicates(spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, node int, key string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_hard_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (None, None), (3, "x y"), (3, "p q r"), (4, "p q r"), (None, "only here"), (None, "only here")]
    got = sorted(map(str, N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "kept").collect()))
    assert len(got) == len(rows)
    kept = N.drop_near_duplicates(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string"))
    assert kept.columns == ["doc_id", "text", "lang"]
    # an id keeps those of its texts that are no copies, a text of null ids alone stays once
    want = [(1, "a b c d e f"), (2, None), (3, "p q r"), (3, "x y"), (None, None), (None, "only here")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_is_unbiased():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) for n in (900, 150, 150))
        x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        errors.append(N.estimate(N.registers(x), N.registers(y), np.array(len(x)), np.array(len(y)))[0] - 0.75)
    assert abs(np.mean(errors)) < 0.015
    x, y = (np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2)) for _ in range(2))
    assert N.estimate(N.registers(x), N.registers(y), np.array(5000), np.array(5000))[0] < 0.03


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    """Without null ids: the copy under a repeated id goes, its other text stays; clashing column names do no harm."""
    one, other = " ".join("abcdefghijkl"), " ".join("mnopqrstuvwx")
    rows = [(5, one, "a", 1), (5, other, "b", 1), (3, one, "c", 1), (7, other + " y", "d", 1), (8, "", "e", 1), (8, "", "f", 1)]
    kept = N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, node string, label int"))
    assert kept.columns == ["doc_id", "text", "node", "label"]
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, one), (5, other), (8, "")]
