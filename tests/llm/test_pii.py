"""Base spans against the contract's own patterns; hard texts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from veldra.llm import pii

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for i, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), i, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


HARD = [
    None, "", "a@b.c+d@e.f", "a@b..c@d.e", "x@y.z. q@w-e.r-t.", "a@b", "@a.b", "..a@b.c..d@e.f", "é😀 jo.e+x@mail-1.example.com😀",
    "1.2.3.4.5.6.7.8", "256.1.1.1 0255.0.0.1 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 x 4111  1111 1111 1111", "41111111111111111", "4111111111111111 4111111111111111",
    "+1 (555) 123-4567", "+1 555", "+12345678901234567", "+1 (207) 555-7294. +44 20 7946 0958)", "++1 (207) 555-7294 1", " 41111111 a@bc",
    "a@" + "b." * 20000 + "c", "1 " * 20000, "9" * 30000, "a" * 100000 + " x@y.zz", "1." * 5000, "(" * 3000 + "+1" + "(" * 3000,
    "call 555 123-4567 or me [at] site [dot] org, ssn 123-45-6789", "10.0.0.1a 300.300.300.300", "+1-2-3-4-5-6-7-8-9-0-", "1-2 3-4 5-6 7-8 9-0 1-2 3-4",
]


def test_base_spans_equal_the_contract(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(HARD)] + [(0, "a@b.c", "y"), (None, "a@b.c", "y")], "doc_id long, text string, spans string")
    rows = pii.digests(docs).collect()
    assert len(rows) == len(HARD) + 2
    said = {(r["doc_id"], r["base_sha256"]) for r in rows}
    for i, text in enumerate(HARD):
        assert (i, hashlib.sha256(brute(text).encode()).hexdigest()) in said, repr(text)[:80]
    assert (None, hashlib.sha256(b"email:0:5").hexdigest()) in said


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    import random

    rng = random.Random(seed)
    texts = ["".join(rng.choice("a1@.+- ()09é%_") for _ in range(rng.randint(1, 200))) for _ in range(400)]
    rows = pii.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert r["base_sha256"] == hashlib.sha256(brute(texts[r["doc_id"]]).encode()).hexdigest(), texts[r["doc_id"]]


def test_many_matches_in_one_text_take_linear_time(spark):
    import time

    texts = [" ".join(f"u{i}@b{i}.cd +1 (555) {i % 900 + 100}-4567 u [at] b [dot] cd" for i in range(n)) for n in (50, 10_000)]
    began = time.monotonic()
    rows = pii.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert time.monotonic() - began < 30
    for r in rows:
        assert r["base_sha256"] == hashlib.sha256(brute(texts[r["doc_id"]]).encode()).hexdigest()


def test_candidates_their_context_and_neighbours_equal_brute_force(spark):
    """What the trees see: places, the characters around a candidate, and base spans over or near it."""
    import random

    rng, texts = random.Random(11), []
    parts = ["a@b.cd", "+1 (555) 123-4567", "10.0.0.1", "4111 1111 1111 1111", "555 123-4567", "123-45-6789", "me [at] site [dot] org", "x", " ", "é😀", "ssn ", "y" * 130, ", "]
    for n in (0, 1, 3, 10, 200, 200):
        texts.append("".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(n)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = docs.select("doc_id", pii.spans(F.col("text"), pii.PHONE_LIKE, True).alias("p"), pii.spans(F.col("text"), pii.MAIL_LIKE, True).alias("m"))
    for r in found.collect():
        text = texts[r["doc_id"]]
        for pattern, got in ((pii.PHONE_LIKE, r["p"]), (pii.MAIL_LIKE, r["m"])):
            want = [(m.start(), m.end(), m[0], text[max(0, m.start() - pii.CONTEXT) : m.start()], text[m.end() : m.end() + 1]) for m in re.finditer(pattern, text, re.ASCII)]
            assert [tuple(s) for s in got] == want, text
    tables = pii._tables(docs).withColumn("near", F.transform("cands", lambda s: F.array(*(f(s, F.col(k)).cast("int") for k in pii.KINDS[: pii.BASE] for f in (pii._near, pii._covers)))))
    seen = 0
    for r in tables.collect():
        for s, flags in zip(r["cands"], r["near"], strict=True):
            want = []
            for kind in pii.KINDS[: pii.BASE]:
                over = [b["start"] < s["end"] and b["end"] > s["start"] for b in r[kind]]
                close = [b["start"] < s["end"] + pii.NEAR and b["end"] + pii.NEAR > s["start"] for b in r[kind]]
                want += [int(any(c and not o for c, o in zip(close, over, strict=True))), int(any(over))]
            assert flags == want
            seen += 1
    assert seen > 100


def test_empty_table_and_boosting(spark):
    assert pii.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [({n: 0 for n in pii.FEATURES} | {"gen": g, "cue": c}, 100.0, 95.0 if c else 5.0) for g in range(4) for c in range(2)]
    start, trees = pii.boost(rows)
    margins = [start + sum(pii._run(t, x) for t in trees) for x, _, _ in rows]
    limits = pii.thresholds(rows, margins)
    assert all((m >= limits[x["gen"]]) == bool(x["cue"]) for (x, _, _), m in zip(rows, margins, strict=True))


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "mail a@b.c, call +1 (555) 123-4567")], "doc_id long, text string")
    for df in (pii._tables(docs), pii.digests(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_identity_numbers_are_found(spark):
    rows = [(i, f"the social security number is {100 + i}-{10 + i % 80}-{1000 + 7 * i} as stated") for i in range(60)]
    rows += [(100 + i, f"pay to IBAN {iban} soon") for i, iban in enumerate(["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606"])]
    rows += [(200 + i, f"write to user{i}@example.org or read part {900 + i % 90}-{10 + i}-{2000 + i} of it") for i in range(30)]
    got = {r["doc_id"]: [(pii.KINDS[s["kind"]], s["base"]) for s in r["spans"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for key in [*range(60), 100, 101, 102]:
        assert got[key] == [("id_like", False)], key
    assert all(("id_like", False) not in got[200 + i] for i in range(30))
    checked = spark.createDataFrame([("DE89370400440532013000",), ("DE88370400440532013000",), ("GB82 WEST 1234 5698 7654 32",)], "hit string").select(pii.iban("hit").alias("ok"))
    assert [r["ok"] for r in checked.collect()] == [True, False, True]
