"""Personal data (operator 4), with DataFrame functions only.

Base spans come from four patterns.  Besides, high-recall generators propose loose spans (spelled-out addresses,
numbers that look like phones, identity numbers or cards).  Each candidate becomes a vector of small integers: its
generator, its count of digits, separators, the words before it, what touches it and whether other personal data is
near.  Gradient-boosted trees over these vectors learn how likely such a candidate is to be personal data; examples
are all candidates of the corpus, positive where they cover a base span or their format checks (identity numbers and
short cards have no base pattern: ranges of social security numbers, check digits of the others), so the trees see counts per vector, a
table of at most some thousand rows whatever the corpus.  For every generator the threshold is the lowest score at
which the held-out examples above it are right in ``PRECISION`` of all cases; candidates from there on are added to the base
spans.  The trees run as CASE expressions.

Patterns are written so that Java's engine runs them in linear time and without recursion: separators between two
digits, and full stops inside a domain, are first replaced by private characters of the same length, which turns
repeated groups into runs of one class.  Positions come from the lengths of the pieces between matches.

Cases: null and empty texts have no spans; repeated rows and null ids are scanned row by row; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone", "mail_like", "phone_like", "id_like", "card_like")
BASE = 4
#: Rounds of boosting, shrinkage, and the share of right candidates above a threshold.
ROUNDS, SHRINK, PRECISION = 40, 0.3, 0.9
#: Characters of context before a candidate, and the distance to other personal data that counts as near.
CONTEXT, NEAR = 30, 120
#: Matches of a block of running sums.
BLOCK = 64

#: Private characters that stand for a separator between digits and for a full stop inside a domain.
SEP, DOT = "", ""
LOCAL = f"[A-Za-z0-9._%+{DOT}-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = f"[0-9{SEP}]{{14,}}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
MAIL_LIKE = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?(?:\[at\]|\(at\)|\{at\}|@) ?[A-Za-z0-9-]{2,63}+ ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z]{2,24}"
PHONE_LIKE = r"(?<![0-9A-Za-z.])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])"
ID_LIKE = r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])"
CARD_LIKE = f"[0-9{SEP}]{{12,}}+"
#: Words before personal data.
CUES = r"(?i)(?:e-?mail|mail|phone|tel|call|mobile|fax|card|visa|account|iban|ssn|social|passport|contact|id)[^A-Za-z0-9]{0,4}(?:[a-z]{1,8}[^A-Za-z0-9]{1,3})?$"
#: Names of the features and how many values each has.
FEATURES = {"gen": 4, "digits": 6, "seps": 4, "cue": 2, "before": 3, "after": 3, "near": 2}


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: Column, pattern: str, context: bool = False) -> Column:
    """array of (start, end, hit) of all matches; code points, end exclusive.  With ``context`` also the ``CONTEXT``
    characters before a match (head) and the one after it (next).

    Running sums go block by block, as a growing array is copied whole at every step; the texts around a match come
    from the pieces between matches, as a position in a text is found by counting from its start."""
    right = lambda x: F.when(F.length(x) > CONTEXT, F.substring(x, -CONTEXT, CONTEXT)).otherwise(x)

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        end = start + F.length(m["hit"])
        if not context:
            return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), m["hit"].alias("hit"))).alias("out"))
        head = right(F.concat(acc["tail"], m["head"]))
        found = F.struct(start.alias("start"), end.alias("end"), m["hit"].alias("hit"), head.alias("head"), m["next"].alias("next"))
        return F.struct(end.alias("at"), right(F.concat(head, m["hit"])).alias("tail"), F.array_append(acc["out"], found).alias("out"))

    def matches(pieces: Column, hits: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            fields = [F.length(F.get(pieces, i)).alias("gap"), hit.alias("hit")]
            if context:
                after = F.concat(F.get(pieces, i + 1), F.coalesce(F.get(hits, i + 1), F.lit("")))
                fields += [right(F.get(pieces, i)).alias("head"), F.substring(after, 1, 1).alias("next")]
            return F.struct(*fields)

        return F.transform(hits, one)

    def summed(blocks: Column) -> Column:
        width = lambda block: F.aggregate(block, F.lit(0), lambda n, m: n + m["gap"] + F.length(m["hit"]))
        starts = F.aggregate(F.transform(blocks, width), F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))

        def block_of(starts: Column) -> Column:
            def walk(block: Column, i: Column) -> Column:
                fields = [F.get(starts, i).alias("at")]
                if context:  # a match has a character at least, so CONTEXT of them hold the context
                    before = F.coalesce(F.get(blocks, i - 1), F.slice(block, 1, 0))
                    before = F.slice(before, F.greatest(F.size(before) - CONTEXT, F.lit(0)) + 1, F.lit(CONTEXT))
                    fields.append(right(F.array_join(F.transform(before, lambda m: F.concat(m["head"], m["hit"])), "")).alias("tail"))
                return F.aggregate(block, F.struct(*fields, _none(context).alias("out")), step, lambda acc: acc["out"])

            return F.flatten(F.transform(blocks, walk))

        return _let(starts, block_of)

    def blocked(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(found) / BLOCK)).cast("int")), lambda i: F.slice(found, i * BLOCK + 1, F.lit(BLOCK)))

    pairs = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    found = _let(pairs, lambda both: _let(both["pieces"], lambda p: _let(both["hits"], lambda h: matches(p, h))))
    return _let(_let(found, blocked), summed)


def _none(context: bool = False) -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,hit:string" + (",head:string,next:string>>)" if context else ">>)"))


def _where(test: Column, found: Column, context: bool = False) -> Column:
    return F.when(test, found).otherwise(_none(context))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the check digit of a digit string is right."""
    turned = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        x = F.ascii(F.substring(turned, i, F.lit(1))) - 48
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def iban(hit: Column) -> Column:
    """True if the check digits of an account number are right (its letters count from 10, modulo 97)."""
    code = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(code, 5, 99), F.substring(code, 1, 4))

    def add(acc: Column, i: Column) -> Column:
        x = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(x < 65, acc * 10 + x - 48).otherwise(acc * 100 + x - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))), F.lit(0), add) == 1


def _right(generator: str, hit: Column) -> Column:
    """1 if the format of a candidate speaks for personal data although no base pattern covers it: social security
    numbers of the ranges in use, account numbers and cards with the right check digits."""
    if generator == "id_like":
        return F.when(hit.rlike("^[0-9]"), hit.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")).otherwise(iban(hit)).cast("int")
    if generator == "card_like":
        return (F.length(_digits(hit)).between(12, 19) & luhn(_digits(hit))).cast("int")
    return F.lit(0)


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
        return F.filter(found, lambda s: s["hit"].rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
    if kind == "card":
        return F.filter(found, lambda s: F.length(_digits(s["hit"])).between(14, 19) & luhn(_digits(s["hit"])))
    if kind == "phone":
        return F.filter(found, lambda s: F.length(_digits(s["hit"])).between(10, 15))
    return found


def _tables(docs: DataFrame) -> DataFrame:
    """(doc_id, one array of spans per base kind, cands): cands with features but for ``near``."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), SEP + DOT, "��")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("joined", F.when(F.col("text").rlike("[0-9](?:[ -]?[0-9]){11}"), F.regexp_replace("text", "(?<=[0-9])[ -](?=[0-9])", SEP)))
    rows = rows.withColumn("dotted", F.when(F.col("text").contains("@"), F.regexp_replace("text", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)))
    t = F.col("text")
    base = {
        "email": _where(F.col("dotted").isNotNull(), spans(F.col("dotted"), EMAIL)),
        "ip": _where(t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), spans(t, IP)),
        "card": _where(F.col("joined").isNotNull(), spans(F.col("joined"), CARD)),
        "phone": _where(t.contains("+"), spans(t, PHONE)),
    }
    loose = {
        "mail_like": _where(t.contains("@") | t.rlike(r"(?i)[\[({]at[\])}]"), spans(t, MAIL_LIKE, True), True),
        "phone_like": _where(t.rlike(r"[0-9][ .-][0-9]{3}"), spans(t, PHONE_LIKE, True), True),
        "id_like": _where(t.rlike(r"[0-9]{3}-[0-9]{2}-|[A-Z]{2}[0-9]{2}"), spans(t, ID_LIKE, True), True),
        "card_like": _where(F.col("joined").isNotNull(), spans(F.col("joined"), CARD_LIKE, True), True),
    }

    def described(g: int, name: str, found: Column) -> Column:
        def one(s: Column) -> Column:
            digits = F.length(_digits(s["hit"]))
            seps = F.length(F.regexp_replace(s["hit"], f"[^ ().{SEP}-]", ""))
            last, nxt = F.substring(s["head"], -1, 1), s["next"]
            touch = lambda c: F.when(c.rlike("[A-Za-z0-9]"), 2).when(c.rlike("[^\\s]"), 1).otherwise(0)
            return F.struct(
                s["start"].alias("start"), s["end"].alias("end"), F.lit(g).alias("gen"),
                F.when(digits < 4, 0).when(digits < 9, 1).when(digits < 12, 2).when(digits < 14, 3).when(digits < 20, 4).otherwise(5).alias("digits"),
                F.least(seps, F.lit(3)).alias("seps"), s["head"].rlike(CUES).cast("int").alias("cue"), touch(last).alias("before"), touch(nxt).alias("after"),
                _right(name, s["hit"]).alias("right"),
            )

        return F.transform(found, one)

    cands = F.concat(*(described(g, n, f) for g, (n, f) in enumerate(loose.items())))
    return rows.select("doc_id", *(_valid(k, f).alias(k) for k, f in base.items()), cands.alias("cands"))


def _first(found: Column, test) -> Column:
    """How many spans of a sorted array pass a test that all fail from some place on; by halving."""
    span = F.struct(F.lit(0).alias("lo"), F.size(found).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        low = (acc["lo"] < acc["hi"]) & F.coalesce(test(F.get(found, mid)), F.lit(False))
        return F.struct(F.when(low, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(found)))), span, halve, lambda acc: acc["lo"])


def _covers(s: Column, found: Column) -> Column:
    """Whether a candidate overlaps a span of a kind; these are sorted and never overlap one another."""
    last = F.get(found, _first(found, lambda b: b["start"] < s["end"]) - 1)
    return F.coalesce(last["end"] > s["start"], F.lit(False))


def _near(s: Column, found: Column) -> Column:
    """Whether a span of a kind lies within ``NEAR`` characters of a candidate without overlapping it."""
    before = F.get(found, _first(found, lambda b: b["end"] <= s["start"]) - 1)
    after = F.get(found, _first(found, lambda b: b["start"] < s["end"]))
    return F.coalesce(before["end"] + NEAR > s["start"], F.lit(False)) | F.coalesce(after["start"] - NEAR < s["end"], F.lit(False))


Tree = tuple


def boost(rows: list[tuple[dict[str, int], float, float]], rounds: int = ROUNDS, shrink: float = SHRINK) -> tuple[float, list[Tree]]:
    """Logistic boosting with trees of depth two over (features, weight, positive weight) rows; ties take the first split."""
    total, positive = sum(w for _, w, _ in rows), sum(p for _, _, p in rows)
    if not total or positive in (0, total):
        return (-9.0 if not positive else 9.0), []
    start = math.log(positive / (total - positive))
    margin, trees = [start] * len(rows), []

    def leaf(own: list[int], grad, hess) -> float:
        return shrink * sum(grad[i] for i in own) / (sum(hess[i] for i in own) + 1.0)

    def split(own: list[int], grad, hess):
        best = None
        g_all, h_all = sum(grad[i] for i in own), sum(hess[i] for i in own)
        for name, values in FEATURES.items():
            for cut in range(values - 1):
                g = sum(grad[i] for i in own if rows[i][0][name] <= cut)
                h = sum(hess[i] for i in own if rows[i][0][name] <= cut)
                gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, name, cut)
        return best

    def grow(own: list[int], depth: int, grad, hess) -> Tree:
        best = split(own, grad, hess) if depth else None
        if best is None:
            return (leaf(own, grad, hess),)
        _, name, cut = best
        low, high = [i for i in own if rows[i][0][name] <= cut], [i for i in own if rows[i][0][name] > cut]
        return (name, cut, grow(low, depth - 1, grad, hess), grow(high, depth - 1, grad, hess))

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad = [pos - w * q for (_, w, pos), q in zip(rows, p, strict=True)]
        hess = [w * q * (1 - q) for (_, w, _), q in zip(rows, p, strict=True)]
        tree = grow(list(range(len(rows))), 2, grad, hess)
        if len(tree) == 1:
            break
        trees.append(tree)
        margin = [m + _run(tree, x) for m, (x, _, _) in zip(margin, rows, strict=True)]
    return start, trees


def _run(tree: Tree, x: dict[str, int]) -> float:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def _sql(tree: Tree, of: str) -> str:
    return repr(tree[0]) + "D" if len(tree) == 1 else f"IF({of}.{tree[0]} <= {tree[1]}, {_sql(tree[2], of)}, {_sql(tree[3], of)})"


def thresholds(rows: list[tuple[dict[str, int], float, float]], margins: list[float], precision: float = PRECISION) -> list[float]:
    """Per generator the lowest margin with the asked precision among the examples from there up; infinite if none."""
    out = []
    for g in range(FEATURES["gen"]):
        own = sorted(((m, w, p) for (x, w, p), m in zip(rows, margins, strict=True) if x["gen"] == g), reverse=True)
        best, weight, right = float("inf"), 0.0, 0.0
        for i, (m, w, p) in enumerate(own):
            weight, right = weight + w, right + p
            last = i + 1 == len(own) or own[i + 1][0] < m - 1e-12
            if last and right >= precision * weight:
                best = m
        out.append(best)
    return out


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): spans is an array of (start, kind, end, base) by start, then kind; kind indexes KINDS."""
    found = materialize(_tables(docs), "pii")

    def named(i: int) -> Column:
        return F.transform(KINDS[i], lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    base = F.concat(*map(named, range(BASE)))
    rows = found.withColumn("base", base)
    # a candidate that covers a base span asks whether there is another one near; the others ask for any
    names = ["start", "end", "right", *(n for n in FEATURES if n != "near")]

    def near(s: Column) -> Column:
        of_any = lambda test: reduce(or_, (test(s, F.col(k)) for k in KINDS[:BASE])).cast("int")
        return F.struct(*(s[n].alias(n) for n in names), of_any(_near).alias("near"), of_any(_covers).alias("covers"))

    rows = rows.withColumn("cands", F.transform("cands", near))
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(2)).cast("int")
    counts = rows.where(F.size("cands") > 0).select(held_out.alias("fold"), F.explode("cands").alias("c"))
    counts = counts.groupBy("fold", *(F.col(f"c.{n}").alias(n) for n in FEATURES)).agg(F.count(F.lit(1)).alias("w"), F.sum(F.greatest("c.covers", "c.right")).alias("p"))
    # at most twice the product of the sizes in FEATURES, whatever the corpus
    learned: tuple[list, list] = ([], [])
    for r in counts.orderBy("fold", *FEATURES).collect():
        learned[r["fold"]].append(({n: r[n] for n in FEATURES}, float(r["w"]), float(r["p"])))
    start, trees = boost(learned[0])
    limits = thresholds(learned[1], [start + sum(_run(t, x) for t in trees) for x, _, _ in learned[1]])
    margin = " + ".join([repr(start) + "D", *(_sql(t, "c") for t in trees)])
    chosen = " OR ".join(f"(c.gen = {g} AND {margin} >= {limit - 1e-9!r}D)" for g, limit in enumerate(limits) if limit < float("inf")) or "false"
    extra = F.expr(f"transform(filter(cands, c -> c.covers = 0 AND ({chosen})), c -> named_struct('start', c.start, 'kind', {BASE} + c.gen, 'end', c.end))")
    flagged = lambda arr, flag: F.transform(arr, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(flag).alias("base")))
    return rows.select("doc_id", F.array_sort(F.concat(flagged(F.col("base"), True), flagged(extra, False))).alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """The op4 query."""
    names = F.array(*map(F.lit, KINDS))
    joined = lambda arr: F.array_join(F.transform(arr, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])]
    base = F.filter("spans", lambda s: s["base"])
    return find(docs).select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
