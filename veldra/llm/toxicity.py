"""Toxicity (operator 8).

Method: a lexicon of terms and stems is learned from labelled rows and kept in a trie.  The trie is intersected
with Levenshtein automata, and the product is determinised as words are read: a state is a set of (trie node,
edits so far), a dead state ends the word after a letter or two, and states are shared by all words.  Terms of 5
letters allow one edit, of 9 letters two; stems, and terms with several ordinary words in reach, must match
exactly.  As labelled rows may hold no misspellings, each toxic example also teaches with its terms misspelled.  Each hit is weighed in a window of words:
quotation marks around it and verbs of speech before it speak for a quotation, further hits near it for abuse.  A
logistic model over these counts gives the score.

Labels are learned from rows only whose crc32(doc_id as text) mod 5 is not 0, and from at most ``SAMPLE`` of them
(those of the smallest hash).  Of these, examples of one label that share the smallest hash of their shingles count
once, so that a passage copied many times doesn't look telling; a pair of unlike examples meets that fate only as
often as it shares shingles.  The lexicon has at most ``TERMS`` terms and stems, the strongest; it, the exceptions
and the model are a few kilobytes.  Scoring is one pass
over whole texts without a shuffle.

Cases: null and empty texts score as texts without hits; null labels and labels without a document teach nothing;
repeated labels count once (toxic wins); without toxic examples every score is 0; repeated rows and null ids are
scored row by row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, sliced, whole_texts
from .near_dedup import shingle_set

#: At most so many labelled rows teach the model.
SAMPLE = 20_000
#: A term must occur in this share of toxic examples (and in three), be this many times likelier there, and its
#: log-likelihood ratio must rule out chance among some millions of candidates.  At most TERMS are kept.
SUPPORT, LIFT, RATIO, TERMS = 0.01, 4.0, 40.0, 300
STEMS = range(4, 9)
WINDOW = 8
#: Ordinary words that may come close to a term that allows edits.
NEIGHBOURS = 2
#: Words that introduce speech, and quotation marks.
SPEECH = frozenset("said says wrote quoted quote called term word titled reported".split())
QUOTES = "\"'“”„«»‘’"
_WORD = re.compile(r"[^\W_]+")
_CLEAN, _EXACT, _STEM, _FUZZY = 0, 1, 2, 3


def allowed(term: str) -> int:
    return 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0


class Automaton:
    """Lexicon trie x Levenshtein automata, determinised lazily."""

    LIMIT = 200_000

    def __init__(self, terms: list[str], stems: list[str], strict: frozenset[str] = frozenset()):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        self.stems: set[int] = set()
        self.budget: list[int] = [0]
        for term in terms:
            edits = 0 if term in strict else allowed(term)
            self.ends[self._insert(term, edits)] = edits
        for stem in stems:
            self.stems.add(self._insert(stem, 0))
        self.reset()

    def _insert(self, word: str, edits: int) -> int:
        node = 0
        self.budget[0] = max(self.budget[0], edits)
        for c in word:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.budget.append(0)
            node = self.children[node][c]
            self.budget[node] = max(self.budget[node], edits)
        return node

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._close({(0, 0)}))

    def _close(self, pairs: set[tuple[int, int]]) -> frozenset:
        """Adds what skipping letters of a term reaches."""
        todo, best = list(pairs), {}
        for node, edits in pairs:
            best[node] = min(edits, best.get(node, 9))
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits + 1 <= self.budget[child] and edits + 1 < best.get(child, 9):
                    best[child] = edits + 1
                    todo.append((child, edits + 1))
        return frozenset(best.items())

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.ids:
            self.ids[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
        return self.ids[pairs]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, edits in self.sets[state]:
            for letter, child in self.children[node].items():
                cost = edits + (letter != c)
                if cost <= self.budget[child]:
                    out[child] = min(cost, out.get(child, 9))
            if edits + 1 <= self.budget[node]:
                out[node] = min(edits + 1, out.get(node, 9))
        target = self._state(self._close(set(out.items())))
        self.moves[state][c] = target
        return target

    def match(self, word: str) -> int:
        """_EXACT, _STEM, _FUZZY or _CLEAN."""
        if len(self.sets) > self.LIMIT:
            self.reset()
        state, stem, moves, dead = self.start, False, self.moves, self.dead
        for c in word:
            nxt = moves[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state == dead:
                break
            if self.stems and not stem:
                stem = any(e == 0 and n in self.stems for n, e in self.sets[state])
        edits = [e for n, e in self.sets[state] if e <= self.ends.get(n, -1)]
        if edits and min(edits) == 0:
            return _EXACT
        return _STEM if stem else _FUZZY if edits else _CLEAN


class Matcher(dict):
    """Chunk of text -> kind of hit, remembered; words seen in clean examples are no misspellings."""

    LIMIT = 150_000

    def __init__(self, terms: list[str], stems: list[str], known: frozenset[str] = frozenset(), strict: frozenset[str] = frozenset()):
        super().__init__()
        self.automaton, self.known = Automaton(terms, stems, strict), known

    def word(self, word: str) -> int:
        kind = self.automaton.match(word)
        return _CLEAN if kind == _FUZZY and word in self.known else kind

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        kinds = [k for w in _WORD.findall(chunk) if (k := self.word(w))]
        kind = min(kinds) if kinds else _CLEAN
        if len(chunk) <= 64:
            self[chunk] = kind
        return kind


def features(text: str | None, matcher: Matcher) -> list[float]:
    """Counts of hits by kind, hits in quotation, hits near others, and the share of words that are hits."""
    chunks = text.lower().split() if text else []
    kinds = bytes(map(matcher.__getitem__, chunks))
    hits = len(kinds) - kinds.count(0)
    if not hits:
        return [0.0] * 6
    at = [i for i, k in enumerate(kinds) if k]
    quoted = crowded = 0
    for n, i in enumerate(at):
        before, after = chunks[max(0, i - WINDOW) : i], chunks[i + 1 : i + 1 + WINDOW]
        opened = chunks[i][0] in QUOTES or any(c[0] in QUOTES for c in before)
        closed = chunks[i].rstrip(".,;:!?")[-1:] in QUOTES or any(c.rstrip(".,;:!?")[-1:] in QUOTES for c in after)
        quoted += opened and closed or any(c.strip(".,;:!?") in SPEECH for c in before[-3:]) and opened
        crowded += (n > 0 and i - at[n - 1] <= WINDOW) or (n + 1 < len(at) and at[n + 1] - i <= WINDOW)
    exact, stems, fuzzy = kinds.count(_EXACT), kinds.count(_STEM), kinds.count(_FUZZY)
    return [float(np.log1p(x)) for x in (exact, stems, fuzzy, quoted, crowded)] + [min(1.0, 20.0 * (hits - quoted) / len(kinds))]


def _terms_of(text: str | None) -> set[str]:
    words = set(_WORD.findall(text.lower())) if text else set()
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _count_terms(sample: DataFrame, toxic: int, only: frozenset[str] | None) -> DataFrame:
    """(term, n): examples of one label that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                own = _terms_of(text)
                counts.update(own if only is None else own & only)
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    return sample.where(F.col("toxic") == toxic).select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def likelihood_ratio(a: float, b: float, n: float, m: float) -> float:
    """G squared of a of n against b of m."""
    total = 0.0
    for seen, size in ((a, n), (b, m)):
        for x, p in ((seen, (a + b) / (n + m)), (size - seen, 1 - (a + b) / (n + m))):
            if x > 0:
                total += 2 * x * np.log(x / (size * p))
    return total


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> tuple[list[str], list[str]]:
    """(whole words, stems) from the counts of examples, strongest first; stems only where several words share them."""
    strong = {}
    for term, n in toxic.items():
        if (n + 0.5) / n_toxic >= LIFT * (clean.get(term, 0) + 0.5) / n_clean:
            ratio = likelihood_ratio(n, clean.get(term, 0), n_toxic, n_clean)
            if ratio >= RATIO:
                strong[term] = ratio
    words: list[str] = []
    stems: list[str] = []
    for term in sorted(strong, key=lambda t: (-strong[t], t))[: 4 * TERMS]:
        root = term.rstrip("*")
        if any(root.startswith(s) or s.startswith(root) for s in stems) or len(words) + len(stems) >= TERMS:
            continue
        if term == root:
            words.append(term)
        elif max((toxic[w] for w in strong if w[-1] != "*" and w.startswith(root)), default=0) < 0.6 * toxic[term]:
            stems.append(root)
            words = [w for w in words if not w.startswith(root)]
    return sorted(words), sorted(stems)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Newton's method with a small ridge; the last weight is the intercept."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _without_copies(examples: DataFrame) -> DataFrame:
    """One example of each label and smallest shingle hash: near copies would make their every word look telling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [int(s[0]) >> 1 if len(s := shingle_set(t)) else -1 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], ["text", "toxic", "key"])

    return examples.mapInArrow(run, "text string, toxic int, key long").groupBy("toxic", "key").agg(F.min("text").alias("text")).select("text", "toxic")


def crowded_terms(terms: list[str], known: frozenset[str]) -> frozenset[str]:
    """Terms that more than ``NEIGHBOURS`` ordinary words come close to."""
    alone = {t: Automaton([t], []) for t in terms if allowed(t)}
    return frozenset(t for t, automaton in alone.items() if sum(automaton.match(w) == _FUZZY for w in known) > NEIGHBOURS)


Model = tuple[list[str], list[str], frozenset[str], frozenset[str], np.ndarray | None]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """(terms, stems, known clean words, strict terms, weights); weights are None without examples of both labels."""
    spark = docs.sparkSession
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    own = labels.where("doc_id is not null and toxic is not null").where(~held_out).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    if not chosen:
        return [], [], frozenset(), frozenset(), None
    # at most ``sample`` pairs of numbers: a bounded broadcast that keeps the texts where they are
    picked = F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in chosen], "own long, toxic int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    examples = materialize(_without_copies(texts.join(picked, F.col("doc_id") == F.col("own")).select("text", "toxic")), "examples")
    sizes = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        discard(examples)
        return [], [], frozenset(), frozenset(), None
    least = max(3, int(SUPPORT * sizes[1]))
    toxic = {r["term"]: r["n"] for r in _count_terms(examples, 1, None).where(F.col("n") >= least).collect()}
    clean = {r["term"]: r["n"] for r in _count_terms(examples, 0, frozenset(toxic)).collect()}
    terms, stems = choose(toxic, clean, sizes[1], sizes[0])
    matcher = Matcher(terms, stems)

    def near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = {w for t in batch.column(0).to_pylist() if t for w in _WORD.findall(t.lower())}
            yield pa.RecordBatch.from_pydict({"word": pa.array([w for w in words if matcher.word(w) == _FUZZY], pa.string())})

    # only words within the edits of a term: bounded by the lexicon
    known = frozenset(r["word"] for r in examples.where("toxic = 0").select("text").mapInArrow(near_words, "word string").distinct().collect())
    strict = crowded_terms(terms, known)
    matcher = Matcher(terms, stems, known, strict)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_pylist()
            found = [features(t, matcher) for t in batch.column(0).to_pylist()]
            # the same example with its exact terms misspelled
            bent = [[0.0, x[1], float(np.log1p(np.expm1(x[0]) + np.expm1(x[2]))), *x[3:]] for x, y in zip(found, labels, strict=True) if y and x[0]]
            yield pa.RecordBatch.from_arrays([pa.array(found + bent, pa.list_(pa.float64())), pa.array(labels + [1] * len(bent), pa.int32())], ["x", "y"])

    # at most twice the rows of the sample, six numbers each
    got = examples.select("text", "toxic").mapInArrow(rows, "x array<double>, y int").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    discard(examples)
    x = np.repeat(np.array([r["x"] for r in got]), [r["n"] for r in got], axis=0)
    y = np.repeat(np.array([r["y"] for r in got], float), [r["n"] for r in got])
    return terms, stems, known, strict, fit_logistic(x, y)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The op8 query: (doc_id, held_out, score, predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*shared.value[:4])
        for part in sliced(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(part.column(1).to_pylist(), matcher, shared.value[4]), pa.float64())], ["doc_id", "score"])

    rows = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def scores(texts: list[str | None], matcher: Matcher, weights: np.ndarray | None) -> np.ndarray:
    if weights is None or not texts:
        return np.zeros(len(texts))
    x = np.array([features(t, matcher) for t in texts])
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The pipeline's stage: documents whose score is below 0.5, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*shared.value[:4])
        for part in sliced(batches):
            keep = scores(part.column(part.schema.get_field_index("text")).to_pylist(), matcher, shared.value[4]) < 0.5
            yield part.filter(pa.array(keep))

    return whole_texts(docs).mapInArrow(run, docs.schema)
