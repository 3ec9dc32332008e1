"""Secret scans (operator 7): plain patterns plus multipart credential linking.

Plain (base) finds are reported as they are.  Besides, weak parts are generated: identifiers (``client_id = ...``),
secrets (assigned keys and tokens of high entropy) and endpoints (URLs, ``host = ...``).  An interval join within a
scope (a document, parts at most ``REACH`` code points apart, over both sorted lists) links parts; a weak
part is reported only where complementary parts co-occur: a secret with an identifier or an endpoint, and an
identifier or endpoint with a secret.  Base finds count as parts of their kind.

Cases: null and empty texts have no spans; repeated rows and null ids are scanned row by row; whole texts of any
length are scanned in linear time; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, whole_texts

KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
BASE = 3
#: Code points between two parts of one credential, and the least entropy of an unassigned secret in bits a character.
REACH, ENTROPY = 300, 3.6
MARK = "<SECRET>"

ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
IDENT = re.compile(r"""(?<![A-Za-z0-9])(?:client_?id|key_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""", re.IGNORECASE | re.ASCII)
KEY = re.compile(r"""(?:secret|private|access|auth)[A-Za-z_]{0,20}key["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_=-]{16,})""", re.IGNORECASE | re.ASCII)
DENSE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?:[a-z][a-z0-9+]{1,15}://[A-Za-z0-9.-]+(?::[0-9]+)?|(?<![A-Za-z])(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}(?::[0-9]+)?)""", re.ASCII)

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end), by start, then kind."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def _entropy(token: str) -> float:
    counts = Counter(token)
    return -sum(c / len(token) * math.log2(c / len(token)) for c in counts.values())


def weak_parts(text: str, base: list[Span]) -> list[Span]:
    """Candidates that count only beside a complement; none overlaps a base find."""
    taken = sorted((s, e) for s, _, e in base)
    starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def free(start: int, end: int) -> bool:
        i = bisect_left(starts, end) - 1
        return i < 0 or ends[i] <= start

    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [(m.start(1), 3, m.end(1)) for m in IDENT.finditer(text) if free(m.start(1), m.end(1))]
        out += [(m.start(1), 4, m.end(1)) for m in KEY.finditer(text) if free(m.start(1), m.end(1))]
        out += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text) if free(m.start(), m.end())]
    if out or base:
        known = {(s, e) for s, _, e in out}
        for m in DENSE.finditer(text):
            token = m[0]
            if (m.start(), m.end()) in known or not free(m.start(), m.end()):
                continue
            if any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and _entropy(token) >= ENTROPY:
                out.append((m.start(), 4, m.end()))
    return sorted(set(out))


def link(base: list[Span], weak: list[Span]) -> list[Span]:
    """The weak parts with a complement in reach: those of an interval join, found without making its pairs.

    In start order a complement that begins no later reaches a part if the largest end so far does; of those that
    begin later the first decides."""
    secret = sorted([(s, e) for s, k, e in base if k in (0, 2)] + [(s, e) for s, k, e in weak if k == 4])
    other = sorted([(s, e) for s, k, e in base if k == 1] + [(s, e) for s, k, e in weak if k in (3, 5)])

    def near(span: tuple[int, int], side: list[tuple[int, int]], ends: list[int]) -> bool:
        before, after = bisect_left(side, span), bisect_right(side, span)
        return before > 0 and span[0] - ends[before - 1] <= REACH or after < len(side) and side[after][0] - span[1] <= REACH

    secret_ends, other_ends = (list(accumulate((e for _, e in side), max)) for side in (secret, other))
    return [(s, k, e) for s, k, e in weak if (near((s, e), other, other_ends) if k == 4 else near((s, e), secret, secret_ends))]


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, linked spans) of one text."""
    if not text:
        return [], []
    base = base_spans(text)
    weak = weak_parts(text, base)
    return base, link(base, weak) if weak else []


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): spans is an array of (kind, start, end, base), by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in sliced(batches):
            found = []
            for text in batch.column(1).to_pylist():
                base, linked = find(text)
                found.append([{"kind": KINDS[k], "start": s, "end": e, "base": k < BASE} for s, k, e in sorted(base + linked)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    rows = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def digests(docs: DataFrame) -> DataFrame:
    """The op7 query."""
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS[:BASE]]
    return scan(docs).select(
        "doc_id", *counts, F.sha2(F.expr(joined.format("filter(spans, s -> s.base)")).cast("binary"), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: every document stays, each found span becomes ``MARK`` and n_chars follows the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            lengths = batch.column(batch.schema.get_field_index("n_chars")).to_pylist() if "n_chars" in batch.schema.names else None
            for i, text in enumerate(texts):
                base, linked = find(text)
                if base or linked:
                    texts[i] = _masked(text, base + linked)
                    if lengths:
                        lengths[i] = len(texts[i])
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["text"] = pa.array(texts, pa.string())
            if lengths is not None:
                columns["n_chars"] = pa.array(lengths, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_pydict(columns)

    return whole_texts(docs).mapInArrow(run, docs.schema)


def _masked(text: str, spans: list[Span]) -> str:
    out, last = [], 0
    for start, _, end in sorted(spans):
        if start >= last:
            out += [text[last:start], MARK]
        last = max(last, end)
    return "".join(out) + text[last:]


def linked_brute_force(base: list[Span], weak: list[Span]) -> list[Span]:
    """:func:`link` by all pairs (for tests)."""
    side = {0: "s", 2: "s", 4: "s", 1: "o", 3: "o", 5: "o"}
    parts = base + weak
    return [(s, k, e) for s, k, e in weak if any(side[k] != side[k2] and s2 - e <= REACH and s - e2 <= REACH for s2, k2, e2 in parts)]


def brute_force(text: str | None) -> tuple[str, str]:
    """The contract's digest string and its SHA-256, without the shortcuts above (for tests)."""
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return said, hashlib.sha256(said.encode()).hexdigest()
