"""Near-duplicate documents (operator 10) by HyperMinHash.

A text is the set of its distinct five-word shingles, kept as 64-bit hashes.  The hash range is cut into
``REGISTERS`` equal buckets; a register holds, for the smallest hash of its bucket, the count of leading zeros and
the next ten bits (16 bits in all).  For banding, an empty register borrows from the first full one on a random walk
of its own (the same for all texts), else short texts would meet in bands with a single shingle.  Five registers
make a band.  Texts that agree on a band are candidates; the
share of equal registers, corrected for chance collisions, estimates the Jaccard similarity; candidates that may
reach the threshold are confirmed on their full sets.

With 51 bands of five registers a pair at the threshold of 0.75 shares no band with a probability of
(1 - 0.75^5)^51, about 1e-6, and less above it.

Skew.  Texts with equal sets are one node.  Buckets are never expanded into pairs: in each of ``STAR_ROUNDS`` one
member of a bucket, the one with the most company in all its buckets, is compared with those members that aren't
yet in its component, then leaves the bucket; so the copies of one original meet the original first.  Buckets that
still hold several components are finished in blocks of ``BLOCK`` members: the members outside the bucket's largest
component meet each other and that component, one small task for each pair of blocks, which only looks at pairs
from different components and returns a spanning set of the links it finds.  So no link between components is
lost, whatever the size of a bucket.

Cases: null and empty texts, and texts of white space, have no shingles and are linked with nothing; fewer than
five words are one shingle; rows that share a doc_id are judged by their own texts; a null doc_id never names a
component (its row takes the component of its text, null if no other row has that text); other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import anti, discard, materialize, mix64, semi, sliced, thin, whole_texts
from .components import contract

WORDS = 5
REGISTERS, ROWS = 255, 5
STAR_ROUNDS = 3
BLOCK = 600
#: Members of a bucket that one task is meant to hold.
SPLIT = 2000
#: One key of so many is finished first; most buckets are done after that.
FIRST = 8
#: Standard errors below the threshold at which an estimate is still confirmed.
SLACK = 6.0
_FACTORS = mix64(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)
_BANDS = mix64(np.arange(7001, 7001 + REGISTERS // ROWS, dtype=np.uint64))
_PLACES = mix64(np.arange(9001, 9001 + ROWS, dtype=np.uint64)) | np.uint64(1)
#: For each register the order in which it asks the others.
_WALKS = np.argsort(mix64(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(1 << 40)).reshape(REGISTERS, -1), axis=1).astype(np.int64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles.  bytes.lower and bytes.split know just ASCII letters and white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < WORDS:
        hashes = np.concatenate([hashes, np.full(WORDS - len(words), len(words), np.uint64)])
    n = len(hashes) - WORDS + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(WORDS):
        mixed += hashes[i : i + n] * _FACTORS[i]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mix64(mixed))


def registers(hashes: np.ndarray) -> np.ndarray:
    """uint16 registers, 0 where a bucket is empty.  ``hashes`` ascend, so a bucket's first is its smallest."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(hashes):
        # bucket = floor(h * m / 2^64), from two 32-bit halves; the wrapped product is the place inside the bucket
        m = np.uint64(REGISTERS)
        bucket = ((hashes >> np.uint64(32)) * m + (((hashes & np.uint64(0xFFFFFFFF)) * m) >> np.uint64(32))) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        fraction, exponent = np.frexp(((hashes[first] * m) >> np.uint64(11)).astype(np.float64))
        zeros = np.clip(53 - exponent, 0, 62)
        mantissa = np.where(fraction > 0, (2 * fraction - 1) * 1024, 0).astype(np.int64)
        out[bucket[first].astype(np.int64)] = (zeros * 1024 + (1023 - mantissa) + 1).astype(np.uint16)
    return out


def densify(sketch: np.ndarray) -> np.ndarray:
    """Rows of registers with the empty ones filled from full ones."""
    out = sketch.copy()
    row, at = np.nonzero(sketch == 0)
    for step in range(REGISTERS):
        if not len(row):
            break
        found = sketch[row, _WALKS[at, step]]
        full = found > 0
        out[row[full], at[full]] = found[full]
        row, at = row[~full], at[~full]
    return out


def band_keys(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every band, from rows of registers of which none is all empty."""
    bands = densify(sketch).reshape(len(sketch), -1, ROWS)
    keys = mix64((bands.astype(np.uint64) * _PLACES).sum(axis=2, dtype=np.uint64) ^ _BANDS)
    return np.repeat(np.arange(len(sketch)), keys.shape[1]), keys.ravel().view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimate, registers it rests on), corrected for registers that agree by chance.

    The minima of independent buckets at rates x and y fall into one of 2^10 parts of a binade with a
    probability of 2^-10 / (2 ln 2) * xy / (x + y)^2.
    """
    used = ((a > 0) | (b > 0)).sum(-1)
    same = ((a == b) & (a > 0)).sum(-1)
    x, y = size_a.astype(float), size_b.astype(float)
    chance = x * y / np.maximum(x + y, 1) ** 2 / (2 * np.log(2)) / 1024
    return np.maximum(same / np.maximum(used, 1) - chance, 0) / (1 - chance), used


def may_link(a, b, size_a, size_b, percent: int) -> np.ndarray:
    guess, used = estimate(a, b, size_a, size_b)
    t = percent / 100
    sizes = 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
    return sizes & (guess >= t - SLACK * np.sqrt(t * (1 - t) / np.maximum(used, 1)))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exactly: 100 |A and B| >= percent |A or B|."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, sketch): node is a 128-bit digest of the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            counts, nodes, kept = [], [], []
            for text in part.column(1).to_pylist():
                own = shingle_set(text)
                counts.append(len(own))
                nodes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                kept.append(registers(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(kept, pa.binary())], ["doc_id", "n_shingles", "node", "sketch"])

    rows = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, node binary, sketch binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """(key, nid) of every band of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 2000):
            row, keys = band_keys(_sketch_rows(part.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0).take(pa.array(row))], ["key", "nid"])

    return nodes.select("nid", "sketch").mapInArrow(run, "key long, nid long")


def _node_of(text: str | None) -> bytes | None:
    own = shingle_set(text)
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def _candidate_texts(docs: DataFrame, wanted: DataFrame, check: bool) -> DataFrame:
    """(nid, text) of the wanted (nid, node, rep), one row each.  ``check``: an id may stand for several texts; the
    digest tells which one is meant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_node_of(t) == n for n, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    found = wanted.select("nid", "node", "rep").join(thin(texts, "rep", wanted), "rep").select("nid", "node", "text")
    if check:
        found = found.mapInArrow(run, "nid long, node binary, text string")
    return found.select("nid", "text").dropDuplicates(["nid"])


def _sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _of_center(table: DataFrame) -> DataFrame:
    return table.select(*(F.col(c).alias("center" if c == "nid" else f"c_{c}") for c in table.columns))


def _confirm(pairs: DataFrame, small: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (nid, center) that link: first by estimate, then, for what is left, on full sets."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _sketch_rows(batch.column("sketch")), _sketch_rows(batch.column("c_sketch"))
            keep = may_link(a, b, batch.column("n").to_numpy(), batch.column("c_n").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("nid", "center")], ["nid", "center"])

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, center_set = None, np.empty(0, np.uint64)
        for part in sliced(batches):
            keep = []
            for center, text, other in zip(*(part.column(c).to_pylist() for c in ("center", "text", "c_text")), strict=True):
                if center != last:  # rows of a center follow each other
                    last, center_set = center, shingle_set(other)
                keep.append(linked(shingle_set(text), center_set, percent))
            yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(keep, pa.bool_())) for c in ("nid", "center")], ["nid", "center"])

    near_ = pairs.join(small, "nid").join(_of_center(small), "center").mapInArrow(near, "nid long, center long")
    likely = materialize(near_, "likely")
    # one filter serves both sides
    needed = thin(texts, "nid", likely.select("nid").unionByName(likely.select(F.col("center").alias("nid"))))
    sure_ = likely.join(needed, "nid").join(_of_center(needed), "center").mapInArrow(sure, "nid long, center long")
    links = materialize(sure_, "links")
    discard(likely)
    return links


def _finish(held: DataFrame, small: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links between the components of buckets (key, nid, label) that still hold several, block by block.  Blocks look
    at sketches first; only members that may link there get their texts."""
    parts = held.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    sized = parts.groupBy("key").agg(F.sum("size").alias("all"), F.max(F.struct("size", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    ceil = "cast(ceil(({}) / {}) as int)"
    sized = sized.select("key", F.col("main.label").alias("main"), F.expr(ceil.format("main.size", BLOCK)).alias("mains"), F.expr(ceil.format("all - main.size", BLOCK)).alias("others"))
    dealt = held.join(sized, "key").withColumn("is_main", F.col("label") == F.col("main"))
    # blocks 0 to others - 1 hold the other components, those from there on the largest one
    of = "cast(pmod(xxhash64(nid, key), {}) as int)"
    dealt = dealt.withColumn("own", F.expr(f"if(is_main, others + {of.format('mains')}, {of.format('others')})"))
    dealt = dealt.withColumn("other", F.explode(F.expr("if(is_main, sequence(0, others - 1), sequence(0, others + mains - 1))")))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "nid", "label")

    def partners(table: pa.Table, label: np.ndarray):
        """For each row the later rows of other components and, where two blocks meet, of the other block that may link."""
        n, own = table.column("n").to_numpy(), table.column("own").to_numpy()
        sketch, split, rows = _sketch_rows(table.column("sketch")), own.min() != own.max(), np.arange(len(n))
        for x in rows:
            apart = np.flatnonzero((label != label[x]) & (rows > x) & ((own != own[x]) | (not split)))
            if len(apart):
                yield x, apart[may_link(sketch[x], sketch[apart], np.full(len(apart), n[x]), n[apart], percent)]

    def probe(table: pa.Table) -> pa.Table:
        keep = np.zeros(table.num_rows, bool)
        for x, found in partners(table, table.column("label").to_numpy()):
            if len(found):
                keep[x] = keep[found] = True
        return table.filter(pa.array(keep)).select(["key", "i", "j", "own", "nid", "label", "n", "sketch"])

    def run(table: pa.Table) -> pa.Table:
        label, said, nids, sets, a, b = table.column("label").to_numpy().copy(), table.column("text").to_pylist(), table.column("nid").to_pylist(), {}, [], []

        def members(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = shingle_set(said[x])
            return sets[x]

        for x, found in partners(table, label):
            for y in found.tolist():
                if label[x] != label[y] and linked(members(x), members(y), percent):
                    a.append(nids[x])
                    b.append(nids[y])
                    label[label == label[y]] = label[x]
        return pa.table({"nid": pa.array(a, pa.int64()), "center": pa.array(b, pa.int64())})

    columns = ["key", "i", "j", "own", "nid", "label", "n", "sketch"]
    sketched = dealt.join(small, "nid").select(*columns).groupBy("key", "i", "j")
    likely = materialize(sketched.applyInArrow(probe, "key long, i int, j int, own int, nid long, label long, n long, sketch binary"), "likely")
    said = likely.join(thin(texts, "nid", likely), "nid").select(*columns, "text")
    links = materialize(said.groupBy("key", "i", "j").applyInArrow(run, "nid long, center long"), "links")
    discard(likely)
    return links


def judged(docs: DataFrame, percent: int = 75) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, n_shingles, node, root, component_id, kept) of each document, and the written tables it rests on.
    ``root`` tells components apart that have one name, as texts of one id may be unlike."""
    rows = materialize(sketches(docs), "sketches")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes.where("rep is not null").withColumn("nid", F.monotonically_increasing_id()), "nodes")
    several = not rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").isEmpty()
    bands = _bands(nodes)
    crowded = materialize(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "crowded")
    # a large bucket is dealt to several places, wherever its members meet one row of its own
    salted = "1 + cast(size div {} as int) AS parts".format(SPLIT)
    buckets = thin(bands, "key", crowded).join(crowded, "key").selectExpr("key", "nid", "size", salted)
    written = buckets = materialize(buckets.withColumn("salt", F.expr("cast(pmod(xxhash64(nid), parts) as int)")), "buckets")
    discard(crowded)
    company = buckets.groupBy("nid").agg(F.sum("size").alias("company"))
    labels = materialize(company.select("nid", F.col("nid").alias("label"), "company"), "labels")
    # the rounds below only ever join nodes that share a bucket
    sharing = materialize(semi(nodes, "nid", labels), "sharing")
    texts = materialize(_candidate_texts(docs, sharing, several), "texts")
    small = sharing.select("nid", "n", "sketch")

    def merge(links: DataFrame, labels: DataFrame) -> DataFrame:
        a, b = labels.select("nid", F.col("label").alias("a")), labels.select(F.col("nid").alias("center"), F.col("label").alias("b"))
        moves = contract(links.join(a, "nid").join(b, "center").select("a", "b"))
        moved = labels.join(moves.withColumnRenamed("old", "label"), "label", "left")
        merged = materialize(moved.select("nid", F.coalesce("new", "label").alias("label"), "company"), "labels")
        discard(links, moves, labels)
        return merged

    for _ in range(STAR_ROUNDS):
        held = buckets.join(labels, "nid")
        lead = F.max(F.struct("company", F.xxhash64("nid").alias("h"), "nid", "label")).alias("lead")
        leads = held.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("parts").alias("parts"), lead).where("lo <> hi")
        leads = leads.select("key", F.explode(F.expr("sequence(0, parts - 1)")).alias("salt"), F.col("lead.nid").alias("center"), F.col("lead.label").alias("c_label"))
        met = held.join(leads, ["key", "salt"]).where("nid <> center")
        open_ = materialize(met.select("key", "nid", "size", "parts", "salt", "label", "center", "c_label"), "open")
        pairs = open_.where("label <> c_label").select("nid", "center").distinct()
        labels = merge(_confirm(pairs, small, texts, percent), labels)
        discard(written)
        written, buckets = open_, open_.select("key", "nid", "size", "parts", "salt")
    for part in (f"pmod(key, {FIRST}) = 0", f"pmod(key, {FIRST}) <> 0"):
        rest = materialize(buckets.where(part).join(labels, "nid").select("key", "nid", "label"), "rest")
        labels = merge(_finish(rest, small, texts, percent), labels)
        discard(rest)

    known = sharing.select("nid", "node", "rep").join(labels.select("nid", "label"), "nid")
    names = known.groupBy("label").agg(F.min("rep").alias("name"))
    moved = known.join(names, "label").where("name <> rep or nid <> label").select("node", "name", "label")
    named = nodes.select("node", "rep", "nid").join(moved, "node", "left").select("node", F.coalesce("name", "rep").alias("named"), F.coalesce("label", "nid").alias("root"))
    named = materialize(named, "named")
    discard(sharing, texts, labels, written, nodes)
    judged = rows.where("node is not null").join(named, "node", "left").select("doc_id", "n_shingles", "node", "root", F.col("named").alias("component_id"))
    judged = judged.unionByName(rows.where("node is null").select("doc_id", "n_shingles", "node", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id")))
    return judged.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), [rows, named]


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each document."""
    return judged(docs, percent)[0].select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents that stay: of each component one row, of the smallest doc_id.

    Rows without an id, and rows whose id occurs more than once, are judged by their texts: an id loses just those of
    its texts that are copies.  A text that occurs under null ids alone stays once; of rows that agree in id and text
    one stays."""
    found, under = judged(docs, percent)
    found = materialize(found, "near")
    discard(*under)
    often = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    gone = found.where("not kept and doc_id is not null").select("doc_id").distinct()
    special = materialize(often.unionByName(found.where("doc_id is null").select("doc_id").limit(1)), "special")
    if special.isEmpty():
        return anti(docs, "doc_id", gone)
    plain = anti(anti(docs, "doc_id", special).where("doc_id is not null"), "doc_id", gone)

    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = pa.array([_node_of(t) for t in batch.column(names.index("text")).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], [*names, "__node"])

    picked = semi(docs, "doc_id", special).unionByName(docs.where("doc_id is null"))
    own = picked.mapInArrow(run, f"{fields}, __node binary")
    verdict = found.select(F.col("doc_id").alias("__doc"), F.col("node").alias("__set"), F.col("root").alias("__root"), F.col("component_id").alias("__component"), F.col("kept").alias("__kept")).distinct()
    both = own.join(verdict, F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("__node").eqNullSafe(F.col("__set")))
    stay = both.where("__kept or (doc_id is null and __component is null)")
    # a component has one row; texts without shingles are told apart by id and text
    group = F.when(F.col("__node").isNull(), F.concat_ws(":", F.lit("t"), "doc_id", "text")).otherwise(F.coalesce(F.concat(F.lit("c"), F.col("__root").cast("string")), F.hex("__node")))
    return plain.unionByName(stay.withColumn("__group", group).dropDuplicates(["__group"]).select(*names))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r
)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(reach.r) AS component_id, d.doc_id = min(reach.r) AS kept
FROM documents d JOIN reach ON reach.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
