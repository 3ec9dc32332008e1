"""BPE encoding and decoding of whole texts (operator 2).

Method: a segment tree over the ranks of adjacent symbol pairs (:class:`veldra.llm.tokens.SegmentTreeBPE`); its
root is the leftmost pair of lowest rank, and each merge is a logarithmic point update.

Cases: a null or empty text has no ids and decodes to the empty string; strings of special tokens in a text are
those tokens; repeated rows and null ids are encoded row by row; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_texts
from .tokens import LibraryEncoder, SegmentTreeWordEncoder, vocabulary_path

#: Rows of one output batch: bounds what a worker holds besides the batch it reads.
OUT_ROWS = 256
#: Cache generations of the byte-level vocabulary, which keeps capitals apart: 650,000 entries, some 450 MB a worker.
BYTE_ENTRIES = 650_000
#: The word vocabulary's: the pipeline's workers hold them beside what its other stages left.
WORD_ENTRIES = 250_000
_ENCODERS: dict[tuple, object] = {}


def encoder(kind: str, path: str):
    """One encoder per worker process, so its cache outlives a task."""
    make = {"tree": SegmentTreeWordEncoder, "word": lambda p: LibraryEncoder(p, False, WORD_ENTRIES), "byte": lambda p: LibraryEncoder(p, True, BYTE_ENTRIES)}
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = make[kind](path)
    return _ENCODERS[kind, path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids as little-endian unsigned 32-bit integers in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder("tree", path)
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                ids = list(own.encode(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["key", "ids"])

    return whole_texts(docs).select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "key long, ids binary")


def decode(encoded: DataFrame, path: str, special: bool = True) -> DataFrame:
    """(key, ids, text) from (key, ids).  ``special=False`` leaves special tokens out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder("tree", path).bpe
        dropped = set() if special else {*own.specials.values()}
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                texts = []
                for packed in part.column(1).to_pylist():
                    ids = memoryview(packed).cast("I").tolist() if packed else []
                    texts.append(own.decode([i for i in ids if i not in dropped] if dropped else ids))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["key", "ids", "text"])

    return encoded.select("key", "ids").mapInArrow(run, "key long, ids binary, text string")


def digests(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """The op2 query: per document the count and digest of its ids and the digest of the decoded text."""
    path = vocabulary_path(vocabulary)
    back = decode(encode(docs, path), path)
    return back.select(
        F.col("key").alias("doc_id"),
        F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )
