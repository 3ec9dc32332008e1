import hashlib
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from veldra.llm import bpe, token_store
from veldra.llm.tokens import vocabulary_path


def test_mph_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 40000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        index = token_store.build_mph(keys)
        assert sorted(token_store.mph_slots(keys, *index).tolist()) == list(range(len(keys)))
        assert (token_store.keys_of(token_store.fingerprints(keys)) == keys).all()


def test_store_round_trip(spark, tmp_path, monkeypatch):
    rows = [(5, "b b b", 9), (None, "null key", 9), (3, None, 9), (3, "Again. And", 9), (-7, "", 9), (9, "é " * 3000, 9), (3, "Again. And", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, path, vocabulary_path("byte_bpe_50k.json"), "byte", 2)
    got = token_store.read_documents(spark, path).orderBy("start").collect()
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    crc = lambda t: zlib.crc32(np.array(ids(t), "<u4").tobytes())
    want = sorted(((-1e9 if k is None else k), len(ids(t)), crc(t)) for k, t, _ in rows)
    assert sorted(((-1e9 if r["doc_id"] is None else r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    keys = [-1e9 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(keys)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    found = token_store.lookup(spark, path, [5, 3, 4, 9]).collect()
    assert sorted((r["key"], tuple(r["ids"])) for r in found) == sorted((k, tuple(ids(t))) for k, t, _ in rows if k in (5, 3, 9))


def test_digests_of_an_empty_table_and_bpe(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.digests(empty).count() == 0 and bpe.digests(empty).count() == 0
    row = bpe.digests(spark.createDataFrame([(None, None), (1, "The END"), (1, "The END")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in row] == [0, 2, 2] and row[1] == row[2]
    encoded = bpe.encode(spark.createDataFrame([(1, "a<|endoftext|> b")], "doc_id long, text string"), vocabulary_path("word_bpe_49k.json"))
    back = bpe.decode(encoded, vocabulary_path("word_bpe_49k.json"), special=False).first()["text"]
    assert back == "a</w> b</w>"


def test_shards_reject_foreign_keys_and_take_wide_ids():
    wide = [np.array([70_000, 3], "<u4").tobytes(), np.array([1], "<u4").tobytes()]
    shard = token_store.Shard(token_store.pack_shard([None, 7], wide))
    assert shard.width == 4 and shard.ids(0).tolist() == [70_000, 3] and shard.ids(1).tolist() == [1]
    keys = np.arange(-500, 500) * 7919
    shard = token_store.Shard(token_store.pack_shard(keys.tolist(), [wide[1]] * len(keys)))
    assert (shard.find(keys)[1] == 1).all() and (shard.find(np.arange(1, 200_000, 7919 + 2))[1] == 0).all()


def test_a_keyed_read_opens_one_shard(spark, tmp_path, monkeypatch):
    """Row groups hold one shard each, with the range of its keys; a key that many rows share takes several shards."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(token_store, "SHARD_DOCS", 10)
    docs = spark.range(200).selectExpr("if(id < 60, 5, id) AS doc_id", "concat('text ', id) AS text")
    path = f"{tmp_path}/store"
    token_store.write_store(docs, f"file://{path}", vocabulary_path("byte_bpe_50k.json"), "byte", 2)
    groups = [pq.ParquetFile(f).metadata.row_group(g) for f in sorted((tmp_path / "store").glob("*.parquet")) for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert all(g.num_rows == 1 for g in groups) and len(groups) >= 20
    column = [c.split()[0] for c in token_store.SCHEMA.split(", ")].index
    holds = lambda k: sum(g.column(column("first_key")).statistics.min <= k <= g.column(column("last_key")).statistics.max for g in groups)
    assert holds(100) == 1 and holds(5) >= 6
    assert token_store.lookup(spark, f"file://{path}", [5]).count() == 60 and token_store.lookup(spark, f"file://{path}", [100, 7]).count() == 1


ODD = [*"ab Z.,;\n'_1\t\r\u0001\u0002\u001c\u001f\x85\xa0", " .", " , ", ". ", ".\n", "e\u0301", "\u0307", "\u0130", "\u03a3", "J\u030c", "\U0001f600", "\u0558", "\u1c89", "<|endoftext|>", "don't"]


def test_digests_equal_the_library(spark):
    """Both digests of op2 and the ids of op3 on texts with blanks before stops, control characters and marks."""
    rng = random.Random(11)
    texts = ["a , b", "hello . World", "end .\nNext", "a \u0001b", "\u0130.\n;", None, "", "x" * 5000, *("".join(rng.choices(ODD, k=rng.randint(1, 30))) for _ in range(1500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    word, byte = (Tokenizer.from_file(vocabulary_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    for i, text in enumerate(texts):
        ids = word.encode(text or "", add_special_tokens=False).ids
        back = word.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want, repr(text)
    at = 0
    for r in sorted(token_store.digests(docs).collect(), key=lambda r: r["doc_id"]):
        ids = [*byte.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(texts[r["doc_id"]])
        at += len(ids)
