"""run() against a brute-force version of each stage on a fixture that every stage changes."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from veldra.llm import secrets
from veldra.llm.tokens import vocabulary_path


def fixture(spark, folder):
    rng = random.Random(11)
    words = ["w" + "".join(rng.choice("aeioustrn") for _ in range(5)) for _ in range(800)]
    rows, labels, toxic, copies = [], [], set(), set()
    for i in range(260):
        own = [rng.choice(words) for _ in range(rng.randint(30, 80))]
        if i % 4 == 0:
            own[5:5] = ["grobbel", "snorfik", "grobbel"]
            toxic.add(i)
        if i % 10 == 3:
            own.append('password = "hunter22xyz"')
        if i % 13 == 6 and i > 13 and i - 13 not in toxic and i not in toxic:
            own = rows[i - 13][1].split(" ")[:-1]
            copies.add(i)
        rows.append((i, " ".join(own), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i in toxic)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "long " * 5000, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, toxic


def test_run(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows, toxic = fixture(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-dedup", "secret-scan", "packing"]
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - toxic

    clean = [r for r in rows if r[0] not in toxic]
    sets = {}
    for key, text, *_ in clean:
        w = (text or "").encode().lower().split()
        sets[key] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    want = {}
    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    for key, text, *_ in clean:
        if root[key] != key:
            continue
        base, linked = secrets.find(text)
        ids = library.encode(secrets._masked(text or "", base + linked), add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            cut = np.array(ids[at : at + 2048], "<u4")
            want[key, n] = (at, len(cut), zlib.crc32(cut.tobytes()))
    assert len({k for k, _ in want}) < len(clean)
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.05 * sum(v[1] for v in want.values()) / 2048 + 1
