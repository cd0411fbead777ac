"""Very long texts, samples and partitions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphfactor.llm import decontaminate, gif, licenses, neardup, quality, sample, scratch, substring, text, tokens

N = 700_000


@pytest.fixture(scope="module")
def long(spark):
    """A text of some 5 MB, one that shares 60 words of it, and a short one."""
    words = [f"w{i}" for i in range(N)]
    shared = words[350_000:350_060]
    rows = [(1, " ".join(words), "s"), (2, "first " + " ".join(shared) + " last", "s"), (3, "short", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), shared


def test_text_operators_take_very_long_texts(spark, long):
    table, shared = long
    cut = {r.doc_id: r for r in substring.dedup(table, 35).collect()}
    assert (cut[1].n_words, cut[1].n_removed, cut[2].kept_text, cut[3].n_removed) == (N, 60, "first last", 0) and [tuple(s) for s in cut[1].spans] == [(350_000, 350_060)]
    bench = spark.createDataFrame([("a", " ".join(shared[5:17])), ("b", "w699999")], "item_id string, text string")
    found = {r.doc_id: r for r in decontaminate.find(table, bench, 10).collect()}
    assert [tuple(s) for s in found[1].spans] == [(350_005, 350_017), (N - 1, N)] and found[1]["items"] == ["a", "b"] and found[2]["items"] == ["a"] and found[3].spans == []
    twice = table.union(table.select(F.col("doc_id") + 10, F.concat("text", F.lit(" end")), "source"))
    groups = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(twice, 3, 85, 100).collect()}
    assert groups[1] == (N - 2, 1) and groups[11] == (N - 1, 1) and groups[12][1] == 2 and groups[3] == (1, 3) and groups[13] == (1, 13)
    assert {r.doc_id: r.n_words for r in licenses.scan(table).collect()} == {1: N, 2: 62, 3: 1}
    model = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    assert quality.score(table, model).count() == 3


def test_texts_in_parts_give_what_whole_texts_give():
    rnd = random.Random(4)
    texts = [rnd.choice([" ", "\n", ",  "]).join(rnd.choice(["a", "B", "cc", "dé", "w" * 30, "x1"]) for _ in range(rnd.randrange(1, 200))).encode() + rnd.choice([b"", b"  ", b" \n" * 20]) for _ in range(40)] + [b"", b" " * 50, b"z" * 90]
    for limit in (1, 16, 100):
        for t in texts:
            for kept in (text.SPACED, text.PLAIN):
                whole = text.words([t], kept, lower=True)
                w_hash = text.word_hashes(whole)
                for overlap in (0, 1, 4):
                    seen = {}
                    for w, before in text.word_parts([t], kept, overlap, True, limit):
                        h = text.word_hashes(w)
                        assert (h == w_hash[before : before + len(h)]).all()
                        for i in range(len(h) - overlap):
                            seen[before + i] = seen.get(before + i, 0) + 1
                    assert seen == {i: 1 for i in range(max(len(w_hash) - overlap, 0))}
            for width in (1, 3, 5):
                assert neardup._shingles([t, b"a b", t], width, limit)[1].tolist() == neardup._shingles([t, b"a b", t], width)[1].tolist()
            counts, marks = decontaminate._marked([t], [2, 6], False, None, limit)
            want_counts, want = decontaminate._marked([t], [2, 6], False, None)
            spread = lambda m: {(x["size"], x["print"], x["place"] + i, tuple(x["words"].split()[i : i + x["size"]])) for x in m.to_pylist()[0] for i in range(len(x["words"].split()) - x["size"] + 1)}
            assert counts.tolist() == want_counts.tolist() and spread(marks) == spread(want)


def test_substring_dedup_in_parts_finds_the_same_windows():
    rnd = random.Random(5)
    t = " ".join(rnd.choice("abcdefgh") for _ in range(400)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([t])], ["d", "t", "text"])
    found = {}
    for limit in (60, 1 << 20):
        rows = pa.Table.from_batches(substring._find(6, limit)(iter([batch]))).to_pylist()
        found[limit] = sorted((r["seed"], (r["place"] >> 16) + i) for r in rows for i in range(r["place"] & 0xFFFF))
        listed = pa.array([[{"place": r["place"], "seed": r["seed"], "asked": True, "hot": i % 2 == 0} for i, r in enumerate(rows)]])
        again = pa.Table.from_batches(substring._taken(6, limit)(iter([batch.append_column("listed", listed)]))).to_pylist()
        words = t.decode().split()
        assert all(r["words"].split() == words[r["place"] >> 16 : (r["place"] >> 16) + (r["place"] & 0xFFFF) + 5] for r in again if r["window"] is None)
        assert sum(1 if r["window"] is not None else r["place"] & 0xFFFF for r in again) == 395
        places = pa.array([[10 << 16 | 3, 12 << 16 | 1, 100 << 16 | 200, 394 << 16 | 1]])
        batch2 = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([t]), places], ["doc_id", "text", "places"])
        cut = next(substring._cut(6, limit)(iter([batch2]))).to_pylist()[0]
        gone = {*range(10, 18), *range(100, 305), *range(394, 400)}
        assert cut["kept_text"].split() == [w for i, w in enumerate(words) if i not in gone] and (cut["n_words"], cut["n_removed"]) == (400, len(gone))
    assert found[60] == found[1 << 20]


def test_stored_forms_take_very_long_texts(spark, long):
    table, _ = long
    raw = table.where("doc_id = 1").first().text.encode()
    path = tokens.store(table, __import__("public_tokenizers").path("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in tokens.read(spark, path).collect()}
    assert rows[2].start == rows[1].n_tokens and rows[1].n_tokens > N
    frames = gif.frames(gif.store(table.withColumnRenamed("text", "payload"))).where("doc_id = 1").first().frames
    back = b"".join(bytes(f.pixels) for f in frames)
    assert len(frames) == -(-len(raw) // 65_536) and hashlib.sha256(back[: len(raw)]).digest() == hashlib.sha256(raw).digest()


def test_samples_are_the_rows_of_least_hash(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 7).alias("k"))
    every = [r.id for r in rows.orderBy(F.xxhash64("id"), "id").collect()]
    for n in (0, 1, 17, 900, 5000, 9000):
        assert [r.id for r in sample.least_by_hash(rows.repartition(3), n, "id").collect()] == every[:n]
    # a third of all rows have one hash
    assert sample.least_by_hash(rows, 2000, "k").count() == 2000


def test_partitions_are_merged_by_cores_and_bytes(spark, tmp_path, monkeypatch):
    spark.range(100_000).repartition(60).write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t").repartition(60)
    cores = spark.sparkContext.defaultParallelism
    assert scratch.few(read).rdd.getNumPartitions() == 4 * cores
    monkeypatch.setattr(scratch, "PART_BYTES", 10_000)
    assert 4 * cores < scratch.few(read).rdd.getNumPartitions() <= 60
