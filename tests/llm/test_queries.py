"""Queries that SQL can't express, against plain Python over the whole small table."""

import hashlib
import zlib

import numpy as np
from tokenizers import Tokenizer

import public_tokenizers
from graphfactor.llm import gif, quality, queries

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op4_rows(spark):
    rows = queries.op4_quality(spark, SF).collect()
    found = texts(spark)
    assert sorted(r.doc_id for r in rows) == sorted(found)
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
        assert abs(r.score - float(model.score(quality.features([found[r.doc_id].encode()]))[0])) < 1e-12


def test_op9_rows(spark):
    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, {}
    for i, t in sorted(texts(spark).items()):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_token_files(spark, SF).collect()} == want


def test_op10_rows(spark):
    for r in queries.op10_gif_media(spark, SF).collect():
        raw = texts_once(spark)[r.doc_id].encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        media = gif.encode(padded)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest())
        grey = np.bincount(np.frombuffer(padded, np.uint8) >> 6, minlength=4)
        counts = [0] * 64
        for level, n in enumerate(grey.tolist()):
            counts[level * 21] = n
        assert r.feature == f"frames=1;ms=100;colours={','.join(map(str, counts))}"


_TEXTS: dict = {}


def texts_once(spark):
    if not _TEXTS:
        _TEXTS.update(texts(spark))
    return _TEXTS
