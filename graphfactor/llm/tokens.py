"""Token files: ids of each document, compressed one by one with a shared dictionary.

The file format is a Parquet folder of *packs*. A pack holds consecutive documents of one shard, ascending by
doc_id: one blob of zstandard frames, one frame per document, and the index of the blob (doc_ids, offsets, n_tokens).
A short document is read by its pack's range of doc_ids and its offsets, without unpacking its neighbours. Beside it
lies the dictionary, trained on the serialized ids of a bounded sample of pieces, drawn by hash from all pieces of all
texts; each pack names its hash, and a reader with another dictionary refuses. Shards are ranges of doc_id, so packs
in order of (shard, pack) are in ascending doc_id order.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .sample import cut_step, step_of
from .scratch import in_batches
from .text import release

#: Pieces whose ids train the dictionary, characters of a piece, and bytes of the dictionary.
SAMPLE, PIECE, DICT_BYTES = 2000, 4000, 64 << 10
#: Text bytes encoded at once: the more, the fewer words are looked up twice.
_SLICE = 8 << 20
#: Compressed bytes after which a pack is full.
PACK_BYTES = 1 << 20
#: Pieces of words that an encoder remembers before it starts anew.
_CACHED = 300_000
_PACKS = "shard int, pack int, dict_hash string, width int, doc_ids array<long>, offsets array<long>, n_tokens array<long>, before long, blob binary"


class Encoder:
    """Ids of texts, encoded by distinct word; pieces of words that were met before are looked up.

    White space always parts words here: the vocabulary's normaliser makes it one space and its pre-tokenizer drops
    it, so a text's ids are those of its space-separated words in a row. A text of ASCII and Latin letters is cut the
    way the pre-tokenizer cuts it, in lower case; each piece ends with one end-of-word token, so many new pieces are
    encoded as one text and told apart by these. Any other text (other scripts, combining marks, control and special
    tokens) is encoded by itself.
    """

    _LETTER = "a-z\u00df-\u00f6\u00f8-\u017f"
    _PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|\n| |[^{_LETTER}0-9\n ]+")
    _SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces: dict[str, bytes] = {}
        kind = json.loads(self.tokenizer.to_str())
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = kind["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        # the short cut holds for this kind of vocabulary only
        self.cuts = bool(suffix) and [n.get("type") for n in (kind["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        # spaces, printable ASCII and Latin letters, but no character that a special token begins with
        taken = {t["content"][0] for t in kind["added_tokens"]}
        ranges = ((0x20, 0x7F), (0xC0, 0xD7), (0xD8, 0xF7), (0xF8, 0x130), (0x131, 0x180))
        self.plain = re.compile("[" + re.escape("".join(chr(c) for a, b in ranges for c in range(a, b) if chr(c) not in taken)) + "]*").fullmatch

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, pieces: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(pieces), 4096):
            part = pieces[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(part):
                out += self._alone(part)
                continue
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip([0, *stops], stops, strict=False)]
        return out

    def batch(self, texts: list[bytes], end_id: int) -> list[np.ndarray]:
        """Ids of each text, with end_id after them."""
        strings = [t.translate(self._SPACES).decode() for t in texts]
        plain = [self.cuts and self.plain(s) is not None for s in strings]
        end = np.array([end_id], np.uint32)
        slow = iter([np.concatenate([np.frombuffer(x, np.uint32), end]) for x in self._alone([s for s, p in zip(strings, plain, strict=True) if not p])] if not all(plain) else [])
        quick = iter(self._cut(" \n ".join(compress(strings, plain)), end_id) if any(plain) else [])
        return [next(quick if p else slow) for p in plain]

    def _cut(self, texts: str, end_id: int) -> list[np.ndarray]:
        """Ids of texts of which a line feed between spaces parts each from the next."""
        buffer = np.frombuffer(f" {texts} \n ".lower().encode(), np.uint8)
        spaces = buffer == 0x20
        # one space after each word
        one = np.flatnonzero(~(spaces & np.concatenate([[True], spaces[:-1]])))
        buffer = buffer[one]
        offsets = np.concatenate([[0], np.flatnonzero(buffer == 0x20) + 1]).astype(np.int32)
        # Arrow finds the distinct words
        words = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(buffer)]).dictionary_encode()
        ids, first = self._words(b"".join(words.dictionary.to_pylist()).decode())
        which = words.indices.to_numpy()
        start, count = first[which], np.diff(first)[which]
        row = ids[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        ends = np.flatnonzero(row == _MARK)
        row[ends] = end_id
        return np.split(row, ends[:-1] + 1)

    def _words(self, words: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and where each word's begin and the last one's end; a space ends each word."""
        if len(self.pieces) > _CACHED:
            self.pieces.clear()
        known, row = self.pieces, self._PIECE.findall(words)
        # a line feed stands for no id of the vocabulary, so it marks the ends of texts; a space has no ids
        known["\n"], known[" "] = _MARK.tobytes(), b""
        unknown = list(set(row).difference(known))
        known.update(zip(unknown, self._together(unknown), strict=True))
        parts = list(map(known.__getitem__, row))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        stops = (np.cumsum(sizes) >> 2)[sizes == 0]
        return np.frombuffer(b"".join(parts), np.uint32), np.concatenate([[0], stops])


_MARK = np.uint32(0xFFFFFFFF)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python process: what one task has learned serves the next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of several batches, about _SLICE bytes of text; null texts are empty."""
    ids, texts, size = [], [], 0
    for batch in batches:
        ids += batch.column("doc_id").to_pylist()
        more = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        texts += more
        size += sum(map(len, more))
        if size >= _SLICE:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _write(path: str, dictionary: bytes, end_id: int, width: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), encoder(path)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        dict_hash = hashlib.sha256(dictionary).hexdigest()
        pack, doc_ids, frames, counts, size, before = 0, [], [], [], 0, 0

        def full() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype(np.int64)
            row = {"shard": shard, "pack": pack, "dict_hash": dict_hash, "width": width, "doc_ids": doc_ids, "offsets": offsets.tolist(), "n_tokens": counts, "before": before, "blob": b"".join(frames)}
            kinds = pa.schema([("shard", pa.int32()), ("pack", pa.int32()), ("dict_hash", pa.string()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("before", pa.int64()), ("blob", pa.binary())])
            return pa.RecordBatch.from_pylist([row], kinds)

        for some_ids, texts in _gathered(batches):
            for doc_id, ids in zip(some_ids, encode.batch(texts, end_id), strict=True):
                frames.append(packer.compress(_serialized(ids, width)))
                doc_ids.append(doc_id)
                counts.append(len(ids))
                size += len(frames[-1])
                if size >= PACK_BYTES:
                    yield full()
                    before += sum(counts)
                    pack, doc_ids, frames, counts, size = pack + 1, [], [], [], 0
            release()
        if doc_ids:
            yield full()

    return run


def _sampled(docs: DataFrame, sample: int) -> DataFrame:
    """h, text: the ``sample`` pieces with the least hash, of all pieces of PIECE characters that all whole texts are cut into.

    A piece's hash is that of its text's doc_id and hash and of its number, so neither files nor order of rows matter.
    """
    h = lambda i: F.xxhash64("doc_id", "t", i)
    texts = docs.where("text <> ''").select("doc_id", F.xxhash64("text").alias("t"), F.floor((F.char_length("text") - 1) / PIECE).cast("int").alias("last"), "text")
    numbers = F.sequence(F.lit(0), F.col("last"))
    cut = cut_step(texts.select("doc_id", "t", F.explode(numbers).alias("i")), h("i"), sample)
    taken = F.transform(F.filter(numbers, lambda i: step_of(h(i)) <= cut), lambda i: F.struct(h(i).alias("h"), F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE)).alias("text")))
    return texts.select(F.explode(taken).alias("piece")).select("piece.*").orderBy("h", "text").limit(sample)


def _encoded(tokenizer: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            found = encode.batch([t.encode() for t in batch.column("text").to_pylist()], end_id)
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array([_serialized(ids, width) for ids in found], pa.binary())], ["h", "ids"])
        release()

    return run


def train(docs: DataFrame, tokenizer: str, end_id: int, width: int, sample: int = SAMPLE) -> bytes:
    """A zstandard dictionary from the serialized ids of ``sample`` pieces, drawn by hash from all pieces of all texts.

    It depends on the rows only, not on their order or files. The dictionary changes how small the files are, not what
    they hold. Empty (no dictionary) if the corpus is too small to train one. The driver sees the pieces' ids only.
    """
    found = _sampled(docs, sample).where("trim(text) <> ''").repartition(8).transform(in_batches, _encoded(tokenizer, end_id, width), "h long, ids binary")
    samples = [ids for _, ids in sorted((r["h"], bytes(r["ids"])) for r in found.collect())]
    if sum(map(len, samples)) < 16 * 1024 or len(samples) < 50:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, level: int = 3) -> None:
    """Encode every text and write the token files to ``path``.

    docs: doc_id (long) and text; other columns are not read. tokenizer: path of a tokenizers file, on every machine.
    Null and empty texts are the end id alone. Null doc_ids come first; repeated rows are written again.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    release()
    width = 2 if max(size - 1, end_id) < 1 << 16 else 4
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train(docs, tokenizer, end_id, width)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "dict_hash string, dictionary binary").write.parquet(f"{path}/dictionary")
    scratch.settle(spark)
    ranged = docs.repartitionByRange(F.asc_nulls_first("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    ranged.transform(in_batches, _write(tokenizer, dictionary, end_id, width, level), _PACKS).write.parquet(f"{path}/packs")


def _unpacked(dictionary: bytes, with_ids: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        dict_hash = hashlib.sha256(dictionary).hexdigest()
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_hash"] != dict_hash:
                    raise ValueError(f"pack {row['shard']}/{row['pack']} was written with another dictionary: {row['dict_hash']}")
                blob, o = row["blob"], row["offsets"]
                ids = [np.frombuffer(unpacker.decompress(blob[a:b]), "<u2" if row["width"] == 2 else "<u4").astype("<u4") for a, b in zip(o, o[1:])]
                starts = row["before"] + row["shard_start"] + np.cumsum([0, *row["n_tokens"]])[:-1]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                more = [pa.array([x.tobytes() for x in ids], pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays([*columns, *more], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns) + len(more)])

    return run


def dictionary_of(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(row["dictionary"])).hexdigest() != row["dict_hash"]:
        raise ValueError("the dictionary does not have the hash it is filed under")
    return bytes(row["dictionary"])


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every document of token files, unpacked: doc_id, start (ids before it), n_tokens, ids_crc32 (of the ids as
    little-endian numbers of 4 bytes) and, unless they aren't wanted, ids (these bytes).

    A start is what the shards before hold (as many sums as shards, joined by broadcast up to Spark's threshold), what
    the shard's packs before hold (kept in the pack) and what the pack's documents before hold.
    """
    packs = spark.read.schema(_PACKS).parquet(f"{path}/packs")
    shards = packs.groupBy("shard").agg(F.max(F.expr("aggregate(n_tokens, before, (a, b) -> a + b)")).alias("n")).orderBy("shard").collect()
    before, rows = 0, []
    for r in shards:
        rows.append((r["shard"], before))
        before += r["n"]
    packs = packs.join(spark.createDataFrame(rows, "shard int, shard_start long"), "shard")
    return packs.transform(in_batches, _unpacked(dictionary_of(spark, path), with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def read_one(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the document (or of each row that has this doc_id), unpacking its frames only."""
    packs = spark.read.schema(_PACKS).parquet(f"{path}/packs").where(F.array_contains("doc_ids", F.lit(doc_id)))
    hits = packs.select(F.posexplode("doc_ids").alias("nth", "id"), "offsets", "width", "blob").where(F.col("id") == doc_id)
    frames = hits.select("width", F.expr("substring(blob, int(offsets[nth] + 1), int(offsets[nth + 1] - offsets[nth]))").alias("frame")).collect()
    dictionary = dictionary_of(spark, path)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return [np.frombuffer(unpacker.decompress(bytes(f["frame"])), "<u2" if f["width"] == 2 else "<u4").tolist() for f in frames]


def store(docs: DataFrame, tokenizer: str, end_id: int = 2) -> str:
    """write() to a fresh folder of the shared directory; returns its path."""
    path = scratch.new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end_id)
    return path
