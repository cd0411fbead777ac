"""Benchmark decontamination by winnowing.

Of the k-grams in each window of ``window`` words the one with the least hash is a fingerprint; two texts that share
a window share its fingerprint, so every shared window is found. Neighbouring windows with one fingerprint are a
*stretch* of words around it.

1. fingerprints of the benchmark and of the documents are joined;
2. a hit is extended over its stretch: each window of the document's stretch is joined by its words to the windows of the
   benchmark that have this fingerprint. Words are compared, so a clash of hashes gives no hit;
3. windows that touch are spans; the items of a text's windows are its items.

An item of fewer than ``window`` words is one window of its own length and goes the same way: windows of each length
that items have are winnowed. Hits belong to texts, of which equal ones are looked at once. Documents are read once;
fingerprints that no item can have, by a table of 2 ** BITS bits, are left out before the join, so a benchmark of usual
size makes few rows, and a large one fills the table and leaves the work to the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .scratch import in_batches
from .text import PART, PLAIN, Runs, Spoken, Stretches, signed, slices, stretches, word_hashes, word_parts

#: Words of a fingerprint's k-gram; at most the window.
GRAM = 5
#: Binary logarithm of the bits that tell which fingerprints the benchmark may have; at least 6.
BITS = 22

_MARK = pa.struct([("size", pa.int32()), ("print", pa.int64()), ("place", pa.int64()), ("words", pa.string())])


def _text_key() -> list[Column]:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2")]


def _marked(texts: list[bytes], sizes: list[int], of_items: bool, bits: np.ndarray | None, limit: int = PART) -> tuple[np.ndarray, pa.ListArray]:
    """Number of words of each text, and its fingerprints with their stretches of windows of the given sizes.

    Of items, windows have the last size, and those of shorter items the item's own.
    """
    docs, rows, counts = [], [], np.zeros(len(texts), np.int64)
    in_parts = len(texts) == 1 and len(texts[0]) > limit
    for w, before in word_parts(texts, PLAIN, max(sizes, default=1) - 1, lower=True, limit=limit):
        runs, owner, spoken = Runs(word_hashes(w)), np.repeat(np.arange(len(texts)), w.counts), Spoken(w)
        counts = before + w.counts
        for size in sizes:
            found = stretches(runs, owner, size, min(GRAM, size))
            if of_items and size < sizes[-1]:
                found = Stretches(*(x[(w.counts[owner[found.first]] == size) & (not in_parts)] for x in found))
            if bits is not None:
                top = found.seed >> np.uint64(64 - int(np.log2(64 * len(bits))))
                found = Stretches(*(x[(bits[top >> np.uint64(6)] >> (top & np.uint64(63)) & np.uint64(1)).astype(bool)] for x in found))
            doc = owner[found.first]
            docs.append(doc)
            columns = [pa.array(np.full(len(doc), size, np.int32)), signed(found.seed), pa.array(found.first - w.bounds[doc] + before), spoken.take(found.first, found.count + size - 1)]
            rows.append(pa.StructArray.from_arrays(columns, fields=list(_MARK)))
    doc = np.concatenate([*docs, np.empty(0, np.int64)])
    order = np.argsort(doc, kind="stable")
    offsets = np.searchsorted(doc[order], np.arange(len(texts) + 1))
    return counts, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays([*rows, pa.array([], _MARK)]).take(pa.array(order)))


def _marks(sizes: list[int], of_items: bool, bits: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole):
                counts, marks = _marked(texts, sizes, of_items, bits)
                kept = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(counts, pa.int64()), marks], [*kept, "n_words", "marks"])

    return run


_FOUND = "n_words long, marks array<struct<size:int,print:long,place:long,words:string>>"


def _windows(marks: DataFrame, *carried: str) -> DataFrame:
    """One row for each window of the stretches: carried columns, size, print, place, window (its words)."""
    spoken = F.split("words", " ")
    starts = F.sequence(F.lit(0), F.size("spoken") - F.col("size"))
    each = F.transform(starts, lambda j: F.struct((F.col("place") + j).alias("place"), F.array_join(F.slice("spoken", j + 1, F.col("size")), " ").alias("window")))
    return marks.withColumn("spoken", spoken).select(*carried, "size", "print", F.explode(each).alias("one")).select(*carried, "size", "print", "one.*")


def _benchmark(benchmark: DataFrame, window: int) -> DataFrame:
    """item, size, print, window: every distinct window of the benchmark."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    found = items.transform(in_batches, _marks([*range(1, window + 1)], True), f"item string, {_FOUND}")
    marks = found.select("item", F.explode("marks").alias("mark")).select("item", "mark.*")
    return scratch.table(_windows(marks, "item").select("item", "size", "print", "window").distinct(), "benchmark", 1)


def _bits(known: DataFrame, bits: int) -> np.ndarray:
    """Which upper ``bits`` bits the fingerprints have: 2 ** (bits - 6) numbers at most come to the driver."""
    top = F.shiftrightunsigned("print", 64 - bits)
    held = known.groupBy(F.shiftright(top, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(print, {64 - bits}) & 63))")).alias("held"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for r in held.collect():
        out[r["at"]] = np.int64(r["held"]).view(np.uint64)
    return out


def _verified(found: DataFrame, known: DataFrame) -> DataFrame:
    """t1, t2, size, print, place, window: the windows of documents that stand in the benchmark.

    found: t1, t2, marks; known: size, print, window, ...
    """
    marks = found.where("size(marks) > 0").select("t1", "t2", F.explode("marks").alias("mark")).select("t1", "t2", "mark.*")
    hits = marks.join(known.select("size", "print").distinct(), ["size", "print"])
    extended = _windows(hits, "t1", "t2")
    return extended.join(known.select("size", "print", "window").distinct(), ["size", "print", "window"]).distinct()


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    known = _benchmark(benchmark, window)
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())
    scan = docs.select(*[c for c in docs.columns if c != "text"], *_text_key(), "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scan.schema if f.name != "text")
    found = scratch.table(scan.transform(in_batches, _marks(sizes, False, _bits(known, bits)), f"{kinds}, {_FOUND}"), "marks")
    return found, known, scratch.table(_verified(found, known), "hits", 1)


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, bits: int = BITS) -> DataFrame:
    """Find the words of docs that lie in a window of a benchmark item.

    docs: doc_id and text; benchmark: item_id and text; other columns are not read. A-Z count as a-z; words are runs
    of digits, letters and bytes above 127. A window is ``window`` words in a row of an item; an item of fewer words
    is one window. Returns one row per row of docs: doc_id, n_words, spans (start, stop: hit words from 0), items
    (sorted distinct item ids, as strings, with a window in the text).

    Null or empty texts have no words and no windows. Items with null id are looked for, but not named. Items with
    the same words are all named. Repeated rows of docs each keep their row; repeated items count once. An empty
    benchmark hits nothing. Every item is used, however many there are.
    """
    found, known, hits = _scanned(docs.select("doc_id", "text"), benchmark, window, bits)
    order = Window.partitionBy("t1", "t2").orderBy("place", "stop")
    apart = F.col("place") > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select("t1", "t2", "place", (F.col("place") + F.col("size")).alias("stop")).distinct()
    spans = spans.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("apart").over(order))
    spans = spans.groupBy("t1", "t2", "span").agg(F.min("place").alias("start"), F.max("stop").alias("stop"))
    spans = spans.groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    items = hits.select("t1", "t2", "size", "print", "window").distinct().join(known.where("item is not null"), ["size", "print", "window"])
    items = items.select("t1", "t2", "item").distinct().groupBy("t1", "t2").agg(F.array_sort(F.collect_list("item")).alias("items"))
    each = scratch.table(spans.join(items, ["t1", "t2"], "left"), "spans", 1)
    none = F.array().cast("array<struct<start:long,stop:long>>"), F.array().cast("array<string>")
    joined = found.select("doc_id", "t1", "t2", "n_words").join(each, ["t1", "t2"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, bits: int = BITS) -> DataFrame:
    """The rows of docs, with all their columns, in which ``find`` finds nothing."""
    *_, hits = _scanned(docs.select("text"), benchmark, window, bits)
    # a table of its real size, so that Spark broadcasts it only up to its threshold
    found = scratch.table(hits.select("t1", "t2").distinct(), "found", 1)
    t1, t2 = _text_key()
    return docs.join(found, (t1 == found.t1) & (t2 == found.t2), "left_anti")
