"""Near-duplicates by bottom-k sketches from one hash function.

Documents with the same set of word shingles are one class. A class keeps the k least hashes of its set (all, if it
has no more). Inverted lists of retained values give the candidates, in two steps with a small and a large k: the
small one finds the few classes that can have a partner at all, the large one, for these classes only, their pairs.

* Two sets of the wanted similarity share at least c retained values, so it is enough to meet in one of the k - c + 1
  rarest; values that stand in one class only are dropped before anything else. For sets that fit into sketches c is
  exact; else it is a binomial quantile that a pair at the threshold falls short of with a probability of at most MISS.
  The small sketch comes first, so only sets that fit into it are compared without this chance; a pair is missed with a
  probability of at most 2 MISS, MISS for each size of sketch.
* Values are ordered by rarity, and a pair that meets at places i and j can share no more than what follows in both.
* Within a list each class is compared with the list's *leader*, the class with most shared values, so a list of n
  classes gives n - 1 pairs. What the leaders link is one component. Only pairs of a list that lie in different
  components after that are compared one by one.

A pair's similarity is estimated from the sketch of the union first, with the same quantile; pairs that reach it are
verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import exp, floor, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .scratch import in_batches
from .text import PART, SPACED, Runs, mix, repeated, signed, slices, word_hashes, word_parts, words

#: Sizes of the small and the large sketch.
K, FINE = 64, 1024
#: Probability at most, for each size of sketch, that a pair at the threshold is missed.
MISS = 1e-9


def _shingles(texts: list[bytes], width: int, limit: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct shingles, ascending; a text of fewer words is one shingle."""
    if any(len(t) > limit for t in texts):
        found = [_in_parts(t, width, limit) if len(t) > limit else _shingles([t], width)[1] for t in texts]
        return np.repeat(np.arange(len(texts)), [len(x) for x in found]), np.concatenate(found)
    w = words(texts, SPACED, lower=True)
    runs, counts = Runs(word_hashes(w)), w.counts
    owner = np.repeat(np.arange(len(texts)), counts)
    short = np.flatnonzero((counts > 0) & (counts < width))
    at = np.arange(max(0, runs.n - width + 1))
    at = at[owner[at] == owner[at + width - 1]] if len(at) else at
    doc = np.concatenate([owner[at], short]).astype(np.int64)
    hashes = np.concatenate([runs.at(at, width), runs.at(w.bounds[short], counts[short])])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def _in_parts(text: bytes, width: int, limit: int) -> np.ndarray:
    """The distinct shingles of one long text, ascending."""
    found = np.empty(0, np.uint64)
    for w, before in word_parts([text], SPACED, width - 1, lower=True, limit=limit):
        runs = Runs(word_hashes(w))
        # a last part of the overlap alone has no shingle of its own, but a text of few words is one
        own = runs.every(width) if runs.n >= width or before else runs.at(np.zeros(1, np.int64), runs.n)[: runs.n]
        found = np.union1d(found, own)
    return found


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole):
                doc, hashes = _shingles(texts, width)
                first = np.searchsorted(doc, np.arange(len(texts) + 1))
                n = np.diff(first)
                both = []
                for salt in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)):
                    sums = np.zeros(len(hashes) + 1, np.uint64)
                    np.cumsum(mix(hashes ^ salt), out=sums[1:])
                    both.append(sums[first[1:]] - sums[first[:-1]])
                held = np.minimum(n, k)
                offsets = np.concatenate([[0], np.cumsum(held)])
                at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first[:-1], held)
                sketch = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), signed(hashes[at] >> np.uint64(1)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(n, pa.int64()), signed(both[0]), signed(both[1]), sketch], ["doc_id", "t", "n", "s1", "s2", "sketch"])

    return run


def _fine(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole):
                doc, hashes = _shingles(texts, width)
                first = np.searchsorted(doc, np.arange(len(texts) + 1))
                at = np.flatnonzero(np.arange(len(doc)) - first[doc] < k) if len(doc) else np.empty(0, np.int64)
                owner = doc[at]
                yield pa.RecordBatch.from_arrays([repeated(batch.column("c"), owner), pa.array(np.diff(first)[owner], pa.int32()), signed(hashes[at] >> np.uint64(1))], ["c", "n", "v"])

    return run


def _hopeful(num: int, den: int, k: int):
    """Keep the pairs whose similarity may reach num / den by the sketch of their union."""
    least = _least(num / den, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a_sketch"), batch.column("b_sketch")
            sizes = np.diff(a.offsets.to_numpy()), np.diff(b.offsets.to_numpy())
            pair = np.concatenate([np.repeat(np.arange(len(batch)), n) for n in sizes])
            value = np.concatenate([a.flatten().to_numpy(), b.flatten().to_numpy()])
            order = np.lexsort((value, pair))
            pair, value = pair[order], value[order]
            twice = np.zeros(len(pair), bool)
            twice[1:] = (pair[1:] == pair[:-1]) & (value[1:] == value[:-1])
            # rank of each value in its pair's union; a value's second copy has the rank of the first
            distinct = np.cumsum(~twice)
            union = np.bincount(pair[~twice], minlength=len(batch))
            start = np.concatenate([[0], np.cumsum(union)])[:-1]
            rank = distinct - 1 - start[pair]
            whole = (batch.column("a_n").to_numpy() <= k) & (batch.column("b_n").to_numpy() <= k)
            m = np.where(whole, union, np.minimum(union, k))
            shared = np.bincount(pair[twice & (rank < m[pair])], minlength=len(batch))
            # where a sketch is cut, the union has k values at least
            keep = np.where(whole, shared * den >= union * num, shared >= least)
            places = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([repeated(batch.column(x), places) for x in "ab"], ["a", "b"])

    return run


def _alike(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = None, np.empty(0)
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            texts = batch.column("a_text").cast(pa.binary()).to_pylist()
            others = batch.column("b_text").cast(pa.binary())
            keep = []
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < 1 << 20):
                    size += len(texts[stop] or b"")
                    stop += 1
                doc, hashes = _shingles([t or b"" for t in texts[at:stop]], width)
                first = np.searchsorted(doc, np.arange(stop - at + 1))
                for i in range(at, stop):
                    other = others[i].as_py() or b""
                    if last[0] != other:
                        last = other, _shingles([other], width)[1]
                    own = hashes[first[i - at] : first[i - at + 1]]
                    both = len(np.intersect1d(own, last[1], assume_unique=True))
                    keep.append(both > 0 and den * both >= num * (len(own) + len(last[1]) - both))
                at = stop
            places = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([repeated(a, places), repeated(b, places)], ["a", "b"])

    return run


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, width: int, num: int, den: int, k: int) -> DataFrame:
    """Those of the pairs (a, b) that are alike: by the sketch of the union, then on full sets."""
    side = lambda x: sketches.select(F.col("c").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").transform(in_batches, _hopeful(num, den, k), "a long, b long")
    left = likely.join(texts.select(F.col("c").alias("a"), F.col("text").alias("a_text")), "a")
    both = left.join(texts.select(F.col("c").alias("b"), F.col("text").alias("b_text")), "b").select("a", "b", "a_text", "b_text")
    return both.transform(in_batches, _alike(width, num, den), "a long, b long").distinct()


def _rarest(entries: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """entries: c, n, v. Returns c, n, v, at, rank: the shared values among a class's rarest ones in which it must meet
    any partner, their place in the order of rarity, and how many of its values are shared."""
    t = num / den
    shared = entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    wide = k - _least(t, k) + 1
    # n - ceil(t n) + 1 of the n values if no partner's sketch is cut, else `wide` of the min(n, k) values
    needed = F.when(F.col("n") <= floor(t * k), F.col("n") - F.ceil(F.col("n") * num / den) + 1).otherwise(F.lit(wide))
    return (
        entries.join(shared, "v").groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
        .withColumn("alone", F.least("n", F.lit(k)) - F.size("vs")).withColumn("left", (needed - F.col("alone")).cast("int")).where("left > 0")
        .select("c", "n", "alone", F.size("vs").alias("rank"), F.posexplode(F.expr("slice(vs, 1, left).v")).alias("at", "v"))
        .select("c", "n", "v", (F.col("alone") + F.col("at")).alias("at"), "rank")
    )


@cache
def _least(t: float, k: int) -> int:
    """Retained values that two sets of similarity t share at least, if their sketches are cut: the most of which fewer
    come out of k draws with a probability of at most MISS. (Draws from a set without replacement fall short less often.)"""
    below = 0.0
    for c in range(k if t < 1 else 0):
        below += exp(lgamma(k + 1) - lgamma(c + 1) - lgamma(k - c + 1) + c * log(t) + (k - c) * log1p(-t))
        if below > MISS:
            return c
    return k


def groups(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, k: int = K, fine: int = FINE) -> DataFrame:
    """Group documents whose sets of word shingles have a Jaccard similarity of at least num / den, and what they reach.

    docs: doc_id (long) and text; other columns are not read. A-Z count as a-z; words are runs of bytes other than
    space and tab to carriage return. A document's set: distinct shingles of ``shingle`` words; with fewer words, all of
    them as one. Returns one row per row of docs: doc_id, n_shingles, component_id (the least doc_id of its group),
    kept (whether it is that document).

    Texts without words (null, empty, blank) are linked with nothing. A row without doc_id can't be named: it is
    linked with nothing, has no component_id and is kept. Rows with one doc_id count as one document, linked with
    what any of them is like: they have one component_id, though each its own n_shingles. Empty table: no rows.
    """
    t = num / den
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    made = scratch.table(rows.transform(in_batches, _sketches(shingle, k), "doc_id long, t long, n long, s1 long, s2 long, sketch array<long>"), "sketches")
    usable = made.where("doc_id is not null and n > 0")
    # a class has a number of its own (which the written table settles) and stands in the text of its least document
    classes = usable.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "t")).alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.table(classes.select(F.monotonically_increasing_id().alias("c"), "s1", "s2", F.col("one.doc_id").alias("least"), F.col("one.t").alias("t"), "n", "sketch"), "classes", 2)

    playing = _rarest(classes.select("c", "n", F.explode("sketch").alias("v")), num, den, k).select("c").distinct()
    held = scratch.table(classes.join(playing, "c").select("c", "least", "t", "n", "sketch"), "playing", 2)
    # of repeated rows one counts; the join has dealt them by these columns already
    texts = rows.join(held.select(F.col("least").alias("doc_id"), "t", "c"), ["doc_id", "t"]).groupBy("doc_id", "t", "c").agg(F.first("text").alias("text"))
    texts = scratch.table(texts.select("c", "text"), "texts")

    entries = texts.transform(in_batches, _fine(shingle, fine), "c long, n int, v long")
    lists = scratch.table(_rarest(entries, num, den, fine), "lists")

    def may_be(x: str, y: str):
        """Whether two classes that meet in a list can be alike, by their sizes and places."""
        n, m, i, j = (F.col(f"{p}_{q}") for q in ("n", "at") for p in (x, y))
        whole = (n <= fine) & (m <= fine)
        least = F.when(whole, F.ceil((n + m) * num / (num + den))).otherwise(F.lit(_least(t, fine)))
        return (n * den >= m * num) & (m * den >= n * num) & (F.least(F.least(n, F.lit(fine)) - i, F.least(m, F.lit(fine)) - j) >= least)

    side = lambda df, x, *more: df.select("v", *(F.col(c).alias(x if c == "c" else f"{x}_{c}") for c in ("c", "n", "at", *more)))
    leaders = lists.groupBy("v").agg(F.max(F.struct("rank", "n", "c", "at")).alias("top"), F.count("*").alias("m")).where("m > 1").select("v", "top.c", "top.n", "top.at")
    stars = scratch.table(side(lists, "a").join(side(leaders, "b"), "v").where((F.col("a") != F.col("b")) & may_be("a", "b")).select("a", "b").distinct(), "stars", 1)
    links = scratch.table(_verified(stars, held, texts, shingle, num, den, k), "links", 1)
    part = components(links)

    placed = lists.join(part.withColumnRenamed("id", "c"), "c", "left").withColumn("g", F.coalesce("component", "c"))
    open_lists = placed.groupBy("v").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("v")
    placed = scratch.table(placed.join(open_lists, "v").select("v", "c", "n", "at", "g"), "open", 1)
    # sizes that fit lie in the same or in neighbouring steps of a geometric scale
    step = F.floor(F.log("a_n") / F.log(F.lit(den / num * 1.000001))).cast("int")
    one = side(placed, "a", "g").select("*", F.explode(F.array(step, step + 1)).alias("step"))
    two = side(placed, "a", "g").withColumn("step", step).select("v", "step", *(F.col(f"a{c}").alias(f"b{c}") for c in ("", "_n", "_at", "_g")))
    ordered = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a") < F.col("b")))
    rest = one.join(two, ["v", "step"]).where(ordered & (F.col("a_g") != F.col("b_g")) & may_be("a", "b")).select("a", "b").distinct()
    tried = stars.union(stars.select("b", "a"))
    more = scratch.table(_verified(rest.join(tried, ["a", "b"], "left_anti"), held, texts, shingle, num, den, k), "more", 1)
    # a doc_id that has several texts links their classes
    many = made.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("low"), F.max(F.struct("s1", "s2")).alias("high")).where("low < high").select("doc_id")
    shared = scratch.table(made.select("doc_id", "s1", "s2").join(many, "doc_id").distinct(), "shared", 1)
    held_by = shared.join(classes.select("s1", "s2", "c"), ["s1", "s2"]).select("doc_id", "c")
    own = held_by.join(held_by.groupBy("doc_id").agg(F.min("c").alias("a")), "doc_id").select("a", F.col("c").alias("b"))
    own = scratch.table(own.where("a < b").distinct(), "own", 1)
    if not (more.isEmpty() and own.isEmpty()):
        scratch.drop(part)
        part = components(links.union(more).union(own))
    scratch.drop(held, texts, lists, stars, links, placed, more, own)

    # a component's name is the least doc_id of its classes; classes without links have their own
    linked = part.withColumnRenamed("id", "c").join(classes.select("c", "least"), "c")
    lows = linked.groupBy("component").agg(F.min("least").alias("low"))
    linked = linked.select("c", "component").join(lows, "component").select("c", "low")
    named = classes.select("s1", "s2", "c", "least").join(linked, "c", "left").select("s1", "s2", F.coalesce("low", "least").alias("g"))
    whole = scratch.table(shared.join(named, ["s1", "s2"]).groupBy(F.col("doc_id").alias("d")).agg(F.min("g").alias("whole")), "whole", 1)
    scratch.settle(docs.sparkSession)
    found = made.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2"], "left").join(whole, F.col("doc_id") == F.col("d"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("whole", F.when(F.col("n") > 0, F.col("g")), "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
