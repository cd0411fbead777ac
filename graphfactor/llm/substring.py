"""Substring dedup by Relative Lempel-Ziv parsing.

The corpus is its own reference. Reference and documents are taken as *stretches*: neighbouring windows of ``window``
words with one seed (the run of SEED words with the least hash) form a stretch. Two places with the same window
have the same seed in it, so a document only has to be parsed against the reference blocks that index its seeds: a
block is a hash partition of the seeds, with one copy of each different stretch around them. Reading every document
against all other blocks, which is quadratic, would find nothing more.

1. seeds that stand at one place only are dropped (count by seed, then a join, which may split hot seeds);
2. a stretch that stands elsewhere as a whole is one factor (count by seed and stretch);
3. each other stretch is parsed greedily against its block, whose words have a suffix array: from its first word on,
   the longest match with any other stretch of the block is a factor, and the next factor begins behind it;
4. factors of ``window`` words and more are duplicate spans. A window that crosses factor boundaries is in no factor;
   these windows are checked one by one for a match of their own;
5. each document joins its factors to the longest spans and cuts the words they cover.

Blocks compare words; whole stretches and seeds have 64-bit hashes each. All counts are combined before they are
shuffled; what a document gathers is bounded by its own length. A seed of more than GROUP different stretches would be
a hot spot of its block, so its windows are counted over the cluster instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .scratch import in_batches
from .text import PART, SPACED, Runs, Spoken, covered, repeated, signed, slices, stretches, word_hashes, word_parts, words

#: Words of a seed; at most the window.
SEED = 10
#: Stretches of one seed that a block takes, and stretches after which a block is parsed.
GROUP, BLOCK = 4096, 4096
#: A stretch with more than this part of all rows is looked up by broadcast: one over HOT.
HOT = 1000


def _find(window: int, limit: int = PART):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole):
                for w, before in word_parts(texts, SPACED, window - 1, limit=limit):
                    runs, owner = Runs(word_hashes(w)), np.repeat(np.arange(len(texts)), w.counts)
                    found = stretches(runs, owner, window, min(SEED, window))
                    doc = owner[found.first]
                    place = (found.first - w.bounds[doc] + before) << 16 | found.count
                    yield pa.RecordBatch.from_arrays(
                        [repeated(batch.column("d"), doc), repeated(batch.column("t"), doc), signed(found.seed), signed(runs.at(found.first, found.count + window - 1)), pa.array(place)],
                        ["d", "t", "seed", "stretch", "place"],
                    )

    return run


def _taken(window: int, limit: int = PART):
    """The words of listed stretches, or hashes of the windows of those whose seed is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole):
                listed = batch.column("listed")
                rows, text_of = listed.flatten(), np.repeat(np.arange(len(texts)), np.diff(listed.offsets.to_numpy()))
                place, hot = rows.field("place").to_numpy(), rows.field("hot").to_numpy(zero_copy_only=False)
                start, windows = place >> 16, place & 0xFFFF
                for w, before in word_parts(texts, SPACED, window - 1, limit=limit):
                    runs, spoken = Runs(word_hashes(w)), Spoken(w)
                    # a stretch lies in the part in which it was found
                    here = np.flatnonzero((start >= before) & (start + windows + window - 1 <= before + w.counts[text_of]))
                    count = np.where(hot, windows, 1)[here]
                    for some in _portions(count, 20_000):
                        row = np.repeat(here[some], count[some])
                        doc, nth = text_of[row], np.arange(len(row)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
                        at, n = start[row] + nth, np.where(hot[row], window, windows[row] + window - 1)
                        first = at - before + w.bounds[doc]
                        key = pa.array(runs.at(first, n).view(np.int64), mask=~hot[row])
                        yield pa.RecordBatch.from_arrays(
                            [repeated(batch.column("d"), doc), repeated(batch.column("t"), doc), repeated(rows.field("seed"), row), repeated(rows.field("asked"), row), key, pa.array(at << 16 | np.where(hot[row], 1, windows[row])), spoken.take(first, np.where(hot[row], 0, n))],
                            ["d", "t", "seed", "asked", "window", "place", "words"],
                        )

    return run


def _portions(sizes: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Places of rows whose sizes add up to about ``limit``."""
    part = (np.cumsum(sizes) - sizes) // limit
    yield from np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1)


class Block:
    """Words of stretches with a suffix array, which tells the longest match of every place with any other.

    group: stretches are compared within their group only.
    """

    def __init__(self, texts: list[bytes], group: np.ndarray):
        w = words(texts, SPACED)
        n = len(w.starts)
        spoken = Spoken(w)
        told = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(spoken.ends.astype(np.int32)), pa.py_buffer(spoken.row)]).dictionary_encode()
        self.bounds, at = w.bounds, np.arange(n)
        owner = np.repeat(np.arange(len(texts)), w.counts)
        left = w.bounds[1:][owner] - at  # words to the end of the stretch
        rank = np.unique(group[owner] * np.int64(n + 1) + told.indices.to_numpy(), return_inverse=True)[1]
        #: rank of the 1, 2, 4, ... words from each place, or of as many as there are
        ranks, span = [rank], 1
        while span < left.max(initial=0):
            behind = np.where(left > span, rank[np.minimum(at + span, n - 1)] + 1, 0)
            rank = np.unique(rank * np.int64(n + 1) + behind, return_inverse=True)[1]
            ranks.append(rank)
            span *= 2
        order = np.argsort(rank, kind="stable")
        a, b = order[:-1], order[1:]
        common = np.zeros(max(n - 1, 0), np.int64)
        room = np.minimum(left[a], left[b])
        for k in reversed(range(len(ranks))):
            step = 1 << k
            fits = common + step <= room
            same = fits & (ranks[k][np.minimum(a + common, n - 1)] == ranks[k][np.minimum(b + common, n - 1)])
            common += np.where(same, step, 0)
        #: words that the longest match of each place has
        self.longest = np.zeros(n, np.int64)
        self.longest[a] = common
        self.longest[b] = np.maximum(self.longest[b], common)

    def factors(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy parse of the asked stretches: stretch, place and length of each factor; a word without match has length 0."""
        which, at = asked, self.bounds[asked]
        out = []
        while len(at):
            live = at < self.bounds[which + 1]
            which, at = which[live], at[live]
            length = self.longest[at]
            out.append((which, at, length))
            at = at + np.maximum(length, 1)
        return tuple(np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out, strict=True) if out else ((),) * 3))

    def repeats(self, asked: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of the asked stretches that stand elsewhere too: stretch, first window (from 0), number of windows."""
        which, at, length = self.factors(asked)
        wide = length >= window
        # windows that begin before a boundary between two factors and end behind it
        inner = at[at > self.bounds[which]]
        crossing = covered(np.maximum(inner - window + 1, 0), inner, len(self.longest))
        edge = np.flatnonzero(crossing & (self.longest >= window))
        owner = np.searchsorted(self.bounds, edge, "right") - 1
        mine = np.zeros(len(self.bounds), bool)
        mine[asked] = True
        edge, owner = edge[mine[owner]], owner[mine[owner]]
        head = np.flatnonzero(np.concatenate([[True], (np.diff(edge) > 1) | (np.diff(owner) > 0)])) if len(edge) else np.empty(0, np.int64)
        which, first = np.concatenate([which[wide], owner[head]]), np.concatenate([at[wide], edge[head]])
        count = np.concatenate([length[wide] - window + 1, np.diff(head, append=len(edge))])
        return which, first - self.bounds[which], count


def _factors(window: int):
    """Parse stretches, which come ordered by seed, block by block; a seed's stretches are in one block."""

    def parsed(block: pa.Table) -> pa.RecordBatch:
        _, group = np.unique(block.column("seed").to_numpy(), return_inverse=True)
        texts = block.column("words").combine_chunks().cast(pa.binary()).to_pylist()
        asked = np.flatnonzero(block.column("asked").combine_chunks().to_numpy(zero_copy_only=False))
        which, first, count = Block(texts, group).repeats(asked, window)
        place = block.column("place").to_numpy()[which]
        taken = block.select(["d", "t"]).take(pa.array(which)).combine_chunks()
        columns = [c.chunk(0) if c.num_chunks else pa.array([], pa.int64()) for c in taken.columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(((place >> 16) + first) << 16 | count)], ["d", "t", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < BLOCK:
                continue
            block = pa.Table.from_batches(held)
            seeds = block.column("seed").to_numpy()
            whole = int(np.searchsorted(seeds, seeds[-1]))
            if whole:
                yield parsed(block.slice(0, whole))
                held, size = block.slice(whole).to_batches(), size - whole
        if size:
            yield parsed(pa.Table.from_batches(held))

    return run


def _cut(window: int, limit: int = PART):
    def cut(text: bytes, places: list[int] | None) -> tuple[bytes, list[dict], int, int]:
        if not places and len(text) <= limit:
            all_words = text.split()
            return b" ".join(all_words), [], len(all_words), 0
        p = np.array(places or [], np.int64)
        stops = (p >> 16) + (p & 0xFFFF) - 1 + window
        gone = covered(p >> 16, stops, int(stops.max(initial=0)))
        edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
        factors, kept, n = list(zip(edge[::2], edge[1::2], strict=True)), [], 0
        for w, _ in word_parts([text], SPACED, 0, limit=limit) if len(text) > limit else [(None, 0)]:
            some = (text if w is None else w.buffer.tobytes()).split()
            rest, at = [], 0
            for start, stop in factors:
                start, stop = max(start - n, 0), min(stop - n, len(some))
                if start < stop:
                    rest += some[at:start]
                    at = stop
            rest += some[at:]
            n += len(some)
            if rest:
                kept.append(b" ".join(rest))
        return b" ".join(kept), [{"start": a, "stop": b} for a, b in factors], n, int(gone.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for whole in batches:
            for batch, texts in slices(whole):
                columns = zip(*map(cut, texts, batch.column("places").to_pylist()), strict=True)
                arrays = [pa.array(x, kind) for x, kind in zip(columns, (pa.binary(), spans, pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), arrays[0].cast(pa.string()), *arrays[1:]], ["doc_id", "kept_text", "spans", "n_words", "n_removed"])

    return run


def dedup(docs: DataFrame, window: int = 35, group: int = GROUP) -> DataFrame:
    """Cut every word covered by ``window`` words that also stand elsewhere in the corpus (or in the same text).

    docs: doc_id (long) and text; other columns are not read. Words are runs of bytes other than space and tab to
    carriage return. Returns one row per row of docs: doc_id, kept_text (the other words, joined by one space),
    spans (start, stop: cut words from 0), n_words, n_removed.

    Null text: no words, empty kept_text. Texts of fewer than ``window`` words: nothing is cut. Null doc_id and
    repeated rows: each row counts as a document of its own, so the words of a repeated row are all cut if it has
    ``window`` of them. Rows with one doc_id and different texts are different documents. Empty table: no rows.
    ``group`` changes where stretches are compared (see above), not what is found.
    """
    if not 1 <= window < 1 << 15:
        raise ValueError("window must lie between 1 and 32767 words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", F.coalesce("doc_id", F.xxhash64(F.lit("no id"), "text")).alias("d"), F.xxhash64("text").alias("t"), "text")
    found = rows.select("d", "t", "text").transform(in_batches, _find(window), "d long, t long, seed long, stretch long, place long")
    # a table of its own, so that Spark may split the join's partitions of hot seeds
    seeds = scratch.table(found.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), "seeds")
    found = scratch.table(found.join(seeds, "seed"), "found")

    index = scratch.table(found.groupBy("seed", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "place")).alias("one")), "index")
    # fewer than HOT stretches can have more than 1 / HOT of the rows: these are broadcast, the others shuffled
    total = index.agg(F.sum("n")).first()[0] or 0
    key, hot = ["seed", "stretch"], F.col("n") > total // HOT
    often, seldom = (index.where((F.col("n") > 1) & x).select(key) for x in (hot, ~hot))
    often = F.broadcast(often)
    factors = found.join(often, key).union(found.join(often, key, "left_anti").join(seldom, key)).select("d", "t", "place")

    mixed = index.groupBy("seed").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
    mixed = mixed.select("seed", (F.col("m") > group).alias("hot"))
    listed = index.join(mixed, "seed").select("one.d", "one.t", F.struct("one.place", "seed", (F.col("n") == 1).alias("asked"), "hot").alias("row"))
    listed = listed.groupBy("d", "t").agg(F.collect_set("row").alias("listed"))
    taken = rows.select("d", "t", "text").join(listed, ["d", "t"])
    taken = scratch.table(taken.transform(in_batches, _taken(window), "d long, t long, seed long, asked boolean, window long, place long, words string"), "reference")
    parsed = taken.where("window is null").select("d", "t", "seed", "asked", "place", "words").repartition("seed").sortWithinPartitions("seed")
    parsed = parsed.transform(in_batches, _factors(window), "d long, t long, place long")
    windows = taken.where("window is not null").select("d", "t", "seed", "asked", "window", "place")
    again = windows.groupBy("seed", "window").agg(F.count("*").alias("n")).where("n > 1").select("seed", "window")
    edges = windows.where("asked").join(again, ["seed", "window"]).select("d", "t", "place")

    places = scratch.table(factors.union(parsed).union(edges).groupBy("d", "t").agg(F.collect_set("place").alias("places")), "places")
    scratch.drop(seeds, found, index, taken)
    scratch.settle(docs.sparkSession)
    return rows.join(places, ["d", "t"], "left").select("doc_id", "text", "places").transform(
        in_batches, _cut(window), "doc_id long, kept_text string, spans array<struct<start:long,stop:long>>, n_words long, n_removed long"
    )
