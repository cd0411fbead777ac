"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts and ratios over the whole text. Each is cut into bins at quantiles of the training rows. Cyclic
boosting takes the features in turn; each turn fits one shallow tree to the current log-odds gradients and adds its
leaves, shrunken, to that feature's lookup table. Then the pairs whose joint trees explain most of what is left get
tables over pairs of coarse bins in the same way. A score is the logistic of a sum of table entries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .sample import least_by_hash
from .scratch import in_batches
from .text import SPACED, mix, slices, word_hashes, words

#: Labelled rows that the model is fitted on at most, those with the least hash of doc_id.
SAMPLE = 20_000
BINS, COARSE, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, MIN_ROWS = 32, 8, 150, 8, 60, 0.15, 20

FEATURES = (
    "words (log)", "mean word length", "capitals among letters", "digits", "punctuation", "exclamation marks", "bars and brackets",
    "words equal to the one before", "distinct words (log ratio)", "share of the commonest word", "words in capitals only", "words of one or two bytes",
    "bytes above 127", "line breaks per word", "share of repeated lines", "words with digits", "longest word (log)", "words that end a sentence",
)

#: Text bytes at once; features take some 150 bytes of memory each.
_SLICE = 1 << 19
_GAP = re.compile(rb"[\x09-\x0D\x20]")

_CLASS = np.zeros(256, np.uint8)
_UPPER, _LOWERCASE, _DIGIT, _PUNCT, _BANG, _BAR, _HIGH, _BREAK = 1, 2, 3, 4, 5, 6, 7, 8
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = _UPPER, _LOWERCASE, _DIGIT, _HIGH
_CLASS[[*b"""\"#$%&'()*+,-./:;=?@\\^_`~"""]] = _PUNCT
_CLASS[[*b"!"]], _CLASS[[*b"|<>[]{}"]], _CLASS[[*b"\n"]] = _BANG, _BAR, _BREAK


class Counts(NamedTuple):
    """What the features of texts are made of, one number per text."""

    size: np.ndarray  # bytes
    kinds: list[np.ndarray]  # bytes of each kind
    words: np.ndarray
    word_bytes: np.ndarray
    same: np.ndarray  # words equal to the one before
    distinct: np.ndarray
    commonest: np.ndarray  # times that the commonest word stands there
    capitals: np.ndarray  # words in capitals only
    short: np.ndarray  # words of one or two bytes
    with_digits: np.ndarray
    longest: np.ndarray
    ends: np.ndarray  # words that end a sentence
    lines: np.ndarray  # lines with words
    repeated: np.ndarray  # lines that stood there before

    def features(self) -> np.ndarray:
        size, per = np.maximum(self.size, 1), np.maximum(self.words, 1)
        letters = np.maximum(self.kinds[_UPPER] + self.kinds[_LOWERCASE] + self.kinds[_HIGH], 1)
        share = [self.kinds[k] / size for k in range(9)]
        return np.stack(
            [
                np.log1p(self.words), self.word_bytes / per, self.kinds[_UPPER] / letters, share[_DIGIT], share[_PUNCT], share[_BANG], share[_BAR],
                self.same / per, np.log(np.maximum(self.distinct, 1)) / np.maximum(np.log(np.maximum(self.words, 2)), 0.5), self.commonest / per,
                self.capitals / per, self.short / per, share[_HIGH], self.kinds[_BREAK] / per, self.repeated / np.maximum(self.lines, 1),
                self.with_digits / per, np.log1p(self.longest), self.ends / per,
            ],
            axis=1,
        )


def features(texts: list[bytes], longest: int = 0) -> np.ndarray:
    """One row of features per text; an empty text has zeros. Texts beyond ``longest`` bytes (_SLICE) are read in parts."""
    limit = longest or _SLICE
    out = np.empty((len(texts), len(FEATURES)))
    short = [i for i, t in enumerate(texts) if len(t) <= limit]
    if short:
        out[short] = _counted([texts[i] for i in short]).features()
    for i, t in enumerate(texts):
        if len(t) > limit:
            out[i] = _counted_in_parts(t, limit).features()[0]
    return out


def _grouped(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of groups of equal (key, hash), in order, and the sizes of the groups."""
    order = np.lexsort((hashes, keys))
    k, h = keys[order], hashes[order]
    head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])) if len(k) else np.empty(0, np.int64)
    return k[head], np.diff(head, append=len(k))


def _line_hashes(hashes: np.ndarray, line: np.ndarray, before: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First word of each line, and a sum over the line's words and their places; ``before`` words stand in the first line already."""
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    new = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    place = np.arange(len(hashes)) - np.repeat(new, np.diff(new, append=len(hashes)))
    place[: new[1] if len(new) > 1 else len(place)] += before
    return new, np.add.reduceat(mix(hashes + place.astype(np.uint64)), new)


def _counted(texts: list[bytes]) -> Counts:
    m = len(texts)
    w = words(texts, SPACED)
    kind = _CLASS[w.buffer]
    lengths = np.array([len(t) + 1 for t in texts])
    first = np.concatenate([[0], np.cumsum(lengths)])
    sums = [np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)]) for k in range(9)]
    doc = np.repeat(np.arange(m), w.counts)
    by_doc = lambda x: np.bincount(doc, x, m)
    word_size, hashes = (w.ends - w.starts).astype(float), word_hashes(w)
    inside = lambda k: sums[k][w.ends] - sums[k][w.starts]
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    of, times = _grouped(doc, hashes)
    commonest, longest = np.zeros(m), np.zeros(m)
    np.maximum.at(commonest, of, times)
    np.maximum.at(longest, doc, word_size)
    last = w.buffer[w.ends - 1]
    new, line_hash = _line_hashes(hashes, sums[_BREAK][w.starts] + doc)
    line_doc = doc[new]
    lines = np.bincount(line_doc, minlength=m)
    return Counts(
        lengths - 1, [(s[first[1:]] - s[first[:-1]]).astype(float) for s in sums], w.counts.astype(float), by_doc(word_size), by_doc(same), np.bincount(of, minlength=m), commonest,
        by_doc((inside(_UPPER) > 1) & (inside(_LOWERCASE) == 0)), by_doc(word_size <= 2), by_doc(inside(_DIGIT) > 0), longest, by_doc((last == 0x2E) | (last == 0x3F)),
        lines, lines - np.bincount(_grouped(line_doc, line_hash)[0], minlength=m),
    )


def _counted_in_parts(text: bytes, step: int) -> Counts:
    """Counts of one long text, some ``step`` bytes at a time; different words and lines are kept as hashes."""
    total = np.zeros(10)
    kinds = np.zeros(9)
    word_hash, word_times, lines = np.empty(0, np.uint64), np.empty(0, np.int64), [np.empty(0, np.uint64)]
    longest, last_hash, open_words, open_sum, at = 0.0, None, 0, np.uint64(0), 0
    while at < len(text):
        gap = _GAP.search(text, min(at + step, len(text)))
        stop = gap.end() if gap else len(text)
        w = words([text[at:stop]], SPACED)
        at = stop
        kind = _CLASS[w.buffer]
        kinds += np.bincount(kind, minlength=9)
        # the space that ends the buffer is of no kind that is asked for
        sums = {k: np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)]) for k in (_UPPER, _LOWERCASE, _DIGIT, _BREAK)}
        breaks = int(sums[_BREAK][-1])
        inside = lambda k: sums[k][w.ends] - sums[k][w.starts]  # noqa: B023, E731
        hashes, size = word_hashes(w), w.ends - w.starts
        if len(hashes):
            line = sums[_BREAK][w.starts]
            before, carried = (open_words, open_sum) if line[0] == 0 else (0, np.uint64(0))
            if line[0] and open_words:
                lines.append(np.array([open_sum]))
            new, found = _line_hashes(hashes, line, before)
            found[:1] += carried
            open_words, open_sum = len(hashes) - int(new[-1]) + (before if len(new) == 1 else 0), found[-1]
            lines.append(found[:-1])
            if line[-1] < breaks:
                lines.append(np.array([open_sum]))
                open_words, open_sum = 0, np.uint64(0)
            last = w.buffer[w.ends - 1]
            total += [
                len(hashes), size.sum(), (hashes[1:] == hashes[:-1]).sum() + (last_hash is not None and hashes[0] == last_hash), 0, 0,
                ((inside(_UPPER) > 1) & (inside(_LOWERCASE) == 0)).sum(), (size <= 2).sum(), (inside(_DIGIT) > 0).sum(), 0, ((last == 0x2E) | (last == 0x3F)).sum(),
            ]
            longest, last_hash = max(longest, float(size.max())), hashes[-1]
            word_hash, of = np.unique(np.concatenate([word_hash, hashes]), return_inverse=True)
            word_times = np.bincount(of, np.concatenate([word_times, np.ones(len(hashes))])).astype(np.int64)
        elif breaks and open_words:
            lines.append(np.array([open_sum]))
            open_words, open_sum = 0, np.uint64(0)
    if open_words:
        lines.append(np.array([open_sum]))
    line_hash = np.concatenate(lines)
    total[3], total[4], total[8] = len(word_hash), word_times.max(initial=0), longest
    one = lambda x: np.array([float(x)])
    return Counts(one(len(text)), list(map(one, kinds)), *map(one, total), one(len(line_hash)), one(len(line_hash) - len(np.unique(line_hash))))


class Model(NamedTuple):
    base: float
    cuts: list[np.ndarray]  # of each feature
    tables: list[np.ndarray]  # by bin
    coarse: list[np.ndarray]  # coarse bin of each bin
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)]
        z = np.full(len(x), self.base)
        for b, t in zip(bins, self.tables, strict=True):
            z += t[b]
        for i, j, t in self.pairs:
            z += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins in two."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(gl):
        return 0.0, 0
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain[(nl < MIN_ROWS) | (n.sum() - nl < MIN_ROWS)] = 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Leaf value of each bin of a shallow tree, grown by its best split."""
    parts = [(0, len(g), *_best_split(g, h, n))]
    while len(parts) < leaves and max(p[2] for p in parts) > 1e-9:
        p = max(parts, key=lambda p: p[2])
        parts.remove(p)
        for a, b in ((p[0], p[0] + p[3]), (p[0] + p[3], p[1])):
            parts.append((a, b, *_best_split(g[a:b], h[a:b], n[a:b])))
    out = np.zeros(len(g))
    for a, b, *_ in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree that cuts one axis and then each side on the other; the better of both ways."""
    best = 0.0, np.zeros(g.shape)
    for turn in (False, True):
        a, b, c = (x.T if turn else x for x in (g, h, n))
        _, k = _best_split(a.sum(1), b.sum(1), c.sum(1))
        out, gain = np.zeros(a.shape), -_gain(a.sum(), b.sum())
        for rows in (slice(0, k), slice(k, None)):
            if a[rows].size:
                _, j = _best_split(a[rows].sum(0), b[rows].sum(0), c[rows].sum(0))
                for columns in (slice(0, j), slice(j, None)):
                    gs, hs = a[rows, columns].sum(), b[rows, columns].sum()
                    out[rows, columns], gain = -gs / (hs + 1.0), gain + _gain(gs, hs)
        if gain > best[0]:
            best = float(gain), out.T if turn else out
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on feature rows and labels 0/1. Without rows of both labels the model is their smoothed share."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    width = len(FEATURES)
    if len(np.unique(y)) < 2:
        return Model(base, [np.empty(0)] * width, [np.zeros(1)] * width, [np.zeros(1, np.int64)] * width, [])
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(width)]
    bins = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(len(y), base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, tables, strict=True)]
    for _ in range(ROUNDS):
        for i, (b, t) in enumerate(zip(bins, tables, strict=True)):
            g, h = gradients()
            step = RATE * _tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), counts[i])
            t += step
            z += step[b]
    coarse = [np.arange(len(t)) * COARSE // len(t) for t in tables]
    cells = lambda i, j: coarse[i][bins[i]] * COARSE + coarse[j][bins[j]]
    grid = lambda c, v=None: np.bincount(c, v, COARSE * COARSE).reshape(COARSE, COARSE)
    g, h = gradients()
    gains = sorted(((_pair_tree(grid(c := cells(i, j), g), grid(c, h), grid(c))[0], i, j) for i, j in combinations(range(width), 2)), key=lambda r: (-r[0], r[1:]))
    pairs = [(i, j, np.zeros((COARSE, COARSE)), cells(i, j)) for gain, i, j in gains[:PAIRS] if gain > 1e-9]
    for _ in range(PAIR_ROUNDS):
        for _, _, t, c in pairs:
            g, h = gradients()
            step = RATE * _pair_tree(grid(c, g), grid(c, h), grid(c))[1]
            t += step
            z += step.ravel()[c]
    return Model(base, cuts, tables, coarse, [(i, j, t) for i, j, t, _ in pairs])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch, texts in slices(whole, limit=_SLICE):
            x = features(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text, modulo 5, is 0. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows that are not held out: doc_id and text of docs, doc_id and quality of labels.

    At most ``sample`` labels are used, those with the least hash of doc_id; they are broadcast, a few bytes each.
    Null ids, null labels and labels without a document are left out; of several labels of an id the largest counts;
    repeated documents count once. The driver sees features of the sample only.
    """
    use = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    use = least_by_hash(use, sample, "doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(use), "doc_id").select("doc_id", "label", "text")
    found = rows.transform(in_batches, _rows, "doc_id long, label int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("row"))
    found = sorted((r["doc_id"], r["row"]["label"], r["row"]["x"]) for r in found.collect())
    x, y = np.array([x for *_, x in found], float).reshape(-1, len(FEATURES)), np.array([y for _, y, _ in found], float)
    del found
    scratch.settle(docs.sparkSession)
    return fit(x, y)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole, limit=_SLICE):
                kept = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(model.score(features(texts)))], [*kept, "score"])

    return run


def score(docs: DataFrame, model: Model, carry: bool = False) -> DataFrame:
    """Score every text: doc_id, score (0 to 1, higher: quality 1 likelier), one row per row of docs.

    With ``carry`` also row, a struct of all columns of docs. Null texts score as empty ones; equal texts score alike.
    """
    docs = docs.select("doc_id", *([F.struct("*").alias("row")] if carry else []), "text")
    out = T.StructType([f for f in docs.schema if f.name != "text"]).add("score", "double")
    return docs.transform(in_batches, _scores(model), out)
