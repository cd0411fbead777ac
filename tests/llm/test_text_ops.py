"""Substring dedup, near-dedup, decontamination and components against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphfactor.llm import decontaminate, neardup, substring, text
from graphfactor.llm.components import components

SCHEMA = "doc_id long, text string, seed int, place string, n int, row string"  # names that operators use too


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "p", 2, "r") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def some_texts(n, seed, words=12, length=40):
    rnd = random.Random(seed)
    vocabulary = ["the", "The", "é", "ab,", "x-y", "ß", "漢字", "1", "..", "q"] + [f"w{i}" for i in range(words)]
    texts = [rnd.choice([" ", "  ", "\n", "\t"]).join(rnd.choice(vocabulary) for _ in range(rnd.randrange(length))) for _ in range(n)]
    for _ in range(n // 3):  # copies with edits
        t = rnd.choice(texts).split()
        for _ in range(rnd.randrange(3)):
            if t:
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
        texts.append(" ".join(t))
    return texts + ["a b " * 50, "a b " * 30, "", " \n", None, "one", "one", "x " * 100]


def brute_cut(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


@pytest.mark.parametrize("window,seed,group", [(4, 1, 4096), (12, 2, 4096), (1, 3, 4096), (4, 4, 2), (12, 5, 3)])
def test_substring_dedup_equals_brute_force(spark, window, seed, group):
    texts = some_texts(60, seed)
    rows = substring.dedup(table(spark, texts), window, group).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows}
    assert got == dict(enumerate(brute_cut(texts, window)))
    for r in rows:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed


def test_factors_are_the_greedy_longest_matches():
    rnd = random.Random(12)
    for size in (1, 3, 30):
        texts = [[rnd.choice("abc") for _ in range(rnd.randrange(1, 25))] for _ in range(size)]
        texts += [t[i:] + ["z"] for t in texts for i in (0, 2) if len(t) > 2]
        group = np.array([rnd.randrange(3) * 7 for _ in texts])
        block = substring.Block([" ".join(t).encode() for t in texts], group)

        def longest(i, p):
            best = 0
            for j, other in enumerate(texts):
                for q in range(len(other)):
                    n = 0
                    while (i, p) != (j, q) and group[i] == group[j] and p + n < len(texts[i]) and q + n < len(other) and texts[i][p + n] == other[q + n]:
                        n += 1
                    best = max(best, n)
            return best

        want, asked = [], [i for i in range(len(texts)) if i % 3]
        for i in asked:
            p = 0
            while p < len(texts[i]):
                want.append((i, p, longest(i, p)))
                p += max(1, want[-1][2])
        which, at, length = block.factors(np.array(asked, np.int64))
        assert sorted(zip(which.tolist(), (at - block.bounds[which]).tolist(), length.tolist(), strict=True)) == want
        for window in (1, 4, 9):
            repeats = {(int(i), int(a) + k) for i, a, n in zip(*block.repeats(np.array(asked, np.int64), window), strict=True) for k in range(n)}
            assert repeats == {(i, p) for i in asked for p in range(len(texts[i])) if longest(i, p) >= window}


def test_substring_dedup_repeated_rows_null_ids_and_empty_table(spark):
    texts = ["a b c d e f", "a b c d e f", "g h i j", "g h i", None]
    rows = substring.dedup(table(spark, texts, [1, 1, None, None, None]), 4).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in rows) == [("1", 6), ("1", 6), ("None", 0), ("None", 0), ("None", 0)]
    assert substring.dedup(table(spark, []), 4).collect() == []


def test_word_hashes_depend_on_bytes_only():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("ab\x00é漢") for _ in range(rnd.randrange(1, 9))) for _ in range(3000)] + ["z" * 300_000]
    w = text.words([" ".join(words).encode(), b"", words[0].encode()], text.SPACED)
    h = text.word_hashes(w)
    assert w.counts.tolist() == [3001, 0, 1] and h[0] == h[-1]
    by_word = {}
    for x, y in zip([*words, words[0]], h.tolist(), strict=True):
        assert by_word.setdefault(x, y) == y
    assert len(set(by_word.values())) == len(by_word)


def test_lowest_is_the_leftmost_minimum():
    rnd = np.random.default_rng(1)
    for width in (1, 2, 3, 5, 7, 26):
        v = rnd.integers(0, 4, 60).astype(np.uint64)
        assert text.lowest(v, width).tolist() == [i + int(np.argmin(v[i : i + width])) for i in range(60 - width + 1)]


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain(t):
    return WORD.findall((t or "").encode().translate(LOW))


def brute_hits(texts, items, window):
    windows = defaultdict(set)
    for name, t in items:
        w = plain(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(name)
    out = []
    for t in texts:
        w, hit, names = plain(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((len(w), sorted(hit), sorted(str(x) for x in names if x is not None)))
    return out


@pytest.mark.parametrize("bits", [22, 6])
def test_decontamination_equals_brute_force(spark, bits):
    texts = some_texts(40, 7, words=4)
    rnd = random.Random(8)
    items = [(i, " ".join((rnd.choice(texts) or "").split()[3:14])) for i in range(15)] + [(20, "One"), (21, "one"), (22, None), (23, "!!"), (None, "w1 W2 w3"), (24, "a-B"), (24, "a-B")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    got = decontaminate.find(table(spark, texts), bench, 5, bits).collect()
    want = brute_hits(texts, items, 5)
    assert len(got) == len(texts)
    for r in got:
        places = [p for s in r.spans for p in range(s.start, s.stop)]
        assert (r.n_words, places, r["items"]) == want[r.doc_id]
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))
    clean = decontaminate.clean(table(spark, texts), bench, 5, bits).collect()
    assert {r.doc_id for r in clean} == {i for i, (_, places, _) in enumerate(want) if not places} and len(clean) == len({r.doc_id for r in clean})
    assert all(r.text == texts[r.doc_id] and r.place == "p" for r in clean)


def test_decontamination_of_many_and_long_items(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(400))) for _ in range(60)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 30)))) for i in range(400)] + [(1000 + i, t[100:400]) for i, t in enumerate(texts[:20])]
    got = decontaminate.find(table(spark, texts * 2), spark.createDataFrame(items, "item_id long, text string"), 6, 8).collect()
    want = brute_hits(texts, items, 6) * 2
    assert len(got) == 120 and {r.doc_id: (r.n_words, [p for s in r.spans for p in range(s.start, s.stop)], r["items"]) for r in got} == dict(enumerate(want))


def test_decontamination_compares_words_and_not_only_hashes(spark):
    kind = "t1 long, t2 long, marks array<struct<size:int,print:long,place:long,words:string>>"
    found = spark.createDataFrame([(1, 1, [(3, 77, 5, "a b c d")]), (2, 2, [(3, 77, 0, "x b c d")]), (3, 3, [(3, 78, 0, "a b c")])], kind)
    known = spark.createDataFrame([("i", 3, 77, "a b c"), ("j", 3, 77, "b d c")], "item string, size int, print long, window string")
    assert [(r.t1, r.place, r.window) for r in decontaminate._verified(found, known).collect()] == [(1, 5, "a b c")]


def test_decontamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.spans, r["items"]) for r in decontaminate.find(table(spark, ["a b"]), none).collect()] == [(2, [], [])]
    assert decontaminate.find(table(spark, []), none).collect() == []
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [(r.doc_id, r.n_words, len(r.spans)) for r in decontaminate.find(table(spark, ["a b", "a b", None], [None, 3, 3]), bench).orderBy("n_words", "doc_id").collect()] == [(3, 0, 0), (None, 2, 1), (3, 2, 1)]
    assert [r.text for r in decontaminate.clean(table(spark, ["a b", None, "b a"], [None, 3, 3]), bench).orderBy("text").collect()] == [None, "b a"]


def brute_groups(texts, ids, width, num, den):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = (t or "").encode().translate(LOW).split()
        sets[i] = frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("shingle,num,k,fine", [(3, 85, 64, 1024), (5, 80, 64, 1024), (2, 50, 64, 128)])
def test_near_dedup_equals_brute_force(spark, shingle, num, k, fine):
    texts = some_texts(80, shingle)
    base = [f"v{i}" for i in range(60)]
    rnd = random.Random(1)
    for _ in range(40):  # a family around one text, many with too many edits to be alike
        t = list(base)
        for _ in range(rnd.randrange(9)):
            t[rnd.randrange(len(t))] = f"e{rnd.randrange(10**6)}"
        texts.append(" ".join(t))
    ids = [i * 7 % 1009 for i in range(len(texts))]
    rows = neardup.groups(table(spark, texts, ids), shingle, num, 100, k, fine).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_groups(texts, ids, shingle, num, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and len(rows) == len(texts)


def test_near_dedup_edge_rows(spark):
    rows = neardup.groups(table(spark, ["a b c d", "a b c d", None, "", "a b c d", "A b c d"], [3, 3, 4, 5, None, 9])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in rows), key=str) == [(3, 3, True), (3, 3, True), (4, 4, True), (5, 5, True), (9, 3, False), (None, None, True)]
    assert neardup.groups(table(spark, [])).collect() == []


def test_near_dedup_of_ids_with_several_texts(spark):
    base = " ".join(f"v{i}" for i in range(28))
    rows = neardup.groups(table(spark, [base, "quite another text of this id", base + " x"], [5, 5, 9]), 3, 85, 100).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(5, 5), (9, 5)}
    rows = neardup.groups(table(spark, ["a b c d", "a b c d", "e f g h", "e f g h", "", "a b c d"], [1, 5, 5, 7, 7, None])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {(1, 1, True), (5, 1, False), (7, 1, False), (None, None, True)}


def test_near_dedup_with_repeated_ids_equals_brute_force(spark):
    rnd = random.Random(21)
    texts = [t for t in some_texts(70, 9) if t and t.split()]
    ids = [rnd.randrange(60) for _ in texts]
    rows = neardup.groups(table(spark, texts, ids), 3, 60, 100).collect()
    alone = brute_groups(texts, range(len(texts)), 3, 60, 100)
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for place, (_, group) in alone.items():
        for other in (("id", ids[place]), ("group", group)):
            up[find(("row", place))] = find(other)
    members = defaultdict(set)
    for place, i in enumerate(ids):
        members[find(("row", place))].add(i)
    want = {i: min(m) for m in members.values() for i in m}
    assert len(rows) == len(texts) and {(r.doc_id, r.component_id, r.kept) for r in rows} == {(i, g, i == g) for i, g in want.items()}


@pytest.mark.parametrize("k,fine", [(64, 1024), (4096, 4096)])
def test_long_documents_with_cut_and_whole_sketches(spark, k, fine):
    rnd = random.Random(3)
    texts = []
    for _ in range(4):
        base = [f"u{rnd.randrange(10**6)}" for _ in range(2500)]
        for edits in (0, 5, 30, 120):
            t = list(base)
            for _ in range(edits):
                t[rnd.randrange(len(t))] = f"e{rnd.randrange(10**6)}"
            texts.append(" ".join(t))
    rows = neardup.groups(table(spark, texts), 3, 85, 100, k, fine).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_groups(texts, range(len(texts)), 3, 85, 100)


def test_no_long_pair_near_the_threshold_is_missed(spark):
    rnd = random.Random(31)
    texts, alike = [], []
    for pair in range(150):
        base = [f"p{pair}x{i}" for i in range(1400 + rnd.randrange(1500))]
        other = list(base)
        # m single edits, far apart, change 3 m shingles: similarity (n - 3 m) / (n + 3 m)
        n = len(base) - 2
        most = int(n * 15 / 185 / 3)
        for at in rnd.sample(range(3, len(base) - 3, 4), most + rnd.randrange(-3, 3)):
            other[at] = "edited"
        sets = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in (base, other)]
        texts += [" ".join(base), " ".join(other)]
        alike.append(100 * len(sets[0] & sets[1]) >= 85 * len(sets[0] | sets[1]))
    rows = neardup.groups(table(spark, texts), 3, 85, 100).collect()
    assert 20 < sum(alike) < 130 and {r.doc_id: r.component_id for r in rows} == {i: i - i % 2 if alike[i // 2] else i for i in range(300)}


@pytest.mark.parametrize("num,k", [(80, 64), (85, 64), (80, 1024), (85, 1024)])
def test_bounds_of_cut_sketches_miss_no_more_than_they_say(num, k):
    def missed(c):
        return Fraction(sum(comb(k, i) * num**i * (100 - num) ** (k - i) for i in range(c)), 100**k)

    c = neardup._least(num / 100, k)
    assert missed(c) <= Fraction(1, 10**9) < missed(c + 1)


def test_components_of_paths_stars_and_loops(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (200, 201), (201, 200), (None, 5)]
    links += [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    assert got == {x: find(x) for x in up}


def test_queries_give_digests_of_real_outputs(spark):
    from graphfactor.llm import queries

    rows = queries.op1_substring_dedup(spark, "/root/testdata/sf0.001").limit(5).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        if not r.n_removed:
            assert r.kept_sha256 == hashlib.sha256(b" ".join(texts[r.doc_id].encode().split())).hexdigest()
