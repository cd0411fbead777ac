"""License scans, revisits, quality, URL lists, mixing, token files, GIF and the pipeline."""

import random
import re
import zlib
from collections import Counter
from math import log, log1p

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphfactor.llm import asof, gif, licenses, mixing, neardup, quality, revisits, tokens, urllists

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, score int, row string, t string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "r", "t") for i, t, s in rows], DOCS)


# license scans


def test_license_places_spans_and_edge_rows(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."
    near = gpl.replace("redistribute it", "kindly redistribute it").replace("modify", "change")
    rows = [(1, "x MIT License, mit license. THE Apache-License", "a"), (2, None, None), (2, None, None), (3, "", "a"), (4, gpl, "a"), (5, near, "a"), (None, "cc by", "a"), (6, "mit, cc, by", "a"), (7, "mit license MİT LICENSE mitK license", "a")]
    got = sorted(licenses.scan(docs(spark, rows)).collect(), key=lambda r: (str(r.doc_id), r.n_words))
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and sum(r.doc_id == 2 for r in got) == 2
    assert [(p.label, p.start) for p in by[1].places] == [("apache", 6), ("mit", 1), ("mit", 3)] and by[1].score == 1.0 and by[1].n_words == 8
    assert by[2].n_words == 0 and by[2].score == 0 and by[2].labels == [] and by[3].labels == []
    assert by[4].labels == ["gpl"] and [s.label for s in by[4].spans] and by[5].labels == ["gpl"] and by[5].spans[0].share < 1
    assert by[None].labels == ["cc-by"] and [(p.label, p.start) for p in by[6].places] == [("cc-by", 1)]
    assert by[7].labels == [] and licenses.scan(docs(spark, [])).collect() == []


def test_license_spans_are_beaten_by_rivals_on_the_same_words_only(spark):
    bsd = "Redistribution and use in source and binary forms, without modification, are permitted provided that the following conditions are met"
    rows = [
        (1, f"All rights reserved. {bsd}", "a"),
        (2, f"{bsd.replace('are met', 'all rights reserved are met')}", "a"),
        (3, "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "a"),
        (4, "x licensed under cc by sa 4 0 all rights reserved released under the mit license", "a"),
    ]
    by = {r.doc_id: [(s.label, s.start, s.stop) for s in r.spans] for r in licenses.scan(docs(spark, rows)).collect()}
    assert by[1] == [("all-rights-reserved", 0, 3), ("bsd", 3, 22)]
    assert [x[0] for x in by[2]] == ["all-rights-reserved", "bsd"] and by[3] == [("lgpl", 0, 23)]
    assert by[4] == [("all-rights-reserved", 8, 11), ("cc-by-sa", 1, 8), ("mit", 11, 16)]


def brute_spans(text):
    """Places, spans and labels by the definitions: diagonals of each template's word pairs, bands, shares, rivals."""
    w = [x.lower() for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    places = sorted((label, i) for label, phrase in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    spans = []
    for label, template in licenses.TEMPLATES:
        t = template.split()
        hits = {}
        for p in range(len(w) - 1):
            for q in range(len(t) - 1):
                if w[p : p + 2] == t[q : q + 2]:
                    hits.setdefault(p - q, []).append((p, q))
        bands = []
        for diagonal in sorted(hits):
            if bands and diagonal - bands[-1][0] <= licenses.NEAR:
                bands[-1][0] = diagonal
                bands[-1][1] += hits[diagonal]
            else:
                bands.append([diagonal, list(hits[diagonal])])
        for _, found in bands:
            share, at = len({q for _, q in found}) / (len(t) - 1), {p for p, _ in found}
            if share >= licenses.ENOUGH:
                spans.append((label, min(at), max(at) + 2, share, at))
    beaten = lambda s: any(o[3] > s[3] and o[1] < s[2] and s[1] < o[2] and len(s[4] & o[4]) >= licenses.SAME * len(s[4]) for o in spans)
    return len(w), places, sorted(s[:4] for s in spans if not beaten(s))


def test_license_scan_equals_brute_force(spark):
    rnd = random.Random(15)
    parts = [t for _, t in licenses.TEMPLATES] + [t for _, t in licenses.PHRASES] + ["of the", "this is", "under the terms of the"]
    texts = []
    for _ in range(250):
        words = " ".join(rnd.choice(parts) if rnd.random() < 0.6 else rnd.choice(["code", "the", "a", "license"]) for _ in range(rnd.randrange(1, 9))).split()
        for _ in range(rnd.randrange(6)):
            k = rnd.randrange(len(words) + 1)
            words[k : k + rnd.randrange(3)] = [rnd.choice(["Kindly", "the", "of", "x"])] * rnd.randrange(3)
        texts.append(rnd.choice([" ", ", ", "\n"]).join(words).replace("license", rnd.choice(["license", "License", "LICENSE"])))
    got = licenses.scan(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    assert len(got) == len(texts)
    for r in got:
        n, places, spans = brute_spans(texts[r.doc_id])
        assert (r.n_words, [tuple(p) for p in r.places]) == (n, places)
        assert sorted((s.label, s.start, s.stop, s.share) for s in r.spans) == spans
        assert r.labels == sorted({x[0] for x in places + spans}) and r.score == max([1.0] * bool(places) + [s[3] for s in spans], default=0)


# as-of join, revisits, URL lists


@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_equals_brute_force(spark, inclusive):
    rnd = random.Random(4)
    left = [(rnd.choice(["hot", "hot", "b", "c", None]), rnd.choice([None, *range(-20, 60)]), (i,)) for i in range(200)]
    right = [(rnd.choice(["hot", "hot", "b", None]), rnd.choice([None, *range(-20, 60)]), (i,)) for i in range(120)]
    kind = "key string, t long, row struct<i:int>"
    got = asof.latest(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), 7, inclusive).collect()
    for r in got:
        fit = [(t, i) for k, t, (i,) in right if k is not None and k == r.key and t is not None and r.t is not None and (t <= r.t if inclusive else t < r.t)]
        assert (r.found.i if r.found else None) == (max(fit)[1] if fit else None)
    assert len(got) == len(left)


def test_revisits_check_validators_and_merge_permitted_headers(spark):
    kind = "record_id long, url string, fetched long, kind string, etag string, last_modified string, headers map<string,string>, body string, key string"
    rows = [
        (1, "HTTP://www.A.com:80/x/?b=1&utm_q=2&a=2#f", 10, "response", '"e"', "m", {"etag": '"e"', "server": "s", "date": "1"}, "one", "k"),
        (2, "https://a.com/x?a=2&b=1", 20, "response", '"f"', "n", {"date": "2"}, "two", "k"),
        (3, "a.com/x?a=2&b=1", 15, "revisit", 'W/"e"', None, {"date": "9", "server": "evil"}, None, "k"),
        (4, "http://a.com/x?b=1&a=2", 20, "revisit", None, "m", None, None, "k"),
        (5, "http://a.com/x?b=1&a=2", 21, "revisit", '"e"', "n", {}, None, "k"),
        (6, "http://a.com/x?b=1&a=2", 10, "revisit", '"e"', "n", {}, None, "k"),
        (7, None, 99, "revisit", '"e"', "n", {}, None, "k"),
        (8, "http://a.com/x?b=1&a=2", 30, "revisit", None, None, {}, None, "k"),
        (8, "http://a.com/x?b=1&a=2", 30, "revisit", None, None, {}, None, "k"),
        (9, "http://a.com/y", 30, "request", None, None, {}, None, "k"),
        (10, "http://a.com/x?b=1&a=2", None, "revisit", '"e"', None, {}, None, "k"),
    ]
    got = revisits.resolve(spark.createDataFrame(rows, kind), bucket=4).collect()
    by = {r.record_id: r for r in got}
    assert len(got) == 8
    assert by[3].outcome == "resolved" and by[3].response_id == 1 and by[3].body == "one" and by[3].headers == {"etag": '"e"', "server": "s", "date": "9"}
    assert by[4].outcome == "resolved" and by[4].headers["date"] == "1"
    assert by[5].outcome == "validators differ" and by[5].body is None and by[5].headers is None
    assert by[6].outcome == by[7].outcome == by[10].outcome == "no earlier response" and by[8].outcome == "no validator"
    assert revisits.resolve(spark.createDataFrame([], kind)).collect() == []


def test_revisits_of_repeated_ids_profiles_and_targets(spark):
    kind = "record_id long, url string, fetched long, kind string, etag string, last_modified string, headers map<string,string>, body string, profile string, refers_to string"
    good, other = "http://netpreserve.org/warc/1.0/revisit/server-not-modified", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
    rows = [
        (1, "a.com/x", 10, "response", '"e"', "m", {}, "b1", None, None),
        (1, "a.com/x", 10, "response", '"e"', "m", {}, "b2", None, None),
        (None, "a.com/y", 10, "response", '"y"', "m", {"age": "1"}, "by", None, None),
        (3, "a.com/x", 20, "revisit", '"e"', None, {}, None, None, None),
        (4, "a.com/x", 20, "revisit", '"e"', None, {}, None, other, None),
        (5, "b.com/z", 20, "revisit", '"e"', None, {}, None, good, "http://a.com/x"),
        (6, "a.com/y", 20, "revisit", '"y"', None, None, None, good, None),
    ]
    seen = set()
    for order in range(6):
        table = spark.createDataFrame(random.Random(order).sample(rows, len(rows)), kind).repartition(1 + order)
        got = {r.record_id: (r.url, r.outcome, r.response_id, r.body) for r in revisits.resolve(table).collect()}
        seen.add(str(sorted(got.items())))
    assert len(seen) == 1 and got[3][3] in ("b1", "b2") and got[5] == ("a.com/x", "resolved", 1, got[3][3])
    assert got[4] == ("a.com/x", "other profile", None, None) and got[6] == ("a.com/y", "resolved", None, "by")


def test_url_lists_equal_brute_force(spark):
    rnd = random.Random(6)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "notb.org", "A.com."]
    entries = [(rnd.choice([*hosts, ".a.com", None]), rnd.choice(["block", "allow", "remove", None]), rnd.choice([None, *range(40)])) for _ in range(60)]
    captures = [(i, rnd.choice([f"http://u@{rnd.choice(hosts)}:8/p@q", rnd.choice(hosts).upper(), None, "", "//"]), rnd.choice([None, *range(50)])) for i in range(150)]
    got = urllists.evaluate(spark.createDataFrame(captures, "capture_id long, url string, fetched long").withColumn("domain", F.lit(1)), spark.createDataFrame(entries, "domain string, action string, listed long"), bucket=6).collect()
    clean = {}
    for d, a, t in entries:
        if None not in (d, a, t):
            k = (d.lower().strip("."), t)
            clean[k] = min(a, clean.get(k, "zzz"))
    for r in got:
        best = None
        if r.host and r.fetched is not None:
            for d in {k[0] for k in clean}:
                if r.host == d or r.host.endswith("." + d):
                    active = max((t for k, t in clean if k == d and t <= r.fetched), default=None)
                    if active is not None and clean[d, active] != "remove" and (best is None or len(d) > len(best[0])):
                        best = (d, clean[d, active], active)
        assert ((r.domain, r.action, r.valid_from) if r.domain else None) == best and r.blocked == (best is not None and best[1] == "block")
    assert len(got) == len(captures) and sum(r.blocked for r in got) > 5


# quality


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(table, labels)
    rows = quality.score(table, model, carry=True).join(labels, "doc_id").where(quality.held_out()).select("doc_id", "score", "quality").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    assert np.mean([(r.score >= 0.3) == bool(r.quality) for r in rows]) > 0.93
    again = quality.score(table, quality.train(table.repartition(5), labels.repartition(3))).collect()
    first = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    assert all(first[r.doc_id] == r.score for r in again)


def plain_features(t):
    """One text's features, word by word and byte by byte."""
    spaced = re.compile(rb"[^\x20\x09-\x0D]+")
    w, size = spaced.findall(t), max(len(t), 1)
    n, per = len(w), max(len(w), 1)
    count = lambda some: sum(c in some for c in t)
    upper, lower = (lambda x: sum(65 <= c <= 90 for c in x)), (lambda x: sum(97 <= c <= 122 for c in x))
    high = sum(c >= 128 for c in t)
    lines = [x for x in map(tuple, map(spaced.findall, t.split(b"\n"))) if x]
    return [
        log1p(n), sum(map(len, w)) / per, upper(t) / max(upper(t) + lower(t) + high, 1), count(b"0123456789") / size,
        count(b"\"#$%&'()*+,-./:;=?@\\^_`~") / size, count(b"!") / size, count(b"|<>[]{}") / size,
        sum(a == b for a, b in zip(w, w[1:])) / per, log(max(len(set(w)), 1)) / max(log(max(n, 2)), 0.5), max(Counter(w).values(), default=0) / per,
        sum(upper(x) > 1 and not lower(x) for x in w) / per, sum(len(x) <= 2 for x in w) / per, high / size, t.count(b"\n") / per, (len(lines) - len(set(lines))) / max(len(lines), 1),
        sum(any(48 <= c <= 57 for c in x) for x in w) / per, log1p(max(map(len, w), default=0)), sum(x[-1:] in (b".", b"?") for x in w) / per,
    ]


def test_features_equal_plain_python_in_one_go_and_in_parts():
    rnd = random.Random(1)
    symbols = [*"aAbB1.?! \n\t|é漢Z,;", " ", "\n", "ab ", "AB ", "x1 ", "the the\n"]
    texts = ["".join(rnd.choice(symbols) for _ in range(rnd.randrange(200))).encode() for _ in range(300)] + [b"", b" ", b"\n\n", b"a" * 500, b"a\nb\na\n\n b\n"]
    want = np.array([plain_features(t) for t in texts])
    assert np.allclose(quality.features(texts), want, rtol=1e-12, atol=0)
    for step in (1, 7, 40):
        assert np.allclose(quality.features(texts, step), want, rtol=1e-12, atol=0)


def test_quality_ranks_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score(table, quality.train(table, labels)).join(labels, "doc_id").where(quality.held_out()).select("score", "quality").collect()
    good, bad = ([r.score for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.97


def test_quality_edge_rows(spark):
    table = docs(spark, [(i, t, "s") for i, t in enumerate(["good words here", None, "", "bad bad bad bad", "\n\n", "x" * 100_000, "good words here"])] + [(None, "é", "s")])
    for labels in ([], [(0, 1)], [(0, 1), (3, 0), (3, 1), (None, 1), (4, None), (77, 1)]):
        got = quality.score(table, quality.train(table, spark.createDataFrame(labels, "doc_id long, quality int")), carry=True).collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 and r.row.row == "r" for r in got)
        by = {r.doc_id: r.score for r in got}
        assert by[0] == by[6] and by[1] == by[2]


def test_additive_tables_explain_the_score():
    rnd = np.random.default_rng(0)
    x = rnd.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # an interaction that no single feature shows
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95 and (0, 1) in {(i, j) for i, j, _ in model.pairs}


# mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > cap * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in free}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        free -= full
    return out


def test_mixing_targets_and_copies(spark):
    rnd = random.Random(9)
    rows = [(i, "w " * rnd.randrange(30), rnd.choice(["a", "a", "a", "b", "é", "Z", None])) for i in range(600)] + [(900, None, "b"), (None, "x y", "void"), (901, "", "empty"), (5, "w w w", "a"), (5, "w w w", "a")]
    table = docs(spark, rows)
    got = mixing.plan(table).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(want[r.row.source]) and r.source_size == sizes[r.row.source]
        assert r.copies in ((0,) if r.rate == 0 else (int(r.rate), int(r.rate) + 1)) and r.copies <= 2
    taken = sum(r["size"] * r.copies for r in got if r.row.source == "a")
    assert abs(taken / want["a"] - 1) < 0.15
    key = lambda rows: sorted((str(r.doc_id), r["size"], r.copies) for r in rows)
    assert key(mixing.plan(table.repartition(7)).collect()) == key(got)
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.plan(docs(spark, [])).collect() == [] and mixing.plan(docs(spark, [(1, None, None)])).first().copies == 0


# token files

TOKENIZER = __import__("public_tokenizers").path("word_bpe_49k.json")


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(TOKENIZER), tokens.encoder(TOKENIZER)
    rnd = random.Random(3)
    alphabet = list("aZé'sdtİßſΣ漢!?12ĿŉªµØø×÷-<>|\n\t\x0b\x1c\x00̱́ KH ") + ["<|endoftext|>", "don't ", "I'LL ", " "]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(25))) for _ in range(3000)] + ["", " "]
    for t, ids in zip(texts, encode.batch([t.encode() for t in texts], 2), strict=True):
        assert ids.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2], repr(t)


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = [(i, "tokens of text %d, " % i * (i % 60), "s") for i in range(300, 0, -1)] + [(400, None, "s"), (401, "", "s"), (7, "again", "s"), (402, "long word " * 30_000, "s")]
    path = tokens.store(docs(spark, rows), TOKENIZER)
    got = tokens.read(spark, path).orderBy("start").collect()
    start = 0
    for r, (i, t) in zip(got, sorted((i, t or "") for i, t, _ in rows if i != 7), strict=False):
        if r.doc_id >= 7:
            break
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        start += len(ids)
    assert [r.doc_id for r in got] == sorted(i for i, _, _ in rows) and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert tokens.read_one(spark, path, 20) == [[*tokenizer.encode("tokens of text 20, " * 20, add_special_tokens=False).ids, 2]] and len(tokens.read_one(spark, path, 7)) == 2
    assert tokens.dictionary_of(spark, path)
    other = tokens._unpacked(b"")
    with pytest.raises(ValueError, match="another dictionary"):
        list(other([spark.read.parquet(f"{path}/packs").withColumn("shard_start", F.lit(0)).toArrow().to_batches()[0]]))


def test_dictionary_is_trained_on_all_sources_and_parts_of_documents(spark):
    rows = [(i, " ".join(f"{'ab'[i > 300]}{i * j % 997}" for j in range(40)), "ab"[i > 300]) for i in range(600)]
    first, last = (spark.createDataFrame(rows[::x], "doc_id long, text string, source string").coalesce(1) for x in (1, -1))
    assert tokens.train(first, TOKENIZER, 2, 2, sample=200) == tokens.train(last, TOKENIZER, 2, 2, sample=200) != b""
    taken = [r.text for r in tokens._sampled(first, 200).collect()]
    assert len(taken) == 200 and {t[0] for t in taken} == {"a", "b"}
    long = spark.createDataFrame([(i, "x" * 50_000 + "y" * 50_000 + str(i)) for i in range(60)] + [(99, None), (99, "")], "doc_id long, text string")
    drawn = [r.text for r in tokens._sampled(long, 60).collect()]
    assert len(drawn) == 60 and {t[0] for t in drawn} >= {"x", "y"} and tokens._sampled(long, 5000).count() == 60 * 26


def test_token_files_of_empty_table(spark):
    assert tokens.read(spark, tokens.store(docs(spark, []), TOKENIZER)).collect() == []


# GIF


def slow_unpack(data, least, wanted):
    """One code at a time."""
    clear, out, bits, have, at, width, table, last = 1 << least, bytearray(), 0, 0, 0, least + 1, None, None
    while len(out) < wanted:
        while have < width:
            if at >= len(data):
                return bytes(out)
            bits, have, at = bits | data[at] << have, have + 8, at + 1
        code, bits, have = bits & (1 << width) - 1, bits >> width, have - width
        if code == clear or table is None:
            table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], least + 1, None
            if code == clear:
                continue
        if code == clear + 1:
            break
        text = table[code] if code < len(table) else last + last[:1]
        if last is not None and len(table) < 4096:
            table.append(last + text[:1])
            width += len(table) == 1 << width and width < 12
        out += text
        last = text
    return bytes(out[:wanted])


def slow_pack(samples, least, restart):
    """Greedy LZW with a clear code after every ``restart`` codes, or none."""
    clear, out, bits, have = 1 << least, bytearray(), 0, 0

    def emit(code, width):
        nonlocal bits, have
        bits, have = bits | code << have, have + width
        while have >= 8:
            out.append(bits & 255)
            bits, have = bits >> 8, have - 8

    table, width, text, n = {bytes([i]): i for i in range(clear)}, least + 1, b"", 0
    emit(clear, width)
    for s in [*samples, None]:
        if s is not None and (longer := text + bytes([s])) in table:
            text = longer
            continue
        if text:
            emit(table[text], width)
            n += 1
            size = len(table) + 2
            if size < 4096:
                width += size == 1 << width
                if s is not None:
                    table[longer] = size
        if s is not None and restart and n % restart == 0:
            emit(clear, min(width, 12))
            table, width = {bytes([i]): i for i in range(clear)}, least + 1
        text = bytes([s]) if s is not None else b""
    emit(clear + 1, min(width, 12))
    return bytes(out) + (bytes([bits & 255]) if have else b"")


def slow_pack_full(data):
    """Greedy LZW of bytes, text by text, with a clear code when the table is full."""
    codes, table, text = [(256, 9)], {bytes([i]): i for i in range(256)}, b""
    n = 0  # codes since the clear code

    def width():
        return max(9, min(258 + max(n - 1, 0), 4095).bit_length())

    for i in range(len(data)):
        longer = text + data[i : i + 1]
        if longer in table:
            text = longer
            continue
        codes.append((table[text], width()))
        n += 1
        if len(table) + 2 < 4096:
            table[longer] = len(table) + 2
        else:
            codes.append((256, width()))
            table, n = {bytes([i]): i for i in range(256)}, 0
        text = data[i : i + 1]
    if text:
        codes.append((table[text], width()))
        n += 1
    codes.append((257, width()))
    total = at = 0
    for code, size in codes:
        total |= code << at
        at += size
    return total.to_bytes((at + 7) // 8, "little")


def test_code_streams_decode_as_one_code_at_a_time():
    rnd = random.Random(1)
    for _ in range(120):
        least, n = rnd.choice([2, 3, 4, 8]), rnd.choice([0, 1, 5, 100, 3000, 20_000])
        used = rnd.choice([1, 2, 1 << least])
        samples = bytes(rnd.randrange(min(used, 1 << least)) for _ in range(n)) if rnd.random() < 0.7 else (b"\1\0" * n)[:n]
        stream = slow_pack(samples, least, rnd.choice([None, None, 50, 700]))
        assert slow_unpack(stream, least, n) == samples
        assert gif.unpack(stream, least, n).tobytes() == samples
        assert gif.unpack(stream[: len(stream) // 2], least, n).tobytes() == slow_unpack(stream[: len(stream) // 2], least, n)
    noise = np.random.default_rng(2).integers(0, 256, 30_000, dtype=np.uint8).tobytes()
    prose = " ".join(rnd.choice(["the", "code", "table", "is", "full", str(rnd.randrange(999))]) for _ in range(9000)).encode()
    for data in (b"", b"a", b"aa", b"aaaaaaa", noise[:256], noise, prose, b"ab" * 20_000, bytes(70_000)):
        stream = gif.pack(data)
        assert stream == slow_pack_full(data) and slow_unpack(stream, 8, len(data)) == gif.unpack(stream, 8, len(data)).tobytes() == data
    assert len(gif.pack(prose)) < len(prose) / 2


def picture(*frames, size=(4, 4), palette=b"\0\0\0\xff\0\0\0\xff\0\0\0\xff"):
    import struct

    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x81, 0, 0), palette, b"\x21\xfe\x05hello\0"]
    for left, top, w, h, pixels, disposal, clear, delay, interlaced in frames:
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0), struct.pack("<BHHHHB", 0x2C, left, top, w, h, 0x40 if interlaced else 0), b"\x02", gif._blocks(slow_pack(pixels, 2, None))]
    return b"".join([*out, b"\x3b"])


def test_frames_palettes_disposal_transparency_and_interlace(spark):
    data = picture((0, 0, 4, 4, [1] * 16, 1, None, 5, False), (1, 1, 2, 2, [2, 0, 0, 2], 2, 0, 7, False), (0, 0, 4, 1, [3, 0, 0, 0], 3, 0, 0, False), (0, 0, 4, 4, [0, 0, 0, 3] * 4, 0, 0, 1, False))
    first, second, third, fourth = gif.decode(data)
    red, green, blue = b"\xff\0\0", b"\0\xff\0", b"\0\0\xff"
    assert first.delay_ms == 50 and first.pixels == red * 16 and first.histogram[48] == 16
    assert second.pixels == green + red * 2 + green and (second.left, second.top) == (1, 1)
    assert third.pixels == blue + red * 3
    rows = [fourth.pixels[i : i + 12] for i in range(0, 48, 12)]
    assert rows[0] == red * 3 + blue and rows[1] == red + b"\0\0\0" * 2 + blue  # second was disposed of, third put back
    lines = [bytes([i % 4] * 4) for i in range(10)]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    woven = picture((0, 0, 4, 10, b"".join(lines[i] for i in order), 0, None, 0, True), size=(4, 10))
    assert gif.decode(woven)[0].pixels == gif.decode(picture((0, 0, 4, 10, b"".join(lines), 0, None, 0, False), size=(4, 10)))[0].pixels
    broken = [(1, data), (2, None), (3, b"GIF"), (4, data[:60]), (5, b""), (6, data[:-1])]
    rows = {r.id: r for r in gif.frames(spark.createDataFrame([(i, bytearray(x) if x is not None else None, 1) for i, x in broken], "id int, media binary, error int")).collect()}
    assert len(rows[1].frames) == 4 and rows[1].error is None and rows[2].frames is None and all(rows[i].error and rows[i].frames == [] for i in (3, 4, 5, 6))


def test_stored_payloads_come_back(spark):
    texts = ["", None, "a", "é" * 31, "x" * 64, "long " * 200_000, "漢字\0"]
    table = spark.createDataFrame([(i, t, "m") for i, t in enumerate([*texts, texts[2]])], "doc_id long, payload string, media string")
    rows = gif.frames(gif.store(table)).collect()
    for r in rows:
        raw = ([*texts, texts[2]][r.doc_id] or "").encode()
        back = b"".join(bytes(f.pixels) for f in r.frames)
        assert r.n_bytes == len(raw) and len(back) % 64 == 0 and back == raw + bytes(len(back) - len(raw)) and 0 < len(back) < len(raw) + 65
    tall = (np.random.default_rng(1).integers(0, 4, 64 * 3000, dtype=np.uint8) * 80).tobytes()
    data = gif.encode(tall)
    frames = gif.decode(data)
    assert [f.height for f in frames] == [1024, 1024, 952] and {f.channels for f in frames} == {1} and b"".join(f.pixels for f in frames) == tall
    assert data.count(gif._TURNED[0]) == 1 and len(data) < len(tall) / 2
    # the third byte of each control block: what disposes of the frame, and that a colour is clear
    assert data.count(b"\x21\xf9\x04\x09") == 3


def test_huge_canvases_and_streams_are_errors_of_their_rows(spark):
    import struct

    claim = b"GIF89a" + struct.pack("<HHBBB", 65_535, 65_535, 0, 0, 0) + b"\x3b"
    small = gif.encode(b"x" * 64)
    rows = {r.id: r for r in gif.frames(spark.createDataFrame([(1, bytearray(claim)), (2, bytearray(small))], "id int, media binary")).collect()}
    assert "65535" in rows[1].error and rows[1].frames == [] and rows[2].error is None and len(rows[2].frames) == 1
    zeros = gif.pack(bytes(4_000_000))
    assert gif.unpack(zeros, 8, 1000).tobytes() == bytes(1000) and len(gif.unpack(zeros, 8, 4_000_000)) == 4_000_000


# pipeline


def test_pipeline_stages_equal_their_operators_by_brute_force(spark):
    import corpus_pipeline
    from test_text_ops import brute_groups, brute_hits

    from graphfactor.llm import scratch

    docs0 = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing to target weights", "token files"]
    kept = [docs0]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch.table(stage(spark, kept[-1], SF), f"t{i}")
        assert i == 4 or out.schema.simpleString() == docs0.schema.simpleString()
        kept.append(out)
    rows = [{r.doc_id: r for r in d.collect()} for d in kept[:4]]
    model = quality.train(docs0, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs0, model).collect() if r.score >= 0.3}
    assert set(rows[1]) == good and 0 < len(good) < len(rows[0])
    ids = sorted(rows[1])
    groups = brute_groups([rows[1][i].text for i in ids], ids, 5, 80, 100)
    assert set(rows[2]) == {i for i, (_, g) in groups.items() if i == g}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = sorted(rows[2])
    hits = brute_hits([rows[2][i].text for i in ids], bench, 10)
    assert set(rows[3]) == {i for i, (_, places, _) in zip(ids, hits, strict=True) if not places}
    copies = {r.doc_id: r.copies for r in mixing.plan(kept[3]).collect()}
    mixed = [r.doc_id for r in kept[4].collect()]
    assert sorted(mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    final = kept[5].orderBy("start").collect()
    assert [r.doc_id for r in final] == sorted(mixed) and all(a.start + a.n_tokens == b.start for a, b in zip(final, final[1:]))
    assert neardup.groups(kept[3], 5, 80, 100).where("not kept").count() == 0
