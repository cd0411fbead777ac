"""License scans by diagonal voting, in DataFrame operations.

All rolling word pairs of a text are hashed; those that templates have are joined to the places where they stand there
(a broadcast of fixed size: the templates are constants). Texts without any telling pair are left out before: a span of
enough pairs has one. A hit at word p of the text and word q of a template votes for the diagonal p - q. Votes are gathered per diagonal as a bit per template pair, so repeated hits count once; neighbouring diagonals,
which insertions and deletions cause, are merged; a span is verified when enough of the template's pairs were found
word by word. Of licences that differ in a word the best one counts: a span is left out if the places of nearly all its
pairs speak for a span of larger share. Only hits are shuffled, and one row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Label, and the phrase that stands for it.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
#: Label, and a sentence of the public licence or notice.
TEMPLATES = (
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("all-rights-reserved", "all rights reserved"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Word pairs of these alone tell nothing: they are everywhere.
COMMON = frozenset("a and any are as is it may not of or that the this to under use with you".split())
#: Words by which merged diagonals may differ, and share of a template's pairs that makes a span.
NEAR, ENOUGH = 3, 0.6
#: Share of a span's found pairs that another span must have found in the same places to stand for the same words.
SAME = 0.8

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands for the end of a text among its pairs, so that every document comes through the join.
_END = -7046029254386353131


def text_words(text: str) -> Column:
    """Words of a text column with A-Z as a-z: runs of digits, letters and characters beyond ASCII; null has none.

    lower() changes letters beyond ASCII too, none of which stands in a phrase or template; of them only the Kelvin
    sign would become an ASCII letter, so it is changed into another letter before.
    """
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("K"), F.lit("ɐ"))), _BETWEEN), "")


def pairs_of(phrases=PHRASES, templates=TEMPLATES) -> list[tuple]:
    """tid, label, phrase or not, words, pairs, bit, q, a, b, telling: every word pair (a, b) of each template, at word q."""
    rows = []
    for tid, (label, text, phrase) in enumerate([(a, b, True) for a, b in phrases] + [(a, b, False) for a, b in templates]):
        w = text.split()
        n = len(w) - 1
        if not 1 <= n <= 63:
            raise ValueError(f"a template needs 2 to 64 words: {text}")
        dull = [{w[q], w[q + 1]} <= COMMON for q in range(n)]
        # with fewer dull pairs than make a span, every span has a telling one
        apart = not phrase and sum(dull) < ENOUGH * n
        rows += [(tid, label, phrase, len(w), n, q, q, w[q], w[q + 1], not (apart and dull[q])) for q in range(n)]
    return rows


def _index(spark: SparkSession, phrases, templates) -> DataFrame:
    kinds = "tid int, label string, phrase boolean, words int, pairs int, bit int, q int, a string, b string, telling boolean"
    known = spark.createDataFrame(pairs_of(phrases, templates), kinds).withColumn("h", F.xxhash64("a", "b"))
    end = spark.createDataFrame([(-1, "", False, 0, 0, 0, 0, "", "", False)], kinds).withColumn("h", F.lit(_END))
    return known.union(end)


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Find license phrases and templates in every text.

    docs: doc_id and text; other columns are not read. Returns one row per row of docs: doc_id, n_words, places (array
    of label, start: every place of a phrase), spans (array of label, start, stop, share: verified template spans, from
    the first found word to behind the last; one whose pairs another of larger share has found too is left out),
    labels (sorted distinct), score (largest share of a span, 1 for a phrase, else 0).

    Null text counts as empty: no words, no labels, score 0. Null doc_ids are kept. Repeated rows each get their row.
    """
    spark = docs.sparkSession
    index = _index(spark, phrases, templates)
    # hashes that no template has are dropped before they become rows; the set is as bounded as the templates
    hashes = index.select("h", "telling").collect()
    known, telling = sorted({r["h"] for r in hashes} - {_END}), sorted({r["h"] for r in hashes if r["telling"]})
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), text_words("text").alias("w"))
    m = F.greatest(F.size("w") - 1, F.lit(0))
    rows = rows.select("doc_id", "t", "w", F.zip_with(F.slice("w", 1, m), F.slice("w", 2, m), lambda a, b: F.xxhash64(a, b)).alias("pairs"))
    placed = F.filter(F.transform("pairs", lambda h, p: F.struct(p.alias("p"), h.alias("h"))), lambda x: x["h"].isin(known))
    named = F.transform(placed, lambda x: F.struct(x["p"].alias("p"), x["h"].alias("h"), F.get("w", x["p"]).alias("x"), F.get("w", x["p"] + 1).alias("y")))
    end = F.array(F.struct(F.lit(0).alias("p"), F.lit(_END).alias("h"), F.lit("").alias("x"), F.lit("").alias("y")))
    found = F.when(F.arrays_overlap("pairs", F.array(*map(F.lit, telling))), F.concat(named, end)).otherwise(end)
    rows = rows.select("doc_id", "t", F.size("w").alias("n_words"), F.explode(found).alias("hit")).select("doc_id", "t", "n_words", "hit.*")
    hits = rows.join(F.broadcast(index), "h").where((F.col("x") == F.col("a")) & (F.col("y") == F.col("b")))
    votes = hits.select("doc_id", "t", "n_words", "tid", "label", "phrase", "words", "pairs", "p", (F.col("p") - F.col("q")).alias("diagonal"), F.expr("shiftleft(1L, bit)").alias("vote"))
    key = ["doc_id", "t", "n_words", "tid", "label", "phrase", "words", "pairs"]
    diagonals = votes.groupBy(*key, "diagonal").agg(F.bit_or("vote").alias("found"), F.count("*").alias("n"), F.collect_set("p").alias("at"))

    order = Window.partitionBy("doc_id", "t", "tid").orderBy("diagonal")
    far = F.coalesce(F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR), F.lit(True))
    merged = diagonals.withColumn("far", far.cast("int")).withColumn("band", F.sum("far").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy(*key, "band").agg(F.bit_or("found").alias("found"), F.min("diagonal").alias("start"), F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    share = F.bit_count("found") / F.col("pairs")
    enough = (F.col("tid") >= 0) & F.when(F.col("phrase"), share == 1).otherwise(share >= ENOUGH)

    # a template may begin before the text does
    start = F.greatest("start", F.lit(0)).cast("long").alias("start")
    gathered = spans.groupBy("doc_id", "t", "n_words").agg(
        F.array_sort(F.collect_list(F.when(enough & F.col("phrase"), F.struct("label", start)))).alias("places"),
        F.array_sort(F.collect_list(F.when(enough & ~F.col("phrase"), F.struct("label", F.array_min("at").cast("long").alias("start"), (F.array_max("at") + 2).cast("long").alias("stop"), share.alias("share"), "at")))).alias("spans"),
        F.max(F.when(F.col("tid") < 0, F.col("n"))).alias("rows"),
    )
    # of templates that stand in one place, such as licences that differ in a word, the best one counts
    same = lambda s, o: F.size(F.array_intersect(s["at"], o["at"])) >= F.size(s["at"]) * SAME
    beaten = lambda s: F.exists("spans", lambda o: (o["share"] > s["share"]) & (o["start"] < s["stop"]) & (s["start"] < o["stop"]) & same(s, o))
    told = lambda s: F.struct(*(s[x].alias(x) for x in ("label", "start", "stop", "share")))
    gathered = gathered.withColumn("spans", F.transform(F.filter("spans", lambda s: ~beaten(s)), told))
    labels = F.array_sort(F.array_distinct(F.concat("places.label", "spans.label")))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0)))
    full = gathered.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "places", "spans", labels.alias("labels"), score.alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("one"))
    return full.drop("one")
