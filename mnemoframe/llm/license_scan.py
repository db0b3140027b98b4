"""Licences by a positional index of rare words, in DataFrame expressions only.

Templates are short licence texts with a label and a mandatory key phrase. Document frequencies of the templates' words
over all documents give their rarity; each template is indexed by its RARE rarest words, with their places in it.
A text is looked up by those words: each occurrence votes for (template, place in text - place in template), the key
phrase too, and a template is found where the votes at one such offset carry at least ALIGNED of the template's
weight and the key phrase is among them. Base phrases are found next to that, anywhere in a text.

The index is made of constants and one count per template word, so it is small whatever the corpus; it is sent to
every task. Votes are summed by row and offset, partly before the shuffle. Rows are found again by id and text
hash, so repeated ids and null ids keep their own results.

Words are those of the text in lower case. Plain lower() is used: beyond A-Z it changes only letters beyond ASCII, and
none of them into a character of a phrase or a separator. Null and empty texts have no words, no labels and score 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, with_words, written

BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# (label, key phrase, text), in lower-case words
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the mit license", "released under the mit license"),
    ("apache-2", "apache license version 2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "apache license version 2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-2", "gnu general public license version 2", "under the terms of the gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved", "copyright all rights reserved"),
)
RARE = 6
ALIGNED = 0.7


def phrase_places(phrase: str) -> Column:
    """Where the words of a phrase stand one after the other; looked for only where the line has them at all."""
    parts = phrase.split(" ")
    want = F.array(*map(F.lit, parts))
    places = F.filter(F.transform("_words", lambda w, i: F.when((w == parts[0]) & (F.slice("_words", i + 1, F.lit(len(parts))) == want), i)), lambda i: i.isNotNull())
    there = F.contains(F.concat(F.lit(" "), F.col("_line"), F.lit(" ")), F.lit(f" {phrase} "))
    return F.when(there, places).otherwise(F.array().cast("array<int>"))


def worded(docs: DataFrame, text: str) -> DataFrame:
    return with_words(docs.withColumn("_text", text_of(text)), F.lower("_text"))


def rarity(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Inverse document frequency of every template word over all documents. One row per word reaches the driver."""
    vocabulary = sorted({w for _, _, t in TEMPLATES for w in t.split(" ")})
    words = worded(docs.select(F.col(text).alias("t")), "t").select(F.explode_outer(F.array_intersect("_words", F.array(*map(F.lit, vocabulary)))).alias("w"))
    counted = {r.w: r.n for r in words.where("w is not null").groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = docs.count()
    return {w: math.log((total + 2) / (counted.get(w, 0) + 1)) for w in vocabulary}


def index(idf: dict[str, float], rare: int = RARE) -> tuple[list[tuple[str, int, int, float]], list[float]]:
    """Postings (word, template, place, weight) of each template's rarest words, and each template's whole weight.

    Of a word that a template repeats only the first place counts. Equal rarity: the earlier word.
    """
    postings, weights = [], []
    for t, (_, _, text) in enumerate(TEMPLATES):
        words = text.split(" ")
        chosen = sorted(set(words), key=lambda w: (-idf[w], words.index(w)))[:rare]
        postings += [(w, t, words.index(w), idf[w] + 1e-6) for w in chosen]
        weights.append(sum(idf[w] + 1e-6 for w in chosen))
    return postings, weights


def licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", aligned: float = ALIGNED) -> DataFrame:
    """(id, text_hash, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per row of docs."""
    spark = docs.sparkSession
    postings, weights = index(rarity(docs, text))
    words = sorted({w for w, _, _, _ in postings})
    phrases = sorted({p for _, p, _ in TEMPLATES} | {p for p, _ in BASE})
    plain = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("_doc")).withColumn("text_hash", F.xxhash64("_doc"))
    found = worded(plain, "_doc").withColumns({f"_p{j}": phrase_places(p) for j, p in enumerate(phrases)})
    base = [F.col(f"_p{phrases.index(p)}") for p, _ in BASE]
    places = F.concat(*base)
    labels = F.filter(F.array(*[F.when(F.size(b) > 0, label) for b, (_, label) in zip(base, BASE)]), lambda x: x.isNotNull())
    keyed = F.concat(*[F.transform(f"_p{j}", votes) for j, votes in ((j, _vote(f"={p}")) for j, p in enumerate(phrases))])
    rare = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(words), F.struct(i.alias("at"), w.alias("word")))), lambda s: s.isNotNull())
    any_phrase = F.greatest(*[F.size(f"_p{j}") for j in range(len(phrases))]) > 0  # without a key phrase nothing is found
    kept = written(found.select("id", "text_hash", F.size("_words").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"),
                                F.array_max(places).cast("long").alias("last_word"), F.array_sort(labels).alias("base_labels"), F.when(any_phrase, F.concat(rare, keyed)).alias("votes")), "licences")
    table = [(w, t, at, x) for w, t, at, x in postings] + [(f"={p}", t, text.split(p)[0].count(" "), 0.0) for t, (_, p, text) in enumerate(TEMPLATES) if p in text]
    known = spark.createDataFrame(table, "word string, template int, place int, weight double")  # at most templates x (RARE + 1) rows
    votes = kept.select("id", "text_hash", F.explode("votes").alias("v")).select("id", "text_hash", "v.at", F.col("v.word").alias("word")).distinct()
    at_offset = votes.join(F.broadcast(known), "word").groupBy("id", "text_hash", "template", (F.col("at") - F.col("place")).alias("offset")).agg(
        F.sum("weight").alias("weight"), F.max(F.col("weight") == 0).alias("keyed"))
    share = F.col("weight") / F.get(F.array(*map(F.lit, weights)), F.col("template"))
    names = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    aligned_ones = at_offset.where("keyed").withColumn("share", F.least(share, F.lit(1.0))).where(F.col("share") >= aligned)
    by_doc = aligned_ones.groupBy("id", "text_hash").agg(F.collect_set(F.get(names, F.col("template"))).alias("more"), F.max("share").alias("share"))
    other = by_doc.select(F.col("id").alias("i"), F.col("text_hash").alias("h"), "more", "share")
    both = kept.drop("votes").join(other, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), "left")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return both.select("id", "text_hash", "n_words", "n_base", "first_word", "last_word", "base_labels", every.alias("labels"), score.alias("score"))


def _vote(word: str):
    return lambda i: F.struct(i.alias("at"), F.lit(word).alias("word"))
