"""Licence scans by a positional rare-token index, in DataFrame functions only.

Templates are licence phrases and notices, each with a mandatory key phrase. One pass over
the texts keeps, for each file, its number of words, its distinct licence words, and, only
where all words of some key phrase are among them, its words with all others blanked. That
narrow table gives the document frequency of every licence word, hence its IDF. A file then
looks up its highest-IDF licence words: for every template whose key words it holds, the two
of them with the highest IDF. Each occurrence proposes a start of the template (its place
less the word's place in the template, of which there may be several); the starts of both
words are intersected; at what is left the key phrase is verified word by word, and the
share of all template words that agree by relative position must reach `MIN_MATCH`. A place
of a whole key phrase has both words at their places, so none is lost.

Defined results: null texts have no words; no hits give null first and last word, empty
labels and score 0; repeated rows are scanned each; words of equal IDF are taken in word
order; texts of any length are read whole, in time linear in them; empty tables give no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.llm.common import lower_ascii, materialize

# Phrases of the contract and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Fixed values: (label, notice, mandatory key phrase) of widely used licence notices.
NOTICES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("mit-notice", "released under the mit license", "mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    (
        "apache-header",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "you may not use this file except in compliance with the license",
    ),
    (
        "gpl-header",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "gnu general public license as published by the free software foundation",
    ),
    (
        "mit-conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "this permission notice shall be included in all copies or substantial portions",
    ),
    (
        "bsd-conditions",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions of source code must retain the above copyright notice",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "for any purpose with or without fee is hereby granted",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        "free and unencumbered software released into the public domain",
    ),
)
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
RARE_WORDS = 2  # looked up for each template that a file may hold
MIN_MATCH = 0.8


def words_of(text: Column) -> Column:
    """Array of lower-cased words."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _strings(items) -> Column:
    return F.array(*[F.lit(x) for x in items])


def _templates(phrases: dict[str, str], notices: tuple) -> list[tuple[str, bool, list[str], list[str], int]]:
    """(label, base, words, key words, place of the key phrase) of each template."""
    out = []
    for label, base, text, key in [*((v, True, k, k) for k, v in phrases.items()), *((n, False, t, k) for n, t, k in notices)]:
        words, own = text.split(" "), key.split(" ")
        out.append((label, base, words, own, next(i for i in range(len(words)) if words[i : i + len(own)] == own)))
    return out


def licence_words(df: DataFrame, id_col: str, text_col: str, templates: list) -> DataFrame:
    """id, n_words, present (distinct licence words), words (blank but for licence words; null where no
    key phrase can stand) of each row: a written table, the one pass over the texts."""
    vocabulary = sorted({w for t in templates for w in t[2]})
    keys = F.array(*[_strings(sorted(set(t[3]), key=lambda w: (-len(w), w))) for t in templates])
    rows = df.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    rows = rows.select("id", "words", F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary))).alias("present"))
    able = F.exists(keys, lambda k: F.forall(k, lambda w: F.array_contains("present", w)))
    kept = F.when(able, F.transform("words", lambda w: F.when(w.isin(vocabulary), w).otherwise("")))
    return materialize(rows.select("id", F.size("words").cast("long").alias("n_words"), "present", kept.alias("words")))


def inverse_frequencies(rows: DataFrame) -> dict[str, float]:
    """IDF of the licence words; at most one row a word, and one of the count, comes back."""
    counts = rows.select(F.explode(F.concat(F.col("present"), _strings([""]))).alias("w")).groupBy("w").count().collect()
    total = max((r[1] for r in counts), default=0)
    return {r[0]: math.log((1 + total) / (1 + r[1])) for r in counts}


def postings(templates: list, idf: dict[str, float], rare: int = RARE_WORDS) -> list[list[tuple[str, list[int]]]]:
    """For each template the key words of the highest IDF and their places in it."""
    out = []
    for _, _, _, key, at in templates:
        chosen = sorted(set(key), key=lambda w: (-idf.get(w, math.inf), w))[:rare]
        out.append([(w, [at + i for i, x in enumerate(key) if x == w]) for w in chosen])
    return out


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """`id_col`, n_words, phrase_hits array<(label, start)>, notice_hits array<(label, start, share)>."""
    templates = _templates(phrases, notices)
    rows = licence_words(df, id_col, text_col, templates)
    index = postings(templates, inverse_frequencies(rows))
    words = F.col("words")

    def posting(word: str, places: list[int]) -> Column:
        return F.struct(F.lit(word).alias("w"), F.array(*map(F.lit, places)).alias("places"))

    shape = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(base).alias("base"), _strings(t).alias("words"), _strings(key).alias("key"), F.lit(at).alias("at"), F.array(*[posting(*p) for p in mine]).alias("rare"))
        for (label, base, t, key, at), mine in zip(templates, index)
    ])
    looked = sorted({w for mine in index for w, _ in mine})
    spots = F.filter(F.transform(words, lambda w, i: F.when(w.isin(looked), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())

    def starts(p: Column) -> Column:
        return F.flatten(F.transform(F.filter("spots", lambda x: x["w"] == p["w"]), lambda x: F.transform(p["places"], lambda k: x["i"] - k)))

    def agreeing(start: Column, template: Column) -> Column:
        same = F.transform(template, lambda w, i: F.when(F.get(words, start + i) == w, 1).otherwise(0))
        return F.aggregate(same, F.lit(0), lambda a, x: a + x)

    def verified(t: Column, start: Column) -> Column:
        share = agreeing(start, t["words"]) / F.size(t["words"])
        return F.when(agreeing(start + t["at"], t["key"]) == F.size(t["key"]), F.struct(t["label"].alias("label"), t["base"].alias("base"), start.cast("long").alias("start"), share.alias("share")))

    def hits(t: Column) -> Column:
        both = F.array_intersect(starts(F.get(t["rare"], F.lit(0))), starts(F.element_at(t["rare"], -1)))
        return F.filter(F.transform(both, lambda s: verified(t, s)), lambda x: x.isNotNull() & (x["share"] >= MIN_MATCH))

    able = F.filter(shape, lambda t: F.forall(t["key"], lambda w: F.array_contains("present", w)))
    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,share:double>>")
    out = rows.select("id", "n_words", "present", "words", F.when(words.isNotNull(), spots).alias("spots"))
    out = out.select("id", "n_words", F.when(words.isNotNull(), F.flatten(F.transform(able, hits))).otherwise(none).alias("found"))
    pick = lambda base: F.filter("found", lambda x: x["base"] == base)
    return out.select(
        F.col("id").alias(id_col), "n_words",
        F.transform(pick(True), lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"))).alias("phrase_hits"),
        F.transform(pick(False), lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["share"].alias("share"))).alias("notice_hits"),
    )
