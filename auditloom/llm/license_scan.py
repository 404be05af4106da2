"""License scans by diagonal voting (native).

All rolling word k-grams of the documents are joined with the places of the same grams
in the templates.  A hit at document word p and template word q votes for the diagonal
p - q.  Diagonals of one document and template that lie within ``GAP`` of each other are
merged, which allows for words put in or left out, and a merged span counts when it
covers enough of the template within a length close to the template's own.

Defined results.  A null text is empty; texts without a hit have no labels and score 0.
Repeated rows are scanned alike and all returned; a tie between templates keeps both
labels.  Empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let

#: Words in a gram; words by which diagonals may differ and still be one span.
GRAM = 3
GAP = 3
#: Share of a template's grams that a span must hold, and its greatest length in templates.
COVERAGE_PCT = 60
STRETCH_PCT = 150
#: The template table is broadcast; it is a list in code, and no longer than this.
MAX_TEMPLATE_WORDS = 20_000

#: Phrases that are labels by themselves.
PHRASES = {
    "cc-by": ["cc", "by"],
    "gpl": ["general", "public", "license"],
    "reserved": ["all", "rights", "reserved"],
}

#: Wordings of public licenses, in lower case.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc 4 0"),
    ("cc-by-sa", "cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "is licensed under the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def scan_words(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and whatever lies outside ASCII.

    ``lower`` also folds letters outside ASCII, which neither parts nor joins words.
    """
    return F.filter(
        F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"),
        lambda w: w != "",
    )


def grams(words: Column) -> Column:
    """All rolling grams of a word array, in order."""
    return let(
        words,
        lambda w: F.when(
            F.size(w) >= GRAM,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - GRAM),
                lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(GRAM)]),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )


def phrase_places(words: Column) -> Column:
    """array<struct<label, at>>: where the words of a phrase stand one after the other."""

    def at(w, x, i):
        found = None
        for label, (first, *rest) in PHRASES.items():
            here = x == first
            for k, word in enumerate(rest, 1):
                here &= F.coalesce(F.get(w, i + k) == word, F.lit(False))
            hit = F.struct(F.lit(label).alias("label"), i.cast("bigint").alias("at"))
            found = F.when(here, hit) if found is None else found.when(here, hit)
        return found

    return let(words, lambda w: F.filter(F.transform(w, lambda x, i: at(w, x, i)), lambda p: p.isNotNull()))


def template_grams(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, label, gram, gram_hash, tpos, n_grams, t_words) of every template."""
    if sum(len(t.split()) for _, t in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError("the templates are too long to be sent to every task")
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("words"))
            for k, (label, text) in enumerate(templates)
        ]
    )
    found = spark.range(1).select(F.explode(rows).alias("t")).select(
        "t.template", "t.label", F.size(scan_words(F.col("t.words"))).alias("t_words"),
        grams(scan_words(F.col("t.words"))).alias("grams"),
    )
    return found.select(
        "template", "label", "t_words", F.size("grams").alias("n_grams"), F.posexplode("grams").alias("tpos", "t_gram")
    ).withColumn("gram_hash", F.xxhash64("t_gram"))


def spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    coverage_pct: int = COVERAGE_PCT,
) -> DataFrame:
    """Verified spans: (id, digest, label, start_word, end_word, matched, n_grams)."""
    known = template_grams(docs.sparkSession, templates)
    rolling = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("digest"),
        F.posexplode(grams(scan_words(F.col(text_col)))).alias("pos", "gram"),
    ).withColumn("gram_hash", F.xxhash64("gram"))
    # the hash finds the place, the words confirm it
    hits = rolling.join(F.broadcast(known), "gram_hash").filter(F.col("gram") == F.col("t_gram"))
    votes = hits.groupBy(
        "id", "digest", "template", "label", "n_grams", "t_words", (F.col("pos") - F.col("tpos")).alias("diagonal")
    ).agg(F.collect_set("tpos").alias("tposes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    line = Window.partitionBy("id", "digest", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > GAP, F.lit(False))
    merged = (
        votes.withColumn("apart", apart.cast("int"))
        .withColumn("span", F.sum("apart").over(line))
        .groupBy("id", "digest", "template", "label", "n_grams", "t_words", "span")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("tposes")))).alias("matched"),
            F.min("first").cast("bigint").alias("start_word"),
            (F.max("last") + GRAM).cast("bigint").alias("end_word"),
        )
    )
    long_enough = 100 * F.col("matched") >= coverage_pct * F.col("n_grams")
    close = 100 * (F.col("end_word") - F.col("start_word")) <= STRETCH_PCT * F.col("t_words")
    return merged.filter(long_enough & close).select(
        "id", "digest", "label", "start_word", "end_word", "matched", "n_grams"
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, phrase places, labels of phrases and of spans, score.

    The score is 1 with a phrase, else the best span's share of its template, else 0.
    """
    base = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("digest"),
        scan_words(F.col(text_col)).alias("words"),
    ).select("id", "digest", F.size("words").cast("bigint").alias("n_words"), phrase_places(F.col("words")).alias("places"))
    found = (
        spans(docs, id_col, text_col)
        .groupBy("id", "digest")
        .agg(F.collect_set("label").alias("found"), F.max(F.col("matched") / F.col("n_grams")).alias("best"))
    )
    labels = F.transform("places", lambda p: p["label"])
    none = F.array().cast("array<string>")
    return base.join(
        found, base["id"].eqNullSafe(found["id"]) & (base["digest"] == found["digest"]), "left"
    ).select(
        base["id"],
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
