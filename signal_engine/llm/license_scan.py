"""License scans by diagonal voting.

All rolling k-word hashes of a document meet, in one join, the places of equal k-word hashes in the license
templates (k is four, or a shorter template's length). A hit votes for the offset diagonal (place in the
document less place in the template); neighbouring diagonals of one template are merged; a span is verified
when its distinct template places cover at least ``MIN_COVER`` of the template. A base phrase is a template
of its own whose every hit is a whole place.

Texts are cut into words after A-Z are lower-cased; a word is a run of ASCII letters and digits and of
characters beyond ASCII. The join is with a table of a few hundred places, so documents are not shuffled;
only votes are. A row also sends one vote with its word count, so that all rows come back, as often as they are there.

Defined results: null or empty text has no words and no spans; each row gives its own row, also those of equal id
and text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 4
NEAR = 3
MIN_COVER = 0.6

#: Label and phrase.
BASE_PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Label and the words of public license statements.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the terms of the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license version"),
    ("lgpl", "licensed under the gnu lesser general public license version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

_DOCUMENT = -1


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; empty array for null or none."""
    text = F.coalesce(text, F.lit(""))
    # lower() differs from lower-casing A-Z in ASCII results only for these two characters
    odd = text.contains("K") | text.contains("İ")
    low = F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    trimmed = F.regexp_replace(low, rf"^{gap}|{gap}\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, gap))


def template_places(spark, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]) -> DataFrame:
    """(template, label, base, grams, off, k, pair, rest): one row per place of a template's k-gram; pair is the
    hash of its first two words, rest of all k."""
    rows = [(i, label, True, *_cut(text)) for i, (label, text) in enumerate(phrases)]
    rows += [(len(phrases) + i, label, False, *_cut(text)) for i, (label, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, w array<string>, k int")
    table = table.withColumn("off", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))))
    at = [F.get("w", F.col("off") + i) for i in range(GRAM)]
    rest = F.when(F.col("k") == 2, F.xxhash64(*at[:2])).when(F.col("k") == 3, F.xxhash64(*at[:3])).otherwise(F.xxhash64(*at))
    return table.select("template", "label", "base", (F.size("w") - F.col("k") + 1).alias("grams"), "off", "k", F.xxhash64(*at[:2]).alias("pair"), rest.alias("rest"))


def _cut(text: str) -> tuple[list[str], int]:
    found = text.split()
    if len(found) < 2:
        raise ValueError("a template has two words at least")
    if len(found) > 62 + GRAM:
        raise ValueError("a template's places must fit one 64-bit mask; cut it in two")
    return found, min(GRAM, len(found))


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = BASE_PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, base (array of struct(label, first_word)), spans (array of
    struct(label, first_word, end_word, cover)) of the verified template spans."""
    spark = docs.sparkSession
    places = template_places(spark, phrases, templates).select("template", "label", "base", "grams", "off", "k", "pair", "rest")
    marker = spark.range(1).select(F.lit(_DOCUMENT).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(1).alias("grams"), F.lit(0).alias("off"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("pair"), F.lit(0).cast("long").alias("rest"))
    text = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), words(F.col(text_col)).alias("w"))
    # place -1 stands for the document itself
    place = text.select("doc", "th", "w", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("w") - 2, F.lit(-1)))).alias("pos"))
    at = [F.get("w", F.col("pos") + i) for i in range(GRAM)]
    place = place.select("doc", "th", "w", "pos", F.when(F.col("pos") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64(*at[:2])).alias("pair"))
    rest = F.when(F.col("k") == 4, F.xxhash64(*at)).when(F.col("k") == 3, F.xxhash64(*at[:3])).otherwise(F.col("pair"))
    long_enough = F.col("pos") + F.col("k") <= F.size("w")
    hit = place.join(F.broadcast(places.unionByName(marker)), "pair").where(F.when(F.col("k") == 0, F.col("pos") < 0).otherwise((F.col("pos") >= 0) & long_enough & (rest == F.col("rest"))))
    votes = (
        hit.select("doc", "th", "template", "label", "base", "grams", "pos", "off", "k", F.size("w").alias("n"))
        .groupBy("doc", "th", "template", "label", "base", "grams", (F.col("pos") - F.col("off")).alias("diagonal"))
        .agg(F.max("n").alias("n"), F.count("*").alias("hits"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("off"))).alias("offs"), F.min("pos").alias("first"), F.max(F.col("pos") + F.col("k")).alias("end"))
    )
    by_template = Window.partitionBy("doc", "th", "template").orderBy("diagonal")
    apart = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(by_template) > NEAR), 1).otherwise(0)
    spans = (
        votes.withColumn("new", apart)
        .withColumn("span", F.sum("new").over(by_template))
        .groupBy("doc", "th", "template", "label", "base", "grams", "span")
        .agg(F.max("n").alias("n"), F.sum("hits").alias("hits"), F.bit_or("offs").alias("offs"), F.min("first").alias("first"), F.max("end").alias("end"))
        .withColumn("cover", F.bit_count("offs") / F.col("grams"))
    )
    is_doc = F.col("template") == _DOCUMENT
    base = F.when(F.col("base"), F.struct("label", F.col("first").cast("long").alias("first_word")))
    verified = ~is_doc & ~F.col("base") & (F.col("cover") >= MIN_COVER)
    span = F.when(verified, F.struct("label", F.col("first").cast("long").alias("first_word"), F.col("end").cast("long").alias("end_word"), "cover"))
    return (
        spans.groupBy("doc", "th")
        .agg(F.max(F.when(is_doc, F.col("n"))).cast("long").alias("n_words"), F.max(F.when(is_doc, F.col("hits"))).alias("rows"), F.array_sort(F.collect_list(base)).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
        .select(F.col("doc").alias(id_col), "n_words", "base", "spans", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"))
        .drop("copy")
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of scan's rows."""
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    n = F.size("base")
    return found.select(
        id_col,
        "n_words",
        n.cast("long").alias("n_base"),
        F.array_min("base.first_word").alias("first_word"),
        F.array_max("base.first_word").alias("last_word"),
        join(F.col("base.label")).alias("base_labels"),
        join(F.concat("base.label", "spans.label")).alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.cover"), F.lit(0.0))).alias("score"),
    )
