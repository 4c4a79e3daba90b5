"""Operator 10: license scans by an exact set-similarity join.

Licence notices (``TEMPLATES``) and text blocks are sets of words. A block matches a template if it holds at
least ``threshold`` of the template's words. The join finds all such blocks:

- order: all template words are ordered by how many documents hold them, rarest first;
- prefix: a template of t words that needs an overlap of o shares one of its t - o + 1 rarest words with
  every block that matches it, so blocks meet templates on those words alone;
- length: a block with fewer template words than o can't match;
- position: after the first common word, at place i of the template and j of the block, at most
  1 + min(t - i, b - j) words are common;
- what passes is checked on the sets themselves.

Base places, where a fixed phrase's words stand one after another, are found in the row.

Scale: texts are read once; a document gives one compact row, with blocks only if all its words together
could match some template. Words outside the templates never leave the row. The templates and the word
order are bounded by the templates given, not by the corpus; Spark broadcasts them if their measured size
allows. A notice that a third of all documents hold meets as many templates as any other.

Defined cases: null text is empty: no words, no places, null first and last word, no labels, score 0;
repeated rows are judged each; blocks are windows over the words of the whole text, so that wrapped notices count, and
each template has windows of its own: one and a half times its words, each starting half its words after the one before
(a run of a template's length lies in one of them). Words scattered wider than that don't match. Only ``id_col``
and ``text_col`` are read.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakescope.llm.shared import frozen, let

# Phrases of the base places and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices of public licences, as their texts say to show them.
TEMPLATES = {
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "This work is licensed under the MIT License", "Released under the MIT License"],
    "apache": ["Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License",
               "Licensed under the Apache License, Version 2.0"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "This work is licensed under the GNU General Public License, version 3"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc": ["This work is licensed under a Creative Commons Attribution International License", "Licensed under CC BY 4.0",
           "Licensed under CC BY-NC 4.0", "Licensed under CC BY-SA 4.0"],
}
THRESHOLD = 0.9

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case. ``lower`` does so too, and what else it changes stays outside ASCII, but for two
    letters (the Kelvin sign and the dotted capital I) whose texts take the slower way."""
    return F.when(text.rlike("[Kİ]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def license_words(lowered: Column) -> Column:
    return F.filter(F.split(lowered, _BREAK), lambda w: w != "")


def template_words(text: str) -> list[str]:
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(str.maketrans(UPPER, LOWER))) if w]


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * size, 9)))


def windows(length: int) -> tuple[int, int]:
    """Words of a block for a template of so many words, and words from one block's start to the next."""
    return length + length // 2, max(1, length // 2)


def _template_rows(templates: dict[str, list[str]], threshold: float) -> list[tuple]:
    rows = []
    for label, texts in templates.items():
        for text in texts:
            tokens = sorted(set(template_words(text)))
            if tokens:
                rows.append((len(rows), label, tokens, len(tokens), needed(len(tokens), threshold), len(template_words(text))))
    return rows


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _places(words: Column, lowered: Column, phrases: dict[str, str]) -> Column:
    """All places of the phrases in the words: array of (label, start)."""
    def of(phrase: list[str], label: str) -> Column:
        here = lambda i: _all(F.get(words, i + k) == F.lit(w) for k, w in enumerate(phrase))
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
        place = lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start"))
        held = (F.size(words) >= len(phrase)) & _all(lowered.contains(w) for w in phrase)
        return F.when(held, F.transform(starts, place)).otherwise(F.array().cast("array<struct<label:string,start:bigint>>"))

    return F.concat(*[of(phrase.split(), label) for phrase, label in phrases.items()])


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def _blocks(words: Column, held: Column, vocabulary: Column, rows: list[tuple]) -> Column:
    """Blocks that hold enough template words for some template of their length: array of (no, length, tokens).

    Windows of a length are made only where the text's words together match a template of that length."""
    none = F.array().cast("array<struct<no:int,length:int,tokens:array<string>>>")

    def of_length(length):
        of, (size, step) = [r for r in rows if r[5] == length], windows(length)
        least = min(r[4] for r in of)
        could = reduce(lambda x, y: x | y, [F.size(F.array_intersect(held, _strings(r[2]))) >= r[4] for r in of])
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(words) - size) / step).cast("int")))
        block = lambda k: F.struct(k.alias("no"), F.lit(length).alias("length"),
                                   F.array_intersect(F.slice(words, k * step + 1, size), vocabulary).alias("tokens"))
        return F.when(could, F.filter(F.transform(starts, block), lambda x: F.size(x["tokens"]) >= least)).otherwise(none)

    parts = [of_length(length) for length in sorted({r[5] for r in rows})]
    return F.concat(*parts) if parts else none


def compact(docs: DataFrame, templates: dict[str, list[str]], phrases: dict[str, str], threshold: float,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document, from one reading of its text: row, doc_id, n_words, places, held (template
    words in it), blocks (those that could match)."""
    rows = _template_rows(templates, threshold)
    vocabulary = _strings(sorted({w for r in rows for w in r[2]}))

    def of(words: Column, lowered: Column) -> Column:
        def with_held(held):
            return F.struct(F.size(words).cast("long").alias("n_words"), _places(words, lowered, phrases).alias("places"), held.alias("held"),
                            _blocks(words, held, vocabulary, rows).alias("blocks"))
        return let(F.array_intersect(words, vocabulary), with_held)

    t = F.coalesce(F.col(text_col), F.lit(""))
    one = let(ascii_lower(t), lambda lowered: let(license_words(lowered), lambda w: of(w, lowered)))
    d = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(one)).alias("one"))
    return frozen(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "one.*"))


def _template_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The templates as a table: template, label, tokens, size, need, length."""
    one = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), _strings(tokens).alias("tokens"), F.lit(size).alias("size"),
                    F.lit(need).alias("need"), F.lit(length).alias("length")) for i, label, tokens, size, need, length in rows]
    if not one:
        return spark.range(0).selectExpr("0 AS template", "'' AS label", "array('') AS tokens", "0 AS size", "0 AS need", "0 AS length")
    return spark.range(1).select(F.inline(F.array(*one)))


def matches(found: DataFrame, templates: dict[str, list[str]], threshold: float) -> DataFrame:
    """The join: (row, length, no, template, label, overlap, containment) of every block that matches a template."""
    spark = found.sparkSession
    t = _template_table(spark, _template_rows(templates, threshold))
    counts = found.select(F.explode("held").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("documents"))
    words = t.select("template", "size", "need", "length", F.explode("tokens").alias("token")).join(counts, "token", "left")
    # the order runs over the templates' words only; (documents, token) is the order itself
    place = F.struct(F.coalesce("documents", F.lit(0)).alias("documents"), "token")
    i = F.row_number().over(Window.partitionBy("template").orderBy(place))
    prefix = words.withColumn("i", i).filter(F.col("i") <= F.col("size") - F.col("need") + 1).select("template", "size", "need", "length", "token", "i")
    blocks = found.select("row", F.explode("blocks").alias("b")).select("row", "b.length", "b.no", "b.tokens")
    in_order = counts.withColumn("place", F.struct("documents", "token"))
    each = blocks.select("row", "length", "no", F.size("tokens").alias("b"), F.explode("tokens").alias("token")).join(in_order, "token")
    each = each.withColumn("j", F.row_number().over(Window.partitionBy("row", "length", "no").orderBy("place")))
    met = each.join(prefix, ["token", "length"]).groupBy("row", "length", "no", "template", "size", "need", "b").agg(F.min(F.struct("i", "j")).alias("first"))
    may = met.filter(1 + F.least(F.col("size") - F.col("first.i"), F.col("b") - F.col("first.j")) >= F.col("need"))
    both = may.select("row", "length", "no", "template").join(blocks, ["row", "length", "no"]).join(t.drop("length").withColumnRenamed("tokens", "own"), "template")
    overlap = F.size(F.array_intersect("tokens", "own"))
    return both.withColumn("overlap", overlap).filter("overlap >= need").select(
        "row", "length", "no", "template", "label", "overlap", (F.col("overlap") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None,
         threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks
    (blocks that match a template). ``score`` is the largest containment of a match, 0 without one."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    found = compact(docs, templates, phrases, threshold, id_col, text_col)
    by_row = matches(found, templates, threshold).groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("score"), F.countDistinct("length", "no").alias("n_blocks"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base = F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["start"])
    return found.join(by_row, "row", "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.concat(base, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"))
