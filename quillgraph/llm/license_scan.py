"""License scan: exact phrases, and an exact set-similarity join of text blocks with license templates.

DataFrame operations only. A block is a line, or a run of up to LINES adjacent lines, as notices are wrapped; it matches a template
if it contains at least a threshold's share of the template's distinct words and all words that tell it from others. Template words are ordered by how many texts
of the corpus have them, rarest first. A match must then contain one of a template's first words
(prefix filter), enough template words (length filter), and enough words from its first common one on
(positional filter); what passes is counted exactly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import table
from quillgraph.llm.text_sql import ascii_lower
from quillgraph.operators.components import checkpoint

#: Everything but 0-9, a-z and characters beyond ASCII separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: (label, notice, words that a match must have): license notices in common use.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License', "apache 2"),
    ("apache", "Released under the Apache License", "apache released"),
    ("mit", "Released under the MIT License", "mit released"),
    ("mit", "Licensed under the MIT License", "mit licensed"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission hereby granted"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission fee hereby granted"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution binary"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla 2"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse 2"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "gnu general"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gnu general program"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "gnu lesser library"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "gnu affero program"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered domain"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived law rights"),
    ("cc0", "Licensed under CC0 1.0", "cc0"),
    ("cc-by", "Licensed under CC BY 4.0", "cc by licensed"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", "cc by nd"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
]
#: Adjacent lines that a notice may be wrapped over.
LINES = 4
THRESHOLD = 0.8


def template_words(notice: str) -> list[str]:
    return sorted({w for w in re.split(SEPARATORS, re.sub("[A-Z]+", lambda m: m[0].lower(), notice)) if w})


def need(words: list[str], threshold: float) -> int:
    """The least number of a template's words that reaches the threshold."""
    return math.ceil(threshold * len(words) - 1e-9)


def _spaced(text: Column) -> Column:
    """A lowered text's words, one space between."""
    return F.trim(F.regexp_replace(text, SEPARATORS, " "))


def _words(spaced: Column) -> Column:
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _stands(spaced: Column, phrase: str) -> Column:
    return F.contains(F.concat(F.lit(" "), spaced, F.lit(" ")), F.lit(f" {phrase} "))


def _places(words: str, phrase: str) -> Column:
    """Where the phrase's words stand consecutively, as indexes from 0 of the column ``words``, which is NULL if no phrase stands."""
    parts = phrase.split(" ")
    # a function of a stored column: one that splits would split again at every index
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0)))
    found = F.filter(starts, lambda k: F.slice(words, k + 1, len(parts)) == F.array(*map(F.lit, parts)))
    return F.coalesce(found, F.array().cast("array<int>"))


def _joined(n: int) -> Callable[[Column], Column]:
    return lambda i: F.array_distinct(F.flatten(F.slice("of", i, F.lit(n))))


def contained(blocks: DataFrame, frequency: dict[str, int], templates: list[tuple[str, str, str]], threshold: float) -> DataFrame:
    """``(row, template, share)``: the template blocks of (row, block, words) rows; words are distinct words of a block.

    frequency: how many texts have a template word; it orders the filters and changes no result.
    """
    sets = [sorted(template_words(t), key=lambda w: (frequency.get(w, 0), w)) for _, t, _ in templates]
    telling = F.array(*[F.lit(r.split()) for *_, r in templates])
    order = sorted({w for s in sets for w in s}, key=lambda w: (frequency.get(w, 0), w))
    prefixes = [F.struct(F.lit(w).alias("word"), F.lit(t).alias("template"), F.lit(j).alias("j"), F.lit(len(s)).alias("size"), F.lit(need(s, threshold)).alias("need")) for t, s in enumerate(sets) for j, w in enumerate(s[: len(s) - need(s, threshold) + 1])]
    index = blocks.sparkSession.range(1).select(F.inline(F.array(*prefixes)))  # as large as the templates
    ordered = blocks.withColumn("words", F.array_intersect(F.lit(order), F.col("words")))
    ordered = ordered.where(F.size("words") >= min(need(s, threshold) for s in sets))
    tokens = ordered.select("row", "block", "words", F.posexplode("words").alias("i", "word"))
    first = tokens.join(F.broadcast(index), "word").groupBy("row", "block", "template", "size", "need").agg(F.min(F.struct("i", "j", "words")).alias("p"))
    rest = F.lit(1) + F.least(F.size("p.words") - F.col("p.i") - 1, F.col("size") - F.col("p.j") - 1)
    close = first.where((F.size("p.words") >= F.col("need")) & (rest >= F.col("need")))
    close = close.where(F.size(F.array_except(F.get(telling, F.col("template")), F.col("p.words"))) == 0)
    common = F.size(F.array_intersect(F.col("p.words"), F.get(F.array(*[F.lit(s) for s in sets]), F.col("template"))))
    return close.withColumn("common", common).where("common >= need").select("row", "template", (F.col("common") / F.col("size")).alias("share"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD, lines: int = LINES) -> DataFrame:
    """Phrases and template blocks of every text.

    Returns key, n_words, n_base (places of all phrases), first_word and last_word (smallest and
    largest start, from 0; NULL without one), base_labels, labels (those of templates too; distinct, sorted,
    comma-joined; empty without one), score: 1 where a phrase stands, else the largest share of a
    matching template, else 0. NULL counts as empty. Keys may be NULL or repeat; other columns of docs are not
    read. Empty input, empty result. A very long text is a row of as many blocks as it has lines, times ``lines``, if it holds a
    template's telling words and enough others; else it is never split.
    """
    vocabulary = sorted({w for _, t, _ in templates for w in template_words(t)})
    spaced = F.col("s")
    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), ascii_lower(F.col(text)).alias("t"))
    rows = rows.withColumn("s", _spaced(F.col("t")))
    known = F.array_intersect(_words(spaced), F.lit(vocabulary))
    some = F.lit(False)
    for p in phrases:
        some = some | _stands(spaced, p)
    n_words = F.when(spaced == "", F.lit(0)).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1)
    rows = rows.select("key", "row", "t", n_words.cast("bigint").alias("n_words"), known.alias("known"), F.when(some, F.split(spaced, " ")).alias("w"))
    rows = rows.select("*", *[_places("w", p).alias(f"p{k}") for k, p in enumerate(phrases)])
    places = F.flatten(F.array(*[f"p{k}" for k in range(len(phrases))]))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())]))))
    may = F.lit(False)
    for _, t, telling in templates:
        may = may | ((F.size(F.array_except(F.lit(telling.split()), F.col("known"))) == 0) & (F.size(F.array_intersect(F.col("known"), F.lit(template_words(t)))) >= need(template_words(t), threshold)))
    rows = rows.select("key", "row", "t", "n_words", places.alias("places"), base.alias("base"), "known")
    # a text is kept only where all its words together could make a match
    rows = checkpoint(rows.select("key", "row", "n_words", "places", "base", "known", F.when(may, F.col("t")).alias("t")))

    counted = rows.select(F.explode("known").alias("w")).groupBy("w").count().collect()  # as many rows as the templates have words
    single = rows.where("t IS NOT NULL").select("row", F.transform(F.split("t", "\n"), lambda x: F.array_intersect(_words(_spaced(x)), F.lit(vocabulary))).alias("of"))
    runs = [F.when(F.size("of") >= n, F.transform(F.sequence(F.lit(1), F.size("of") - n + 1), _joined(n))) for n in range(1, lines + 1)]
    blocks = single.select("row", F.posexplode(F.flatten(F.array_compact(F.array(*runs)))).alias("block", "words"))
    found = contained(blocks, {r[0]: r[1] for r in counted}, templates, threshold)
    names = F.lit([label for label, *_ in templates])
    found = found.groupBy("row").agg(F.collect_set(F.get(names, F.col("template"))).alias("more"), F.max("share").alias("share"))

    joined = rows.join(found, "row", "left")
    labels = F.array_sort(F.array_union(F.col("base"), F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        F.col("key").alias(key),
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op6_sql() -> str:
    def places(phrase: str) -> str:
        parts = phrase.split(" ")
        same = " AND ".join(f"w[k + {i + 1}] = '{p}'" for i, p in enumerate(parts))
        return f"list_filter(range(0, len(w) - {len(parts) - 1}), lambda k: {same})"

    templates = ", ".join(f"('{label}', {template_words(t)!r}, {need(template_words(t), THRESHOLD)}, {telling.split()!r})" for label, t, telling in TEMPLATES)
    base = " || ".join(f"CASE WHEN len({places(p)}) > 0 THEN ['{label}'] ELSE [] END" for p, label in PHRASES.items())
    every = " || ".join(places(p) for p in PHRASES)
    words = f"list_filter(string_split_regex({{}}, '{SEPARATORS}'), lambda x: x <> '')"
    return f"""
WITH t(label, words, need, telling) AS (VALUES {templates}),
d AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
s AS (SELECT doc_id, r, x, {words.format('x')} AS w FROM d),
b AS (SELECT doc_id, r, len(w) AS n_words, {every} AS places, {base} AS base FROM s),
p AS (SELECT r, string_split(x, chr(10)) AS y FROM d),
l AS (SELECT r, {words.format('line')} AS w FROM (SELECT r, unnest(list_transform(range(1, len(y) - n + 2), lambda i: array_to_string(y[i:i + n - 1], ' '))) AS line FROM p, (SELECT unnest(range(1, {LINES + 1})) AS n) WHERE len(y) >= n)),
m AS (SELECT r, list(DISTINCT label) AS more, max(len(list_intersect(w, words)) / len(words)) AS share
      FROM l, t WHERE len(list_intersect(w, words)) >= need AND len(list_intersect(w, telling)) = len(telling) GROUP BY r)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
       CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0) END AS score
FROM b LEFT JOIN m USING (r)
"""
