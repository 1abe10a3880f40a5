"""License scans by an exact set-similarity join of text blocks with notice templates, in DataFrame operations only.

A block is a line of a text, or a run of words across lines, as notices are wrapped: a template is compared with every run of
twice as many words as it has, so that words put in front of lines, as numbers or comment marks, do no harm. A block
matches a template if it holds at least 4/5 of the template's distinct words. Template words are
ordered by their document frequency over all texts, rarest first. A matching block must hold one of a template's rarest
words (its prefix), so texts without any are left alone; blocks of the others are joined to an index of the prefixes,
under length and positional filters, and what is left is verified. Runs are only looked at round the words of prefixes. Only template words of a block are kept, as no others
count towards containment. The index has a row for each word of a template's prefix, so it is broadcast.

Beside the join, places are found where a base phrase's words stand one behind the other, in any line or across lines.

Nulls count as empty texts: no words, no places, no labels, score 0. Repeated rows get repeated results. Very long texts
and lines are read whole. Null or clashing ids do no harm: rows are told apart by a key of their own.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import LOWER, UPPER, ascii_lower, spaced, spaced_words, written

TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
# fixed values: base phrases and their labels
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# notices that licenses ask for, as words
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
]


def needed(n: int) -> int:
    """Words of a template of n that a block must hold: 4/5, rounded up."""
    return -(-4 * n // 5)


def run_length(template: str) -> int:
    """Words of a run that a template is compared with."""
    return 2 * len(template.split())


def _words(c):
    """Words of a text or line; one empty word, which no template has, if there are none."""
    return F.split(spaced(c, BETWEEN), " ")


def _strings(values) -> F.Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _stands_at(ws: list[str]):
    """A condition on a place in _words."""
    return lambda i: reduce(and_, [F.get("_words", i + k) == w for k, w in enumerate(ws)])


def order(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """Document frequencies of the template words: a row for each word, whatever the number of texts."""
    own = docs.select(F.array_intersect(_words(ascii_lower(F.col(text))), _strings(vocabulary)).alias("w"))
    counts = own.select(F.explode("w").alias("w")).groupBy("w").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r[0]: r[1] for r in counts}


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (largest containment of a matching block;
    1 with a base phrase; else 0)."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    df = order(docs, text, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (df[w], w)))}
    sets = [(i, label, sorted(set(t.split()), key=rank.get)) for i, (label, t) in enumerate(templates)]
    prefixes = [(w, i, p, len(ws), needed(len(ws))) for i, _, ws in sets for p, w in enumerate(ws[: len(ws) - needed(len(ws)) + 1])]
    least = min(needed(len(ws)) for *_, ws in sets)
    ranked = _strings(sorted(vocabulary, key=rank.get))

    base = docs.select(F.col(doc_id).alias("_id"), ascii_lower(F.coalesce(text, F.lit(""))).alias("_text"))
    base = base.withColumn("_spaced", spaced(F.col("_text"), BETWEEN)).withColumns({"_words": F.split("_spaced", " "), "_joined": F.concat(F.lit(" "), "_spaced", F.lit(" "))})
    places = []
    for phrase, _ in phrases:
        at = F.filter(F.sequence(F.lit(0), F.size("_words") - len(phrase.split())), _stands_at(phrase.split()))
        places.append(F.when(F.contains("_joined", F.lit(f" {phrase} ")), at).otherwise(F.array().cast("array<int>")))
    lines = F.split("_text", "\n")
    blocks = F.filter(F.transform(lines, lambda l, i: F.struct(i.alias("block"), F.array_intersect(ranked, _words(l)).alias("words"))), lambda b: F.size(b["words"]) >= least)
    rare = sorted({p[0] for p in prefixes})
    hit = F.arrays_overlap("_words", _strings(rare))
    reach = max(run_length(t) for _, t in templates)
    anchors = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda x: x["word"].isin(rare))
    start = lambda x: F.greatest(x["i"] - reach + 1, F.lit(0))
    near = F.transform(anchors, lambda x: F.struct(x["word"].alias("word"), (x["i"] - start(x)).alias("at"), F.slice("_words", start(x) + 1, x["i"] - start(x) + reach).alias("words")))
    base = base.select("_id", spaced_words(F.col("_spaced")).alias("n_words"), F.array(*places).alias("_places"), F.when(hit, blocks).alias("_blocks"), F.when(hit, near).alias("_near"))
    base = written(base.withColumn("_row", F.monotonically_increasing_id()))

    # block words are in the common order, so a word's place is its rank within the block
    entries = base.where(F.size("_blocks") > 0).select("_row", F.explode("_blocks").alias("b")).select("_row", "b.block", "b.words", F.posexplode("b.words").alias("j", "word"))
    idx = spark.createDataFrame(prefixes, "word string, template int, i int, n int, need int")
    size = F.size("words")
    close = (size >= F.col("need")) & (F.col("j") <= size - F.col("need")) & (1 + F.least(F.col("n") - F.col("i"), size - F.col("j")) - 1 >= F.col("need"))
    found = entries.join(F.broadcast(idx), "word").where(close).select("_row", "block", "words", "template", "n", "need").dropDuplicates(["_row", "block", "template"])
    table = spark.createDataFrame([(i, label, ws) for i, label, ws in sets], "template int, label string, own array<string>")
    overlap = F.size(F.array_intersect("words", "own"))
    matches = found.join(F.broadcast(table), "template").where(overlap >= F.col("need")).select("_row", "label", (overlap / F.col("n")).alias("share"))
    spans = spark.createDataFrame([(w, label, ws, len(ws), needed(len(ws)), run_length(templates[i][1])) for i, label, ws in sets for w in ws[: len(ws) - needed(len(ws)) + 1]], "word string, label string, own array<string>, n int, need int, length int")
    close_by = base.where(F.size("_near") > 0).select("_row", F.explode("_near").alias("b")).select("_row", "b.*").join(F.broadcast(spans), "word").where(F.size(F.array_intersect("words", "own")) >= F.col("need"))
    runs = F.transform(F.sequence(F.greatest(F.col("at") - F.col("length") + 1, F.lit(0)), "at"), lambda i: F.size(F.array_intersect(F.slice("words", i + 1, F.col("length")), "own")))
    across = close_by.select("_row", "label", "n", "need", F.array_max(runs).alias("o")).where("o >= need").select("_row", "label", (F.col("o") / F.col("n")).alias("share"))
    by_row = matches.union(across).groupBy("_row").agg(F.collect_set("label").alias("_labels"), F.max("share").alias("_share")).withColumnRenamed("_row", "_of")

    starts = F.flatten("_places")
    named = F.array_distinct(F.array_compact(F.array(*[F.when(F.size(F.col("_places")[k]) > 0, label) for k, (_, label) in enumerate(phrases)])))
    out = base.join(by_row, base["_row"] == by_row["_of"], "left")
    return out.select(
        F.col("_id").alias(doc_id), "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(named), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(named, F.coalesce("_labels", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size(starts) > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )


def sql() -> str:
    """The same by plain comparison of every line with every template."""
    places = " + ".join(f"len(p{k})" for k in range(len(PHRASES)))
    lists = ", ".join("list_filter(range(len(ws)), lambda i: " + " AND ".join(f"ws[i + {j + 1}] = '{w}'" for j, w in enumerate(p.split())) + f") AS p{k}" for k, (p, _) in enumerate(PHRASES))
    base = "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES)) + "], lambda x: x IS NOT NULL)))"
    values = ", ".join(f"({i}, '{label}', list_distinct(string_split('{t}', ' ')))" for i, (label, t) in enumerate(TEMPLATES))
    every = " || ".join(f"p{k}" for k in range(len(PHRASES)))
    token = TOKEN.replace("'", "''")
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(t, '{token}') AS ws FROM d),
b AS (SELECT r, doc_id, len(ws) AS n_words, {lists} FROM w),
templates AS (SELECT * FROM (VALUES {values}) AS v(i, label, own)),
blocks AS (SELECT r, list_distinct(regexp_extract_all(l, '{token}')) AS ws FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)),
hits AS (SELECT r, label, len(list_intersect(ws, own)) AS o, len(own) AS n FROM blocks, templates WHERE len(ws) * 5 >= len(own) * 4),
m AS (SELECT r, list(DISTINCT label) AS ls, max(CAST(o AS DOUBLE) / n) AS share FROM hits WHERE 5 * o >= 4 * n GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST({places} AS BIGINT) AS n_base, CAST(list_min({every}) AS BIGINT) AS first_word, CAST(list_max({every}) AS BIGINT) AS last_word, array_to_string({base}, ',') AS base_labels, array_to_string(list_sort(list_distinct({base} || coalesce(ls, []))), ',') AS labels, CASE WHEN {places} > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score FROM b LEFT JOIN m USING (r)"""
