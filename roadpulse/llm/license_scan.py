"""License scan: exact set-similarity join of text blocks with license templates
(DataFrame only).

A text's blocks are windows of words, half overlapping, twice as long as the
longest template, so every passage of a template's length lies whole in one.
A block matches a template if it holds at least ``containment`` of the
template's distinct words.  Template words are ordered by their frequency in
the whole corpus, rarest first.  A match must share one of the template's
first ``m - o + 1`` words (prefix filter; ``m`` words, overlap ``o`` needed),
have ``o`` words at all (length filter), and have enough words left after the
first shared one on both sides (positional filter); what passes is verified.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import ASCII_LOWER, ASCII_UPPER, ascii_lower, fresh, table, written

NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8

#: Phrases and their labels (fixed by the contract)
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public license notices, by label (fixed values)
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is "
               "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc", "licensed under cc by nc 4 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def normalized(text: Column) -> Column:
    """Lower-case words parted by single blanks; null: empty."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD, " "))


def _template_rows(templates):
    """(id, label, distinct words) of each template."""
    return [(i, label, list(dict.fromkeys(words.split()))) for i, (label, words) in enumerate(templates)]


def token_order(norm: DataFrame, column: str, words: list[str]) -> list[str]:
    """Template words by frequency over all texts, rarest first, ties by word.
    The result has one row per template word, however large the corpus."""
    counts = (
        norm.select(F.explode(F.split(column, " ")).alias("w")).filter(F.col("w").isin(words))
        .groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    seen = {r["w"]: r["n"] for r in counts}
    return sorted(words, key=lambda w: (seen.get(w, 0), w))


def scan_licenses(docs: DataFrame, text="text", templates=TEMPLATES, phrases=PHRASES, containment=CONTAINMENT) -> DataFrame:
    """``docs`` without its text, with n_words, n_base, first_word, last_word,
    base_labels, labels, score and matches (array of struct label, start,
    containment: every block that meets the threshold for some template).

    base: places where a phrase's words stand consecutively.  score: 1 where a
    phrase stands, else the best containment found, else 0.  Null or empty
    text: no words, empty labels, score 0.  Whole texts of any length are
    scanned; repeated rows each give a row; columns of ``docs`` named like an
    added one are replaced."""
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
    kept = [c for c in docs.columns if c.lower() not in added and c != text]
    key, norm, words, parts, blocks = fresh(docs, "scan_key", "scan_norm", "scan_words", "scan_parts", "scan_blocks")
    rows = _template_rows(templates)
    need = {i: max(1, math.ceil(containment * len(t) - 1e-9)) for i, _, t in rows}
    width = 2 * max(len(words_.split()) for _, words_ in templates)
    step = width // 2
    texts = docs.select(*kept, normalized(F.col(text)).alias(norm))
    order = token_order(texts, norm, sorted({w for _, _, t in rows for w in t}))
    rank = {w: r for r, w in enumerate(order)}
    ranked = {i: sorted(rank[w] for w in t) for i, _, t in rows}
    prefix = {i: ranked[i][: len(ranked[i]) - need[i] + 1] for i in ranked}
    rare = sorted({order[r] for p in prefix.values() for r in p})

    # base phrases: cut before each place, then count the words before each cut
    starts = "|".join(f"{p} " for p, _ in phrases)
    padded = F.concat(F.lit(" "), F.col(norm), F.lit(" "))
    any_phrase = F.lit(False)
    for p, _ in phrases:
        any_phrase = any_phrase | F.contains(padded, F.lit(f" {p} "))
    pieces = F.split(padded, f"(?<= )(?={starts})")
    blanks = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit("")))
    base_labels = F.array_sort(F.array_distinct(F.array_compact(F.array(
        *[F.when(F.contains(padded, F.lit(f" {p} ")), F.lit(label)) for p, label in phrases]))))

    lit_words = lambda ws: F.array(*[F.lit(w) for w in ws])
    in_order = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])

    def block(start):
        inside = F.slice(F.col(words), start + 1, F.lit(width))
        # words of no template can't match; the others stand by corpus frequency
        return F.struct(start.alias("start"), F.when(F.arrays_overlap(inside, lit_words(rare)), F.array_sort(F.transform(
            F.array_intersect(inside, lit_words(order)), lambda w: in_order[w]))).alias("ranks"))

    starts_at = F.sequence(F.lit(0), F.greatest(F.size(words) - step - 1, F.lit(0)), F.lit(step))
    scanned = written(
        texts
        .withColumn(words, F.split(norm, " "))
        .withColumn(parts, F.when(any_phrase, pieces))
        .select(
            F.monotonically_increasing_id().alias(key), *kept,
            F.when(F.col(norm) == "", F.lit(0)).otherwise(blanks(F.col(norm)) + 1).cast("long").alias("n_words"),
            F.coalesce(F.size(F.when(any_phrase, F.col(parts))) - 1, F.lit(0)).cast("long").alias("n_base"),
            F.when(any_phrase, blanks(F.col(parts)[0]) - 1).cast("long").alias("first_word"),
            F.when(any_phrase, blanks(padded) - 1 - blanks(F.element_at(parts, -1))).cast("long").alias("last_word"),
            base_labels.alias("base_labels"),
            F.when(F.arrays_overlap(words, lit_words(rare)),
                   F.filter(F.transform(starts_at, block), lambda b: b["ranks"].isNotNull())).alias(blocks)),
        "license_blocks")

    # the join: prefix words of the templates, a table as small as the templates themselves
    index = docs.sparkSession.createDataFrame(
        [(r, i, at, need[i], len(ranked[i]), label, ranked[i]) for i, label, _ in rows for at, r in enumerate(prefix[i])],
        "rank int, template int, at int, need int, m int, label string, all_ranks array<int>")
    hits = (
        scanned.filter(F.size(blocks) > 0).select(key, F.explode(blocks).alias("b"))
        .select(key, F.col("b.start").alias("start"), F.col("b.ranks").alias("ranks"), F.posexplode("b.ranks").alias("j", "rank"))
        .join(F.broadcast(index), "rank")
        .filter(F.size("ranks") >= F.col("need"))
        # a pair's first shared word is its prefix's first hit: what is left on both sides must do
        .filter(F.size(F.array_intersect(F.slice("all_ranks", F.lit(1), F.col("at")), F.col("ranks"))) == 0)
        .filter(1 + F.least(F.col("m") - F.col("at") - 1, F.size("ranks") - F.col("j") - 1) >= F.col("need"))
        .withColumn("shared", F.size(F.array_intersect("ranks", "all_ranks")))
        .filter(F.col("shared") >= F.col("need"))
        .groupBy(key).agg(F.array_sort(F.collect_set(F.struct(
            "label", F.col("start").cast("long").alias("start"), (F.col("shared") / F.col("m")).alias("containment")))).alias("matches"))
    )
    found = F.coalesce(F.col("matches"), F.array().cast("array<struct<label:string,start:bigint,containment:double>>"))
    return scanned.join(hits, key, "left").select(
        *kept, "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", found["label"])), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(found["containment"]), F.lit(0.0))).alias("score"),
        found.alias("matches"))


def op6_license_scan(spark, sf_dir):
    """Scan every whole text of documents for licenses."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("matches")


def _oracle():
    width = 2 * max(len(w.split()) for _, w in TEMPLATES)
    step = width // 2
    listed = ", ".join(f"('{label}', {sorted(set(words.split()))!r})" for label, words in TEMPLATES)
    places = " OR ".join(
        "(" + " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(p.split())) + ")" for p, _ in PHRASES)
    has = ", ".join(f"CASE WHEN contains(' ' || array_to_string(ws, ' ') || ' ', ' {p} ') THEN '{label}' END" for p, label in PHRASES)
    return rf"""
WITH norm AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
places AS (SELECT k, i FROM (SELECT k, ws, unnest(range(len(ws))) AS i FROM norm) WHERE {places}),
base AS (SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM places GROUP BY k),
templates(label, t) AS (VALUES {listed}),
blocks AS (SELECT k, ws[s + 1 : s + {width}] AS b FROM (
  SELECT k, ws, unnest(range(0, greatest(len(ws) - {step}, 1), {step})) AS s FROM norm)),
matched AS (SELECT k, label, max(len(list_intersect(b, t)) / len(t)) AS containment FROM blocks, templates
  WHERE len(list_intersect(b, t)) >= greatest(1, ceil({CONTAINMENT} * len(t) - 1e-9)) GROUP BY k, label),
labels AS (SELECT k, list(label) AS found, max(containment) AS best FROM matched GROUP BY k),
based AS (SELECT *, list_filter([{has}], lambda x: x IS NOT NULL) AS own FROM norm)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, array_to_string(list_sort(own), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(own, coalesce(found, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM based LEFT JOIN base USING (k) LEFT JOIN labels USING (k)"""


OP6_SQL = _oracle()
