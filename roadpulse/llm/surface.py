"""Dense surface features of whole texts, and bounded training samples."""
from __future__ import annotations

import re
from operator import eq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]")
#: a digit or sign before a letter; inside a word it may stand for one
INNER_SIGN = re.compile(r"[\d@$!*|+.\-_](?=[^\W\d_])")
#: signs that prose uses, and signs that it seldom does
PROSE_SIGNS, ODD_SIGNS = ".,;:'\"()-", "&$%#*|@^~=<>{}[]\\/_+`"

NAMES = ("long", "letters", "capitals", "capital_words", "digits", "prose_signs", "odd_signs", "shouts", "odd_words",
         "obfuscated", "repeats", "novel", "line_repeats", "word_length", "long_words", "lone_signs")


def surface(text: str | None) -> list[float]:
    """One value per name in ``NAMES``; null and empty texts: zeros."""
    if not text:
        return [0.0] * len(NAMES)
    n = len(text)
    tokens = text.split()
    k = max(1, len(tokens))
    count = text.count
    digits, prose, odd = sum(map(count, "0123456789")), sum(map(count, PROSE_SIGNS)), sum(map(count, ODD_SIGNS))
    shouts = count("!") + count("?")
    words = sum(map(len, tokens))
    letters = max(0, words - digits - prose - odd - shouts)
    obfuscated = sum(1 for m in INNER_SIGN.finditer(text) if m.start() and text[m.start() - 1].isalpha())
    lines = [x for x in text.split("\n") if x.strip()]
    sizes = list(map(len, tokens))
    lone = [t for t, size in zip(tokens, sizes) if size == 1] if sizes.count(1) else []
    return [
        min(1.0, k / 1000),
        letters / n,
        len(CAPITALS.findall(text)) / max(1, letters),
        sum(map(str.isupper, tokens)) / k,
        digits / n,
        prose / n,
        odd / n,
        shouts / k,
        odd / k,
        obfuscated / k,
        sum(map(eq, tokens, tokens[1:])) / k,
        len(set(tokens)) / k,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, letters / k / 20),
        sum(map((20).__lt__, sizes)) / k,
        sum(1 for t in lone if not t.isalnum()) / k,
    ]


def sampled(ids: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, those of the smallest id hashes: the same on
    every run.  ``ids`` has one row per id."""
    return ids.orderBy(F.xxhash64(key), key).limit(bound)


def texts_of(docs: DataFrame, ids: DataFrame, text: str, key: str) -> DataFrame:
    """(id, text, and the other columns of ``ids``) of a bounded set of ids.

    The set is broadcast, so no text is shuffled; of rows that repeat an id,
    however many, one text stays."""
    ids = ids.withColumnRenamed(key, "id")
    found = docs.select(F.col(key).alias("found"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(ids), F.col("found") == F.col("id"))
    return found.groupBy(*ids.columns).agg(F.min("text").alias("text"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, learnable, text: str, key: str, bound: int) -> DataFrame:
    """(id, y, text) of documents with a usable label ``y`` (0 or 1), for at
    most ``bound`` labelled ids.  Labels repeated for an id count as their
    largest; ids without a label, or labelled null, are left out."""
    ids = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(
        F.max(label).cast("int").alias("y")).filter(learnable)
    return texts_of(docs, sampled(ids, key, bound), text, key)
