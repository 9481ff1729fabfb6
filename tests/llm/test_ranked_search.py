"""Ranked search over K2-treaps against brute force."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadpulse.llm import ranked_search
from roadpulse.llm.ranked_search import Treap, rank, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def brute(docs, items, k=20):
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(words(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m))
                    for w, times in terms.items() if c[w])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r, None if gone else d, -s) for r, (s, gone, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéБ中") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    text = lambda m: " ".join(rng.choice(vocabulary[: rng.choice((8, 40, 400))]).capitalize() + rng.choice(("", ",", "-x", "\t7"))
                              for _ in range(m))
    docs = [(i, text(rng.choice((0, 1, 5, 30, 200)))) for i in range(n)]
    docs += [(n + i, docs[3][1] or "copy a b") for i in range(40)]
    return docs, [(i, text(rng.choice((1, 3, 40)))) for i in range(30)]


def test_terms_follow_the_pattern():
    every = "".join(map(chr, range(0x250))) + "中文 Б_б 'İ' x"
    assert [w.decode() for w in terms_of(every)] == words(every)
    assert terms_of(None) == []


def test_treap_holds_the_grid_and_its_maxima():
    rng = np.random.default_rng(5)
    for rows, columns, n in ((1, 1, 1), (300, 9, 700), (5, 900, 600), (64, 64, 4096)):
        cells = np.unique(rng.integers(0, rows * columns, n))
        r, c, impact = cells // columns, cells % columns, rng.integers(1, 10**6, len(cells))
        treap = Treap(r, c, impact)
        # walk down to every cell of the grid
        for i in range(rows):
            node, height = np.zeros(1, np.int64), treap.height
            at = np.zeros(1, np.int64)
            while height and len(node):
                height -= 1
                lower = np.full(len(node), i >> height & 1)
                parts = [(treap.quarter(node, 2 * lower + right), 2 * at + right) for right in (0, 1)]
                below, at = (np.concatenate(x) for x in zip(*parts))
                assert (treap.most[below[below >= 0]] <= treap.most[0]).all()
                node, at = below[below >= 0], at[below >= 0]
            assert sorted(zip(at.tolist(), treap.most[node].tolist())) == sorted(zip(c[r == i].tolist(), impact[r == i].tolist()))


def test_search_keeps_what_ties_with_the_floor():
    row, column = np.zeros(50, np.int64), np.arange(50)
    treap = Treap(row, column, np.full(50, 9))
    names = np.arange(50)[::-1].copy()
    floors = np.ones(1, np.int64)
    item, col, score = search(treap, np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, 2), floors, names, 3)
    assert sorted(col.tolist()) == [47, 48, 49] and set(score.tolist()) == {18} and floors.tolist() == [18]


@pytest.mark.parametrize("sizes", [(8 << 20, 8192, 4 << 20, 256, 1 << 16), (2000, 8192, 0, 7, 40), (8 << 20, 3, 1 << 20, 256, 1 << 16)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK_BYTES", "BLOCK_DOCS", "BROADCAST_BYTES", "BATCH_ITEMS", "BATCH_TERMS"), sizes):
        monkeypatch.setattr(ranked_search, name, value)
    docs, items = corpus(300, 11)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(rank(df, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_edges(spark):
    docs = [(None, "alpha beta"), (None, "alpha beta"), (1, "Alpha beta"), (1, "Alpha beta"), (2, None), (3, ""), (4, ", . !"),
            (5, "beta " * 200_000 + "alpha"), (6, "x" * 300_000 + " gamma"), (7, "ÄÖ äö")]
    items = [(1, "alpha"), (1, "ALPHA beta beta"), (2, None), (3, "missing"), (None, "gamma äö"), (4, "x" * 300_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("RANK", F.lit("r")).withColumn("term", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("s"))
    assert got(rank(d, i)) == brute(docs, items)
    assert rank(d.limit(0), i).collect() == []
    assert rank(d, i.limit(0)).collect() == []
    assert rank(d.where("doc_id = 2"), i).collect() == []
    named = rank(d.withColumnRenamed("doc_id", "number"), i.withColumnRenamed("item_id", "item"), key="number", item_key="item")
    assert named.columns == ["item", "rank", "number", "score"] and got(named) == brute(docs, items)
