"""Ranked lexical search over a K2-treap of the term-document grid.

Documents stand in blocks of bounded size.  A block's grid has a row for each
of its terms (those with the largest impacts first), a column for each of its
documents (shortest first, so that neighbours have like impacts) and the
term's impact in the document as the cell.  The treap is the compressed
quadtree over the grid: only cells that hold something exist, each with the
largest impact in it and a mask of its four quarters, whose cells follow each
other on the level below.

An item is searched for all its terms jointly.  A state is a range of
documents and, for every term that occurs in it, the cell on the term's row
path; its bound is the weighted sum of the cells' maxima.  States are opened
best first, some at a time, each into the two halves of its range, until a
range is one document, whose bound is its score.  States whose bound lies
under the item's k-th best score so far are dropped.  A few blocks are
searched first, and what they find is the floor for all others.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.common import table, written

K = 20
#: bytes of text, and documents, of a block (a longer text is a block of its own)
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 8192
#: distinct terms of a batch of items (an item with more is a batch of its own), items of a batch
BATCH_TERMS, BATCH_ITEMS = 1 << 16, 256
#: bytes of batches up to which they are broadcast; beyond, blocks of a group that they are dealt to
BROADCAST_BYTES, GROUP_BLOCKS = 4 << 20, 8
#: one block in so many is searched first
FIRST_BLOCKS = 16
#: states of an item opened at a time, at first and at most
OPENED, OPENED_MOST = 16, 4096

#: ASCII that separates terms becomes a blank, A-Z become a-z, all else stays (fixed by the contract)
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ONES = np.array([bin(m).count("1") for m in range(16)], np.int8)


def terms_of(text: str | None) -> list[bytes]:
    """Lower-cased terms of a whole text, repeats included."""
    return (text or "").encode().translate(_LETTERS).split()


def impacts(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of terms occurring ``tf`` times in documents of ``lengths`` terms."""
    m = 75 + (25 * lengths.astype(np.int64) * n_docs) // n_terms
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 12 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers at the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


class Treap:
    """Compressed quadtree over the cells (row, column, impact) of a grid.

    Cells of all levels stand in one array, the whole grid first: ``most`` is
    the largest impact in a cell, ``mask`` says which quarters hold something
    (bit 2 * lower + right), ``first`` where the cells of its quarters begin."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impact: np.ndarray):
        self.height = max(1, int(max(rows.max(initial=0), columns.max(initial=0))).bit_length())
        code = _spread(rows) << np.uint64(1) | _spread(columns)
        order = np.argsort(code)
        code, most = code[order], impact[order].astype(np.int64)
        levels = [(most, np.zeros(len(code), np.uint8), np.zeros(len(code), np.int64))]
        for _ in range(self.height):
            above = code >> np.uint64(2)
            begin = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1])))
            quarter = (np.uint8(1) << (code & np.uint64(3)).astype(np.uint8))
            most = np.maximum.reduceat(most, begin)
            levels.append((most, np.bitwise_or.reduceat(quarter, begin), begin))
            code = above[begin]
        levels.reverse()
        starts = np.concatenate(([0], np.cumsum([len(level[0]) for level in levels])))
        self.most = np.concatenate([level[0] for level in levels])
        self.mask = np.concatenate([level[1] for level in levels])
        self.first = np.concatenate([level[2] + below for level, below in zip(levels, starts[1:])])

    def quarter(self, cells: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The cell of a quarter, or -1 where it holds nothing."""
        mask = self.mask[cells]
        below = self.first[cells] + _ONES[mask & ((1 << which) - 1).astype(np.uint8)]
        return np.where(mask >> which.astype(np.uint8) & 1, below, -1)


def _best(item: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    order = np.lexsort((name, -score, item))
    g = item[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g, "left") < k]


def search(treap: Treap, item: np.ndarray, row: np.ndarray, weights: np.ndarray, floors: np.ndarray, names: np.ndarray, k: int):
    """(item, column, score) of each item's k best columns among those that
    reach its floor; equal scores in order of ``names``.

    ``item`` (ascending), ``row`` and ``weights`` list the items' terms;
    ``floors`` (by item) rise to the items' k-th scores."""
    got = (np.zeros(0, np.int64),) * 3
    # a state's pairs stand together; a pair is a term with its cell
    states, at = np.unique(item, return_inverse=True)
    owner, level, column = states, np.full(len(states), treap.height), np.zeros(len(states), np.int64)
    cell = np.zeros(len(item), np.int64)
    bound = np.zeros(len(states), np.int64)
    np.add.at(bound, at, weights * treap.most[0])
    opened, steps = OPENED, 0
    while len(owner):
        # the best states of every item
        order = np.lexsort((-bound, owner))
        rank = np.empty(len(order), np.int64)
        g = owner[order]
        rank[order] = np.arange(len(g)) - np.searchsorted(g, g, "left")
        now = rank < opened
        spot = np.cumsum(now) - 1
        mine = now[at]
        from_, r, w, c = spot[at[mine]], row[mine], weights[mine], cell[mine]
        who, high, left = owner[now], level[now] - 1, column[now]
        lower = r >> high[from_] & 1
        parts = []
        for right in (0, 1):
            below = treap.quarter(c, 2 * lower + right)
            has = below >= 0
            if not has.any():
                continue
            state, r2, w2, c2 = from_[has], r[has], w[has], below[has]
            begin = np.flatnonzero(np.concatenate(([True], state[1:] != state[:-1])))
            sums = np.add.reduceat(w2 * treap.most[c2], begin)
            ids = state[begin]
            sizes = np.diff(np.concatenate((begin, [len(state)])))
            parts.append((who[ids], high[ids], 2 * left[ids] + right, sums, sizes, r2, w2, c2))
        kept = ~now
        sizes = np.bincount(at, minlength=len(owner))
        parts.append((owner[kept], level[kept], column[kept], bound[kept], sizes[kept], row[~mine], weights[~mine], cell[~mine]))
        owner, level, column, bound, sizes, row, weights, cell = (np.concatenate(x) for x in zip(*parts))
        single = level == 0
        if single.any():
            got = tuple(np.concatenate((a, b)) for a, b in zip(got, (owner[single], column[single], bound[single])))
            top = _best(got[0], got[2], names[got[1]], k)
            got = tuple(a[top] for a in got)
            full = np.flatnonzero(np.bincount(got[0], minlength=len(floors)) >= k)
            lowest = np.full(len(floors), np.iinfo(np.int64).max)
            np.minimum.at(lowest, got[0], got[2])
            floors[full] = np.maximum(floors[full], lowest[full])
        # equal to the floor: a smaller name may still win
        open_ = ~single & (bound >= floors[owner])
        mine = np.repeat(open_, sizes)
        at = np.repeat(np.cumsum(open_) - 1, sizes)[mine]
        owner, level, column, bound = owner[open_], level[open_], column[open_], bound[open_]
        row, weights, cell = row[mine], weights[mine], cell[mine]
        steps += 1
        if steps > treap.height:
            opened = min(OPENED_MOST, 2 * opened)
    return got


_POSTINGS = ("block long, ids array<long>, lengths binary, words binary, spans binary, columns binary, tf binary, "
             "held long, terms long")


def build_index(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """Blocks of postings of all documents: what a block's treap is made of.

    held and terms are the block's number of documents with a term and of
    their terms; their sums over all blocks are what impacts depend on, so
    the treaps themselves are made when a block is searched."""
    frame = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    most_bytes, most_docs = BLOCK_BYTES, BLOCK_DOCS

    def block(name, keys, parts, words):
        lengths = np.array([len(p) for p in parts])
        order = np.argsort(lengths, kind="stable")
        column = np.empty(len(order), np.int64)
        column[order] = np.arange(len(order))
        code = np.concatenate(parts).astype(np.int64) << 32 | np.repeat(column, lengths)
        code, tf = np.unique(code, return_counts=True)
        return pd.DataFrame([{
            "block": name, "ids": [keys[i] for i in order], "lengths": lengths[order].astype("<i4").tobytes(),
            "words": b"\n".join(words), "spans": np.bincount(code >> 32, minlength=len(words)).astype("<i4").tobytes(),
            "columns": (code & 0xFFFFFFFF).astype("<u2").tobytes(), "tf": tf.astype("<i4").tobytes(),
            "held": len(keys), "terms": int(lengths.sum())}])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 33, 0
        ids, keys, parts, size = {}, [], [], 0
        for batch in batches:
            for k, t in zip(batch["key"].astype(object), batch["text"]):
                words = terms_of(t)
                if not words:
                    continue
                parts.append(np.array([ids.setdefault(w, len(ids)) for w in words], np.int32))
                keys.append(None if pd.isna(k) else int(k))
                size += len(t)
                if size >= most_bytes or len(keys) >= most_docs:
                    yield block(base + n, keys, parts, list(ids))
                    n, ids, keys, parts, size = n + 1, {}, [], [], 0
        if keys:
            yield block(base + n, keys, parts, list(ids))

    return written(frame.mapInPandas(task, _POSTINGS), "ranked_postings")


class _Block:
    """A block's treap and its terms' rows, read from its postings."""

    def __init__(self, r, n_docs: int, n_terms: int):
        lengths, spans = np.frombuffer(r["lengths"], "<i4"), np.frombuffer(r["spans"], "<i4")
        column, tf = np.frombuffer(r["columns"], "<u2").astype(np.int64), np.frombuffer(r["tf"], "<i4")
        self.missing = np.array([i is None or pd.isna(i) for i in r["ids"]], bool)
        self.ids = np.array([0 if gone else int(i) for i, gone in zip(r["ids"], self.missing)], np.int64)
        # documents without a key come last among equal scores
        self.names = np.empty(len(self.ids), np.int64)
        self.names[np.lexsort((self.ids, self.missing))] = np.arange(len(self.ids))
        impact = impacts(tf, lengths[column], n_docs, n_terms)
        term = np.repeat(np.arange(len(spans)), spans)
        top = np.maximum.reduceat(impact, np.concatenate(([0], np.cumsum(spans)[:-1])))
        by_impact = np.argsort(-top, kind="stable")
        row = np.empty(len(spans), np.int64)
        row[by_impact] = np.arange(len(spans))
        self.row = dict(zip(bytes(r["words"]).split(b"\n"), row.tolist()))
        self.treap = Treap(row[term], column, impact)


def item_terms(items: DataFrame, key="item_id", text="text") -> DataFrame:
    """(item, term, n): how often each term occurs in an item."""
    frame = items.select(F.col(key).alias("item"), F.col(text).cast("string").alias("text"))
    kind = frame.schema["item"].dataType.simpleString()

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, t in zip(batch["item"].astype(object), batch["text"]):
                words, n = np.unique(np.array(terms_of(t), object), return_counts=True)
                if len(words):
                    yield pd.DataFrame({"item": pd.Series([None if pd.isna(k) else k] * len(words), dtype=object), "term": words, "n": n})

    return frame.mapInPandas(task, f"item {kind}, term binary, n long").groupBy("item", "term").agg(F.sum("n").alias("n"))


def _meet(blocks: DataFrame, batches: DataFrame) -> DataFrame:
    """Every batch of items beside every block.  Batches whose measured size is
    small are broadcast; else they are dealt to groups of blocks by a shuffle."""
    size = batches.agg(F.sum(sum(F.octet_length(c) for c in batches.columns))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return blocks.crossJoin(F.broadcast(batches))
    groups = F.lit(max(1, blocks.count() // GROUP_BLOCKS))
    return blocks.withColumn("deal", F.pmod(F.xxhash64("block"), groups)).join(
        batches.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), groups.cast("long") - 1))).hint("merge"), "deal")


def rank(docs: DataFrame, items: DataFrame, k=K, key="doc_id", text="text", item_key="item_id", item_text="text") -> DataFrame:
    """(item_key, rank, key, score): each item's k best documents, equal scores
    by ascending key.

    Every document with at least one term counts, each row for itself, also
    where rows or keys repeat; documents without a key come last among equal
    scores.  Null or empty texts have no terms.  Rows that repeat an item's key
    are one item whose terms add up; a null key is an item too.  Items without
    a matching document, no items or no documents give no rows."""
    spark = docs.sparkSession
    kind = items.select(F.col(item_key)).schema[0].dataType.simpleString()
    nothing = spark.createDataFrame([], f"`{item_key}` {kind}, rank int, `{key}` long, score long")
    index = build_index(docs, key, text)
    n_docs, n_terms = index.agg(F.sum("held"), F.sum("terms")).first()
    # items are numbered once; a null key is a number like any other
    wanted = written(item_terms(items, item_key, item_text), "ranked_wanted")
    numbered = written(wanted.select("item").distinct().withColumn("number", F.monotonically_increasing_id()), "ranked_items")
    if not n_terms or numbered.isEmpty():
        return nothing
    terms = wanted.join(numbered, wanted["item"].eqNullSafe(numbered["item"])).select("number", "term", "n")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Distinct terms in batches."""
        for batch in batches:
            yield pd.DataFrame({"asked": [b"\n".join(batch["term"])]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, r in batch.iterrows():
                spans = np.frombuffer(r["spans"], "<i4")
                asked = set(bytes(r["asked"]).split(b"\n"))
                found = [(w, n) for w, n in zip(bytes(r["words"]).split(b"\n"), spans.tolist()) if w in asked]
                yield pd.DataFrame(found, columns=["term", "df"])

    asked = written(terms.select("term").distinct().mapInPandas(deal, "asked binary"), "ranked_asked")
    df = _meet(index.select("block", "words", "spans"), asked).select("words", "spans", "asked").mapInPandas(
        count, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = written(terms.join(df, "term").groupBy("number").agg(
        F.collect_list(F.struct("term", "n", "df")).alias("terms")), "ranked_weighed")

    most_terms, most_items = BATCH_TERMS, BATCH_ITEMS

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Items with their terms' weights, in batches; an item's terms are one text's."""
        numbers, floors, words, weights, sizes = [], [], [], [], []

        def made():
            return pd.DataFrame([{"numbers": np.array(numbers, "<i8").tobytes(), "floors": np.array(floors, "<i8").tobytes(),
                                  "asked": b"\n".join(words), "weights": np.array(weights, "<i8").tobytes(),
                                  "sizes": np.array(sizes, "<i4").tobytes()}])

        for batch in batches:
            for number, floor, found in zip(batch["number"], batch["floor"], batch["terms"]):
                if numbers and (len(numbers) >= most_items or len(words) + len(found) > most_terms):
                    yield made()
                    numbers, floors, words, weights, sizes = [], [], [], [], []
                numbers.append(number)
                floors.append(floor)
                words += [bytes(t["term"]) for t in found]
                weights += [t["n"] * weight(t["df"], n_docs) for t in found]
                sizes.append(len(found))
        if numbers:
            yield made()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, block, floors_of = None, None, {}
        for batch in batches:
            for _, r in batch.iterrows():
                if r["block"] != last:
                    last, block = r["block"], _Block(r, n_docs, n_terms)
                numbers, floors = np.frombuffer(r["numbers"], "<i8"), np.frombuffer(r["floors"], "<i8").copy()
                # what this task found in other blocks counts too
                floors = np.maximum(floors, [floors_of.get(n, 1) for n in numbers.tolist()])
                words, weights = bytes(r["asked"]).split(b"\n"), np.frombuffer(r["weights"], "<i8")
                rows = np.array([block.row.get(w, -1) for w in words], np.int64)
                item = np.repeat(np.arange(len(numbers)), np.frombuffer(r["sizes"], "<i4"))
                here = rows >= 0
                at, column, score = search(block.treap, item[here], rows[here], weights[here], floors, block.names, k)
                floors_of.update(zip(numbers.tolist(), floors.tolist()))
                good = score >= floors[at]
                at, column, score = at[good], column[good], score[good]
                keys = pd.arrays.IntegerArray(block.ids[column], block.missing[column])
                yield pd.DataFrame({"number": numbers[at], "key": keys, "score": score})

    def searched(blocks: DataFrame, floors: DataFrame | None, name: str) -> DataFrame:
        with_floor = weighed.withColumn("floor", F.lit(1).cast("long")) if floors is None else weighed.join(
            floors, "number", "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("long")))
        batches = written(with_floor.mapInPandas(
            pack, "numbers binary, floors binary, asked binary, weights binary, sizes binary"), "ranked_batches")
        return written(_meet(blocks, batches).mapInPandas(find, "number long, key long, score long"), name)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    early = F.pmod(F.xxhash64("block"), F.lit(FIRST_BLOCKS)) == 0
    first = searched(index.where(early), None, "ranked_first")
    floors = best(first).groupBy("number").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= k).select("number", "floor")
    rest = searched(index.where(~early), floors, "ranked_rest")
    ranked = best(first.unionByName(rest))
    return ranked.join(numbered, "number").select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")


def op12_ranked_search(spark, sf_dir):
    """The 20 best documents for every benchmark item."""
    return rank(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP12_SQL = r"""
WITH words AS (SELECT doc_id, rid, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
postings AS (SELECT rid, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT rid, count(*) AS n FROM words GROUP BY rid),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, whole GROUP BY term),
scores AS (SELECT a.item_id, p.rid, p.doc_id, sum(a.times * w.w *
    ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * l.n * whole.docs) // whole.terms))))::BIGINT AS score
  FROM asked a JOIN weights w ON a.term = w.term JOIN postings p ON a.term = p.term JOIN lengths l ON p.rid = l.rid, whole
  GROUP BY ALL)
SELECT item_id, (row_number() OVER r)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 20"""
