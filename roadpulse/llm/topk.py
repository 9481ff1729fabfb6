"""Exact top-k search by block-at-a-time pruning.

Rows stand in document-range blocks with a forward index (the rows' integer
vectors) and, per term (component and sign), the block's largest impact.  A
query's bound for a block is the sum of its terms' maxima; blocks are scored
from the highest bound down until the bounds fall below the query's k-th
score.  Each query starts with the k-th score inside its own block.

Shards of blocks meet batches of queries, both of bounded size, so the work of
a task does not grow with the table.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.common import table, written
from roadpulse.llm.vectors import LEAST, products, quantized

K = 20
#: rows of a block, blocks of a shard, queries of a batch
BLOCK, SHARD, BATCH = 256, 32, 1024
#: below every score
NONE = LEAST


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best of listed candidates, ties to smaller id."""
    order = np.lexsort((ids, ~score, query))  # ~ turns the order round, and no number overflows
    q = query[order]
    first = np.searchsorted(q, q, "left")
    return order[np.arange(len(q)) - first < k]


def _cut_blocks(width: int, every: int, k: int):
    """Blocks of rows in order; queries take the k-th best score in their block."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, n, ids, rows = TaskContext.get().partitionId() << 33, 0, [], []

        def block():
            v = np.array(rows, np.int64).reshape(len(rows), width)
            names = np.array(ids, np.int64)
            asks = np.flatnonzero(names % every == 0)
            scores = products(v[asks], v)
            scores[names[asks][:, None] == names[None, :]] = NONE
            floor = np.partition(scores, -k, axis=1)[:, -k] if len(rows) >= k and len(asks) else np.full(len(asks), NONE)
            return pd.DataFrame({
                "block": [base + n], "ids": [names.tobytes()], "m": [v.astype("<i8").tobytes()],
                "high": [v.max(0).astype("<i8").tobytes()], "low": [v.min(0).astype("<i8").tobytes()],
                "asks": [asks.astype("<i8").tobytes()], "floors": [floor.astype("<i8").tobytes()]})

        for batch in batches:
            for i, v in zip(batch["id"], batch["v"]):
                ids.append(i)
                rows.append(v)
                if len(rows) == BLOCK:
                    yield block()
                    n, ids, rows = n + 1, [], []
        if rows:
            yield block()
    return cut


def _search(width: int, k: int):
    def search(_, queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if not len(queries) or not len(blocks):
            return empty
        read = lambda column: np.vstack([np.frombuffer(x, "<i8").reshape(-1, width) for x in column])
        blocks = blocks.sort_values("block")
        names, q, floor = queries["query_id"].to_numpy(), read(queries["v"]), queries["floor"].to_numpy().copy()
        # a positive weight's impact is largest at a block's maximum, a negative one's at its minimum
        bound = products(np.hstack((np.maximum(q, 0), np.minimum(q, 0))), np.hstack((read(blocks["high"]), read(blocks["low"]))))
        order = np.argsort(bound, axis=1, kind="stable")[:, ::-1]
        ids = [np.frombuffer(x, "<i8") for x in blocks["ids"]]
        rows = [np.frombuffer(x, "<i8").reshape(-1, width) for x in blocks["m"]]
        got = (np.zeros(0, np.int64),) * 3  # query position, id, score
        alive = np.arange(len(q))
        for step in range(len(rows)):
            at = order[alive, step]
            keep = bound[alive, at] >= floor[alive]  # equal: a smaller id may still win
            alive, at = alive[keep], at[keep]
            if not len(alive):
                break
            new = []  # scores of all candidates that may still be among the k best
            for b in np.unique(at):
                asking = alive[at == b]
                scores = products(q[asking], rows[b])
                hit = (scores >= floor[asking][:, None]) & (names[asking][:, None] != ids[b][None, :])
                x, y = np.nonzero(hit)
                new.append((asking[x], ids[b][y], scores[x, y]))
            got = tuple(np.concatenate([g, *parts]) for g, parts in zip(got, zip(*new)))
            best = _best(*got, k)
            got = tuple(g[best] for g in got)
            full = np.bincount(got[0], minlength=len(q)) >= k
            lowest = np.full(len(q), np.iinfo(np.int64).max)
            np.minimum.at(lowest, got[0], got[2])
            floor = np.where(full, np.maximum(floor, lowest), floor)
        return pd.DataFrame({"query_id": names[got[0]], "vec_id": got[1], "score": got[2]})
    return search


def top_k(vectors: DataFrame, k=K, every=20, key="vec_id", vector="embedding", scale=64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by
    ``every``, the k highest integer inner products over all other rows.

    Null keys, null vectors and vectors with null or non-finite components
    take no part.  Shorter vectors count as ended by zeros.  A key that repeats
    counts once, with its smallest vector; an id is never its own candidate.
    Scores beyond 64 bits are held at the limits.  Equal scores: smaller id
    first.  An empty table gives an empty result."""
    rows = written(
        vectors.select(F.col(key).cast("long").alias("id"), quantized(F.col(vector), scale).alias("v"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull()).groupBy("id").agg(F.min("v").alias("v")), "topk_rows")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    padded = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    # rows with the same strongest component stand together, so that maxima say something
    strongest = F.array_max(F.transform("v", lambda x, i: F.struct(F.abs(x.cast("double")).alias("a"), i.alias("i"), x.alias("x"))))
    ordered = [strongest["i"], strongest["x"], F.xxhash64("v"), F.col("id")]
    blocks = written(
        padded.repartitionByRange(*ordered).sortWithinPartitions(*ordered).mapInPandas(
            _cut_blocks(width, every, k), "block long, ids binary, m binary, high binary, low binary, asks binary, floors binary"),
        "topk_blocks")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, b in batch.iterrows():
                at = np.frombuffer(b["asks"], "<i8")
                ids, v = np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["m"], "<i8").reshape(-1, width)
                yield pd.DataFrame({"query_id": ids[at], "floor": np.frombuffer(b["floors"], "<i8"),
                                    "v": [v[i].tobytes() for i in at]})

    queries = written(blocks.select("ids", "m", "asks", "floors").mapInPandas(ask, "query_id long, floor long, v binary"), "topk_queries")
    batches, shards = math.ceil(queries.count() / BATCH), math.ceil(blocks.count() / SHARD)
    if not batches:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    zero = F.lit(0).cast("long")
    asked = queries.withColumn("batch", F.pmod(F.xxhash64("query_id"), F.lit(batches))).withColumn(
        "shard", F.explode(F.sequence(zero, F.lit(shards - 1).cast("long"))))
    held = blocks.select("block", "ids", "m", "high", "low").withColumn(
        "shard", F.pmod(F.xxhash64("block"), F.lit(shards))).withColumn(
        "batch", F.explode(F.sequence(zero, F.lit(batches - 1).cast("long"))))
    found = asked.groupBy("shard", "batch").cogroup(held.groupBy("shard", "batch")).applyInPandas(
        _search(width, k), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir):
    """Top 20 of every twentieth vector against all rows of embeddings."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP10_SQL = """
WITH vectors AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
terms AS (SELECT vec_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM vectors),
scores AS (SELECT q.vec_id AS query_id, d.vec_id, sum(q.x * d.x)::BIGINT AS score
  FROM terms q JOIN terms d ON q.i = d.i WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20"""
