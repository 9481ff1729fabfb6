"""Embedding near-dedup by spherical-cap filters.

Filter directions are a random product code: a codeword for each part of the
(rotated) coordinates (Becker, Ducas, Gama, Laarhoven, 2016).  A vector is
list-decoded to the directions nearest to it, the same number for every vector
(so none is without filters, however its parts are balanced), vectors meet in
their filters, and meetings are verified by the exact cosine.

Equal vectors are one class with a count.  A filter with many classes is cut
into chunks, and pairs of chunks are compared in tasks of bounded size.  A
link is counted only in the first filter its two ends share, and a task gives
link counts and a spanning forest, never its pairs.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import fresh, table, written
from roadpulse.llm.components import components

THRESHOLD = 0.9
#: filters of a vector, and the number of vectors beyond which it needs more
FILTERS, GROWS_FROM = 56, 10**6
#: inner products held at a time
DECODED = 1 << 22
#: classes of a chunk, and rows of a task
CHUNK, TASK_ROWS = 400, 20_000
SEED = 42


class ProductCode:
    """Codewords of each part, and the threshold, for ``n`` vectors of ``width``.

    There are about as many directions as vectors, so a filter's expected size
    stays the same as the table grows.  The best directions of two near vectors
    agree less often where directions lie denser, so their number grows past a
    million vectors, with the exponent of spherical caps at the threshold."""

    def __init__(self, n: int, width: int, filters=FILTERS, seed=SEED, threshold=THRESHOLD):
        rng = np.random.default_rng(seed)
        parts = min(width, 2 if n <= 10**8 else 3)
        words = max(8, math.ceil(max(n, 2) ** (1 / parts)))
        self.rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
        self.cuts = np.array_split(np.arange(width), parts)
        self.words = []
        for cut in self.cuts:
            w = rng.standard_normal((words, len(cut)))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) * math.sqrt(len(cut) / width))
        self.directions = words**parts
        grown = filters * max(1.0, n / GROWS_FROM) ** max(0.0, (1 - threshold) / (1 + threshold))
        self.filters = min(self.directions, math.ceil(grown))

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted ids of the ``filters`` directions nearest to each unit vector."""
        step = max(1, DECODED // len(self.words[0]))
        return [names for at in range(0, len(unit), step) for names in self._nearest(unit[at:at + step])]

    def _nearest(self, unit: np.ndarray) -> np.ndarray:
        turned = unit @ self.rotation
        sums = names = None
        for cut, w in zip(self.cuts, self.words):
            inner, code = _best(turned[:, cut] @ w.T, self.filters)
            if sums is None:
                sums, names = inner, code
                continue
            # a sum of the x-th and y-th best has x * y - 1 sums before it
            x, y = np.nonzero(np.outer(np.arange(1, sums.shape[1] + 1), np.arange(1, inner.shape[1] + 1)) <= self.filters)
            sums, at = _best(sums[:, x] + inner[:, y], self.filters)
            names = np.take_along_axis(names[:, x] * len(w) + code[:, y], at, 1)
        return np.sort(names, axis=1)


def _best(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest values of each row, largest first, and their places."""
    at = np.argpartition(-values, k - 1, axis=1)[:, :k] if k < values.shape[1] else np.tile(np.arange(values.shape[1]), (len(values), 1))
    order = np.argsort(-np.take_along_axis(values, at, 1), axis=1, kind="stable")
    at = np.take_along_axis(at, order, 1).astype(np.int64)
    return np.take_along_axis(values, at, 1), at


def _usable(vector):
    """Null where a vector is null, zero, or holds null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & some, vector)


def _units(vectors) -> np.ndarray:
    x = np.array(list(vectors), float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _met_before(lists: list[np.ndarray], name: int) -> np.ndarray:
    """Whether two members share a filter before ``name``, as a matrix."""
    before = [x[x < name] for x in lists]
    filters, seen = np.unique(np.concatenate(before), return_counts=True)
    filters = filters[seen > 1]
    has = np.zeros((len(lists), len(filters)), np.float32)
    for i, x in enumerate(before):
        at = np.searchsorted(filters, x)
        at = at[(at < len(filters))]
        has[i, at[np.isin(filters[at], x)]] = 1
    return has @ has.T > 0


def _verify(threshold: float):
    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, partners, counts = [], [], []
        for (name, low, high), cell in rows.groupby(["filter", "low", "high"], sort=True):
            cell = cell.sort_values(["chunk", "id"])
            n, unit = len(cell), _units(cell["v"])
            ids, copies, lists = cell["id"].to_numpy(), cell["copies"].to_numpy(), cell["filters"].tolist()
            near = unit @ unit.T >= threshold
            x, y = np.nonzero(np.triu(near, 1))
            if low != high:  # inside a chunk, pairs belong to that chunk's own cell
                side = cell["chunk"].to_numpy()
                x, y = x[side[x] != side[y]], y[side[x] != side[y]]
            if not len(x):
                continue
            own = ~_met_before(lists, name)[x, y]
            links = np.zeros(n, np.int64)
            np.add.at(links, x[own], copies[y[own]])
            np.add.at(links, y[own], copies[x[own]])
            some = np.flatnonzero(links)
            nodes += ids[some].tolist()
            partners += [None] * len(some)
            counts += links[some].tolist()
            # spanning forest: labels sink along links until none moves
            label = np.arange(n)
            while True:
                sunk = label.copy()
                np.minimum.at(sunk, x, label[y])
                np.minimum.at(sunk, y, label[x])
                sunk = sunk[sunk]
                if (sunk == label).all():
                    break
                label = sunk
            tied = np.flatnonzero(label != np.arange(n))
            nodes += ids[tied].tolist()
            partners += ids[label[tied]].tolist()
            counts += [0] * len(tied)
        return pd.DataFrame({"id": pd.array(nodes, "Int64"), "partner": pd.array(partners, "Int64"), "links": pd.array(counts, "Int64")})
    return verify


def near_duplicates(vectors: DataFrame, key="vec_id", vector="embedding", threshold=THRESHOLD, filters=FILTERS) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    n_links counts other rows linked directly, copies included; component_id
    is the smallest key reachable.  Vectors that are null, zero or hold null
    or non-finite components link with nothing, and vectors of different
    length never link.  Repeated rows are copies of each other.  A null key is
    never the smallest; a row without links keeps its own key."""
    usable, = fresh(vectors.select(key, vector), "usable")
    rows = vectors.select(F.col(key).alias("key"), _usable(F.col(vector)).alias(usable))
    classes = written(
        rows.filter(F.col(usable).isNotNull()).groupBy(F.col(usable).alias("v"))
        .agg(F.min("key").alias("smallest"), F.count(F.lit(1)).alias("copies"))
        .withColumn("id", F.monotonically_increasing_id()), "caps_classes")
    linked = None
    for width in [r[0] for r in classes.select(F.size("v")).distinct().collect()]:  # vector widths, as good as always one
        same = _links(classes.filter(F.size("v") == width), width, threshold, filters)
        linked = same if linked is None else linked.unionByName(same)
    if linked is None:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"),
                           F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    edges = linked.filter(F.col("partner").isNotNull()).select(F.col("id").alias("a"), F.col("partner").alias("b"))
    counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
    rooted = classes.select("id", "v", "smallest", "copies").join(
        components(edges).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = rooted.groupBy("root").agg(F.min("smallest").alias("component"))
    told = written(
        rooted.join(smallest, "root").join(counts, "id", "left")
        .select("v", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "caps_told")
    # unusable vectors get a null and so join nothing
    out = rows.join(told, rows[usable] == told["v"], "left")
    return out.select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component", "key").alias("component_id"),
                      F.coalesce(F.col("key") == F.coalesce("component", "key"), F.lit(True)).alias("kept"))


def _links(classes: DataFrame, width: int, threshold: float, filters: int) -> DataFrame:
    """(id, partner, links): a class's counted links, and forest edges."""
    code = ProductCode(classes.count(), width, filters, threshold=threshold)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(filters=pd.Series(code.decode(_units(batch["v"])), index=batch.index, dtype=object))

    coded = written(classes.select("id", "copies", "v").mapInPandas(
        decode, f"id long, copies long, v {classes.schema['v'].dataType.simpleString()}, filters array<{'int' if code.directions < 1 << 31 else 'long'}>"), "caps_coded")
    met = coded.select("id", F.explode("filters").alias("filter"))
    sizes = met.groupBy("filter").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    chunks = F.ceil(F.col("n") / CHUNK)
    chunk = F.pmod(F.xxhash64("id"), chunks)
    cells = written(
        met.join(sizes, "filter").select("id", "filter", chunk.alias("chunk"), F.explode(
            F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("other"))
        .select("id", "filter", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")),
        "caps_cells")
    tasks = max(1, math.ceil(cells.count() / TASK_ROWS))
    task = F.pmod(F.xxhash64("filter", "low", "high"), F.lit(tasks))
    return written(
        cells.join(coded, "id").withColumn("task", task).groupBy("task").applyInPandas(
            lambda rows: _verify(threshold)(rows), "id long, partner long, links long"), "caps_links")


def op7_embedding_dedup(spark, sf_dir):
    """Near-duplicate links and components of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
