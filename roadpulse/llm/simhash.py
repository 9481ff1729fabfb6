"""SimHash near-dedup by covering locality-sensitive hashing.

Bit ``i`` of a fingerprint has a non-zero vector of radius + 1 bits; table
``v`` keeps the bits whose vector has odd inner product with ``v`` (Pagh,
"CoveringLSH", 2016).  Any set of up to radius differing bits spans less than
the whole space, so some ``v`` is orthogonal to all of it and that table's mask
drops every differing bit: each pair within the radius shares a bucket.

Only distinct fingerprints are hashed, and a bucket gives a spanning forest of
its links, not all its pairs.  A bucket with more than ``BUCKET`` fingerprints
is covered again on the bits its mask left free, which halves them each time,
so the exact answer never needs a large bucket in one task.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.common import fresh, table, written
from roadpulse.llm.components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: distinct fingerprints that one task compares with each other; more are covered again
BUCKET = 200
#: free bits at which a bucket, of at most 2**7 fingerprints then, is compared in any case
LAST_BITS = 7
_CHUNK = 1 << 16


def _fingerprint(text: str | None, shingle: int) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1:].tolist()
    of, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(first), _CHUNK):
        hashes = np.array([of(joined[a:b], SEED) for a, b in zip(first[at:at + _CHUNK], last[at:at + _CHUNK])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(first)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint(text, shingle=SHINGLE):
    """SimHash of a text column as a (signed) long; no words: 0."""
    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_fingerprint(t, shingle) for t in texts], dtype="int64")
    return hashed(text)


def _masks(free: int, radius: int) -> list[int]:
    """Covering masks over the bits of ``free``, one for each non-zero vector."""
    count = (1 << (radius + 1)) - 1
    bits = [i for i in range(64) if free >> i & 1]
    # the free bits take the non-zero vectors in turn
    return [sum(1 << i for k, i in enumerate(bits) if bin((k % count + 1) & v).count("1") % 2) for v in range(1, count + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(radius: int):
    """Spanning forest (pairs) of the links inside each list of fingerprints."""
    @F.pandas_udf("array<struct<a:long,b:long>>")
    def forest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            out = []
            for members in lists:
                left, edges = np.array(members, np.int64), []
                while len(left):
                    reached, left = [left[0]], left[1:]
                    while reached and len(left):
                        node = reached.pop()
                        near = np.bitwise_count(np.bitwise_xor(left, node).view(np.uint64)) <= radius
                        reached += left[near].tolist()
                        edges += [(int(node), int(x)) for x in left[near]]
                        left = left[~near]
                out.append(edges)
            yield pd.Series(out, dtype=object)
    return forest


def links(prints: DataFrame, radius=RADIUS, bucket=BUCKET) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` exactly as
    all pairs within ``radius`` bits would."""
    spark, every = prints.sparkSession, (1 << 64) - 1
    parents, todo, found = {0: 0}, prints.select("fp", F.lit(0).alias("path")), None
    while True:
        # masks of this level: a path's own mask joined with each cover of its free bits
        rows, children = [], {}
        for path, mask in parents.items():
            for sub in dict.fromkeys(_masks(every & ~mask, radius)):
                child = len(children) + 1
                children[child] = mask | sub
                rows.append((path, child, _signed(mask | sub)))
        if not parents[next(iter(parents))]:
            covers = F.explode(F.array(*[F.struct(F.lit(c).alias("child"), F.lit(m).cast("long").alias("mask")) for _, c, m in rows]))
            keyed = todo.select("fp", covers.alias("c")).select("fp", "c.child", F.col("fp").bitwiseAND(F.col("c.mask")).alias("key"))
        else:
            # as many rows as there are masks, whatever the data
            covers = F.broadcast(spark.createDataFrame(rows, "path int, child int, mask long"))
            keyed = todo.join(covers, "path").select("fp", "child", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        keyed = written(keyed, "cover")
        sizes = keyed.groupBy("child", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        shared = written(keyed.join(sizes, ["child", "key"]), "cover_shared")
        # so few free bits hold few fingerprints, and could not be covered again
        done = F.col("child").isin([c for c, m in children.items() if 64 - m.bit_count() <= LAST_BITS]) | (F.col("n") <= bucket)
        small = shared.filter(done).groupBy("child", "key").agg(F.collect_list("fp").alias("l"))
        edges = written(small.select(F.explode(_forest(radius)("l")).alias("e")).select("e.a", "e.b").distinct(), "cover_edges")
        found = edges if found is None else found.unionByName(edges)
        large = shared.filter(~done)
        hot = [r["child"] for r in large.select("child").distinct().collect()]  # masks, not data
        if not hot:
            return found
        # a fingerprint goes on under each mask in whose large bucket it stands
        parents = {c: children[c] for c in hot}
        todo = large.select("fp", F.col("child").alias("path"))


def near_duplicates(docs: DataFrame, text="text", key="doc_id", shingle=SHINGLE, radius=RADIUS, keep=(),
                    names=("fp", "component_id")) -> DataFrame:
    """(key, the columns in ``keep``, fp, component_id) of every row; ``names``
    are those of the last two.

    component_id is the smallest id reachable over links of at most ``radius``
    differing bits.  Null and empty texts have fingerprint 0 and link like any
    other.  Repeated ids each give a row.  A null id is never the smallest:
    its row takes its component's id, or null if the component has none."""
    columns = list(dict.fromkeys([key, *keep]))
    fp, node, component = fresh(docs.select(*columns), "fp", "node", "component")
    hashed = written(docs.select(*columns, fingerprint(F.col(text), shingle).alias(fp)), "simhash")
    prints = written(hashed.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("id")), "simhash_prints")
    linked = components(links(prints, radius))
    rooted = prints.join(linked, prints["fp"] == linked["node"], "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = written(rooted.join(smallest, "root").select(
        F.col("fp").alias(node), F.col("component_id").alias(component)), "simhash_named")
    return hashed.join(named, hashed[fp] == named[node]).select(
        *[hashed[c] for c in columns], hashed[fp].alias(names[0]), named[component].alias(names[1]))


def one_of_each(docs: DataFrame, text="text", key="doc_id", **options) -> DataFrame:
    """One document of each near-duplicate group: the one with its smallest id."""
    fp, component, place = fresh(docs, "of_fp", "of_component", "of_place")
    marked = near_duplicates(docs, text, key, keep=docs.columns, names=(fp, component), **options)
    # rows that repeat an id are thinned before the shuffle
    group = F.coalesce(component, fp)
    first = Window.partitionBy(key, group).orderBy(F.col(text).isNull(), F.xxhash64(text))
    return (
        marked.filter(F.col(key).eqNullSafe(F.col(component)))
        .withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).select(*docs.columns)
    )


def op8_simhash(spark, sf_dir):
    """Near-duplicate components of all documents."""
    marked = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
