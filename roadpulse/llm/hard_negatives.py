"""Hard-negative mining by threshold joins in the manner of L2AP.

Rows stand in shards of bounded size.  A batch of anchors meets a shard only
if the shard's largest components let some score reach an anchor's threshold;
these bounds are taken on shard summaries, before any vector is shipped.
Inside a meeting, dimensions are indexed from the heaviest on, and a row's
dimensions from where its suffix norm, times the largest suffix norm of the
anchors, can't reach the lowest threshold are left out of the index.  Partial
scores are accumulated list by list, pairs are dropped whose partial score
plus the product of the remaining norms stays under the anchor's threshold,
and what is left is scored exactly.

Thresholds start high and are lowered until the windows fill: a shard is first
searched near a window's upper end.  An anchor's own shard goes first; what it
fills gives the thresholds for all other shards, and a window that it can't
fill is searched down to its lower end.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.common import discard, table, written
from roadpulse.llm.vectors import LEAST, MOST, products, quantized, within

EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: the window of a negative's score, in hundredths of the positive's
LOW, HIGH = 30, 90
SCALE = 256
#: bytes of a shard's vectors, anchors of a batch, shard summaries bounded at a time
SHARD_BYTES, BATCH, SUMMARIES = 1 << 20, 256, 4096
#: dimensions accumulated at a time
STEP = 8
#: share of pairs left under which they are scored one by one
FEW = 0.02


def threshold_pairs(q: np.ndarray, t: np.ndarray, x: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of all pairs in ``may`` with an inner product of at
    least the query's threshold ``t``; exact for 64-bit integers."""
    width = q.shape[1]
    heavy = np.argsort(-np.square(x, dtype=float).sum(0), kind="stable")
    qf, xf = q[:, heavy].astype(float), x[:, heavy].astype(float)
    ends = np.minimum(np.arange(0, width + STEP, STEP), width)
    rest_q, rest_x = (np.sqrt(np.cumsum(np.square(v)[:, ::-1], 1)[:, ::-1]) for v in (qf, xf))
    rest_q, rest_x = (np.column_stack((v, np.zeros(len(v))))[:, ends] for v in (rest_q, rest_x))
    slack = 1e-9 * rest_q[:, 0].max(initial=0) * rest_x[:, 0].max(initial=0) + 1e-6
    # a row's indexed dimensions end where suffix norms can't reach the lowest threshold
    low = float(t.min(initial=MOST)) - slack
    indexed = (rest_x[:, :-1] * rest_q.max(0, initial=0)[:-1] >= low).sum(1)
    rows = np.argsort(-indexed, kind="stable")
    indexed, xf, rest_x, alive = indexed[rows], xf[rows], rest_x[rows], may[:, rows].copy()
    partial = np.zeros((len(q), len(x)))
    wanted = t.astype(float)[:, None] - slack
    for step, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        listed = int(np.searchsorted(-indexed, -step, "left"))  # rows whose index holds these dimensions
        # those whose index has ended: what is left is bounded by the norms there
        if not listed:
            break
        partial[:, :listed] += qf[:, a:b] @ xf[:listed, a:b].T
        alive[:, :listed] &= partial[:, :listed] + rest_q[:, step + 1:step + 2] * rest_x[:listed, step + 1] >= wanted
        if np.count_nonzero(alive) < FEW * alive.size:
            break
    else:
        step += 1
    # rows without any indexed dimension reach no threshold at all
    alive[:, indexed == 0] = False
    at, row = np.nonzero(alive)
    if len(at) < FEW * alive.size:
        score = within(q[at], x[rows[row]])
    else:
        score = products(q, x[rows])[at, row]
    good = score >= t[at]
    return at[good], rows[row[good]], score[good]


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each group's k best, ties to the smaller id."""
    order = np.lexsort((ids, ~score, group))  # ~ turns the order round, and no number overflows
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g, "left") < k]


def _kth(group: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """Each group's k-th best score; the least number where a group has fewer."""
    order = np.lexsort((~score, group))
    first = np.searchsorted(group[order], np.arange(n), "left")
    full = np.bincount(group, minlength=n) >= k
    out = np.full(n, LEAST)
    out[full] = score[order][first[full] + k - 1]
    return out


class Rows:
    """Rows read back from their packed columns."""

    def __init__(self, ids, labels, v):
        self.ids, self.labels, self.v = ids, labels, v

    @classmethod
    def read(cls, row, width: int, prefix=""):
        return cls(_read(row[prefix + "ids"]), _read(row[prefix + "labels"]), _read(row[prefix + "v"]).reshape(-1, width))

    def part(self, at: np.ndarray) -> "Rows":
        return Rows(self.ids[at], self.labels[at], self.v[at])


def _pack(numbers) -> bytes:
    return np.asarray(numbers, "<i8").tobytes()


def _read(data) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def window(positive: int, low=LOW, high=HIGH) -> tuple[int, int]:
    """Smallest and largest score of a positive's negatives; empty if crossed."""
    return -(-low * positive // 100), high * positive // 100


def _positives(q: Rows, floors: np.ndarray, rows: Rows, k: int):
    """(query, row, score) of each query's k best rows of its label."""
    may = (q.labels[:, None] == rows.labels[None, :]) & (q.ids[:, None] != rows.ids[None, :])
    at, row, score = threshold_pairs(q.v, floors, rows.v, may)
    best = _first(at, score, rows.ids[row], k)
    return at[best], row[best], score[best]


def _negatives(q: Rows, asked: np.ndarray, lows: np.ndarray, highs: np.ndarray, rows: Rows, k: int):
    """(window, row, score) of each window's k best rows of other labels.

    Window w belongs to query asked[w] and takes scores from lows[w] to
    highs[w].  Thresholds begin in the upper part of the windows and fall
    until every window has k rows or has been searched down to its end."""
    got = (np.zeros(0, np.int64),) * 3
    open_ = np.flatnonzero(lows <= highs)
    for share in (4, 2, 1):
        if not len(open_):
            break
        # whole numbers of any size: the step is taken before it is multiplied
        down = [int(h) - (int(h) - int(lo)) // share for h, lo in zip(highs[open_], lows[open_])]
        t = np.full(len(q.ids), MOST)
        np.minimum.at(t, asked[open_], np.array(down, np.int64))
        some = np.unique(asked[open_])
        may = q.labels[some][:, None] != rows.labels[None, :]
        at, row, score = threshold_pairs(q.v[some], t[some], rows.v, may)
        order = np.argsort(at, kind="stable")
        at, row, score = at[order], row[order], score[order]
        # each window of a query looks at the query's pairs
        place = np.searchsorted(some, asked[open_])
        first, last = np.searchsorted(at, place, "left"), np.searchsorted(at, place, "right")
        sizes = last - first
        pair = np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        win, row, score = np.repeat(open_, sizes), row[pair], score[pair]
        inside = (score >= lows[win]) & (score <= highs[win]) & (score >= np.repeat(np.array(down), sizes))
        win, row, score = win[inside], row[inside], score[inside]
        best = _first(win, score, rows.ids[row], k)
        win, row, score = win[best], row[best], score[best]
        full = np.bincount(win, minlength=len(lows)) >= k
        done = full[open_] if share > 1 else np.ones(len(open_), bool)
        ended = np.isin(win, open_[done])
        got = tuple(np.concatenate((g, x[ended])) for g, x in zip(got, (win, row, score)))
        open_ = open_[~done]
    return got


def _cut(width: int, every: int, k: int):
    """Shards of rows in order, their summaries, and the anchors in them with
    the k-th best score of their own label inside the shard."""
    rows_of = max(32, min(4096, SHARD_BYTES // (8 * width)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, n, ids, labels, rows = TaskContext.get().partitionId() << 33, 0, [], [], []

        def shard():
            v = np.array(rows, np.int64).reshape(len(rows), width)
            whole = Rows(np.array(ids, np.int64), np.array(labels, np.int64), v)
            asks = np.flatnonzero(whole.ids % every == 0)
            at, _, score = _positives(whole.part(asks), np.full(len(asks), LEAST), whole, k)
            return pd.DataFrame([{
                "shard": base + n, "ids": _pack(ids), "labels": _pack(labels), "v": _pack(v), "high": _pack(v.max(0)),
                "low": _pack(v.min(0)), "asks": _pack(asks), "floors": _pack(_kth(at, score, len(asks), k))}])

        for batch in batches:
            for i, label, v in zip(batch["id"], batch["label"], batch["v"]):
                ids.append(i)
                labels.append(label)
                rows.append(v)
                if len(rows) == rows_of:
                    yield shard()
                    n, ids, labels, rows = n + 1, [], [], []
        if rows:
            yield shard()
    return cut


_SHARDS = "shard long, ids binary, labels binary, v binary, high binary, low binary, asks binary, floors binary"
#: an anchor and its windows: the positives they belong to, and their lowest and highest scores
_ANCHORS = "home long, id long, label long, v binary, positive array<long>, scores array<long>, lows array<long>, highs array<long>"
#: the anchors of a batch; asked says which anchor a window belongs to
_BATCHES = ("batch long, q_ids binary, q_labels binary, q_v binary, asked binary, positive binary, scores binary, "
            "lows binary, highs binary")


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchors of the shards, each with one window: its label's scores from its floor on."""
    for batch in batches:
        for _, s in batch.iterrows():
            ids, labels, asks, floors = (_read(s[c]) for c in ("ids", "labels", "asks", "floors"))
            if not len(asks):
                continue
            v = _read(s["v"]).reshape(len(ids), -1)
            yield pd.DataFrame({"home": s["shard"], "id": ids[asks], "label": labels[asks], "v": [v[i].tobytes() for i in asks],
                                "positive": [[0]] * len(asks), "scores": [[0]] * len(asks),
                                "lows": [[f] for f in floors], "highs": [[MOST]] * len(asks)})


def _batched(anchors: DataFrame) -> DataFrame:
    """Anchors of neighbouring shards, put together in batches."""
    size = BATCH

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for a in range(0, len(batch), size):
                b = batch.iloc[a:a + size]
                flat = {c: _pack(np.concatenate([np.asarray(x, np.int64) for x in b[c]])) for c in ("positive", "scores", "lows", "highs")}
                yield pd.DataFrame([{
                    "batch": base + n, "q_ids": _pack(b["id"]), "q_labels": _pack(b["label"]), "q_v": b"".join(b["v"]),
                    "asked": _pack(np.repeat(np.arange(len(b)), [len(x) for x in b["lows"]])), **flat}])
                n += 1

    parts = max(1, math.ceil(anchors.count() / size))
    return written(anchors.repartitionByRange(parts, "home").sortWithinPartitions("home").mapInPandas(pack, _BATCHES), "negatives_batches")


def _met(shards: DataFrame, batches: DataFrame, width: int, run, schema: str, name: str) -> DataFrame:
    """``run`` over every batch and shard in which some score may reach a
    threshold.  The bounds are taken on the shards' smallest and largest
    components, in groups of summaries; only then are vectors shipped."""
    parts = max(1, math.ceil(shards.count() / SUMMARIES))
    part = F.pmod(F.xxhash64("shard"), F.lit(parts))
    summaries = shards.select("shard", "high", "low").groupBy(part.alias("part")).agg(
        F.collect_list(F.struct("shard", "high", "low")).alias("summaries"))  # SUMMARIES of them or about so
    asked = batches.select("batch", "q_v", "asked", "lows").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def bound(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            for _, b in chunk.iterrows():
                q = _read(b["q_v"]).reshape(-1, width)
                t = np.full(len(q), MOST)
                np.minimum.at(t, _read(b["asked"]), _read(b["lows"]))
                sides = np.array([np.concatenate((_read(s["high"]), _read(s["low"]))) for s in b["summaries"]])
                # a positive weight's share is largest at the largest component, a negative one's at the smallest
                best = products(np.hstack((np.maximum(q, 0), np.minimum(q, 0))), sides)
                near = (best >= t[:, None]).any(0)
                yield pd.DataFrame({"batch": b["batch"], "shard": [s["shard"] for s, ok in zip(b["summaries"], near) if ok]}, dtype="int64")

    meetings = written(asked.join(summaries, "part").mapInPandas(bound, "batch long, shard long"), "negatives_meetings")

    def meet(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            for _, r in chunk.iterrows():
                found = run(r, Rows.read(r, width, "q_"), Rows.read(r, width))
                if len(found):
                    yield found

    return written(meetings.join(batches, "batch").join(shards.select("shard", "ids", "labels", "v"), "shard")
                   .mapInPandas(meet, schema), name)


def _ranked(found: DataFrame, by: list[str], score: str, name: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), name)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, key="vec_id", label="label", vector="embedding", every=EVERY, positives=POSITIVES,
         negatives=NEGATIVES, low=LOW, high=HIGH, scale=SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose key is divisible by ``every``; their positives the
    ``positives`` best other rows of their label; a positive's negatives the
    ``negatives`` best rows of other labels whose score is from ``low`` to
    ``high`` hundredths of the positive's.  Scores are integer inner products
    of floor(scale * x), held at the 64-bit limits; ties go to the smaller key.

    Null keys, labels or vectors and vectors with null or non-finite
    components take no part.  Shorter vectors count as ended by zeros.  A key
    that repeats counts once, with its smallest (label, vector).  Positives
    with a score of zero take negatives of zero, those below zero none.  An
    empty table, or anchors without positives, give no rows."""
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = written(
        vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                       quantized(F.col(vector), scale).alias("v"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
        .groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"), "negatives_rows")
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if not width:
        # no rows, or only empty vectors, whose scores are all zero: one component says the same
        if rows.isEmpty():
            return vectors.sparkSession.createDataFrame([], out)
        width = 1
    padded = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    # rows with the same strongest component stand together, so that a shard's bounds say something
    strongest = F.array_max(F.transform("v", lambda x, i: F.struct(F.abs(x.cast("double")).alias("a"), i.alias("i"), x.alias("x"))))
    order = [strongest["i"], strongest["x"], F.col("id")]
    shards = written(padded.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(
        _cut(width, every, positives), _SHARDS), "negatives_shards")
    discard(rows)

    def best(row, q: Rows, rows: Rows) -> pd.DataFrame:
        at, row, score = _positives(q, _read(row["lows"]), rows, positives)
        return pd.DataFrame({"id": q.ids[at], "positive_id": rows.ids[row], "positive_score": score, "home": 0})

    first = written(shards.mapInPandas(_anchors, _ANCHORS), "negatives_anchors")
    batches = _batched(first)
    found = _met(shards, batches, width, best, "id long, positive_id long, positive_score long, home long", "negatives_positives")
    pairs = _ranked(found.drop("home"), ["id"], "positive_score", "positive_id", positives).join(first.select("id", "home"), "id")

    def fill(_, asked: pd.DataFrame, home: pd.DataFrame) -> pd.DataFrame:
        """The anchors of a shard with their windows, raised to what the shard itself fills."""
        made = []
        if len(asked) and len(home):
            rows = Rows.read(home.iloc[0], width)
            spot = {i: n for n, i in enumerate(rows.ids.tolist())}
            asked = asked.sort_values(["id", "positive_score", "positive_id"]).reset_index(drop=True)
            names, at = np.unique(asked["id"].to_numpy(), return_inverse=True)
            q = rows.part(np.array([spot[i] for i in names.tolist()]))
            ends = np.array([window(int(p), low, high) for p in asked["positive_score"]], np.int64).reshape(-1, 2)
            win, _, score = _negatives(q, at, ends[:, 0], ends[:, 1], rows, negatives)
            lows = np.maximum(ends[:, 0], _kth(win, score, len(asked), negatives))
            for n, name in enumerate(names):
                open_ = np.flatnonzero((at == n) & (ends[:, 0] <= ends[:, 1]))
                if len(open_):
                    made.append((int(home["home"].iloc[0]), int(name), int(q.labels[n]), q.v[n].tobytes(),
                                 *(x[open_].tolist() for x in (asked["positive_id"].to_numpy(), asked["positive_score"].to_numpy(),
                                                               lows, ends[:, 1]))))
        return pd.DataFrame(made, columns=[c.split()[0] for c in _ANCHORS.split(", ")])

    windows = written(pairs.groupBy("home").cogroup(
        shards.select(F.col("shard").alias("home"), "ids", "labels", "v").groupBy("home")).applyInPandas(fill, _ANCHORS), "negatives_windows")

    def worst(row, q: Rows, rows: Rows) -> pd.DataFrame:
        asked, positive, scores = (_read(row[c]) for c in ("asked", "positive", "scores"))
        win, at, score = _negatives(q, asked, _read(row["lows"]), _read(row["highs"]), rows, negatives)
        return pd.DataFrame({"anchor_id": q.ids[asked[win]], "positive_id": positive[win], "negative_id": rows.ids[at],
                             "positive_score": scores[win], "negative_score": score})

    found = _met(shards, _batched(windows), width, worst,
                 "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long", "negatives_found")
    return _ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector; every seventh label is turned by one first."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return mine(rows)


OP13_SQL = """
WITH held AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
vectors AS (SELECT vec_id, min({'label': label, 'v': v}) AS x FROM held GROUP BY vec_id),
terms AS (SELECT vec_id, x.label AS label, unnest(range(len(x.v))) AS i, unnest(x.v) AS c FROM vectors),
scores AS (SELECT q.vec_id AS anchor_id, d.vec_id AS other, q.label = d.label AS same, sum(q.c * d.c)::BIGINT AS score
  FROM terms q JOIN terms d ON q.i = d.i WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id GROUP BY ALL),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER w::INTEGER AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) QUALIFY rank <= 10"""
