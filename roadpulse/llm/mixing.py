"""Mixing sources to target weights by systematic sampling (DataFrame only).

Every document of a source has the same expected number of copies, the
source's target over its size.  Documents stand in one fixed order (source,
size, id); their expected copies are prefix-summed within the source, one
seeded random offset per source is added, and a document is emitted once for
each whole number its step crosses.  Standing in size order, neighbours are
of like size, so the words taken stay near the target.

No window runs over documents.  One range shuffle puts them in order, the
row's place in its range comes from ``monotonically_increasing_id``, and only
the (range, source) counts are prefix-summed, so a source with a third of all
rows is spread over as many tasks as any other rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.common import WORD_PATTERN, fresh, table, written

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 42
#: expected copies are held in 2**-24ths, so prefix sums are exact integers
UNIT_BITS = 24
#: sources (one aggregated row each) up to which the table is broadcast
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap=CAP, seed=SEED) -> DataFrame:
    """Targets of (source, source_size): shares by weight of all sizes, none
    above ``cap`` times its source's size.

    The excess of capped sources is reshared by weight until none is above,
    which is water filling: with sources in order of cap over weight, the
    common level is the largest of (what is left) / (weights left)."""
    named = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = filled.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    listed = F.array(*[F.lit(int(w)) for w in weights])
    return (
        sizes
        .withColumn("weight", F.element_at(listed, ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")))
        .withColumn("limit", F.col("source_size") * cap)
        .withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
                    / F.sum("weight").over(onward))
        .withColumn("target", F.least(F.col("limit").cast("double"), F.max("level").over(everything) * F.col("weight")))
        .withColumn("units", F.when(F.col("source_size") > 0,
                                    F.floor(F.col("target") / F.col("source_size") * (1 << UNIT_BITS)))
                    .otherwise(F.lit(0)).cast("long"))
        .withColumn("offset", F.conv(F.substring(F.md5(F.concat(
            F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("n"))).cast("binary")), 1, 6),
            16, 10).cast("long"))
        .select("source", "source_size", "target", "units", "offset")
    )


def mix(docs: DataFrame, weights=WEIGHTS, cap=CAP, seed=SEED, text="text", source="source", key="doc_id",
        size=None) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken added.

    ``size`` names a column that holds sizes already; else ``text`` is counted.

    copies is how often the mix emits the row (0 to ``cap``); taken is copies
    times size.  Null or empty text: size 0, and such a row takes part in the
    sampling with taken 0.  A source of size 0 has target 0 and no copies.
    Null source: one source, ordered last.  Repeated rows and ids count each
    on their own; the result does not depend on how ties among equal rows
    fall.  Columns of ``docs`` named like the added ones are replaced.  An
    empty table gives an empty result.  The outcome is the same on reruns."""
    added = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added and c not in (text, source, key, size)])
    src, siz, spot = fresh(docs, "mix_source", "mix_size", "mix_spot")
    sized = docs.withColumn(src, F.col(source).cast("string")).withColumn(
        siz, F.coalesce(F.col(size).cast("long"), F.lit(0)) if size else word_count(F.col(text)))

    # one ordered, written copy: a row's place is then the same in every later read
    ordered = [F.col(src).asc_nulls_last(), F.col(siz), F.col(key).asc_nulls_last()]
    ranged = sized.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    placed = written(ranged.withColumn(spot, F.monotonically_increasing_id()), "mix")

    runs = placed.groupBy(F.col(src).alias("source"), F.shiftright(F.col(spot), 33).alias("range")).agg(
        F.min(spot).alias("first"), F.count(F.lit(1)).alias("n"), F.sum(siz).alias("words"))
    runs = written(runs, "mix_runs")
    targets = source_targets(runs.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap, seed)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
        .select("source", "range", "before").alias("r")
        .join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        .select(F.col("r.source").alias("m_source"), "range", "before", "source_size", "target", "units", "offset")
    )
    # one row per (range, source): as many as ranges and sources together
    if runs.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    rank = F.col(spot) + F.col("before") + 1
    whole, part = F.shiftright("units", UNIT_BITS), F.col("units") % (1 << UNIT_BITS)

    def crossed(n):
        return F.shiftright(n * part + F.col("offset"), UNIT_BITS)

    return (
        placed.join(plan, F.col(src).eqNullSafe(F.col("m_source"))
                    & (F.shiftright(F.col(spot), 33) == F.col("range")))
        .withColumn("copies", whole + crossed(rank) - crossed(rank - 1))
        .select(*[c for c in docs.columns if c.lower() not in added], F.col(siz).alias("size"), "source_size", "target", "copies",
                (F.col("copies") * F.col(siz)).alias("taken"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its copies say."""
    return (
        mix(docs, **options).filter(F.col("copies") > 0)
        .withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(*docs.columns)
    )


def op1_mix_sources(spark, sf_dir):
    """Mix all documents to the contract's weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs, size="size").select("doc_id", "size", "source_size", "target", "copies", "taken")


def mix_sql(documents="documents"):
    """DuckDB CTEs ending in ``mixed`` (all columns of ``documents`` and the added ones)."""
    return rf"""
sized AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {documents}),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
             FROM per_source),
levels AS (SELECT *, ((sum(source_size) OVER ())::BIGINT
             - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
             / (sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM weighted),
targets AS (SELECT *, least((3 * source_size)::DOUBLE, (max(level) OVER ()) * weight) AS target FROM levels),
rates AS (SELECT source, source_size, target,
            CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216)::BIGINT ELSE 0 END AS units,
            ('0x' || substr(md5('42:' || coalesce('s:' || source, 'n')), 1, 6))::BIGINT AS shift
          FROM targets),
ranked AS (SELECT d.*, r.source_size, r.target, r.units, r.shift,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) AS spot
           FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
mixed AS (SELECT *, (units // 16777216 + (spot * (units % 16777216) + shift) // 16777216
              - ((spot - 1) * (units % 16777216) + shift) // 16777216)::BIGINT AS copies FROM ranked)"""


OP1_SQL = f"WITH {mix_sql()} SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM mixed"
