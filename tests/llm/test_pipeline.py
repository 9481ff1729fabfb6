"""The pipeline against its stages done plainly, one after another."""
import os
import sys
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from roadpulse.llm import mixing, quality, toxicity
from roadpulse.llm.common import fold, table

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_operators import _fingerprint  # noqa: E402


def test_pipeline(spark, sf_dir, tmp_path):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = quality.classify(docs, labels, fold("doc_id", quality.FOLDS) != quality.HELD_OUT).filter("predicted = 1").select(*docs.columns)
    clean = toxicity.classify(good, labels, fold("doc_id", toxicity.FOLDS) != toxicity.HELD_OUT).filter("predicted = 0").select(*docs.columns)
    rows = sorted(clean.collect(), key=lambda r: r["doc_id"])
    assert 0 < len(rows) < docs.count()

    prints, root = [_fingerprint(r["text"] or "") for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                low, old = sorted((root[i], root[j]))
                root = [low if x == old else x for x in root]
    kept = [r for i, r in enumerate(rows) if root[i] == i]
    assert len(kept) < len(rows)

    spark.createDataFrame(kept, docs.schema).coalesce(1).write.parquet(str(tmp_path / "kept"))
    copies = dict(duckdb.connect().sql(
        f"WITH kept AS (SELECT * FROM read_parquet('{tmp_path}/kept/*.parquet')), {mixing.mix_sql('kept')} "
        "SELECT doc_id, copies FROM mixed").fetchall())

    out = corpus_pipeline.run(spark, sf_dir).collect()
    starts, tokens, sequences = defaultdict(list), {}, defaultdict(int)
    for r in out:
        starts[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
        tokens[r["doc_id"]] = r["doc_tokens"]
        sequences[r["sequence_id"]] += r["length"]
    assert set(tokens) == {i for i, n in copies.items() if n}
    for i, n in tokens.items():  # each copy of a document is there in whole
        assert Counter(starts[i]) == Counter({k: copies[i] for k in range(n)})
    assert max(sequences.values()) <= 1024


def test_stages_take_rows_of_their_predecessor(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.col("doc_id") < 60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert out.distinct().exceptAll(docs.distinct()).count() == 0, name
