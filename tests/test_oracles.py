"""Every SQL-checked catalog query against its DuckDB oracle at sf0.001."""
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import _rows, duck_connect  # noqa: E402

SLOW = {"geo_clusters", "train_models", "feature_importance", "assemble_features", "forecast",
        "stream_forecast", "stream_feedback", "retrain_with_feedback", "model_io_roundtrip",
        "training_facts", "geo_cluster_assignment", "model_io_differences"}
NAMES = sorted(n for n in entry.oracle_sql() if n not in SLOW)


@pytest.fixture(scope="module")
def duck(sf_dir):
    return duck_connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = duck.sql(entry.oracle_sql()[name])
    d_cols, d_rows = res.columns, res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _rows(s_cols, s_rows, 6) == _rows(d_cols, d_rows, 6)
