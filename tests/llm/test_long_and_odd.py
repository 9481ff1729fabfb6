"""Very long runs and texts, record layouts, and numbers at their limits."""
import json

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadpulse.llm import chat, packing, topk
from roadpulse.llm.vectors import LEAST, MOST

LONG_RUNS = ["a" + " " * 1_000_000 + "b", "a" + "\t" * 300_000 + "b c", "x\n" + "\n" * 400_000, "a" + " \t\r\n" * 100_000 + " b",
             "word " * 50_000 + " " * 5000 + "end", "-" * 200_000, "a" * 200_000, " " * 100_000]


@pytest.mark.parametrize("n", range(len(LONG_RUNS)))
def test_long_runs_get_the_tokenizers_ids(n):
    exact = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = np.frombuffer(packing.WordIds()(LONG_RUNS[n]), "<u4").tolist()
    assert ids == exact.encode(LONG_RUNS[n], add_special_tokens=False).ids


def test_packing_survives_a_long_blank_run(spark):
    docs = spark.createDataFrame([(1, LONG_RUNS[0]), (2, "short"), (3, LONG_RUNS[3])], "doc_id long, text string")
    rows = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all")).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3} and all(r["n"] == r["all"] for r in rows)


def test_the_end_bears_no_loss_and_segments_are_limited(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(400)], "doc_id long, text string").coalesce(1)
    got = packing.pack(docs)
    per = got.groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("length").alias("tokens"), F.sum("loss_tokens").alias("loss")).collect()
    # 1200 tokens would fit into two sequences, but a sequence takes MAX_SEGMENTS documents
    assert len(per) >= 400 / packing.MAX_SEGMENTS and max(r["n"] for r in per) <= packing.MAX_SEGMENTS
    assert sum(r["loss"] for r in per) == sum(r["tokens"] for r in per) - 400


def test_texts_beyond_twenty_million_characters(spark):
    rows = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant")], "conv_id long, turn long, role string").withColumn(
        "text", F.concat(F.lit("\\<|"), F.repeat(F.lit("ab"), 10_500_000)))
    got = chat.format_chats(chat.conversation_records(rows)).select(
        F.char_length("formatted").alias("n"), F.size(chat.read_turns(F.col("formatted"))).alias("turns"),
        F.char_length(chat.read_loss_text(F.col("formatted"), F.col("loss_spans"))).alias("loss")).first()
    assert got["turns"] == 2 and got["loss"] == 21_000_003 and got["n"] > 42_000_000


RECORDS = {
    '{"instruction":"i","input":"x","output":"o"}': [("user", "i\n\nx"), ("assistant", "o")],
    '{"instruction":"i","input":"","output":"o","id":7}': [("user", "i"), ("assistant", "o")],
    '{"system":"s","instruction":"i","output":"o"}': [("system", "s"), ("user", "i"), ("assistant", "o")],
    '{"messages":[{"role":"user","content":"u","id":1,"name":"n"},{"role":"assistant","content":"a"}]}': [("user", "u"), ("assistant", "a")],
    '{"data":{"prompt":"p","response":"r","score":1}}': [("user", "p"), ("assistant", "r")],
    '{"data":{"messages":[{"role":"user","content":"u"}],"lang":"en"}}': [("user", "u")],
    '{"prompt":"p","completion":"c","meta":{"a":{"b":1}}}': [("user", "p"), ("assistant", "c")],
    '{"prompt":null,"response":"r"}': [("user", ""), ("assistant", "r")],
    '{"question":"q","answer":"[{not a list"}': [("user", "q"), ("assistant", "[{not a list")],
    '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"{\\"prompt\\":1}"}]}': [("user", "h"), ("assistant", '{"prompt":1}')],
    '{"prompt":"p"}': None, '{"unknown":"p","response":"r"}': None, "[1]": None, "no json": None, '{"prompt":{"x":1},"response":"r"}': None,
}


def test_layouts(spark):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(RECORDS)], "n int, record string")
    got = chat.format_chats(frame).select("n", F.when(F.col("formatted").isNotNull(), chat.read_turns(F.col("formatted"))).alias("t")).collect()
    for r in got:
        expected = list(RECORDS.values())[r["n"]]
        assert (None if r["t"] is None else [tuple(t) for t in r["t"]]) == expected, list(RECORDS)[r["n"]]


def test_field_paths(spark):
    record = json.dumps({"b": {"y": [{"q": 1}, {"p": 2}], "x": "v"}, "a": [1, 2], "c": [{"k": 1}]})
    got = spark.createDataFrame([(record,)], "r string").select(chat.field_paths(F.col("r"))).first()[0]
    assert got == "a|b.x|b.y[].p|b.y[].q|c[].k"


def test_turns_without_a_number_come_last(spark):
    rows = spark.createDataFrame([(1, None, "assistant", "z"), (1, 5, "user", "b"), (1, 2, "system", "a")],
                                 "conv_id long, turn long, role string, text string")
    got = chat.format_chats(chat.conversation_records(rows)).select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [t["text"] for t in got] == ["a", "b", "z"]


def test_topk_at_the_limits_and_with_repeated_keys(spark):
    rows = [(0, [1e17, 0.0]), (1, [1e17, 0.0]), (2, [-1e17, 0.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (3, [0.25, 0.5]), (4, None)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, MOST), (0, 2, 3, 16 * 6_400_000_000_000_000_000), (0, 3, 2, LEAST)] or got == [
        (0, 1, 1, MOST), (0, 2, 3, MOST), (0, 3, 2, LEAST)]


@pytest.mark.parametrize("sizes", [(16, 4, 8), (256, 32, 1024)])
def test_topk_over_many_shards_and_batches(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "SHARD", "BATCH"), sizes):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(1500, 12)), 2)
    v[100:160] = v[100]  # copies: ties
    q = np.floor(v * 64).astype(np.int64)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in topk.top_k(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert len(got) == 75
    for i, found in got.items():
        s = q @ q[i]
        order = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-s[j], j))[:20]
        assert sorted(found) == [(n + 1, j, s[j]) for n, j in enumerate(order)]
