"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""
import pytest
from pyspark.sql import functions as F

from roadpulse.llm import (chat, embedding_dedup, language_model, license_scan, mixing, packing, quality, simhash,
                           topk, toxicity)

LONG = "word " * 60_000 + "x" * 50_000
ROWS = [
    (1, "plain words in a row, and then some more of them", "en", "a", 48),
    (1, "plain words in a row, and then some more of them", "en", "a", 48),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (None, "a text without an id", None, "b", 20),
    (4, LONG, "de", "b", len(LONG)),
    (5, " \t\n", "fr", None, 3),
    (6, "MIT License\n mit license", "fr", "b", 24),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that the operators add or use themselves
CLASHES = ("size", "target", "copies", "taken", "score", "predicted", "n_words", "labels", "fp", "_fp", "component_id", "key",
           "y", "x", "_mix_spot", "_quality_kept", "_toxic_score", "sampled_id", "labelled_id", "start", "word", "c")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *[F.lit("extra").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (6, 1, 0)],
                                 "doc_id long, quality int, toxic int")


def _nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _any():
    return F.lit(True)


OPERATORS = {
    "mix": lambda d, l: mixing.mix(d),
    "toxicity": lambda d, l: toxicity.classify(d, l, _any()),
    "quality": lambda d, l: quality.classify(d, l, _any()),
    "pack": lambda d, l: packing.pack(d),
    "lm": lambda d, l: language_model.score_texts(d, _any()),
    "license": lambda d, l: license_scan.scan_licenses(d),
    "simhash": lambda d, l: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_documents(spark, docs, clashing, labels, name):
    run = OPERATORS[name]
    rows = run(docs, labels).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    if name == "pack":
        assert {i for _, i in ids} == {0, 1, 2, 3, 4, 5, 6}
    else:
        assert ids == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    assert len(run(clashing, labels).collect()) == len(rows)
    assert run(_nothing(spark), labels).collect() == []
    assert len(run(docs, labels.limit(0)).collect()) == len(rows)


def test_scores_are_probabilities(docs, labels):
    for rows in (toxicity.classify(docs, labels, _any()).collect(), quality.classify(docs, labels, _any()).collect()):
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_pipeline_stages_keep_the_columns(clashing, labels):
    for stage in (lambda d: quality.good_documents(d, labels), lambda d: toxicity.clean_documents(d, labels),
                  simhash.one_of_each, mixing.mixed_documents):
        assert stage(clashing).columns == clashing.columns
        stage(clashing).collect()


def test_empty_texts_link_and_long_ones_do_not(docs):
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got[2] == got[3] == got[5] == (0, 2)
    assert got[4][1] == 4 and got[1][1] == 1


def test_license_edges(docs):
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    assert (got[6]["n_base"], got[6]["first_word"], got[6]["last_word"], got[6]["base_labels"]) == (2, 0, 2, "mit")
    assert got[3]["n_words"] == 0 and got[3]["labels"] == "" and got[3]["first_word"] is None
    assert got[4]["n_words"] == 60_001


def test_chats(spark):
    odd = 'a <|im_end|> \\ <\\|im_sep|> "quoted"\n' + "<" * 3
    records = spark.createDataFrame([
        (1, '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": null}]}'),
        (2, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'),
        (3, '{"prompt": "", "response": "r"}'), (4, '{"instruction": "i", "output": "o", "system": "s"}'),
        (5, '{"unknown": 1}'), (6, None), (7, "not json"), (8, '{"messages": []}'), (3, '{"prompt": "", "response": "r"}'),
    ], "formatted long, record string")
    got = chat.format_chats(records.withColumn("loss_spans", F.lit(0)).withColumnRenamed("formatted", "id").withColumn("_chat_key", F.lit(1)))
    turns = {r["id"]: r["t"] for r in got.select("id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert [tuple(t) for t in turns[1]] == [("user", "q"), ("assistant", "")]
    assert [tuple(t) for t in turns[2]] == [("user", "q"), ("assistant", "a")]
    assert [tuple(t) for t in turns[4]] == [("system", "s"), ("user", "i"), ("assistant", "o")]
    assert turns[5] is turns[6] is turns[7] is None
    assert got.count() == 9
    rows = spark.createDataFrame([(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 1, "assistant", odd), (2, 0, None, None),
                                  (None, 0, "gpt", odd)], "conv_id long, turn long, role string, text string")
    back = chat.format_chats(chat.conversation_records(rows))
    read = {r["conv_id"]: r for r in back.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"),
                                                 chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("l"),
                                                 "formatted", "loss_spans").collect()}
    assert [tuple(t) for t in read[1]["t"]] == [("user", odd), ("assistant", odd), ("assistant", odd)]
    assert read[1]["l"] == odd + odd
    assert [tuple(t) for t in read[2]["t"]] == [("", "")] and read[2]["l"] == ""
    assert [tuple(t) for t in read[None]["t"]] == [("gpt", odd)]
    # spans are places in the formatted string itself
    whole = read[1]["formatted"]
    masked = [whole[s["start"]:s["start"] + s["length"]] for s in read[1]["loss_spans"] if s["length"] is not None]
    assert masked == [odd.replace("\\", "\\\\").replace("<|", "<\\|")] * 2
    assert chat.format_chats(records.limit(0)).collect() == []


VECTORS = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
           (6, [1.0]), (None, [0.0, 1.0]), (7, [0.99, 0.01]), (8, [float("inf"), 0.0]), (9, [-1.0, 0.0])]


def test_vectors(spark):
    vectors = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")
    wide = vectors.withColumn("v", F.lit(1)).withColumn("id", F.lit(2)).withColumn("_usable", F.lit(3))
    for frame in (vectors, wide):
        got = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"])
                      for r in embedding_dedup.near_duplicates(frame).collect()))
        assert got[:4] == [(False, 0, 3, 0, True), (False, 2, 0, 2, True), (False, 3, 0, 3, True), (False, 4, 0, 4, True)]
        assert (False, 20, 3, 0, False) in got and (False, 7, 3, 0, False) in got and (False, 9, 0, 9, True) in got
        assert len(got) == len(VECTORS)
        top = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(frame, k=3).collect()}
        assert top[0, 1] == (6, 4096) and top[0, 2] == (20, 4096) and top[20, 1] == (0, 4096)
    assert embedding_dedup.near_duplicates(vectors.limit(0)).collect() == []
    assert topk.top_k(vectors.limit(0)).collect() == []


def test_toxicity_learns_from_other_rows(spark, monkeypatch):
    """Lexicons and trees behind the calibration never saw the rows they speak of."""
    rows = [(i, "you zorbal fool" if i % 3 == 0 else f"a quiet walk by the river {i}", int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    seen, real = [], toxicity.learn_lexicon
    monkeypatch.setattr(toxicity, "learn_lexicon", lambda d, *a: seen.append({r["id"] for r in d.select("id").collect()}) or real(d, *a))
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels, _any()).collect()}
    whole, *others = sorted(seen, key=len, reverse=True)
    assert len(whole) == 90 and len(others) == toxicity.PARTS
    left_out = [whole - o for o in others]
    assert sum(map(len, left_out)) == 90 and set.union(*left_out) == whole
    assert all(got[i]["predicted"] == y for i, _, y in rows)


def test_toxicity_with_few_labels(spark):
    docs = spark.createDataFrame([(1, "bad zorbal"), (2, "fine day"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.classify(docs, labels, _any()).collect())
