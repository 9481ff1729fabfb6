"""Backtracking encoder against the sentencepiece library."""
import hashlib
import random

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from roadpulse.llm.sentence_pieces import MODEL, Pieces, encode_texts, op11_sentence_pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces():
    return Pieces(public_tokenizers.path(MODEL))


def ids_of(pieces, text):
    data = pieces.encode(text)
    return [int.from_bytes(data[i:i + 4], "little") for i in range(0, len(data), 4)]


def test_random_texts_equal_the_library(pieces):
    rng = random.Random(7)
    letters = "abcdefghiklmnoprstuvwy      \n\t\0éüß中文的ЯпрТ▁.,'0123456789ａﬁ"
    own = list(pieces.ids)
    for n in range(1500):
        some = ([rng.choice(letters) for _ in range(rng.randint(0, 50))] if n % 3 == 0 else
                [rng.choice(own) for _ in range(rng.randint(1, 10))] if n % 3 == 1 else
                [rng.choice(("a", "er", " ", "  ", "\n", "he")) * rng.randint(1, 20) for _ in range(rng.randint(1, 20))])
        text = "".join(some)
        theirs = pieces.model.encode(text, add_eos=True)
        assert ids_of(pieces, text) == theirs
        assert pieces.decode(theirs) == pieces.model.decode(theirs)


def test_any_list_of_ids_decodes_like_the_library(pieces):
    rng = random.Random(8)
    for _ in range(1500):
        ids = [rng.choice((rng.randrange(260), rng.randrange(len(pieces.surface)))) for _ in range(rng.randint(0, 7))]
        assert pieces.decode(ids) == pieces.model.decode(ids)


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 200_000, "aaab" * 30_000, "中" * 50_000, "\n\t" * 50_000, "ab" * 50_000 + " " * 999 + "c"])
def test_long_texts_without_words(pieces, text):
    assert ids_of(pieces, text) == pieces.model.encode(text, add_eos=True)


def test_backtracking_is_needed_and_marks_places(pieces):
    """Longest matches alone give other ids on some of the vocabulary's own joins."""
    rng, own, greedy = random.Random(9), list(pieces.ids), 0
    for _ in range(2000):
        text = "".join(rng.choice(own).strip("▁") for _ in range(4))
        at, longest = 0, []
        chunk = "▁" + text
        while at < len(chunk):
            piece = next((chunk[at:at + k] for k in range(16, 0, -1) if chunk[at:at + k] in pieces.ids), chunk[at])
            longest.append(piece)
            at += len(piece)
        greedy += [pieces.ids.get(p) for p in longest] != ids_of(pieces, text)[:-1]
        assert ids_of(pieces, text) == pieces.model.encode(text, add_eos=True)
    assert greedy > 100


def test_edges(spark, pieces):
    rows = [(1, None, "x"), (2, "", "y"), (3, "  ", None), (3, "same", "z"), (3, "same", "z"), (None, "no key", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string").withColumn("_piece_text", F.lit(5))
    got = encode_texts(docs).collect()
    assert sorted(encode_texts(docs).columns) == ["_piece_text", "decoded", "doc_id", "ids", "text"]
    assert len(got) == 6
    for r in got:
        assert r["ids"] == pieces.model.encode(r["text"] or "", add_eos=True)
        assert r["decoded"] == (r["text"] or "") and r["_piece_text"] == 5
    assert encode_texts(docs.limit(0)).count() == 0


def test_query_equals_the_library(spark, pieces):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op11_sentence_pieces(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = pieces.model.encode(texts[r["doc_id"]] or "", add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(pieces.model.decode(ids).encode()).hexdigest()
