"""Operators against DuckDB, brute force, round trips and held-out labels."""
import math
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from roadpulse.llm import embedding_dedup, language_model, mixing, packing, queries, simhash
from roadpulse.llm.components import components


def _rows(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, sf_dir, name):
    import oracle_check

    df = queries.QUERIES[name](spark, sf_dir)
    want = oracle_check.duck_connect(sf_dir).sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = oracle_check._rows(df.columns, [tuple(r) for r in df.collect()], 9)
    assert got == oracle_check._rows(want.columns, want.fetchall(), 9)


def test_mix_is_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aaab") if i % 5 else None, "w " * rng.randint(0, 80)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs.repartition(7)).collect()
    assert sorted(r["taken"] for r in got) == sorted(r["taken"] for r in mixing.mix(docs.repartition(3)).collect())
    for source in ("a", "b", None):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.02 * own[0]["target"]
        assert all(r["copies"] <= 3 for r in own)
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(sum(r["size"] for r in got))
    assert mixing.mixed_documents(docs).count() == sum(r["copies"] for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}


def _fingerprint(text):
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark, sf_dir, texts):
    prints = {i: _fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                low, old = sorted((root[a], root[b]))
                root = {i: low if r == old else r for i, r in root.items()}
    got = _rows(spark, sf_dir, "op8_simhash")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", root[i]) for i in texts}


@pytest.mark.parametrize("bucket", [3, 200])
def test_cover_finds_every_link(spark, bucket):
    rng = random.Random(3)
    dense = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(100)}
    for _ in range(150):  # a dense group, in buckets above the limit
        x = dense
        for b in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << b
        prints.add(x)
    prints = sorted(simhash._signed(x) for x in prints)
    frame = spark.createDataFrame([(x,) for x in prints], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(frame, bucket=bucket)).collect()}
    root = {x: x for x in prints}
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and root[a] != root[b]:
                low, old = sorted((root[a], root[b]))
                root = {x: low if r == old else r for x, r in root.items()}
    assert {x: got.get(x, x) for x in prints} == root


def _clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((n // 20, width))
    noise = rng.uniform(0.05, 0.6, (n, 1))
    x = np.vstack([centre[rng.integers(0, len(centre), n // 2)], rng.standard_normal((n - n // 2, width))])
    return (x + noise * rng.standard_normal((n, width)) * (np.arange(n) < n // 2)[:, None]).astype(np.float32)


def test_caps_recall_and_precision(spark):
    x = _clustered(1500, 32, 5)
    x[700:720] = x[3]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(frame).collect()}
    true = dict(enumerate(near.sum(1).tolist()))
    assert all(got[i] <= true[i] for i in true)
    assert sum(got.values()) >= 0.95 * sum(true.values()) > 100


@pytest.mark.parametrize("n", [20_000, 10**6, 10**7])
def test_caps_recall_at_any_size(n):
    """Pairs right at the threshold, under the code of a table of ``n`` vectors."""
    rng = np.random.default_rng(9)
    x, z = rng.standard_normal((2, 300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.905 * x + math.sqrt(1 - 0.905**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    code = embedding_dedup.ProductCode(n, 64)
    a, b = code.decode(x), code.decode(y)
    assert min(map(len, a + b)) >= embedding_dedup.FILTERS
    assert sum(len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)) >= 0.97 * 300


def test_caps_in_chunks(spark, monkeypatch):
    x = _clustered(400, 16, 6)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = sorted(tuple(r) for r in embedding_dedup.near_duplicates(frame).collect())
    monkeypatch.setattr(embedding_dedup, "CHUNK", 3)
    monkeypatch.setattr(embedding_dedup, "TASK_ROWS", 50)
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(frame).collect()) == whole


def test_packing_round_trip(spark, sf_dir, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in _rows(spark, sf_dir, "op4_packing"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 1024 and len(rows) <= packing.MAX_SEGMENTS
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = exact.encode(text, add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def test_word_ids_equal_the_tokenizer():
    ids_of = packing.WordIds()
    rng = random.Random(4)
    parts = ["a", "the", " ", "  ", "\n", "\t", " ", "　", "it's", "12", "...", "é", "漢字", "😀", "<|endoftext|>", "<|", "x" * 40]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        want = ids_of.exact.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids_of(text), "<u4").tolist() == want, repr(text)


def test_packing_limits(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("q" for _ in range(rng.randint(0, 30))), " ".join("a" for _ in range(rng.randint(1, 60)))) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, asked string, text string").coalesce(2)
    got = packing.pack(frame, prompt="asked", capacity=128, max_segments=5, max_loss=100, with_ids=True).collect()
    used = defaultdict(lambda: [0, 0, 0])
    for r in got:
        assert len(r["ids"]) == r["length"]
        for k, v in enumerate((r["length"], 1, r["loss_tokens"])):
            used[r["sequence_id"]][k] += v
    assert all(t <= 128 and s <= 5 and loss <= 100 for t, s, loss in used.values())
    loss = Counter()
    for r in got:
        loss[r["doc_id"]] += r["loss_tokens"]
    assert loss == {i: len(a.split()) for i, _, a in rows}  # the end bears none


@pytest.mark.parametrize("name,column", [("op2_toxicity", "toxic"), ("op3_quality", "quality")])
def test_held_out_labels(spark, name, column):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = Counter((labels[r["doc_id"]], r["predicted"]) for r in _rows(spark, sf, name) if r["held_out"] and r["doc_id"] in labels)
    right = seen[0, 0] + seen[1, 1]
    assert right >= 0.9 * sum(seen.values())
    assert seen[1, 1] >= 0.7 * (seen[1, 0] + seen[1, 1])


def test_prior_estimate():
    from roadpulse.llm.quality import estimate_prior

    rng = np.random.default_rng(1)
    good = rng.normal(3, 1, 4000)
    other = np.concatenate([rng.normal(3, 1, 2400), rng.normal(-3, 1, 1600)])
    assert abs(estimate_prior(good, other) - 0.6) < 0.05


def test_quality_learns_from_every_document(spark, sf_dir):
    """Documents beyond the bound of the labelled sample count as unlabelled ones too."""
    from roadpulse.llm import quality, surface

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    few = surface.sampled(docs.select("doc_id").distinct(), "doc_id", 20).union(labels.select("doc_id")).distinct()
    rest = docs.join(few, "doc_id", "left_anti").select("doc_id", F.lit("!! ## $$ 1 1 1").alias("text"))
    changed = docs.join(few, "doc_id", "left_semi").unionByName(rest)
    assert rest.count() > 20
    was, now = (quality.train(d, labels, F.lit(True), sample=20) for d in (docs, changed))
    assert not np.allclose(was, now, rtol=0.01, atol=0.01)


def test_lm_counts_and_base(spark, sf_dir, texts):
    words = {i: t.encode().lower().split() + [b""] for i, t in texts.items()}
    taught = {i for i in texts if zlib.crc32(str(i).encode()) % 10}
    counts = Counter(w for i in taught for w in words[i])
    n, v = sum(counts.values()), len(counts)
    better = total = 0
    for r in _rows(spark, sf_dir, "op5_lm_scoring"):
        i = r["doc_id"]
        assert r["held_out"] == (i not in taught)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words[i]), sum(w in counts for w in words[i]), n)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words[i])
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        if r["held_out"]:
            better, total = better + (r["score"] > r["base_score"]), total + 1
    assert better >= 0.9 * total > 0


def test_predictions_are_a_distribution():
    """Over all known words and the one unknown, in each context."""
    words, classes = [b"a", b"b", b"", b"unknown"], [7 << 8 | 1, 7 << 8 | 2, 9 << 8 | 1]
    counts = np.array([[5, 0, 1], [2, 3, 0], [1, 1, 40], [0, 0, 0]])
    row = {"words": b"\n".join(words), "spans": language_model._pack([3] * 4), "classes": language_model._pack(classes * 4, kind="<u2"),
           "counts": language_model._pack(counts.ravel(), kind="<i8")}
    arrays, rng = language_model._Seats(row), np.random.default_rng(1)
    seats, discounts = arrays.start(), None
    for _ in range(4):
        tables = [x.tables for x in seats]
        at, n = arrays.totals(tables)
        totals = np.zeros(language_model.PLACES, np.int64)
        totals[at] = n
        rules = language_model._Rules(totals, discounts)
        discounts = rules.discounts
        assert (rules.known, rules.tokens) == (3, 53)
        p = arrays.predict(tables, rules)[0].reshape(4, 3)
        assert np.allclose(p.sum(0), 1) and (p > 0).all()
        arrays.sweep(seats, rules, rng)
        packed = arrays.pack(seats)
        assert [x.packed()[1].tolist() for x in arrays.seats(packed)] == [x.packed()[1].tolist() for x in seats]
        tables = [x.tables for x in seats]
        wanted = (arrays.c, arrays.under(tables[0]), arrays.root(tables[1]))
        for x, c in zip(seats, wanted):
            assert (x.customers == c).all() and (x.tables <= c).all() and ((x.tables > 0) == (c > 0)).all()


def _table_odds(n, parent, others, d, s):
    """Exact odds of the number of tables of n customers of one dish."""
    ways = {1: 1.0}  # generalised Stirling numbers
    for i in range(1, n):
        ways = {t: ways.get(t - 1, 0.0) + (i - d * t) * ways.get(t, 0.0) for t in range(1, i + 2)}
    odds = np.array([ways[t] * parent**t * math.prod(s + d * (others + k) for k in range(t)) for t in range(1, n + 1)])
    return odds / odds.sum()


@pytest.mark.parametrize("case", [(2, 0.3, 0), (6, 0.05, 4), (9, 1.0, 0), (9, 0.4, 30)])
def test_gibbs_reaches_the_posterior_from_any_seating(case):
    """Sweeps from one table and from tables of one: the exact posterior both times."""
    n, parent, others = case
    d, s, many = 0.6, 1.0, 4000
    exact = _table_odds(n, parent, others, d, s)
    for start in (language_model.Seating.first(np.full(many, n)), language_model.Seating(np.full(many, n), np.ones(many * n))):
        rng = np.random.default_rng(5)
        for _ in range(40):
            language_model.gibbs(start, np.full(many, n), np.full(many, parent), np.full(many, others), d, s, rng)
        got = np.bincount(start.tables, minlength=n + 1)[1:] / many
        assert np.abs(got - exact).max() < 0.03, (got, exact)


def test_gibbs_takes_the_present_tables_into_account():
    """One sweep moves a seating, it does not make a new one."""
    rng = np.random.default_rng(2)
    one, single = language_model.Seating.first(np.full(500, 200)), language_model.Seating(np.full(500, 200), np.ones(100_000))
    for x in (one, single):
        language_model.gibbs(x, np.full(500, 200), np.full(500, 0.01), np.zeros(500), 0.6, 1.0, rng)
    assert one.tables.mean() < 5 and single.tables.mean() > 100


def _one_by_one(sizes, parent, others, d, s, rng):
    """Numbers of tables after every customer has moved once, in plain Python."""
    at = [t for t, n in enumerate(sizes) for _ in range(n)]
    for i in rng.permutation(len(at)):
        at[i] = -1
        sizes = Counter(t for t in at if t >= 0)
        tables = list(sizes)
        odds = np.array([*(sizes[t] - d for t in tables), (s + d * (others + len(tables))) * parent])
        at[i] = [*tables, max(tables) + 1][rng.choice(len(odds), p=odds / odds.sum())]
    return sorted(Counter(at).values())


@pytest.mark.parametrize("sizes", [(9,), (5, 2, 1), (1, 1, 1, 1, 1, 1), (4, 4)])
def test_a_sweep_is_as_one_by_one(sizes):
    """Seatings after a sweep, as often as when customers move one after another."""
    parent, others, d, s, many = 0.3, 2, 0.6, 1.0, 6000
    rng, n = np.random.default_rng(3), sum(sizes)
    plain = Counter(tuple(_one_by_one(list(sizes), parent, others, d, s, rng)) for _ in range(many))
    seats = language_model.Seating(np.full(many, len(sizes)), np.tile(sizes, many))
    language_model.gibbs(seats, np.full(many, n), np.full(many, parent), np.full(many, others), d, s, rng, np.full(many, n))
    swept = Counter(tuple(sorted(x[x > 0].tolist())) for x in np.split(seats.size, seats.start[1:-1]))
    for seating in plain | swept:
        assert abs(plain[seating] - swept[seating]) < 5 * math.sqrt(plain[seating] + swept[seating] + 1), seating


def test_every_customer_moves_in_a_sweep():
    """Of 200 customers at tables of their own most join another when they have their turn."""
    row = {"words": b"a", "spans": language_model._pack([1]), "classes": language_model._pack([7 << 8 | 1], kind="<u2"),
           "counts": language_model._pack([200], kind="<i8")}
    arrays = language_model._Seats(row)
    seats = [language_model.Seating([200], np.ones(200)), language_model.Seating([1], [200]), language_model.Seating([1], [1])]
    totals = np.zeros(language_model.PLACES, np.int64)
    totals[[language_model.CUSTOMERS + (7 << 8 | 1), language_model.TABLES + (7 << 8 | 1)]] = 200
    totals[language_model.TABLES + (7 << 8 | 2)] = 100_000  # other words, so that the parent seldom serves this one
    totals[[language_model.PARENTS + 7, language_model.ROOT]] = 1
    totals[language_model.KNOWN] = 1000
    arrays.sweep(seats, language_model._Rules(totals, [0.6, 0.6, 0.6]), np.random.default_rng(6))
    assert seats[0].customers.tolist() == [200] and seats[0].tables[0] < 110


def test_sweeps_of_large_dishes_take_as_long_as_their_changes():
    seats = language_model.Seating.first(np.full(20, 10**9))
    language_model.gibbs(seats, np.full(20, 10**9), np.full(20, 1e-3), np.full(20, 1000), 0.6, 1.0, np.random.default_rng(8), np.full(20, 10**9))
    assert (seats.customers == 10**9).all() and seats.tables.sum() > 20


def test_customers_follow_the_children():
    rng = np.random.default_rng(4)
    for _ in range(30):
        was, now = rng.integers(0, 9, 50), rng.integers(0, 9, 50)
        seats = language_model.Seating.first(was)
        language_model.gibbs(seats, now, rng.random(50), rng.integers(0, 9, 50), 0.5, 1.0, rng)
        assert (seats.customers == now).all() and ((seats.tables > 0) == (now > 0)).all()


def test_scores_against_a_plain_model(spark):
    """Where every dish has one customer there is one seating, so the score
    follows from the restaurants' rule by hand."""
    docs = [(1, "ab cd ef gh", True), (2, "AB cd", False), (3, "zz", False), (4, None, False)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, taught boolean")
    got = {r["key"]: r for r in language_model.score_texts(
        frame.withColumnRenamed("doc_id", "key"), F.col("taught"), key="key").collect()}
    d, s, n = 0.9, 1.0, 5  # discounts are held at 0.9; four words and the end, each once
    root = lambda c: (c * (1 - d) + (s + d * n) / (n + 1)) / (s + n)
    below = lambda c, up, seen: (c * (1 - d) + (s + d * seen) * up) / (s + seen)
    known = below(1, below(1, root(1), 1), 1)      # a word after the word before it
    elsewhere = lambda c: below(0, below(0, root(c), 1), 1)  # noqa: E731  another word in a restaurant of one
    nowhere = root(1)                              # the end after an unknown word: both restaurants are empty
    # "cd" is served after "ab", and its end stands where "ef" was served
    expected = {1: 5 * math.log10(known), 2: 2 * math.log10(known) + math.log10(elsewhere(1)),
                3: math.log10(elsewhere(0)) + math.log10(nowhere), 4: math.log10(elsewhere(1))}
    for i, score in expected.items():
        assert got[i]["score"] == pytest.approx(score, rel=1e-5), i
