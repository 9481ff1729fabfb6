"""Typed place names against every place, one by one."""
import re

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import places

BOX = "west double, north double, east double, south double"
PLACES = [("Silk Board Junction", 12.9, 77.6, 40), ("Silk Mill Road", 12.8, 77.5, 9), ("Hebbal Flyover", 13.0, 77.6, 30),
          ("Hebbal Main Road", 13.1, 77.6, 5), ("Road 11", 12.9, 77.7, 3), ("Road 12", 12.9, 77.7, 2), ("Far Road", 40.0, 10.0, 99),
          ("Near Road", 12.9, 77.6, 1), ("silk  board junction", 12.95, 77.6, 40), (None, 1.0, 1.0, 1), ("", 1.0, 1.0, 1), ("Nowhere", None, None, 7)]
QUERIES = ["Silk Board Junction", "silk bord", "SILKBOARD JUNCTION", "junction silk board", "hebal flyover", "hebbal", "road",
           "road 11", "road 13", "Raod 12", "  ", "", None, "atlantis", "silk atlantis", "Hebbal, Bengaluru", "mian hebal road",
           "nowhere", "silk silk", "x" * 5000, ",,", "board"]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _edits(a, b):
    most = 2 if len(a) >= 8 else 1 if len(a) >= 4 else 0
    if abs(len(a) - len(b)) > most or re.sub("[^0-9]", "", a) != re.sub("[^0-9]", "", b):
        return None
    d = _distance(a, b)
    return d if d <= most else None


def _key(s):
    return " ".join(re.sub(r",\s*bengaluru.*$", "", s.lower().strip()).split())


def _words(s):
    return [w for w in dict.fromkeys(re.split(r"[\W_]+", s)) if w]


def _best(query, known, box):
    if not (query or "").strip():
        return None
    key, found = _key(query), []
    for name, lat, lon, n in known:
        if not name:
            continue
        inside = lat is not None and box[3] <= lat <= box[1] and box[0] <= lon <= box[2]
        rank, place = (0 if inside else 1, -n, name), _key(name)
        whole = _edits(key, place)
        if whole is not None:
            found.append((whole, 0, rank))
        ws, ps = _words(key), _words(place)
        costs = [min((e for e in (_edits(w, p) for p in ps) if e is not None), default=None) for w in ws]
        if costs and None not in costs:
            found.append((sum(costs), max(len(ps) - len(ws), 0), rank))
    return min(found, default=None)


@pytest.fixture
def box(spark):
    return spark.createDataFrame([(77.0, 13.5, 78.0, 12.5)], BOX)


def test_every_query_gets_its_best_place(spark, box):
    known = spark.createDataFrame(PLACES, "display_name string, lat double, lon double, n long")
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    got = {r["query_id"]: r for r in places.search_places(asked.repartition(5), known, box).collect()}
    assert len(got) == len(QUERIES)
    for i, query in enumerate(QUERIES):
        best, r = _best(query, PLACES, (77.0, 13.5, 78.0, 12.5)), got[i]
        if best is None:
            assert r["display_name"] is None and r["lat"] is None, query
        else:
            assert (r["edits"], r["missing"], r["display_name"]) == (best[0], best[1], best[2][2]), query
    assert got[1]["display_name"] == "Silk Board Junction" and got[2]["edits"] == 1 and got[8]["display_name"] is None


def test_repeated_queries_and_empty_tables(spark, box):
    known = spark.createDataFrame(PLACES, "display_name string, lat double, lon double, n long")
    asked = spark.createDataFrame([(1, "hebbal"), (1, "hebbal"), (None, "Hebbal ")], "query_id int, query string")
    assert [r["edits"] for r in places.search_places(asked, known, box).collect()] == [0, 0, 0]
    assert [r["lat"] for r in places.search_places(asked, known.limit(0), box).collect()] == [None] * 3
    assert places.search_places(asked.limit(0), known, box).count() == 0


def test_similar_strings_lose_no_pair(spark):
    """Random short strings over few letters, where grams repeat most."""
    words = [r["w"] for r in spark.range(400).select(F.expr(
        "translate(substr(conv(conv(substr(md5(cast(id as string)), 1, 12), 16, 10), 10, 3), 1, 3 + cast(id % 9 as int)), '012', 'abc')").alias("w")).distinct().collect()]
    left, right = words[::2], words[1::2]
    got = {(r["l"], r["r"]): r["edits"] for r in places.similar_strings(
        spark.createDataFrame([(w,) for w in left], "l string"), spark.createDataFrame([(w,) for w in right], "r string"), "l", "r").collect()}
    assert got == {(a, b): _edits(a, b) for a in left for b in right if _edits(a, b) is not None} and len(got) > 50


def test_requests_by_place_name(spark, box):
    known = spark.createDataFrame(PLACES, "display_name string, lat double, lon double, n long")
    rows = [("a", None, None, "hebal flyover"), ("b", 1.0, 2.0, "hebbal"), ("c", None, 5.0, "atlantis"), ("d", None, None, None)]
    out = {r["request_id"]: r for r in places.locate_requests(
        spark.createDataFrame(rows, "request_id string, lat double, lon double, place string"), known, box).collect()}
    assert (out["a"]["lat"], out["a"]["lon"]) == (13.0, 77.6) and (out["b"]["lat"], out["b"]["lon"]) == (1.0, 2.0)
    assert out["c"]["lat"] is None and out["d"]["lat"] is None and len(out) == 4
