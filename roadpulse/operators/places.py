"""C17 for typed text: misspelt, partial and reordered place names.

A place answers a query in two ways, and the fewer edits count:

* **whole**: the two names lie within the edits allowed for the query's length;
* **by words**: every word of the query stands in the place's name, each within
  the edits allowed for its own length.  Edits add up; words of the place that
  the query leaves out are ``missing``.

Up to 3 characters allow no edit, up to 7 one, more allow two
(``edits_allowed``), and digits must agree: road 11 is never road 12.  Of all
places that answer, the one with the fewest edits wins, then fewest missing
words, a place inside the bounding box, more events, the smaller name.

Both ways rest on one join of distinct strings (``similar_strings``).  Strings
within ``k`` edits share all but ``2k`` of their bigrams, so with bigrams in one
global order, rarest first, they share one of their first ``2k + 1``: only those
are joined, and lengths, digits and the distance itself are checked after.
Queries are resolved once per distinct name.  A query's candidates come from its
rarest word; a query of one word needs that word's best place only, so a frequent
word alone never lists its places.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.operators.roads import normalise_place
from roadpulse.session import materialize

#: edits allowed from these lengths on, and the size of a gram (q)
ONE_EDIT, TWO_EDITS, MOST_EDITS, GRAM = 4, 8, 2, 2


def edits_allowed(c: Column) -> Column:
    n = F.char_length(c)
    return F.when(n >= TWO_EDITS, 2).when(n >= ONE_EDIT, 1).otherwise(0)


def _digits(c) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def place_words(key) -> Column:
    """Distinct words of a normalised name: runs of letters and digits."""
    return F.filter(F.array_distinct(F.split(key, r"[^\p{L}\p{N}]+")), lambda w: w != "")


def _grams(strings: DataFrame, name: str) -> DataFrame:
    """(``name``, gram, occurrence): a string's padded bigrams as a set."""
    padded = F.concat(F.lit("\u0002"), F.col(name), F.lit("\u0003"))
    at = F.sequence(F.lit(1), F.char_length(name) + 1)
    return (strings.select(name, F.explode(F.transform(at, lambda i: F.substring(padded, i, F.lit(GRAM)))).alias("gram"))
            .groupBy(name, "gram").agg(F.count("*").alias("_times"))
            .select(name, "gram", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("occurrence")))


def _prefixes(grams: DataFrame, frequency: DataFrame, name: str) -> DataFrame:
    """(``name``, gram, occurrence, at): each string's first ``2k + 1`` grams
    for the most edits, rarest first."""
    ordered = grams.join(frequency, ["gram", "occurrence"], "left").groupBy(name).agg(F.slice(F.array_sort(F.collect_list(F.struct(
        F.coalesce("_places", F.lit(0)).alias("f"), "gram", "occurrence"))), 1, GRAM * MOST_EDITS + 1).alias("_p"))
    return ordered.select(name, F.posexplode("_p").alias("at", "_g")).select(name, "at", "_g.gram", "_g.occurrence")


def similar_strings(asked: DataFrame, known: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right, edits) of all pairs within the edits that ``left`` allows.
    Both inputs are taken as sets of non-null strings."""
    asked, known = (d.select(c).where(F.col(c).isNotNull()).distinct() for d, c in ((asked, left), (known, right)))
    equal = asked.join(known, F.col(left) == F.col(right)).select(left, right, F.lit(0).alias("edits"))
    # a string longer than all known ones by more than the edits has no partner, so its grams are never made
    longest = known.agg(F.max(F.char_length(right)).alias("_longest"))
    open_ = (asked.where(edits_allowed(F.col(left)) > 0).join(longest, how="cross")
             .where(F.char_length(left) <= F.col("_longest") + MOST_EDITS).select(left))
    known_grams = materialize(_grams(known, right), "known_grams")
    frequency = known_grams.groupBy("gram", "occurrence").agg(F.count("*").alias("_places"))
    a = _prefixes(_grams(open_, left), frequency, left).where(F.col("at") <= GRAM * edits_allowed(F.col(left)))
    b = _prefixes(known_grams, frequency, right).withColumnRenamed("at", "_at")
    near = (a.join(b, ["gram", "occurrence"])
            .where((F.col("_at") <= GRAM * edits_allowed(F.col(left)))
                   & (F.abs(F.char_length(left) - F.char_length(right)) <= edits_allowed(F.col(left)))
                   & (_digits(left) == _digits(right)))
            .select(left, right).distinct()
            .withColumn("edits", F.levenshtein(F.col(left), F.col(right), MOST_EDITS))
            .where((F.col("edits") > 0) & (F.col("edits") <= edits_allowed(F.col(left)))))
    return equal.unionByName(near)


def _known_places(places: DataFrame, bbox: DataFrame) -> DataFrame:
    """One row per normalised name: its best place as a comparable struct."""
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    return (places.select("display_name", "lat", "lon", "n").withColumn("place_key", normalise_place("display_name"))
            .where(F.col("place_key") != "").join(F.broadcast(bbox), how="cross")  # 1-row bbox
            .groupBy("place_key").agg(F.min(F.struct(
                F.when(inside, 0).otherwise(1).alias("outside"), (-F.coalesce("n", F.lit(0))).alias("fewer"),
                "display_name", "lat", "lon")).alias("place"))
            .withColumn("place_words", place_words("place_key")))


def _by_words(keys: DataFrame, known: DataFrame) -> DataFrame:
    """(key, edits, missing, place): answers word by word; for a query of one
    word the best of each word that it may stand for."""
    asked = keys.select("key", "words", F.explode("words").alias("word"))
    postings = known.select("place_key", "place", F.size("place_words").alias("_m"), F.explode("place_words").alias("place_word"))
    similar = materialize(similar_strings(asked, postings, "word", "place_word"), "similar_words")
    best = postings.groupBy("place_word").agg(
        F.count("*").alias("_n"), F.min(F.struct((F.col("_m") - 1).alias("missing"), "place")).alias("_best"))
    met = asked.join(similar, "word").join(best, "place_word")
    single = met.where(F.size("words") == 1).select("key", "edits", "_best.missing", "_best.place")
    # queries all of whose words stand for something: their rarest word, and what each word may stand for
    meant = met.where(F.size("words") > 1).groupBy("key", "words", "word").agg(
        F.sum("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("place_word", "edits"))).alias("_means"))
    full = materialize(meant.groupBy("key", "words").agg(
        F.min(F.struct("_n", "word"))["word"].alias("word"), F.collect_list("_means").alias("_means"))
        .where(F.size("_means") == F.size("words")), "place_meanings")
    pairs = (full.select("key", "word").join(similar, "word").join(postings.select("place_word", "place_key"), "place_word")
             .select("key", "place_key").distinct()
             .join(known.select("place_key", "place", "place_words"), "place_key")
             .join(full.select("key", "words", "_means"), "key"))
    costs = pairs.withColumn("_costs", F.transform("_means", lambda m: F.array_min(F.transform(
        "place_words", lambda p: F.element_at(m, p))))).where(~F.exists("_costs", lambda e: e.isNull()))
    many = costs.select("key", F.aggregate("_costs", F.lit(0), lambda s, e: s + e).alias("edits"),
                        F.greatest(F.size("place_words") - F.size("words"), F.lit(0)).alias("missing"), "place")
    return single.unionByName(many)


def search_places(queries: DataFrame, places: DataFrame, bbox: DataFrame) -> DataFrame:
    """C17: ``queries`` (query_id, query) with lat, lon, display_name, edits and
    missing of the place that answers best.

    ``places``: display_name, lat, lon, n (a gazetteer); places without a name
    answer nothing, without a position they count as outside.  Blank, null and
    unmatched queries keep their row with NULLs; repeated ids and names each
    keep theirs."""
    q = queries.select("query_id", "query").withColumn("key", F.when(F.trim("query") != "", normalise_place("query")))
    # read by both ways, several times each: written once
    keys = materialize(q.where(F.col("key") != "").select("key").distinct().withColumn("words", place_words("key")), "place_keys")
    known = materialize(_known_places(places, bbox), "known_places")
    whole = (similar_strings(keys, known, "key", "place_key").join(known, "place_key")
             .select("key", "edits", F.lit(0).alias("missing"), "place"))
    answers = whole.unionByName(_by_words(keys, known)).groupBy("key").agg(
        F.min(F.struct("edits", "missing", "place")).alias("_a"))
    return q.join(answers, "key", "left").select(
        "query_id", "query", F.col("_a.place.lat").alias("lat"), F.col("_a.place.lon").alias("lon"),
        F.col("_a.place.display_name").alias("display_name"), F.col("_a.edits").alias("edits"), F.col("_a.missing").alias("missing"))


def locate_requests(requests: DataFrame, places: DataFrame, bbox: DataFrame, place: str = "place") -> DataFrame:
    """Requests that name a place instead of a position get the position of
    the place; a position that is given stays.  Requests without either keep
    NULLs, which the forecast's inputs check rejects."""
    named = requests.where(F.col("lat").isNull() | F.col("lon").isNull()).select(F.col(place).alias("query")).distinct()
    found = search_places(named.withColumn("query_id", F.col("query")), places, bbox).select(
        F.col("query").alias(place), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    given = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    out = requests.join(found.where(F.col(place).isNotNull()), place, "left")
    return out.withColumns({"lat": F.when(given, F.col("lat")).otherwise(F.col("_lat")),
                            "lon": F.when(given, F.col("lon")).otherwise(F.col("_lon"))}).select(*requests.columns)
