"""The search index against scores by hand, one pair at a time."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import text as t
from tidegauge.operators import search


def _words(name):
    return [w.lower() for w in re.split(r"[_\-./:]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)) if w]


def _one_edit(a, b):
    if a == b or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1):
        return True
    if len(a) == len(b):
        places = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x != y]
        return len(places) == 2 and places[1] == places[0] + 1 and a[places[0]] == b[places[1]] and a[places[1]] == b[places[0]]
    long, short = max(a, b, key=len), min(a, b, key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def _score(word, words, hay):
    if word in words:
        return 4
    if any(x.startswith(word) for x in words):
        return 3
    if word in hay:
        return 2
    return 1 if len(word) >= 4 and any(_one_edit(word, x) for x in words) else 0


def _brute(terms, queries):
    out = []
    for query in set(queries):
        asked, found = query.lower().split(), []
        for iri, local, prefix in terms:
            scores = [_score(w, _words(local), f"{local} {prefix} {iri}".lower()) for w in asked]
            hit = sum(s >= 1 for s in scores)
            band = "all" if not asked else "match" if all(s >= 2 for s in scores) else "close" if hit * 2 >= len(asked) else None
            if band:
                found.append((band == "close", -sum(scores), len(local), local, iri, band))
        out += [(query, iri, local, band, -score, place) for place, (_, score, _, local, iri, band) in enumerate(sorted(found), 1)]
    return sorted(out)


def _terms():
    rng = random.Random(6)
    stems = ["person", "Name", "title", "birth", "Place", "of", "is", "part", "Ofx", "date", "2", "gene", "Tree", "père", "日本"]
    names = {rng.choice(["", "has", "is"]) + "".join(rng.choice(stems) + rng.choice(["", "_", "-"]) for _ in range(rng.randint(1, 4))) for _ in range(250)}
    return [(f"http://v{k % 3}.example/ns#{n}", n, f"p{k % 3}") for k, n in enumerate(sorted(names))]


QUERIES = ["name", "nmae", "persn", "title date", "titel dat", "part of", "x", "of", "o", "  ", "", "example", "http", "p1 place", "name name zzz", "père", "本", "PERSON", "gene tree birth zz yy", "birthh plcae"]


def test_search_against_brute_force(spark, tmp_path):
    rows = _terms()
    terms = spark.createDataFrame(rows, "iri string, local string, prefix string").repartition(3)
    queries = spark.createDataFrame([(q,) for q in QUERIES], "query string")
    want = _brute(rows, QUERIES)
    assert len(want) > 1500 and {r[3] for r in want} == {"all", "match", "close"}
    assert sorted(map(tuple, search.search(terms, queries).collect())) == want
    search.build_index(terms).write(f"{tmp_path}/index")
    index = search.read_index(spark, f"{tmp_path}/index")
    assert sorted(map(tuple, search.search(index, queries).collect())) == want


def test_deletions_meet_at_one_edit(spark):
    rng = random.Random(4)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(150)})
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    keys = frame.select("w", F.explode(search.deletions(F.col("w"))).alias("d"))
    pairs = keys.join(keys.select(F.col("w").alias("v"), "d"), "d").select("w", "v").distinct().where(t.within_one_edit(F.col("w"), F.col("v")))
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for a in words for b in words if _one_edit(a, b)}


@pytest.mark.parametrize("needle", ["a", "ab", "abc", "bcab", "é", "zzz", "cabcabc"])
def test_containing(spark, needle):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, hay string")
    got = search.containing(frame, spark.createDataFrame([(needle,), ("",)], "needle string"), "k", "hay").collect()
    assert sorted((r.k, r.hay) for r in got) == [(k, x) for k, x in enumerate(texts) if needle in x]


def test_many_queries_over_many_terms_join_by_equal_keys(spark):
    terms = spark.range(20_000).select(F.format_string("http://v/ns#term%05dName", "id").alias("iri"), F.format_string("term%05dName", "id").alias("local"), F.lit("v").alias("prefix"))
    queries = spark.range(2_000).select(F.format_string("term%05d", F.col("id") * 10).alias("query"))
    found = search.search(terms, queries)
    assert not re.search("NestedLoop|Cartesian", found._jdf.queryExecution().executedPlan().toString())
    best = found.where("place = 1 and band = 'match'")
    assert best.where(F.contains("iri", "query")).count() == 2_000
