"""op12 against a plain count, with tiny containers and spills too."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidegauge.llm import op12_phrases as op12


def _brute(rows, least=10, covered=50, top=2000):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^ \t]+", piece)
            sizes[lang] += len(w)
            for k in (1, 2, 3):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if q in found and 100 * a >= covered * found[q]}
        rows = []
        for p, a in found.items():
            if p not in gone:
                score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def _texts(seed, n=300):
    rng = random.Random(seed)
    words = ["The", "the", "ship", "came", "in", "É", "über", "日本", "a_b", "x-1", " ", "\x1c", "'s"]
    ends = [" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", "? ", "  "]
    return [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


def _docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, phrase string").repartition(4)


def test_against_brute_force(spark):
    rows = [*_texts(1), ("en", None), ("fr", ""), ("fr", "only three words"), ("en", "new york city " * 30), ("de", "same row of words") , *[("de", "same row of words")] * 15]
    want = _brute(rows)
    assert {r[0] for r in want} == {"en", "de", "und"}
    assert sorted(map(tuple, op12.collocations(_docs(spark, rows)).collect())) == want
    assert sorted(map(tuple, op12.collocations(_docs(spark, rows), top=7, least=2, covered=90).collect())) == _brute(rows, 2, 90, 7)
    assert op12.collocations(_docs(spark, [])).count() == 0


@pytest.mark.parametrize("limits", [{"held": 50}, {"held_words": 5, "head_words": 3}, {"held": 1, "held_words": 1, "head_words": 0}])
def test_spills_change_nothing(spark, limits):
    rows = _texts(2, 400)
    assert sorted(map(tuple, op12.collocations(_docs(spark, rows), **limits).collect())) == _brute(rows)


@pytest.mark.parametrize("length", [1, 2, 3])
def test_trie_bursts_and_spills_whole_containers(length):
    rng = np.random.default_rng(3)
    trie, want, out = op12.HatTrie(length, burst=8), Counter(), Counter()
    for _ in range(20):
        ids = np.minimum(rng.geometric(0.2, (300, length)), 40)
        packed = ids[:, 0]
        for k in range(1, length):
            packed = packed << op12.ID_BITS | ids[:, k]
        keys, counts = np.unique(packed, return_counts=True)
        trie.add(keys, counts)
        want.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        assert trie.edges == sorted(set(trie.edges)) and trie.held == sum(map(len, trie.parts))
        for k, part in enumerate(trie.parts):
            ends = [*trie.edges, 1 << 63]
            assert all(ends[k] <= key < ends[k + 1] for key in part)
            # What is larger has one prefix.
            assert len(part) <= 8 or length == 1 or len({key >> op12.ID_BITS for key in part}) == 1
        if trie.held > 150:
            for spilled, n in trie.spill(75):
                assert (np.diff(spilled) > 0).all()
                out.update(dict(zip(spilled.tolist(), n.tolist(), strict=True)))
            assert trie.held <= 75
    assert length == 1 or len(trie.edges) > 5
    for spilled, n in trie.spill(0):
        out.update(dict(zip(spilled.tolist(), n.tolist(), strict=True)))
    assert out == want and trie.held == 0


def test_places_of_one_are_those_of_many():
    rng = np.random.default_rng(9)
    values = rng.integers(0, 1 << 63, 50).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert [op12._place(int(v)) for v in values] == op12._mark(values).tolist()


def test_a_text_of_more_words_than_ids(spark, monkeypatch):
    monkeypatch.setattr(op12, "ID_BITS", 9)
    monkeypatch.setattr(op12, "STEP", 50)
    text = " ".join(f"w{k % 400} of" for k in range(6000))
    counting, got = op12._Counting("en", 2), Counter()
    for batch in [*counting.add([text]), *counting.runs(0)]:
        for row in batch.to_pylist():
            got[row["phrase"]] += row["n"]
    w = text.split()
    assert got == Counter(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))


def test_exact_beyond_64_bits(spark):
    n = 3_000_000_000_000
    row = spark.sql(f"SELECT {n}L AS a, {n + 7}L AS l, {2 * n}L AS r")
    assert row.select(op12._score(row.a, row.l, row.r)).first()[0] == 10**6 * n * n // ((n + 7) * 2 * n)


def test_merging_needs_one_exchange(spark):
    runs = spark.createDataFrame([("en", "a b", 1, 2)], "lang string, phrase string, n long, mark long")
    from pyspark.sql import functions as F

    plan = runs.repartitionByRange("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
