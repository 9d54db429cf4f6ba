"""op11 against a plain loop: levels by clamping one round after another, draws in order."""

import hashlib
import random
from fractions import Fraction

import pytest

from tidegauge.llm import op11_mixing as op11


def _targets(sizes, weights=(3, 1, 2), percent=150, epochs=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), Fraction(percent * sum(sizes.values()), 100)
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] > epochs * sizes[s] * total}
        if not above:
            return target | {s: left * weight[s] / total for s in open_}
        for s in above:
            target[s] = Fraction(epochs * sizes[s])
        left -= sum(target[s] for s in above)
        open_ -= above
    return target


def _brute(rows, **options):
    """(doc_id, source, size, source_size, target, taken) of rows (doc_id, text, source)."""
    read = []
    for key, text, source in rows:
        size = len((text or "").encode().split())
        draw = hashlib.md5(f"11|{'' if key is None else key}|{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
        read.append((source, draw, key, size))
    sizes = {}
    for source, _, _, size in read:
        sizes[source] = sizes.get(source, 0) + size
    out = []
    for source, target in _targets(sizes, **options).items():
        want = int(target + Fraction(1, 2))
        times = want // sizes[source] if sizes[source] else 0
        left = want - times * sizes[source]
        for own, _, key, size in sorted((r for r in read if r[0] == source), key=lambda r: (r[1], r[3])):
            extra = min(size, left)
            left -= extra
            out.append((key, own, size, sizes[own], float(target), times * size + extra))
    return out


def _same(got, want):
    order = lambda r: (str(r[0]), str(r[1]), *r[2:4], r[5])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [(*r[:4], r[5]) for r in got] == [(*r[:4], r[5]) for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want], rel=1e-12)


def _docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, draw string")


def test_sources_of_many_sizes(spark):
    rng = random.Random(11)
    rows = [(k, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), rng.choice("abcdefghé") if rng.random() < 0.4 else "hot") for k in range(600)]
    rows += [(k, None, "empty") for k in range(3)] + [(700, "one\x0btwo three", None), (None, "no id", "a"), (None, "none either", "a"), (701, "", "hot")]
    got = op11.mix(_docs(spark, rows).repartition(5)).collect()
    _same(got, _brute(rows))
    assert all(r.taken <= 2 * r.size for r in got)
    _same(op11.mix(_docs(spark, rows[::-1]).repartition(2)).collect(), got)


def test_other_weights_and_a_mix_beyond_the_epochs(spark):
    rows = [(k, "a b c d e"[: 1 + 2 * (k % 5)], str(k % 4)) for k in range(60)]
    for options in ({"weights": (1,), "percent": 80, "epochs": 1}, {"weights": (5, 1), "percent": 300, "epochs": 3}, {"percent": 500, "epochs": 2}, {"percent": 0}):
        _same(op11.mix(_docs(spark, rows), **options).collect(), _brute(rows, **options))


def test_repeated_rows_share_the_cut(spark, monkeypatch):
    monkeypatch.setattr(op11, "_RUN", 7)
    rows = [(5, "four words in it", "a")] * 40 + [(6, "two words", "b")] * 3 + [(7, "x", "c")]
    _same(op11.mix(_docs(spark, rows).repartition(4)).collect(), _brute(rows))


def test_empty_tables_and_one_source(spark):
    assert op11.mix(_docs(spark, [])).count() == 0
    for rows in ([(1, "a b c", "a"), (2, None, "a")], [(1, None, None)], [(1, "a", "a"), (2, "", "b")]):
        _same(op11.mix(_docs(spark, rows)).collect(), _brute(rows))


def test_levels_of_many_sources(spark):
    rng = random.Random(5)
    sizes = {f"s{k:04d}": rng.choice([0, 1, 7, 1000, 10**9]) + rng.randint(0, 5) for k in range(500)}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(6)
    got = {r.source: r.target for r in op11.water_fill(op11.weighted(frame)).collect()}
    want = _targets(sizes)
    assert got == pytest.approx({s: float(t) for s, t in want.items()}, rel=1e-12)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_documents_are_not_sorted_and_texts_not_shuffled(spark, sf):
    plan = op11.mix(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "text" not in plan and "Window" not in plan
