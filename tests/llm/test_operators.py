"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegauge.llm import bits
from tidegauge.llm import op1_quality as op1
from tidegauge.llm import op2_decontamination as op2
from tidegauge.llm import op3_bpe as op3
from tidegauge.llm import op4_language as op4
from tidegauge.llm import op5_substrings as op5
from tidegauge.llm import op6_embeddings as op6
from tidegauge.llm import op7_simhash as op7
from tidegauge.llm import op8_html as op8
from tidegauge.llm import op9_sharding as op9
from tidegauge.llm import op10_token_counts as op10
from tidegauge.llm.components import connected_components
from tidegauge.llm.selection import threshold
from tidegauge.llm.transducer import Lexicon, compile_lexicon

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, print string, words int, score double, shard string, anchor string, items string, n_words string, selected string"


def _text(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


PASSAGE = _text(99, 60)
ROWS = [
    (1, PASSAGE + " " + _text(1, 40)), (2, _text(2, 30) + " " + PASSAGE), (3, PASSAGE + " " + _text(1, 40)), (4, ""), (5, None), (None, _text(5, 50)), (6, "one two"), (7, "ONE  two\n"),
    (8, "Été 日本 <|endoftext|> x" * 3), (9, _text(9, 4000)), (9, _text(9, 4000)), (10, "word " * 300), (11, "z" * 5000), (12, "!!! 123 ???"), (13, _text(9, 4000) + " tail"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if k % 2 else "de", "p", 1, 0.5, "s", "a", "i", "n", "s") for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, "One, TWO!"), (3, None), (4, "..."), (10, PASSAGE)], "item_id long, text string")


def _split(text):
    return (text or "").encode().split()


def test_sharding(docs):
    rows = op9.assign_shards(docs, 5).collect()

    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.law) for r in rows) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key") for i, t in ROWS)
    for r in rows:
        key = (-1 if r.doc_id is None else r.doc_id) % (1 << 64)
        assert (r.shard, r.grown_shard) == (jump(key, 5), jump(key, 6)) and r.grown_shard in (r.shard, 5)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_sharding_on_the_tables(spark, sf):
    """Every row of the table against the plain loop, sizes and checksums against zlib, and slots without gaps."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9.op9_sharding(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 8, zlib.crc32(texts[r.doc_id].encode())) for r in rows)
    for r in rows:
        b, j, key = -1, 0, r.doc_id % (1 << 64)
        while j < 24:
            b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        assert r.shard == b
    for shard in range(24):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_sharding_spreads_rows_without_a_key(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(1).alias("lane"))
    got = op9.assign_shards(rows)
    assert sorted(r.slot for r in got.select("slot").collect()) == list(range(3000))
    dealt = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"windowspecdefinition\(shard#\d+, lane#\d+", dealt)


def test_decontamination(spark, docs, bench):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in ((1, PASSAGE), (2, "One, TWO!"), (10, PASSAGE)):
        w = words(text)
        for k in range(max(1, len(w) - 12)):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(item))
    want = []
    for i, t in ROWS:
        w, hit, items = words(t), set(), set()
        for win, names in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    items |= names
        want.append((str(i), len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    whole = bits.LEAST, bits.MOST
    for limit, sizes in (("10485760", whole), ("-1", whole), ("-1", (64, 64))):  # in 64 bits most words pass for sought ones
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        bits.LEAST, bits.MOST = sizes
        try:
            out = op2.decontaminate(docs, bench)
            got = out.collect()
            clean = op2.decontamination_stage(docs, bench).collect()
            plan = op2.find_windows(docs.select(op2._key("doc_id", "text").alias("key"), "text"), bench)[1]._jdf.queryExecution().executedPlan().toString()
            split = docs.select(op2._key("doc_id", "text").alias("key"), op2.words(F.col("text")).alias("w"))
            probes = op2.benchmark_windows(bench).select(F.col("win")[0].alias("token"), F.lit(None).cast("string").alias("left"), F.get("win", F.lit(1)).alias("right"))
            here = op2.occurrences(split, probes)
            placed = here._jdf.queryExecution().executedPlan().toString()
            counted = op2.corpus_counts(docs.select(op2.words(F.col("text")).alias("w")), op2.benchmark_windows(bench))._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
            bits.LEAST, bits.MOST = whole
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)
        assert sorted(str(r.doc_id) for r in clean) == sorted(w[0] for w in want if not w[-1])
        assert here.columns == ["key", "n", "pos", "token", "before", "after"]
        # Words are thinned out and lose their text in the stage that reads it: no join, no broadcast, one exchange (the fixture's own).
        assert "Join" not in placed and "BroadcastExchange" not in placed and len(re.findall(r"Exchange (?!RoundRobin|SinglePartition)", placed)) == 0
        assert "Python" not in plan and "Generate" not in plan  # texts come back whole, once for each document
        assert re.search(r"Exchange hashpartitioning\(token[^\n]*\n[^\n]*HashAggregate\(keys=\[token[^\n]*partial_count", counted)
    assert op2.decontaminate(docs, bench.limit(0)).where("n_hit > 0").isEmpty()


def test_bpe(docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in op3.encode(docs, lexicon_words=30).collect())
    want = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), b"".join(k.to_bytes(4, "little") for k in ids), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_bpe_on_odd_characters():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, rng = Tokenizer.from_file(path), op3.WordBpe(path), random.Random(1)
    letters = "abcd'stşΣΐ İßﬁ①٣½²_\n\t \x1c\x85!<|中文한́ Ａ\U0001d49c\U0001f642é"
    for _ in range(800):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|startoftext|>", "it's we'll", "q" * 100])
        assert list(memoryview(own.encode_block([text])[0]).cast("I")) == library.encode(text, add_special_tokens=False).ids


def test_transducer_shares_suffixes():
    words = {w: [k] for k, w in enumerate(["nation", "station", "ration", "a", "été"])}
    arrays = compile_lexicon(words)
    assert Lexicon(arrays).lookup([*words, "nat", "", "stations"]) == [*(k.to_bytes(4, "little") for k in range(5)), None, None, None]
    assert len(arrays["keys"]) < sum(len(w.encode()) for w in words)
    assert Lexicon(compile_lexicon({})).lookup(["a"]) == [None]


def test_language(spark, docs):
    rng = random.Random(3)
    make = lambda tails: " ".join(rng.choice(WORDS)[:3] + rng.choice(tails) for _ in range(60))
    rows = [(k, make(("ung", "keit", "sch")), "de") if k % 2 else (k, make(("eau", "tion", "ée")), "fr") for k in range(300)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = op4.train(train, sample=60)
    got = op4.identify(train, net).join(train, "doc_id").where(op4.held_out(F.col("doc_id"))).collect()
    assert len(got) > 40 and all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    odd = {str(r.doc_id): r.lang_pred for r in op4.identify(docs, net).collect()}
    assert odd["4"] == odd["5"] == odd["12"] == "und" and odd["11"] in ("de", "fr") and odd["None"] in ("de", "fr")
    nothing = op4.train(train.limit(0))
    assert {r.lang_pred for r in op4.identify(docs, nothing).collect()} == {"und"}
    again = op4.train(train.repartition(5), sample=60)
    assert all(np.array_equal(net.params[k], again.params[k]) for k in net.params)


def test_bits_tell_rows_apart(spark):
    hashes = spark.range(0, 4000, 2).select(F.xxhash64("id").alias("h"))
    found, size = bits.bit_array(hashes)
    passed = spark.range(4000).where(bits.may_be_in(F.xxhash64("id"), found, size))
    assert size == 1 << 16 and passed.where("id % 2 = 0").count() == 2000 and passed.where("id % 2 = 1").count() < 60
    none, least = bits.bit_array(hashes.limit(0))
    assert least == bits.LEAST and spark.range(100).where(bits.may_be_in(F.xxhash64("id"), none, least)).isEmpty()


def test_language_counts_repeated_rows_once(spark):
    """A label whose rows are each repeated teaches as the same rows do once."""
    rng = random.Random(3)
    make = lambda tails: " ".join(rng.choice(WORDS)[:3] + rng.choice(tails) for _ in range(60))
    rows = [(k, make(("ung", "keit", "sch")), "de") if k % 2 else (k, make(("eau", "tion", "ée")), "fr") for k in range(400)]
    once = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    often = once.where("lang = 'fr'").unionByName(once.where("lang = 'de'").join(spark.range(200).select(F.col("id").alias("again")), F.lit(True)).drop("again"))
    alone, repeated = op4.train(once, sample=60), op4.train(often, sample=60)
    assert all(np.array_equal(alone.params[k], repeated.params[k]) for k in alone.params)


def test_no_letter_is_no_language():
    net = op4.ByteConvNet(["de", "fr"])
    for text in (None, "", " \n", "123", "½ ²", "①②", "Ⅳ", "🙂 !?", "٣٤", "_-_"):
        assert op4.predict(net, [text]) == [("und", 0.0)], text
    for text in ("a", "ß", "中", "1ª", "½x"):
        assert op4.predict(net, [text])[0][0] in ("de", "fr"), text


def direct(net, text):
    """A prediction by plain convolution, window by window."""
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    raw, total = text.lower().encode(), 0
    for at in range(0, len(raw), op4.WINDOW):
        piece = raw[at : at + op4.WINDOW]
        x = np.array([[*piece, *[256] * (op4.WINDOW - len(piece))]])
        pooled = [np.maximum(r.max(axis=1) + net.params[f"c{w}"], 0) for w, r in zip(op4.WIDTHS, net._responses(x), strict=True)]
        scores = (np.concatenate(pooled, axis=1) @ net.params["o"] + net.params["b"])[0]
        scores = np.exp(scores - scores.max())
        total = total + len(piece) * scores / scores.sum()
    total = total / total.sum()
    return net.labels[int(total.argmax())], float(total.max())


def test_language_on_the_tables(spark, sf):
    """Every prediction against plain convolution, and accuracy on texts that taught nothing."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    net = op4.train(table)
    texts = {r.doc_id: r for r in table.collect()}
    got = op4.op4_language(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        label, share = direct(net, texts[r.doc_id].text)
        assert r.lang_pred == label and abs(r.score - share) < 1e-4
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    larger = sf.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{larger}/documents.parquet").where("lang is not null").select("doc_id", "lang").collect()}
    judged = [r.lang_pred == truth[r.doc_id] for r in op4.op4_language(spark, larger).where("held_out").collect() if r.doc_id in truth]
    assert len(judged) > 200 and sum(judged) >= 0.98 * len(judged)


def test_language_stage_uses_the_prediction(spark):
    rng = random.Random(3)
    make = lambda tails, n=60: " ".join(rng.choice(WORDS)[:3] + rng.choice(tails) for _ in range(n))
    german, french = ("ung", "keit", "sch"), ("eau", "tion", "ée")
    rows = [(k, make(german) if k % 2 else make(french), ("de" if k % 2 else "fr") if k % 7 else None, k, "mine") for k in range(300)]
    rows += [(400, "½ ²", "de", 1, "mine"), (401, None, "fr", 1, "mine"), (402, make(german, 40), None, 1, "mine"), (402, rows[1][1], "de", 1, "mine"), (None, make(french), "fr", 1, "mine")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string")
    kept = op4.language_stage(table).collect()
    assert len(kept) == len(rows) - 2 and not {400, 401} & {r.doc_id for r in kept}
    assert all(r.lang == ("de" if r.doc_id % 2 else "fr") for r in kept if r.doc_id is not None and r.doc_id < 300) and all(r.lang_pred == "mine" for r in kept)
    assert sum(r.doc_id == 402 for r in kept) == 2
    french_only = op4.language_stage(table, languages=["fr"]).collect()
    assert 0 < len(french_only) < len(kept) and {r.lang for r in french_only} == {"fr"}
    assert op4.language_stage(table, min_share=1.0).isEmpty()
    assert op4.language_stage(table.limit(0)).isEmpty() and op4.language_stage(table.limit(0)).columns == table.columns


def test_table_lookup_equals_convolution():
    net = op4.ByteConvNet(["a", "b"])
    x = op4.windows(bytes(range(256)) * 3)
    direct = [np.maximum(r.max(axis=1) + net.params[f"c{w}"], 0) for w, r in zip(op4.WIDTHS, net._responses(x), strict=True)]
    scores = np.concatenate(direct, axis=1) @ net.params["o"] + net.params["b"]
    want = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    assert np.allclose(net.probabilities(x, net.pair_tables()), want, atol=1e-5)


@pytest.mark.parametrize(("batches", "group"), [(1, 2000), (3, 1)])
def test_substrings(docs, batches, group):
    order = sorted(range(len(ROWS)), key=lambda k: (ROWS[k][0] is None, ROWS[k][0] or 0))
    seen, want = {}, []
    for k in order:
        i, t = ROWS[k]
        w = _split(t)
        out = [False] * len(w)
        for s in range(len(w) - 19):
            key, me = tuple(w[s : s + 20]), (i, s)
            if seen.setdefault(key, me) != me:
                out[s : s + 20] = [True] * 20
        want.append((str(i), len(w), sum(out), b" ".join(x for x, o in zip(w, out, strict=True) if not o).decode()))
    got = op5.strip_repeats(docs, batches=batches, group=group).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)
    kept = op5.substring_stage(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 3").isEmpty() and kept.where("doc_id = 6").count() == 1


def test_substrings_spread_an_anchor_with_many_windows(spark, monkeypatch):
    # One anchor in 80 contexts, each context twice: nothing but the anchor is common.
    gram, rows = _text(7, 8), []
    for k in range(160):
        side = [f"{w}{k % 80}" for w in _text(1000, 30).split()]
        rows.append((k, " ".join([*side[:15], gram, *side[15:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans = {}
    monkeypatch.setattr(op5, "materialise", lambda df, name, f=op5.materialise: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or f(df, name))
    op5.repeated_windows(docs, group=4)
    plan = plans["marks"]
    assert re.search(r"hashpartitioning\(anchor#\d+L?, offset#\d+, digest#\d+L?, ", plan)
    assert not re.search(r"hashpartitioning\(anchor#\d+L?, \d+\)", plan)
    got = op5.strip_repeats(docs, group=4).collect()
    assert all(r.n_words == 38 and r.n_removed == (38 if r.doc_id >= 80 else 0) for r in got) and len(got) == 160


def test_substrings_of_null_ids_and_copies(spark, monkeypatch):
    # 40 documents without an id, one of them 30 times, and 60 copies of a text under their own ids.
    rows = [(None, f"{_text(2000 + k, 20)} {PASSAGE}") for k in range(40)] + [(None, f"{_text(2000, 20)} {PASSAGE}")] * 29
    rows += [(k, _text(3000, 60)) for k in range(60)]
    docs, read = spark.createDataFrame(rows, "doc_id long, text string"), []
    monkeypatch.setattr(op5, "materialise", lambda df, name, f=op5.materialise: read.append((name, f(df, name))) or read[-1][1])
    got = op5.strip_repeats(docs, group=10).collect()
    assert len(got) == len(rows)
    assert all(r.n_removed == (60 if r.doc_id else 0) for r in got if r.doc_id is not None)
    # The passage stays in one of the 40 documents; the repeated rows of one are treated alike.
    cut = {}
    for r in got:
        if r.doc_id is None:
            cut.setdefault(r.kept.split()[:20].__str__(), set()).add(r.n_removed)
    assert len(cut) == 40 and sorted(next(iter(x)) for x in cut.values())[:2] == [0, 60] and all(len(x) == 1 for x in cut.values())
    assert op5._documents(docs, "doc_id", "text").where(F.col("id") == op5.NO_ID).select("key").distinct().count() == 40
    judged = next(df for name, df in read if name == "judged").where("id < 60")
    assert judged.where("groups > 1").select("anchor", "salt").distinct().count() > judged.select("anchor").distinct().count()


def _marked(marks):
    """{(id, print): start words} of marks."""
    out = {}
    for r in marks.collect():
        out.setdefault((r.id, r.print), set()).update(r.start + k for k in range(13) if r.mask >> k & 1)
    return out


def test_window_index_goes_on_in_later_calls(spark, docs, tmp_path):
    rows = docs.where("doc_id is not null").select("doc_id", "text").unionByName(spark.createDataFrame([(20 + k, _text(k, 30) + " " + PASSAGE) for k in range(6)], "doc_id long, text string"))
    parts = [rows.where("doc_id < 4"), rows.where("doc_id between 4 and 12"), rows.where("doc_id between 13 and 21"), rows.where("doc_id > 21")]
    want = _marked(op5.repeated_windows(rows, batches=1))
    assert len(want) >= 8
    folder, got, runs = f"file://{tmp_path}/index", {}, []
    for part in parts:  # each in an index opened anew; more than one run is compacted before the next is merged with it
        with op5.WindowIndex(spark, folder, buckets=3, fan_in=1) as index:
            got |= _marked(index.add(part, group=3))
            runs.append(sorted(index.runs))
    assert got == want
    assert runs == [[0], [0, 1], [2, 3], [4, 5]]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("windows_")]
    # What is in the index counts as earlier, whatever the ids.
    with op5.WindowIndex(spark, folder) as index:
        again = _marked(index.add(spark.createDataFrame([(-5, PASSAGE), (-6, _text(777, 50))], "doc_id long, text string")))
        assert {k[0]: len(v) for k, v in again.items()} == {-5: 41}
        index.drop()
    assert not (tmp_path / "index").exists()


def test_window_index_merges_runs_without_a_shuffle(spark, docs, tmp_path):
    with op5.WindowIndex(spark, f"file://{tmp_path}/index", buckets=3) as index:
        index.add(docs)
        index.add(docs)
        a, b = (spark.table(t) for t in index.runs.values())
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = a.join(b.withColumnRenamed("n", "m"), "anchor")._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_failed_load_leaves_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(op5, "_first_round", lambda packed: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        op5.repeated_windows(docs)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("windows_")]


def test_a_batch_added_again_after_a_failure_counts_once(spark, tmp_path, monkeypatch):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first, second = frame([(1, _text(5, 60))]), frame([(2, f"{_text(6, 30)} {PASSAGE}"), (3, f"{PASSAGE} {_text(7, 30)}")])
    with op5.WindowIndex(spark, f"file://{tmp_path}/clean", buckets=3) as index:
        index.add(first)
        want = _marked(index.add(second))
        state = index.made, sorted(index.runs), index.batches
    assert {k[0] for k in want} == {3}
    for step in ("materialise", "_log"):
        folder = f"file://{tmp_path}/{step}"
        with op5.WindowIndex(spark, folder, buckets=3) as index:
            index.add(first)
            with monkeypatch.context() as broken:
                if step == "_log":  # when all but the log is written
                    broken.setattr(op5.WindowIndex, "_log", lambda *_: 1 / 0)
                else:
                    broken.setattr(op5, "materialise", lambda *_: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    index.add(second)
            assert _marked(index.add(second)) == want
            assert (index.made, sorted(index.runs), index.batches) == state
        with op5.WindowIndex(spark, folder) as index:  # and in a later session
            assert index.batches == state[2]
            assert {k[0] for k in _marked(index.add(frame([(9, PASSAGE)])))} == {9}


def test_the_query_compacts_runs(spark, docs, monkeypatch):
    runs = []
    monkeypatch.setattr(op5.WindowIndex, "compact", lambda self, own=op5.WindowIndex.compact: (runs.append(sorted(self.runs)), own(self)))
    many = spark.createDataFrame([(k, f"{_text(k % 9, 30)} {PASSAGE}") for k in range(40)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in op5.strip_repeats(many).collect()}
    assert runs == [[0, 1]]
    assert got == {r.doc_id: r.n_removed for r in op5.strip_repeats(many, batches=1).collect()}


def test_index_in_a_process_whose_workers_lack_the_package(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    script = f"""
import sys
sys.path.insert(0, {str(root)!r})
from tidegauge.llm.op5_substrings import WindowIndex
from tidegauge.session import get_session
spark = get_session(cores=2, partitions=2)
with WindowIndex(spark) as index:
    index.add(spark.createDataFrame([(1, "a b c " * 30)], "doc_id long, text string"))
    print("RUNS", len(index.runs))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "RUNS 1" in done.stdout, done.stderr[-2000:]


def test_word_hashes_are_independent_and_bounded():
    known = op5._WordHashes()
    codes = known.codes([b"word", b"other", b"word"])
    assert codes.tolist() == [0, 1, 0] and known.hashes(codes, 0)[0] == xxhash.xxh64_intdigest(b"word", 20) != known.hashes(codes, 1)[0]
    for k in range(40):
        known.codes([bytes([k]) * 1_000_000])
    assert sum(map(len, known)) <= op5._REMEMBERED + 1_000_000


def test_least_of_runs():
    rng = np.random.default_rng(0)
    for size in (1, 2, 3, 8, 13):
        values = rng.integers(0, 30, 200).astype(np.uint64)
        assert op5._least(values, size).tolist() == [k + int(np.argmin(values[k : k + size])) for k in range(200 - size + 1)]


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 16))
    rows = [(k, (base[k % 6] + rng.normal(size=16) * (0.02 if k % 5 else 0.2)).tolist(), "x") for k in range(150)]
    rows += [(200, rows[0][1], "x"), (0, rows[0][1], "x"), (201, [0.0] * 16, "x"), (202, None, "x"), (203, [None] * 16, "x"), (204, [float("nan")] + [1.0] * 15, "x"), (205, [1.0, 2.0], "x"), (206, [2.0, 4.0], "x"), (None, rows[1][1], "x"), (207, [], "x")]
    got = op6.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, unit string"), chunk=20).collect()
    assert len(got) == len(rows)
    known = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    link = {i: {j for j, w in known.items() if j != i and len(w) == len(v) and v @ w >= 0.9} for i, v in known.items()}
    found = sum(r.n_links for r in got if r.vec_id in link)
    total = sum(len(link[r.vec_id]) for r in got if r.vec_id in link)
    assert total >= found >= 0.98 * total
    assert all(r.n_links <= len(link.get(r.vec_id, ())) for r in got)
    again = op6.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, unit string")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    alone = {r.vec_id: r for r in got}
    assert all(alone[k].n_links == 0 and alone[k].component_id == k and alone[k].kept for k in (201, 202, 203, 204, 207))
    assert alone[206].component_id == 205 and alone[200].component_id == 0 and not alone[200].kept


def _simhash(text):
    w = _split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("tile", [4096, 2])
def test_simhash(docs, tile):
    prints = {i: _simhash(t) for i, t in ROWS}
    got = op7.simhash_groups(docs, tile=tile).collect()
    assert len(got) == len(ROWS)
    want = _components([i for i in prints if i is not None], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    for r in got:
        assert int(r.fingerprint, 16) == prints[r.doc_id]
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
    for keys in (10**6, 0):
        stage = op7.near_duplicates_stage(docs, tile=tile, broadcast_keys=keys)
        best = {}
        for i, t in ROWS:
            if i is not None:
                best[want[i]] = min(best.get(want[i], i), i)
        assert sorted((str(r.doc_id) for r in stage.collect())) == sorted([*map(str, best.values()), "None"])
    assert stage.columns == docs.columns and stage.where("doc_id = 9").count() == 1 and stage.where("doc_id = 3").isEmpty() and stage.where("doc_id is null").count() == 1


def test_near_duplicates_of_one_id(spark):
    # Two texts under one id, of which one is a copy of an earlier document; repeats; groups without any id.
    a, b, c, d = (_text(50 + k, 60) for k in range(4))
    rows = [(1, a, 10), (5, a, 11), (5, b, 12), (5, b, 13), (None, a, 14), (None, c, 15), (None, c, 16), (None, d, 17), (7, None, 18), (8, "", 19), (None, None, 20), (3, d, 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key_id int").withColumn("print", F.col("key_id")).withColumn("mark", F.lit("mine")).withColumn("key_mark", F.col("key_id"))
    for keys in (10, 0):
        got = op7.near_duplicates_stage(docs, broadcast_keys=keys).collect()
        assert sorted((str(r.doc_id), r.text) for r in got if r.text) == sorted([("1", a), ("5", b), ("None", c), ("3", d)])
        assert [r.doc_id for r in got if not r.text] == [7]
        assert all(r.key_id == r.print == r.key_mark and r.mark == "mine" and r.doc_id == rows[r.key_id - 10][0] for r in got)


@pytest.mark.parametrize("tile", [64, 7])
def test_simhash_links_random(spark, tile):
    rng = random.Random(tile)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for s in seeds for _ in range(6)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    found = {r.node: r.component for r in connected_components(op7.links(df, tile=tile)).collect()}
    want = _components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {p: found.get(p, p) for p in signed} == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 200), (200, 150), (7, 7), (300, 301), (301, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 150: 100, 200: 100, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "u long, v long")).isEmpty()


PAGE = """<!doctype html><html><head><title>T</title><script>var x = "</p><p>no";</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site work better for all of you.</p></div><!-- <p>hidden</p> --><main><article><h1>A &amp; B</h1><p>First <b>part</b>&nbsp;of
 it, &lt;tag&gt; &#233;.<p>Of.</p><div class='ad banner'><p>Buy this now, it is cheap and good and new.</p></div><ul><li>one point</li></ul></article><section id=comments><p>Nice post, I liked it a lot, thank you very much.</p></section></main>
<aside><p>Related posts you may like to read some day.</p></aside><form><p>Sign up here</p><input></form><footer>&copy; 2026 someone</footer>"""


def test_html(spark):
    want = "A & B\nFirst part of it, <tag> é.\nOf.\none point"
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", "x"), (None, "w", PAGE, "x"), (4, "y", "<p><p <<<", "x"), (5, "z", PAGE[: PAGE.index("Of.")], "x"), (6, "l", "<article>" + "<p>long text here</p>" * 3000, "x")]
    got = {r.url: r for r in op8.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got["u"].text == got["w"].text == want and got["u"].n_chars == len(want)
    assert got[None].text == got["v"].text == "" and got["z"].text == want[: want.index("\nOf")] and got["l"].text.count("\n") == 2999


def test_stages_leave_the_columns_alone(spark, bench):
    """Every filtering stage on nulls, repeats, and columns named as its own: what stays is as it came."""
    names = "n_words n_removed kept key_id key_print key_spans spans _id _no_id _print bad key token hit contaminated mark print key_mark key_stays stays _label score lang_pred".split()
    texts = [_text(1, 40), PASSAGE, None, "", _text(2, 30), _text(2, 30), "x", _text(9, 25) + " " + _text(4, 30), _text(8, 25) + " " + _text(4, 30), "½"]
    ids = [1, 2, 3, 4, 5, 5, None, 7, 8, 9]
    rows = [(i, t, "en", 7, *[k * 100 + m for m in range(len(names))]) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int, " + ", ".join(f"`{n}` int" for n in names))
    stages = {"language": op4.language_stage, "near": op7.near_duplicates_stage, "substrings": op5.substring_stage, "decontamination": lambda d: op2.decontamination_stage(d, bench)}
    left = {"language": {0, 1, 4, 5, 6, 7, 8}, "near": {0, 1, 2, 4, 6, 7, 8, 9}, "substrings": set(range(10)), "decontamination": {0, 2, 3, 4, 5, 6, 7, 8, 9}}
    for name, stage in stages.items():
        got = stage(table)
        assert got.schema == table.schema, name
        found = got.collect()
        kept = {r.n_words // 100 for r in found}
        assert kept == left[name] or name == "near" and len(kept) == len(left[name]) and kept >= {0, 1, 2, 6, 7, 8}, (name, kept)
        for r in found:
            k = r.n_words // 100
            assert [r[n] for n in names] == list(rows[k][4:]) and r.doc_id == ids[k], name
            assert r.text == texts[k] if (name, k) != ("substrings", 8) else r.text == _text(8, 25) and r.n_chars == len(r.text)
        assert stage(table.limit(0)).isEmpty() and stage(table.limit(0)).columns == table.columns, name


def test_quality(spark, docs):
    rng = random.Random(5)
    rows = [(k, (_text(k, 80) + (" junk### %%% " * 15 if k % 4 == 0 else "")), "x") for k in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, selected string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(200) if rng.random() < 0.6] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = op1.resample(table, labels).collect()
    assert len(got) == 200 and not any(r.selected for r in got if r.doc_id % 4 == 0) and sum(r.selected for r in got) > 100
    assert op1.resample(table, labels).orderBy("doc_id").collect() == sorted(got)
    assert sum(r.selected for r in op1.resample(table, labels, k=10).collect()) == 10
    assert sum(r.selected for r in op1.resample(table, labels, k=10_000).collect()) == 200
    assert not any(r.selected for r in op1.resample(table, labels.limit(0)).collect())
    odd = op1.resample(docs, labels).collect()
    assert len(odd) == len(ROWS) and not any(r.selected for r in odd if r.doc_id in (4, 5))


def test_quality_ranks_held_out_labels(spark, sf):
    """Good texts whose label the model never saw weigh more than bad ones: the chance that they do, over all pairs."""
    larger = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    labels = spark.read.parquet(f"{larger}/labels.parquet").select("doc_id", "quality", "toxic").where("quality is not null")
    shown = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0)
    judged = op1.resample(docs, shown).join(labels.join(shown, "doc_id", "left_anti"), "doc_id").where("n_grams > 0").select("log_weight", (F.expr("quality = 1 and coalesce(toxic, 0) = 0")).alias("good")).toPandas()
    ranks, good = judged["log_weight"].rank(), judged["good"]
    n, m = int(good.sum()), int((~good).sum())
    assert n > 20 and m > 20
    auc = (ranks[good].sum() - n * (n + 1) / 2) / (n * m)
    assert auc > 0.8, auc


def test_quality_against_brute_force(spark):
    """Weights and selection of a table by plain loops over dictionaries."""
    rows = [(k, None if k == 7 else "" if k == 8 else _text(k, 30 + k) + (" Gut! %%% ###" * (k % 5)), "x") for k in range(60)] + [(None, _text(3, 40), "x")]
    marks = {k: (int(k % 3 != 0), int(k % 11 == 0)) for k in range(0, 60, 2)}
    table = spark.createDataFrame(rows, "doc_id long, text string, log_weight string")
    labels = spark.createDataFrame([(k, *v) for k, v in marks.items()], "doc_id long, quality int, toxic int")
    m64, odd, even = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

    def grams(text):
        h = [xxhash.xxh64_intdigest(t, 5) for t in re.findall(r"\w+|[^\w\s]+", text or "")]
        return [("w", (x * even & m64) >> 46) for x in h] + [("p", ((a * odd + b) * even & m64) >> 54) for a, b in zip(h, h[1:], strict=False)]

    def fold(name, text):
        return xxhash.xxh64_intdigest(str(name) if name is not None else text or "", 77) & 1

    raw, target = {}, ({}, {})
    for i, t, _ in rows:
        for g in grams(t):
            raw[g] = raw.get(g, 0) + 1
            if marks.get(i) == (1, 0):
                target[fold(i, t)][g] = target[fold(i, t)].get(g, 0) + 1
    share = {(f, kind): sum(n for g, n in target[f].items() if g[0] == kind) / sum(n for g, n in raw.items() if g[0] == kind) for f in (0, 1) for kind in "wp"}
    weights = []
    for i, t, _ in rows:
        f, total = 1 - fold(i, t), 0.0
        for g in grams(t):
            ratio = np.log((target[f].get(g, 0) + op1.PRIOR) / (raw[g] * share[f, g[0]] + op1.PRIOR))
            total += np.sign(ratio) * max(abs(ratio) - op1.DEAD, 0)
        weights.append((i, len(grams(t)), total, total - np.log(-np.log((xxhash.xxh64_intdigest(str(i) if i is not None else t or "", 9) + 0.5) / 2.0**64))))
    k = round(len(rows) * sum(v == (1, 0) for v in marks.values()) / len(marks))
    chosen = {i for i, *_ in sorted((w for w in weights if w[1]), key=lambda w: -w[3])[:k]}
    got = {r.doc_id: r for r in op1.resample(table, labels).collect()}
    assert len(got) == len(rows)
    for i, n, weight, noisy in weights:
        assert got[i].n_grams == n and abs(got[i].log_weight - weight) < 1e-3 and abs(got[i].noisy - noisy) < 1e-3
    assert {i for i, r in got.items() if r.selected} == chosen


def test_threshold_of_large_keys(spark):
    keys = [(1 << 62) - k * k for k in range(500)] + [-(1 << 61)] * 3
    df = spark.createDataFrame([(k,) for k in keys], "q long")
    for k in (1, 2, 250, 499, 501):
        assert threshold(df, k, bins=16) == sorted(keys, reverse=True)[k - 1]


def test_token_counts(docs):
    pieces = set(op10.vocabulary(public_tokenizers.path("byte_bpe_50k.json")))

    def greedy(word):
        n = 0
        while word:
            size = next(k for k in range(min(len(word), longest), 0, -1) if k == 1 or word[:k] in pieces)
            word, n = word[size:], n + 1
        return n

    longest = max(map(len, pieces))
    for r in op10.count_tokens(docs).collect():
        words = next(_split(t) for i, t in ROWS if i == r.doc_id)
        assert r.n_words == len(words)
        assert r.n_tokens == sum(greedy(b" " + w) for w in words)


def test_empty_tables(docs, bench):
    none = docs.limit(0)
    labels = none.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    for out in (
        op1.resample(none, labels), op2.decontaminate(none, bench), op3.encode(none), op4.identify(none, op4.train(none)), op5.strip_repeats(none), op7.simhash_groups(none), op9.assign_shards(none), op10.count_tokens(none),
        op6.embedding_groups(none.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))),
        op8.extract(none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))),
        op3.digests(op3.encode(none)),
    ):
        assert out.isEmpty()
