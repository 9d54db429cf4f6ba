"""The registered queries and the pipeline on the smallest tables."""

import hashlib
import re

import duckdb
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import direct
from tidegauge.llm import op4_language as op4
from tidegauge.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(name, spark, sf):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = registry.queries()[name](spark, sf)
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_operators_are_registered():
    assert {int(n[2:].split("_")[0]) for n in registry.queries()} == set(range(1, 14))


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.mode("overwrite").parquet(path := f"{tmp_path}/{name}")
        docs = spark.read.parquet(path)
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.7 * len(ids)
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
        ids = kept
    assert corpus_pipeline.run(spark, sf).count() == len(ids)


def _fingerprint(text):
    w = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))


def test_pipeline_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    net = op4.train(spark.read.parquet(f"{sf}/documents.parquet"))
    share = {i: direct(net, t) for i, t in docs.items()}
    docs = {i: t for i, t in docs.items() if share[i][0] != "und" and share[i][1] > op4.MIN_SHARE}
    prints = {i: _fingerprint(t) for i, t in docs.items()}
    group = dict(zip(docs, docs, strict=True))
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    docs = {i: t for i, t in docs.items() if group[i] == i}
    seen, cut = {}, {}
    for i in sorted(docs):
        w = docs[i].encode().split()
        gone = set()
        for s in range(len(w) - 19):
            if seen.setdefault(tuple(w[s : s + 20]), (i, s)) != (i, s):
                gone |= set(range(s, s + 20))
        if len(gone) < len(w):
            cut[i] = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else docs[i]
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = _benchmark_words(r.text)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} - {()}
    sizes = {len(w) for w in windows}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in cut.items():
        w = _benchmark_words(t)
        hit = {p for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            ids = library.encode(t, add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got) == sorted(want)
