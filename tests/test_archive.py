"""Reading, validating, storing and re-reading an archive of quads."""

import gzip

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import current, facts, gates
from tidegauge.plans import archive_queries
from tidegauge.schemas import DQV, PROV, RDF_TYPE
from tidegauge.sources import quads, store

NS, XSD = "urn:obs:", "http://www.w3.org/2001/XMLSchema#"
ACT = "urn:obs:activity:2024-01-01T00:00:00Z"
G = "urn:obs:run:2024-01-01T00:00:00Z"


def line(s, p, o, g=G):
    return f"<{s}> <{p}> {o} <{g}> ." if g else f"<{s}> <{p}> {o} ."


def run(at="2024-01-01T00:00:00Z", torn=False):
    act, g, m = f"urn:obs:activity:{at}", f"urn:obs:run:{at}", f"urn:obs:measurement:{at}:e:m"
    out = [
        "# a sweep", line(act, RDF_TYPE, f"<{PROV}Activity>", g), line(act, f"{PROV}generatedAtTime", f'"{at}"^^<{XSD}dateTime>', g), line(act, f"{NS}emission", '"3"', g),
        line(m, RDF_TYPE, f"<{DQV}QualityMeasurement>", g), line(m, f"{DQV}computedOn", "<http://e.org/sparql>", g), line(m, f"{DQV}isMeasurementOf", f"<{NS}metric:m>", g),
        line(m, f"{DQV}value", '"verified"', g), line(m, f"{NS}elapsedMs", f'"42"^^<{XSD}integer>', g), line(act, f"{NS}completedEndpoint", "<http://e.org/sparql>", g),
    ]
    out += [line("urn:x", "urn:p", '"tail"', g)] if torn else [line(act, f"{NS}finalised", f'"true"^^<{XSD}boolean>', g)]
    return "\n".join(out) + "\n"


@pytest.fixture
def archive(tmp_path):
    (tmp_path / "a.nq").write_text(run())
    (tmp_path / "b.nq.gz").write_bytes(gzip.compress(run("2024-01-02T00:00:00Z", torn=True).encode()))
    return tmp_path


def test_parse_terms(spark):
    raw = [
        ('<urn:s> <urn:p> "a \\"b\\" \\u00e9\\n\\\\ \'" <urn:g> .', "a \"b\" é\n\\ '", "literal"), ('_:b1 <urn:p> "x"@en-GB <urn:g> .', "x", "literal"),
        ('<urn:s> <urn:p> _:o .', "_:o", "blank"), ('<urn:s> <urn:p> "" <urn:g> .', "", "literal"), ("<urn:s> <urn:p> broken", None, None),
    ]
    rows = quads.parse_lines(spark.createDataFrame([("f", k, r[0]) for k, r in enumerate(raw)], "src_file string, line_no long, value string")).orderBy("line_no").collect()
    assert [(r.o, r.o_kind) for r in rows] == [(r[1], r[2]) for r in raw]
    assert rows[1].o_lang == "en-GB" and rows[1].s_kind == "blank" and rows[2].g is None and rows[4].bad


def test_lines_round_trip(spark):
    value = 'tab\t "quote" \\ new\nline é {"v":1}'
    df = spark.createDataFrame([("urn:s", "iri", "urn:p", value, "literal", None, "en", "urn:g")], "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string, g string")
    lines = quads.to_lines(df).select(F.lit("f").alias("src_file"), F.lit(1).cast("long").alias("line_no"), "value")
    back = quads.parse_lines(lines).first()
    assert back.o == value and back.o_lang == "en" and back.bad is None


def test_cut_and_facts(spark, archive):
    q = quads.read_quads(spark, str(archive))
    cuts = {r.src_file.rsplit("/", 1)[1]: r for r in gates.cuts(q).collect()}
    assert cuts["a.nq"].discarded == 0 and cuts["b.nq"].discarded == 1 and not cuts["b.nq"].refused
    kept = gates.cut_to_last_terminator(q)
    assert kept.where("p = 'urn:p'").count() == 0
    runs = {r.run: r for r in facts.runs(kept).collect()}
    assert runs[G].finalised and runs["urn:obs:run:2024-01-02T00:00:00Z"].finalised is None
    r = facts.readings(kept).orderBy("run").collect()
    assert [(x.metric, x.verdict, x.elapsed_ms) for x in r] == [("m", "verified", 42)] * 2
    assert current.current_run(facts.readings(kept)).first().run.endswith("02T00:00:00Z")


def test_large_files_are_read_in_ranges(spark, tmp_path):
    texts = {f"f{k}.nq": [f"<urn:s{i}> <urn:p> \"{'x' * (i % 37)} é\" <urn:g> ." if i % 5 else "" for i in range(n)] for k, n in enumerate((0, 1, 3, 900, 1300))}
    (tmp_path / "in").mkdir()
    for k, (name, lines) in enumerate(texts.items()):
        (tmp_path / "in" / name).write_bytes(("\r\n" if k == 3 else "\n").join(lines).encode())
    (tmp_path / "in" / "packed.nq.gz").write_bytes(gzip.compress("\n".join(texts["f4.nq"]).encode()))
    texts["packed.nq"] = texts["f4.nq"]
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        rows = quads.read_lines(spark, str(tmp_path / "in"))
        got = {(r.src_file.rsplit("/", 1)[1], r.line_no): r.value for r in rows.collect() if r.value}
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == {(name, n): line for name, lines in texts.items() for n, line in enumerate(lines, 1) if line}
    assert quads.read_quads(spark, str(tmp_path / "in")).where("bad is not null").isEmpty()


def test_header_fragment_is_refused(spark):
    q = spark.createDataFrame([("f", 1, ACT, "urn:p", "x", G)], "src_file string, line_no long, s string, p string, o string, g string")
    assert gates.cuts(q).first().refused and gates.cut_to_last_terminator(q).isEmpty()


def test_graph_faults(spark):
    q = spark.createDataFrame([("f", "urn:obs:current"), ("f", None), ("h", G)], "src_file string, g string")
    assert {(r.src_file, r.fault) for r in gates.graph_faults(q).collect()} == {("f", "derived graph"), ("f", "default graph")}


def test_contradiction_needs_one_graph(spark):
    rows = [("g1", ACT, f"{NS}dormantEndpoint", "e"), ("g1", "m", f"{NS}notMeasuredOn", "e"), ("g2", ACT, f"{NS}dormantEndpoint", "f"), ("g3", "m", f"{DQV}computedOn", "f")]
    q = spark.createDataFrame([(*r, "iri") for r in rows], "g string, s string, p string, o string, o_kind string")
    assert [(r.g, r.endpoint) for r in gates.contradictions(q).collect()] == [("g1", "e")]
    assert gates.rewrites(q.where("g = 'g2'"), q.where("g = 'g3'").withColumn("g", F.lit("g2"))).count() == 1


def test_pending_files(spark, archive):
    seen = quads.file_digests(spark, str(archive)).collect()
    files = spark.createDataFrame(seen, "key string, digest string")
    assert quads.pending_files(files, None).count() == 2
    assert quads.pending_files(files, files.where("key like '%a.nq'")).count() == 1
    (archive / "a.nq").write_text(run() + "\n")
    assert quads.pending_files(quads.file_digests(spark, str(archive)), files).count() == 1


def test_write_replaces_whole_graphs(spark, archive, tmp_path):
    q = quads.read_quads(spark, str(archive))
    path = str(tmp_path / "store")
    store.write_runs(q, path)
    n = store.read_runs(spark, path).count()
    store.write_runs(q.where(F.col("g") == G), path)
    assert store.read_runs(spark, path).count() == n
    assert store.incomplete_graphs(q, store.read_runs(spark, path)).isEmpty()
    store.write_runs(q.where((F.col("g") == G) & (F.col("line_no") < 5)), path)
    assert [r.g for r in store.incomplete_graphs(q, store.read_runs(spark, path)).collect()] == [G]
    assert store.read_runs(spark, path, [G]).count() == 3


def test_publish(spark, tmp_path):
    path = str(tmp_path / "pub")
    for k in (1, 2, 3):
        store.publish(spark.range(k), path, k)
    assert store.latest(spark, path).count() == 3
    assert [r.generation for r in store.reapable(spark.read.parquet(f"{path}/pointers"), 2).collect()] == [1]


def test_stream_ingest(spark, archive, tmp_path):
    from tidegauge.streaming import jobs

    jobs.ingest(jobs.archive_stream(spark, str(archive)), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert store.read_runs(spark, str(tmp_path / "out")).select("g").distinct().count() == 2


def test_stream_ingest_refuses_bad_files(spark, tmp_path):
    from tidegauge.streaming import jobs

    inbox, base = tmp_path / "in", str(tmp_path)
    inbox.mkdir()
    text = lambda day, *more: run(f"2024-01-{day:02d}T00:00:00Z") + "".join(m + "\n" for m in more)
    at = lambda day: (f"urn:obs:activity:2024-01-{day:02d}T00:00:00Z", f"urn:obs:run:2024-01-{day:02d}T00:00:00Z")
    done = lambda day: line(at(day)[0], f"{NS}dormantCount", '"1"', at(day)[1])
    (inbox / "good.nq").write_text(text(1))
    (inbox / "line.nq").write_text(text(2, "<urn:s> broken"))
    (inbox / "header.nq").write_text(line(at(3)[0], RDF_TYPE, f"<{PROV}Activity>", at(3)[1]) + "\n")
    (inbox / "default.nq").write_text(text(4, line("urn:s", "urn:p", '"x"', None), done(4)))
    (inbox / "contradiction.nq").write_text(text(5, line(at(5)[0], f"{NS}dormantEndpoint", "<http://e.org/sparql>", at(5)[1]), done(5)))
    (inbox / "tie.nq").write_text(text(1).replace("urn:obs:run:2024-01-01", "urn:obs:run:other"))
    (inbox / "last.nq").write_text(text(7))
    faults = []
    load = lambda: jobs.ingest(jobs.archive_stream(spark, str(inbox)), f"{base}/out", f"{base}/log", on_refused=lambda f: faults.extend((r.src_file.rsplit("/", 1)[1], r.fault) for r in f.collect())).awaitTermination()
    load()
    assert set(faults) == {
        ("line.nq", "line"), ("header.nq", "header fragment"), ("default.nq", "default graph"), ("contradiction.nq", "contradiction"), ("tie.nq", "tie"), ("good.nq", "tie"),
    }
    graphs = lambda: {str(r.g)[-20:] for r in store.read_runs(spark, f"{base}/out").select("g").distinct().collect()}
    assert graphs() == {"2024-01-07T00:00:00Z"}
    # Later files against what is stored: dormancy of what has facts, a tie, and a run that comes again.
    faults.clear()
    (inbox / "rewrite.nq").write_text("\n".join([line(at(7)[0], f"{NS}dormantEndpoint", "<http://e.org/sparql>", at(7)[1]), done(7)]) + "\n")
    (inbox / "next.nq").write_text(text(8))
    load()
    assert faults == [("rewrite.nq", "rewritten history")] and graphs() == {"2024-01-07T00:00:00Z", "2024-01-08T00:00:00Z"}
    faults.clear()
    (inbox / "tie2.nq").write_text(text(7).replace("urn:obs:run:2024-01-07", "urn:obs:run:again-07"))
    load()
    assert faults == [("tie2.nq", "tie")]
    faults.clear()
    (inbox / "again.nq").write_text(text(7).replace('"42"', '"43"'))
    load()
    assert faults == [] and {r.o for r in store.read_runs(spark, f"{base}/out").where(f"g like '%07T00%' and p = '{NS}elapsedMs'").collect()} == {"43"}


def test_rebuild_refuses_ties(spark, archive):
    (archive / "c.nq").write_text(run().replace("urn:obs:run:2024-01-01", "urn:obs:run:other"))
    q = quads.read_quads(spark, str(archive))
    assert current.rebuild_current(q).count() == 1  # the tie is not for the newest run
    (archive / "d.nq").write_text(run("2024-01-02T00:00:00Z").replace("urn:obs:run:2024-01-02", "urn:obs:run:other2"))
    with pytest.raises(ValueError):
        current.rebuild_current(quads.read_quads(spark, str(archive)))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from tidegauge import session

    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        session.shared_dir(Fake)


def test_store_query_checks_every_run(spark, sf, monkeypatch):
    whole = archive_queries.archive(spark, sf).select("g").distinct()
    lost = whole.where("g like 'urn:run:2024-01-2%'").agg(F.min("g")).first()[0]
    monkeypatch.setattr(store, "write_runs", lambda rows, path, f=store.write_runs: f(rows.where(F.col("g") != lost), path))
    paths = []
    monkeypatch.setattr(store, "read_runs", lambda spark, path, f=store.read_runs: paths.append(path) or f(spark, path))
    assert {r.missing for r in archive_queries.q_store(spark, sf).collect()} == {1}
    assert spark.read.parquet(paths[0]).select("g").distinct().count() == whole.count() - 1
