"""Queries on tables that are larger or odder than the given ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidegauge.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def same_as_sql(spark, folder, name, *tables):
    """Whether a query over tables of a folder gives what its SQL gives."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(repr(tuple(r)) for r in found.fetchall())
    got = sorted(repr(tuple(r)) for r in QUERIES[name](spark, str(folder)).select(*names).collect())
    assert got == want and want


def test_narrow_keeps_every_entry_of_a_url(spark, tmp_path):
    """two pages of one URL, one active and one not, in either order, and two active ones."""
    rows = [(5, "http://a.org/en/1", ""), (6, "http://a.org/en/1", ""), (7, "http://b.org/en/2", ""), (10, "http://b.org/en/2", ""), (8, "http://c.org/en/3", ""), (9, "http://c.org/en/3", ""), (1, "http://d.org/fr", ""), (2, None, "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    same_as_sql(spark, tmp_path, "g7_narrow", "pages")


def test_archive_shuffles_the_events_once(spark, sf, monkeypatch):
    """A run file's lines come from one shuffle of the events, numbered without gaps."""
    from tidegauge.plans import archive_queries

    plans = []
    monkeypatch.setattr(archive_queries, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    rows = archive_queries.archive(spark, sf)
    assert plans[0].count("Exchange") == 1 and plans[0].count("FileScan") == 1
    files = rows.groupBy("src_file").agg(F.count("*").alias("n"), F.count_distinct("line_no").alias("lines"), F.min("line_no").alias("first"), F.max("line_no").alias("last"))
    assert files.where("n <> lines or first <> 1 or last <> n").isEmpty() and not files.isEmpty()


def test_lines_of_the_archive_are_compiled(spark, sf, monkeypatch):
    """no list of lines is made by interpreted functions, and no step's code is too long for the JVM to compile (8,000 bytes)."""
    from tidegauge.plans import archive_queries

    monkeypatch.setattr(archive_queries, "materialise", lambda df, name: df)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (archive_queries.archive(spark, sf), archive_queries.q_graph_faults(spark, sf), archive_queries.q_completions(spark, sf)):
            run = df._jdf.queryExecution()
            assert "lambda" not in run.optimizedPlan().toString()
            steps = run.debug().codegenToSeq()
            assert steps.size() > 3 and max(steps.apply(k)._3().maxMethodCodeSize() for k in range(steps.size())) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


@pytest.mark.parametrize("name", ["v3_graph_faults", "f9_completions"])
def test_an_archive_that_is_read_once_is_not_written(spark, sf, tmp_path, monkeypatch, name):
    """over twice the events, with pairs stated again in a run, as the SQL has it."""
    from tidegauge.plans import archive_queries

    events = spark.read.parquet(f"{sf}/events.parquet")
    more = events.withColumns({"event_id": F.col("event_id") + 10_000_000, "user_id": F.when(F.col("event_id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 10_000)})
    events.unionByName(more).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    written = []
    monkeypatch.setattr(archive_queries, "materialise", lambda df, name, own=archive_queries.materialise: written.append(name) or own(df, name))
    same_as_sql(spark, tmp_path, name, "events")
    assert not written


def test_documents_are_joined_once(spark, sf):
    """the lines of description documents come from one join of lineitem and orders."""
    from tidegauge.plans import archive_queries

    plan = archive_queries._documents(spark, sf)[0]._jdf.queryExecution().executedPlan().toString()
    assert sum(plan.count(j) for j in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin")) == 1


def test_a_line_is_matched_once(spark):
    """parsing applies its pattern once a line, and keeps what the parts said."""
    from tidegauge.sources import quads

    rows = [("f", 1, '<a> <b> "x\\"y"^^<d> <g> .'), ("f", 2, "\n\n\n"), ("f", 3, '_:b <p> "" .'), ("f", 4, '<a> <b> "' + "x" * 200_000 + '"@en <g> .'), ("f", 5, "<a> <b> _:o. x")]
    parsed = quads.parse_lines(spark.createDataFrame(rows, "src_file string, line_no long, value string"))
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 0 and plan.count("regexp_replace(value") == 1
    got = {r.line_no: r for r in parsed.collect()}
    assert (got[1].o, got[1].o_datatype, got[1].g) == ('x"y', "d", "g") and (got[3].o, got[3].s_kind, got[3].g) == ("", "blank", None)
    assert len(got[4].o) == 200_000 and got[4].o_lang == "en" and got[5].bad and got[2].bad and len(got) == 5


def test_ingest_has_packed_files_and_one_copy_of_the_lines(spark, sf, tmp_path, monkeypatch):
    """no archive is written before the run files, which are packed, nor the kept lines beside the parsed ones; the files go once they are loaded."""
    from pathlib import Path

    from tidegauge.plans import archive_queries, stream_queries
    from tidegauge.streaming import jobs

    written, packed, paths = {}, [], []
    monkeypatch.setattr(archive_queries, "materialise", lambda df, name: pytest.fail(f"{name} is written"))
    stream = jobs.archive_stream
    monkeypatch.setattr(stream_queries.jobs, "archive_stream", lambda spark, path, **k: paths.append(path) or stream(spark, path, **k))

    def counted(df, name, own=jobs.materialise):
        if not packed:
            packed.extend(Path(paths[0].removeprefix("file:").removesuffix("/*")).glob("*/part-*"))
        out = own(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(jobs, "materialise", counted)
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/events.parquet")
    same_as_sql(spark, tmp_path, "x1_ingest", "events")
    runs = events.select(F.date_trunc("hour", "ts")).distinct().count()
    assert written["incoming"] > 5000 and sum(written.values()) < 1.5 * written["incoming"]
    assert len(packed) == runs and all(p.suffix == ".gz" for p in packed) and not any(p.exists() for p in packed)


def test_tasks_of_the_archive_do_not_follow_the_size_of_events(spark, sf):
    """an event becomes a hundred times as many bytes of lines, so few small events are still dealt over many tasks."""
    from tidegauge.plans import archive_queries

    assert archive_queries.archive_lines(spark, sf).rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism


def test_ingest_refuses_every_file_of_a_graph_at_fault(spark, tmp_path):
    """the gates that read few predicates still find the files of a graph that hold none of them; lines may end in CR LF."""
    from tests.test_archive import NS, line, run
    from tidegauge.sources import store
    from tidegauge.streaming import jobs

    act, g = "urn:obs:activity:2024-01-02T00:00:00Z", "urn:obs:run:2024-01-02T00:00:00Z"
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "good.nq").write_bytes(run().replace("\n", "\r\n").encode())
    (inbox / "bad.nq").write_text(run("2024-01-02T00:00:00Z") + line(act, f"{NS}dormantEndpoint", "<http://e.org/sparql>", g) + "\n" + line(act, f"{NS}dormantCount", '"1"', g) + "\n")
    (inbox / "more.nq").write_text(line("urn:x", "urn:p", '"of the same graph"', g) + "\n")
    faults = []
    load = jobs.ingest(jobs.archive_stream(spark, str(inbox)), f"{tmp_path}/out", f"{tmp_path}/log", on_refused=lambda f: faults.extend((r.src_file.rsplit("/", 1)[1], r.fault) for r in f.collect()))
    load.awaitTermination()
    assert sorted(faults) == [("bad.nq", "contradiction"), ("more.nq", "contradiction")]
    stored = store.read_runs(spark, f"{tmp_path}/out")
    assert stored.count() == run().count(" .\n") and stored.where("contains(o, '\r') or g like '%02T00%'").isEmpty()


def test_ingest_holds_no_lines_of_a_whole_file(spark, tmp_path, monkeypatch):
    """lines are parsed as they are read, whatever a file is called and however it is cut; nothing is parsed where nothing is new."""
    import gzip

    from tests.test_archive import NS, run
    from tidegauge.sources import store
    from tidegauge.streaming import jobs

    inbox = tmp_path / "in {a} %20"
    inbox.mkdir()
    names = {1: "a[1].nq", 2: "b *?.nq", 3: "c%3A d.nq.gz", 4: "eé.nq"}
    for day, name in names.items():
        text = run(f"2024-01-{day:02d}T00:00:00Z").encode()
        (inbox / name).write_bytes(gzip.compress(text) if name.endswith("gz") else text)
    (inbox / "empty.nq").write_text("")
    plans = []
    monkeypatch.setattr(jobs, "parse_lines", lambda lines, own=jobs.parse_lines: plans.append(lines._jdf.queryExecution().optimizedPlan().toString()) or own(lines))
    stream = lambda log: jobs.ingest(jobs.archive_stream(spark, str(tmp_path / "in*")), f"{tmp_path}/out", f"{tmp_path}/{log}").awaitTermination()
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        stream("log")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert "split(" not in plans[0] and "Generate" not in plans[0]
    stored = store.RunStore(spark, f"{tmp_path}/out")
    assert stored.read().count() == sum(run().count(" .\n") for _ in names) and stored.read().where(f"p = '{NS}finalised'").count() == len(names)
    assert stored.files().count() == len(names)
    stream("another log")
    assert stored.read().count() == sum(run().count(" .\n") for _ in names) and stored.files().count() == len(names)
