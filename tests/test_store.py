"""The run store: all or nothing, files by size, gates by the catalogue, repair of current state, reaping."""

import re

import pytest
from pyspark.sql import functions as F

from tests.test_archive import NS, line, run
from tidegauge.operators import current, facts, gates
from tidegauge.sources import quads, store
from tidegauge.streaming import jobs

AT = lambda day: f"urn:obs:run:2024-01-{day:02d}T00:00:00Z"


def _rows(spark, n_runs=5, n=600):
    rows = spark.range(n_runs * n).select(
        F.format_string("urn:s:%d", "id").alias("s"), F.lit("iri").alias("s_kind"), F.lit("urn:p").alias("p"), F.col("id").cast("string").alias("o"), F.lit("literal").alias("o_kind"),
        F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"), F.format_string("urn:obs:run:%d", F.col("id") % n_runs).alias("g"),
    )
    return rows


def _files(path, gen=None):
    return [f for f in path.glob(f"gen={gen if gen is not None else '*'}/g=*/*.parquet")]


def test_files_of_a_run_follow_its_size(spark, tmp_path):
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        archive = store.RunStore(spark, str(tmp_path))
        archive.write(_rows(spark).repartition(6))
        assert len(_files(tmp_path)) == 5
        # A run larger than a partition should be is dealt over several tasks.
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
        archive.write(_rows(spark, 1, 4000).repartition(4))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    assert 2 <= len(_files(tmp_path, "000000001")) <= 40
    assert archive.read(["urn:obs:run:0"]).count() == 4000 and archive.read().count() == 4000 + 4 * 600


def test_a_failed_write_leaves_the_old_state(spark, tmp_path, monkeypatch):
    archive = store.RunStore(spark, str(tmp_path))
    archive.write(_rows(spark))
    before = sorted(map(tuple, archive.catalogue().drop("bloom").collect()))
    broken = _rows(spark, 2, 30).withColumn("o", F.when(F.col("s") == "urn:s:59", F.raise_error(F.lit("lost"))).otherwise(F.col("o")))
    with pytest.raises(Exception, match="lost"):
        archive.write(broken)
    with monkeypatch.context() as m:  # all data written, the catalogue not
        m.setattr(store.RunStore, "_described", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            archive.write(_rows(spark, 2, 30))
    assert sorted(map(tuple, archive.catalogue().drop("bloom").collect())) == before
    assert archive.read().count() == 3000 and archive.read(["urn:obs:run:0"]).count() == 600
    archive.write(_rows(spark, 2, 30))
    assert {r.run: r.quads for r in archive.catalogue().collect()} == {f"urn:obs:run:{k}": 30 if k < 2 else 600 for k in range(5)}
    assert archive.read().count() == 3 * 600 + 60 and {r.g: r["count"] for r in archive.read().groupBy("g").count().collect()}["urn:obs:run:1"] == 30


def test_digests_do_not_hang_on_order(spark, tmp_path):
    for k, rows in enumerate((_rows(spark), _rows(spark).repartition(7), _rows(spark).withColumn("o", F.when(F.col("s") == "urn:s:3", "x").otherwise(F.col("o"))))):
        store.RunStore(spark, f"{tmp_path}/{k}").write(rows)
    one, two, three = ({r.run: r.digest for r in store.RunStore(spark, f"{tmp_path}/{k}").catalogue().collect()} for k in range(3))
    assert one == two and {g for g in one if one[g] != three[g]} == {"urn:obs:run:3"}


def _parsed(spark, *texts):
    lines = [(f"f{k}", n, v) for k, text in enumerate(texts) for n, v in enumerate(text.split("\n"), 1)]
    return quads.parse_lines(spark.createDataFrame(lines, "src_file string, line_no long, value string"))


def test_gates_read_the_catalogue_and_the_partitions_they_touch(spark, tmp_path, monkeypatch):
    archive = store.RunStore(spark, str(tmp_path))
    archive.write(_parsed(spark, *(run(f"2024-01-{d:02d}T00:00:00Z") for d in range(1, 9))))
    read = []
    monkeypatch.setattr(store.RunStore, "read", lambda self, runs=None, own=store.RunStore.read: read.append((runs, own(self, runs))) or read[-1][1])
    act = lambda d: f"urn:obs:activity:2024-01-{d:02d}T00:00:00Z"
    dormant = lambda d, e: "\n".join([line(act(d), f"{NS}dormantEndpoint", f"<{e}>", AT(d)), line(act(d), f"{NS}dormantCount", '"1"', AT(d))])
    # New runs, and dormancy of what no stored run has facts of: nothing is opened.
    faults = jobs.load_faults(_parsed(spark, run("2024-01-20T00:00:00Z"), dormant(21, "http://e.org/sparql"), dormant(3, "http://other.org/sparql")), archive)
    assert faults.collect() == [] and read == []
    faults = jobs.load_faults(_parsed(spark, dormant(3, "http://e.org/sparql"), run("2024-01-05T00:00:00Z").replace("run:2024", "run:again-2024")), archive)
    assert {tuple(r) for r in faults.collect()} == {("f0", "rewritten history"), ("f1", "tie")}
    assert [runs for runs, _ in read] == [[AT(3)]]
    plan = read[0][1]._jdf.queryExecution().executedPlan().toString()
    wanted = plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert re.search(r"gen#\d+ = 0+\)", wanted) and re.search(rf"g#\d+ = {AT(3)[:20]}", wanted)


def test_the_filter_of_a_run_leaves_no_endpoint_out(spark, tmp_path):
    archive = store.RunStore(spark, str(tmp_path))
    rows = spark.range(700).select(
        F.format_string("urn:m:%d", "id").alias("s"), F.lit("iri").alias("s_kind"), F.lit("http://www.w3.org/ns/dqv#computedOn").alias("p"), F.format_string("http://e%d/", "id").alias("o"),
        F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"), F.lit("g").alias("g"),
    )
    archive.write(rows)
    asked = spark.range(1400).select(F.lit("g").alias("g"), F.format_string("http://e%d/", "id").alias("endpoint"))
    found = {int(r.endpoint[8:-1]) for r in archive.may_govern(asked).collect()}
    assert set(range(700)) <= found and len(found) < 850


def test_ingest_keeps_current_repaired(spark, tmp_path):
    inbox, base = tmp_path / "in", str(tmp_path)
    inbox.mkdir()
    declined = lambda day: run(f"2024-01-{day:02d}T00:00:00Z").replace("QualityMeasurement", "x").replace("dqv#computedOn", "dqv#not").replace('dqv#value> "verified"', 'dqv#no> "x"')
    load = lambda: jobs.ingest(jobs.archive_stream(spark, str(inbox)), f"{base}/out", f"{base}/log", current=f"{base}/current").awaitTermination()
    archive = store.RunStore(spark, f"{base}/out")
    newest = lambda: spark.read.parquet(f"{base}/current/gen={max(jobs._generations(spark, f'{base}/current')):09d}")
    steps = [("b.nq", run("2024-01-05T00:00:00Z")), ("a.nq", run("2024-01-03T00:00:00Z")), ("b2.nq", declined(5)), ("c.nq", run("2024-01-09T00:00:00Z"))]
    for k, (name, text) in enumerate(steps):
        (inbox / name).write_text(text)
        load()
        want = current.current_readings(facts.readings(archive.read()))
        assert sorted(map(repr, newest().select(*want.columns).collect())) == sorted(map(repr, want.collect()))
        assert newest().first().run == AT([5, 5, 3, 9][k])
    assert len(jobs._generations(spark, f"{base}/current")) == 2
    # The same text under another name is passed over; a failure between store and state is made good.
    (inbox / "c-again.nq").write_text(steps[-1][1])
    version = archive.version()
    load()
    assert archive.files().where("key like '%c-again.nq'").count() == 1 and archive.version() >= version
    archive.write(_parsed(spark, run("2024-01-11T00:00:00Z")))
    jobs.follow(archive, f"{base}/current")
    assert newest().first().run == AT(11)


def test_current_stream_follows_runs_that_come_again(spark, tmp_path):
    schema = "run string, run_at timestamp, endpoint string, metric string, kind string, verdict string, reason string"
    row = lambda day, kind, e="e": (f"r{day}", f"2024-01-{day:02d} 00:00:00", e, "m", kind, "absent" if kind == "measured" else None, None if kind == "measured" else "liveness-failed")
    parts = [[row(5, "measured"), row(5, "measured", "f")], [row(3, "measured")], [row(5, "declined")], [row(1, "declined", "f")]]
    held = {}
    for k, part in enumerate(parts):
        frame = spark.createDataFrame(part, schema.replace("timestamp", "string")).withColumn("run_at", F.to_timestamp("run_at"))
        frame.write.mode("append").parquet(f"{tmp_path}/in")
        jobs.current_stream(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/now", f"{tmp_path}/log").awaitTermination()
        held = {r: v for r, v in held.items() if r not in {p[0] for p in part}} | {p[0]: [q for q in part if q[0] == p[0]] for p in part}
        whole = spark.createDataFrame([q for v in held.values() for q in v], schema.replace("timestamp", "string")).withColumn("run_at", F.to_timestamp("run_at"))
        got = spark.read.parquet(f"{tmp_path}/now/gen={k:09d}")
        assert sorted(map(repr, got.select(*whole.columns).collect())) == sorted(map(repr, current.current_readings(whole).collect()))
    assert jobs._generations(spark, f"{tmp_path}/now") == [2, 3]


def test_reaping_spares_readers(spark, tmp_path):
    archive = store.RunStore(spark, f"{tmp_path}/runs")
    for n in (600, 500, 400):
        archive.write(_rows(spark, 2, n))
    reader = archive.read(["urn:obs:run:1"])
    assert archive.reap(keep=1, grace_s=3600) == 0 and reader.count() == 400
    assert archive.reap(keep=2, grace_s=0) > 0
    assert archive.read().count() == 800 and archive.catalogue(1).count() == 2 and not list((tmp_path / "runs").glob("gen=000000000/g=*/*.parquet"))
    path = f"{tmp_path}/published"
    for k in (1, 2, 3, 4):
        store.publish(spark.range(k), path, k)
    assert store.reap(spark, path, keep=2, grace_s=3600) == [] and store.reap(spark, path, keep=2, grace_s=0) == [1, 2]
    assert store.latest(spark, path).count() == 4 and spark.read.parquet(f"{path}/gen=000000003").count() == 3


def test_empty_stores_and_batches(spark, tmp_path):
    archive = store.RunStore(spark, str(tmp_path))
    assert archive.read().count() == 0 and archive.read(["x"]).count() == 0 and archive.version() == -1
    archive.write(_rows(spark, 1, 0))
    assert archive.version() == 0 and archive.catalogue().count() == 0
    archive.write(_rows(spark, 1, 3))
    assert archive.read().count() == 3 and gates.governed(archive.read()).count() == 0


def test_sketches_of_runs_are_the_sketch_of_the_whole(spark, tmp_path):
    from tidegauge.operators import rollup

    archive = store.RunStore(spark, str(tmp_path))
    archive.write(_rows(spark, 7, 300))
    whole = rollup.merged_statistics(rollup.run_sketches(archive.read().withColumn("g", F.lit("all")), "urn:p")).drop("graphs").first()
    parts = archive.statistics()
    assert parts.drop("graphs").first() == rollup.merged_statistics(rollup.run_sketches(archive.read(), "urn:rdf")).drop("graphs").first()
    exact = rollup.archive_statistics(archive.read(), "urn:rdf")
    assert "Expand" not in exact._jdf.queryExecution().executedPlan().toString()
    row = exact.first()
    assert (row.triples, row.subjects, row.predicates, row.graphs, row.current, row.newest) == (2100, 2100, 1, 7, 0, None)
    assert whole.subjects == parts.first().subjects and abs(whole.subjects - 2100) < 0.1 * 2100 and parts.first().graphs == 7
