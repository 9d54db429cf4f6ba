"""Streaming queries over the events table: read as a stream, run to its end, with SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.operators import rollup
from tidegauge.operators.planning import Thresholds
from tidegauge.plans.adapters import FLEET_SQL, READINGS_SQL, RUN_TEXT, fleet_readings, readings
from tidegauge.plans.archive_queries import archive_lines
from tidegauge.plans.state_queries import _text
from tidegauge.schemas import NAMESPACE as NS
from tidegauge.schemas import display_state
from tidegauge.session import remove, remove_at_end, shared_dir, ship
from tidegauge.sources import quads as nq
from tidegauge.sources import store
from tidegauge.streaming import jobs

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _deliveries(rows: DataFrame, order: str = "run_at", n: int = 3) -> list[DataFrame]:
    """The rows in ``n`` parts by a column."""
    key = F.unix_seconds(order)
    cuts = rows.agg(F.percentile_approx(key, [k / n for k in range(1, n)]).alias("c")).first()["c"] if n > 1 else []
    parts = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if low is None else rows.where(key > low)
        parts.append(part if high is None else part.where(key <= high))
    return parts


def _deliver(parts: list[DataFrame], start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Delivers parts one after another to a job that goes on from its checkpoint each time."""
    spark = parts[0].sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(path)
        start(spark.readStream.schema(parts[0].schema).parquet(path)).awaitTermination()


def _run(job: Callable[[DataFrame], DataFrame], parts: list[DataFrame], mode: str = "append") -> DataFrame:
    """Runs a stream over deliveries into a table of the shared folder."""
    spark = parts[0].sparkSession
    base = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    ship(spark)
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)

    def start(stream: DataFrame) -> StreamingQuery:
        out = job(stream).writeStream.option("checkpointLocation", f"{base}/log").trigger(availableNow=True)
        if mode == "append":
            return out.format("parquet").option("path", f"{base}/out").start()
        return out.foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.parquet(f"{base}/out/batch-{n:06d}")).outputMode(mode).start()

    try:
        _deliver(parts, start)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    path = f"{base}/out" if mode == "append" else f"{base}/out/batch-*"
    return spark.read.parquet(path)


def q_daily_stream(spark, sf):
    return _text(_run(jobs.daily_stream, _deliveries(fleet_readings(spark, sf))), "day")


def q_dedupe_stream(spark, sf):
    r = readings(spark, sf)
    twice = r.unionByName(r.where("endpoint like '%3'"))
    out = _run(jobs.dedupe_stream, [twice])
    return out.groupBy("metric", "kind").agg(F.count("*").alias("n"))


def q_strikes_stream(spark, sf):
    r = fleet_readings(spark, sf).where("kind = 'measured'")
    o = rollup.sweep_outcomes(r, r, "m0").join(r.select("run", "run_at").distinct(), "run")
    o = o.select(F.col("endpoint").alias("url"), F.col("run_at").alias("at"), "cost_ms", "positive", "liveness_failed")
    states = _run(lambda s: jobs.strikes_stream(s, Thresholds(strikes=2, cost_ms=20_000)), _deliveries(o, "at"), "update")
    last = states.groupBy("url").agg(F.max_by(F.struct("strikes", "last_probed"), "last_probed").alias("s"))
    return last.select("url", "s.strikes", F.date_format("s.last_probed", "yyyy-MM-dd HH:mm:ss").alias("last_probed"))


def q_transition_stream(spark, sf):
    r = fleet_readings(spark, sf).select("endpoint", "metric", "run_at", display_state(F.col("kind"), F.col("verdict")).alias("state"))
    return _text(_run(jobs.transition_stream, _deliveries(r)), "run_at")


def q_current_stream(spark, sf):
    """Late runs, and a day's runs that came with another text first; the result must be the rebuild.

    The first text of the day had measured what it really declined, under an endpoint more.
    """
    r = readings(spark, sf)
    day, extra = F.to_date("run_at") == "2024-01-20", F.lit(None).cast("string")
    wrong = r.where(day).withColumns({"kind": F.lit("measured"), "verdict": F.lit("absent"), "reason": extra})
    wrong = wrong.unionByName(wrong.withColumn("endpoint", F.concat("endpoint", F.lit("-gone"))))
    late = F.to_date("run_at") < "2024-01-10"
    base = f"{shared_dir(spark)}/current-{uuid.uuid4().hex}"
    parts = [r.where(~day & ~late).unionByName(wrong), r.where(day), r.where(late)]
    _deliver(parts, lambda stream: jobs.current_stream(stream, base, f"{base}-log"))
    out = spark.read.option("basePath", base).parquet(f"{base}/gen=*")
    newest = out.agg(F.max("gen").alias("g"))
    return out.join(F.broadcast(newest), F.col("gen") == F.col("g")).groupBy("kind", "verdict", "reason").agg(F.count("*").alias("n"))


def q_ingest(spark, sf):
    """The archive as run files, loaded with all gates; runs that contradict themselves (V4) are refused."""
    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    # A packed file for each run, as a sweep leaves it. Its lines are made in one task, which sorts them: none is shuffled, and nothing but the files is written.
    lines = archive_lines(spark, sf).select(F.translate("src_file", ":", "_").alias("name"), "line_no", nq.to_line().alias("value"))
    lines.sortWithinPartitions("name", "line_no").select("name", "value").write.partitionBy("name").option("compression", "gzip").text(f"{base}/runs")
    remove_at_end(spark, base)
    faults = f"{base}/refused"
    stream = jobs.archive_stream(spark, f"{base}/runs/*", files_per_trigger=10_000)
    jobs.ingest(stream, f"{base}/store", f"{base}/log", on_refused=lambda f: f.write.mode("append").parquet(faults)).awaitTermination()
    remove(spark, f"{base}/runs")  # all loaded or refused
    loaded = store.read_runs(spark, f"{base}/store").groupBy(F.col("g").cast("string").alias("run")).agg(F.count_if(F.col("p") == f"{NS}completedEndpoint").alias("endpoints"))
    refused = spark.read.parquet(faults).where("fault = 'contradiction'").agg(F.count("*").alias("refused"))
    return loaded.crossJoin(refused)  # one row


def q_summary_gaps(spark, sf):
    """Closed days that a stream of the first three weeks has not summarised."""
    r = fleet_readings(spark, sf)
    summary = _run(jobs.daily_stream, _deliveries(r.where("run_at < '2024-01-22'")))
    return _text(jobs.summary_gaps(rollup.closed_days(r.where("kind = 'measured'")), summary), "day")


def q_staleness(spark, sf):
    r = readings(spark, sf)
    out = jobs.staleness(r.select("run", "run_at").distinct(), F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return out.select(F.date_format("newest", RUN_TEXT).alias("newest"), "age_s", "stale")


_O = f"""{FLEET_SQL}, o AS (SELECT run_at, endpoint, sum(coalesce(elapsed_ms, 0)) AS cost, bool_or(verdict IN ('verified', 'undeclared-but-verified')) AS pos, bool_or(metric = 'm0' AND verdict NOT IN ('verified', 'undeclared-but-verified')) AS lf FROM readings WHERE kind = 'measured' GROUP BY 1, 2),
x AS (SELECT *, NOT pos AND (cost > 20000 OR lf) AS struck, max(CASE WHEN pos OR NOT (cost > 20000 OR lf) THEN run_at END) OVER (PARTITION BY endpoint) AS cleared FROM o)"""

QUERIES = {
    "x2_daily_stream": (
        q_daily_stream,
        f"""{FLEET_SQL}, m AS (SELECT max(run_at) - INTERVAL 3 DAY AS mark FROM readings WHERE kind = 'measured')
SELECT CAST(CAST(run_at AS DATE) AS VARCHAR) AS day, endpoint, metric, verdict, count(*) AS n FROM readings, m WHERE kind = 'measured' AND date_trunc('day', run_at) + INTERVAL 1 DAY <= mark GROUP BY ALL""",
    ),
    "x6_dedupe_stream": (q_dedupe_stream, f"{FLEET_SQL.replace('(user_id % 10)', 'user_id')} SELECT metric, kind, count(*) AS n FROM readings GROUP BY 1, 2"),
    "x4_strikes_stream": (
        q_strikes_stream,
        f"{_O} SELECT endpoint AS url, CAST(count(*) FILTER (WHERE struck AND (cleared IS NULL OR run_at > cleared)) AS INT) AS strikes, strftime(max(run_at), '%Y-%m-%d %H:%M:%S') AS last_probed FROM x GROUP BY 1",
    ),
    "x5_transition_stream": (
        q_transition_stream,
        f"""{FLEET_SQL}, s AS (SELECT endpoint, metric, run_at, CASE WHEN kind = 'declined' THEN 'not-measured' ELSE verdict END AS now FROM readings), l AS (SELECT *, lag(now) OVER (PARTITION BY endpoint, metric ORDER BY run_at) AS was FROM s)
SELECT endpoint, metric, strftime(run_at, '%Y-%m-%d %H:%M:%S') AS run_at, was, now FROM l WHERE was IS NULL OR was <> now""",
    ),
    "x1_current_stream": (
        q_current_stream,
        f"""{FLEET_SQL.replace("(user_id % 10)", "user_id")}, c AS (SELECT *, row_number() OVER (PARTITION BY endpoint, metric ORDER BY kind = 'measured' DESC, coalesce(reason, '') NOT IN ('cadence', 'cost-ceiling') DESC, run_at DESC) AS k FROM readings)
SELECT kind, verdict, reason, count(*) AS n FROM c WHERE k = 1 GROUP BY ALL""",
    ),
    "x1_ingest": (
        q_ingest,
        f"""{READINGS_SQL}, bad AS (SELECT DISTINCT run FROM readings WHERE metric = 'm0' AND verdict = 'absent')
SELECT run, count(DISTINCT endpoint) AS endpoints, (SELECT count(*) FROM bad) AS refused FROM readings WHERE run NOT IN (SELECT run FROM bad) GROUP BY 1""",
    ),
    "x3_summary_gaps": (
        q_summary_gaps,
        f"""{FLEET_SQL}, m AS (SELECT max(run_at) - INTERVAL 3 DAY AS mark FROM readings WHERE kind = 'measured' AND run_at < '2024-01-22'),
d AS (SELECT DISTINCT CAST(run_at AS DATE) AS day FROM readings WHERE kind = 'measured'), c AS (SELECT day FROM (SELECT day, row_number() OVER (ORDER BY day DESC) AS k FROM d) WHERE k > 3)
SELECT CAST(day AS VARCHAR) AS day FROM c, m WHERE day + INTERVAL 1 DAY > mark""",
    ),
    "x7_staleness": (q_staleness, f"{FLEET_SQL} SELECT strftime(max(run_at), '%Y-%m-%dT%H:%M:%SZ') AS newest, CAST(epoch(TIMESTAMP '2024-02-01 00:00:00' - max(run_at)) AS BIGINT) AS age_s, epoch(TIMESTAMP '2024-02-01 00:00:00' - max(run_at)) > 7200 AS stale FROM readings"),
}
