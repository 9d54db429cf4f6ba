"""Queries of current state, roll-ups and readers over the events table, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import current, gates, readers, rollup
from tidegauge.plans.adapters import CURRENT_SQL, FLEET_SQL, READINGS_SQL, fleet_readings, raw_readings, readings

_AT = "yyyy-MM-dd HH:mm:ss"


def _text(df: DataFrame, *names: str) -> DataFrame:
    """Instants and days as text."""
    kinds = dict(df.dtypes)
    return df.withColumns({n: F.date_format(n, _AT) if kinds[n].startswith("timestamp") else F.col(n).cast("string") for n in names})


def _current(spark: SparkSession, sf: str) -> DataFrame:
    return current.current_readings(readings(spark, sf))


def _runs(r: DataFrame) -> DataFrame:
    """The run dimension of the adapter: finalised unless the hour is 23."""
    return r.select("run", "run_at").distinct().withColumns({"emission": F.lit("1"), "finalised": F.hour("run_at") != 23})


_RUNS_SQL = "runs AS (SELECT DISTINCT run, run_at, extract(hour FROM run_at) <> 23 AS finalised FROM readings)"
_S = "strftime({}, '%Y-%m-%d %H:%M:%S') AS {}"


def _s(name: str, source: str = "") -> str:
    return _S.format(source or name, name)


def q_current_run(spark, sf):
    return _text(current.current_run(readings(spark, sf)), "run_at")


def q_newest_measured(spark, sf):
    return _text(current.newest_measured(readings(spark, sf)).select("endpoint", "metric", "run", "run_at", "verdict", "elapsed_ms"), "run_at")


def q_newest_decline(spark, sf):
    return _text(current.newest_decline(readings(spark, sf)).select("endpoint", "metric", "run", "run_at", "reason"), "run_at")


def q_current_readings(spark, sf):
    return _text(_current(spark, sf).select("endpoint", "metric", "run", "run_at", "kind", "verdict", "reason", "elapsed_ms"), "run_at")


def q_sample_pointers(spark, sf):
    return _text(current.sample_pointers(readings(spark, sf).where("observed_count > 500")), "run_at")


def q_document_pointers(spark, sf):
    docs = readings(spark, sf).where("kind = 'measured'").withColumn("doc_kind", F.when(F.col("verdict") == "verified", "void").otherwise("description"))
    return _text(current.document_pointers(docs), "run_at")


def q_latest_declarations(spark, sf):
    r = readings(spark, sf)
    declared = r.where("kind = 'measured'").groupBy("endpoint", "run", "run_at").agg(F.bool_or(F.col("verdict") == "verified").alias("read"), F.count("*").alias("classes"))
    return _text(current.latest_declarations(r, declared).select("endpoint", "run", "run_at", "read", "classes"), "run_at")


def q_merge_current(spark, sf):
    """History and delta in two steps; the result must be the rebuild."""
    r = readings(spark, sf)
    old, new = r.where("run_at >= '2024-01-15'"), r.where("run_at < '2024-01-15'")  # a late delta
    merged = current.merge_current(current.current_readings(old), new)
    return _text(merged.select("endpoint", "metric", "run", "run_at", "kind", "verdict", "reason", "elapsed_ms"), "run_at")


def q_reloaded_run(spark, sf):
    """A day's runs were loaded with a wrong text and are loaded again; the result must be the rebuild."""
    r = readings(spark, sf)
    day = F.to_date("run_at") == "2024-01-20"
    wrong = r.withColumn("verdict", F.when(day & (F.col("kind") == "measured"), "zzz").otherwise(F.col("verdict"))).withColumn("elapsed_ms", F.when(day, F.lit(10**9)).otherwise(F.col("elapsed_ms")))
    merged = current.merge_current(current.current_readings(wrong), r.where(day))
    return _text(merged.select("endpoint", "metric", "run", "run_at", "kind", "verdict", "reason", "elapsed_ms"), "run_at")


def q_check_current(spark, sf):
    r = readings(spark, sf)
    stale = current.current_readings(r.where("run_at < '2024-01-25'"))
    return current.check_current(stale, current.current_readings(r)).select("endpoint", F.array_join("reasons", ",").alias("reasons"), "pairs")


def q_kept_newer(spark, sf):
    r = readings(spark, sf)
    late = current.kept_newer(current.current_readings(r.where("run_at >= '2024-01-10'")), r.where("run_at < '2024-01-10'"))
    return _text(late, "current_at", "delta_at")


def q_newest_sample(spark, sf):
    samples = readings(spark, sf).where("observed_count is not null").select("endpoint", "metric", "run", "run_at", "observed_count")
    return _text(current.newest_sample(samples, "m1"), "run_at")


def q_prune_plan(spark, sf):
    r = readings(spark, sf)
    runs = r.groupBy("run", F.to_date("run_at").alias("day")).agg(F.count("*").alias("quads"))
    pinned = _current(spark, sf).select("run").distinct()
    return _text(current.prune_plan(runs, pinned, r.select(F.to_date("run_at").alias("day")).where("day <> '2024-01-05'")), "day")


def q_ties(spark, sf):
    """Runs of two sources that share an instant: the hour's first and second half."""
    raw = raw_readings(spark, sf).withColumn("run", F.concat("run", F.lit("/"), F.col("event_id") % 2))
    return _text(current.ties(raw, ["endpoint"]), "run_at")


def q_conflicts(spark, sf):
    raw = raw_readings(spark, sf)
    return gates.conflicting(raw, ["run", "endpoint", "metric"], ["kind", "verdict", "reason", "elapsed_ms"]).groupBy("endpoint").agg(F.count("*").alias("dropped"))


def q_settled(spark, sf):
    raw = raw_readings(spark, sf)
    kept = gates.without_conflicts(raw.drop("event_id"), ["run", "endpoint", "metric"], ["kind", "verdict", "reason", "elapsed_ms"])
    return kept.groupBy("metric", "kind").agg(F.count("*").alias("kept"))


def q_daily(spark, sf):
    d = rollup.daily(fleet_readings(spark, sf))
    return _text(d.withColumn("verdicts", rollup.verdict_text(F.col("verdicts"))), "day")


def q_verify_summary(spark, sf):
    r = fleet_readings(spark, sf)
    stored = rollup.daily(r.where("elapsed_ms is null or elapsed_ms % 97 <> 0"))
    return _text(rollup.verify_summary(stored, r), "day")


def q_closed_days(spark, sf):
    return _text(rollup.closed_days(readings(spark, sf)), "day")


def q_endpoint_days(spark, sf):
    d = rollup.endpoint_days(rollup.daily(fleet_readings(spark, sf)), "urn:user:3", "m1")
    return _text(d.withColumn("verdicts", rollup.verdict_text(F.col("verdicts"))), "day")


def q_uptime(spark, sf):
    return _text(rollup.uptime(fleet_readings(spark, sf)), "day")


def q_uptime_summary(spark, sf):
    return _text(rollup.uptime_of_summary(rollup.daily(fleet_readings(spark, sf))), "day")


def q_calendar(spark, sf):
    r = readings(spark, sf)
    series = rollup.calendar_series(rollup.uptime(r), rollup.uptime_of_summary(rollup.daily(r.where("run_at < '2024-01-12'"))), days=30)
    return _text(series.select("endpoint", "metric", "day", "uptime", "answered", "probes"), "day")


def q_fleet_stats(spark, sf):
    return _text(rollup.fleet_stats(readings(spark, sf), "m0", "m1"), "first", "last")


def q_changed(spark, sf):
    return rollup.changed_pairs(readings(spark, sf))


def q_changed_whole(spark, sf):
    return rollup.changed_pairs(readings(spark, sf), whole=True)


def q_transitions(spark, sf):
    return _text(rollup.transitions(fleet_readings(spark, sf)), "run_at")


def q_state_matrix(spark, sf):
    return rollup.state_matrix(_current(spark, sf))


def q_state_facets(spark, sf):
    return rollup.state_facets(_current(spark, sf))


def q_legend(spark, sf):
    return rollup.legend(_current(spark, sf))


def q_availability(spark, sf):
    c = _current(spark, sf)
    dormant = c.where("kind = 'declined' and reason = 'liveness-failed'").select("endpoint").distinct()
    inactive = c.select("endpoint").distinct().where(F.col("endpoint").endswith("7"))
    return rollup.availability(c, dormant, inactive, "m0").groupBy("availability").agg(F.count("*").alias("endpoints"))


def q_row_size(spark, sf):
    return rollup.row_size(_current(spark, sf), ("m0", "m1"))


def q_day_volume(spark, sf):
    return _text(rollup.day_volume(fleet_readings(spark, sf)), "day")


def q_cost_distribution(spark, sf):
    return rollup.cost_distribution(readings(spark, sf), F.col("metric"))


def q_sweep_outcomes(spark, sf):
    r = readings(spark, sf)
    return rollup.sweep_outcomes(r.where("kind = 'measured'"), r, "m0")


def q_stretches(spark, sf):
    return _text(rollup.stretches(rollup.daily(readings(spark, sf))), "first", "last")


def q_agreement(spark, sf):
    from tidegauge.session import table

    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    return rollup.agreement(labels.select("doc_id", "quality"), docs.select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("long")), "doc_id", "quality", "long")


def q_index(spark, sf):
    r = readings(spark, sf)
    rows = readers.index(current.current_readings(r), current.current_run(r), _runs(r))
    return _text(rows.select("endpoint", "metric", "kind", "verdict", "own_run", "own_at", "measured_at", "newest_run"), "own_at", "measured_at")


def q_endpoint_measurements(spark, sf):
    r = readings(spark, sf)
    rows = readers.index(current.current_readings(r), current.current_run(r), _runs(r))
    return readers.endpoint_measurements(rows, "urn:user:42").select("endpoint", "metric", "verdict", "reason", "own_run", "reading_run")


def q_run_status(spark, sf):
    """R3 over two archives: all runs (the newest lacks its end), and those that have theirs (the newest is whole).

    Runs before the 3rd do not say how they are written. A run completes the
    endpoints it measured; the newest declares every fifth user dormant whom it did not.
    """
    every, out = readings(spark, sf), None
    for name, r in (("all", every), ("ended", every.where("hour(run_at) <> 23"))):
        runs = _runs(r).withColumn("emission", F.when(F.dayofmonth("run_at") >= 3, "1"))
        done = r.where("kind = 'measured'").select("run", "endpoint").distinct()
        newest = runs.agg(F.max_by("run", F.struct("run_at", "run")).alias("run"))  # one row: dormancy is asked of the newest run alone
        dormant = r.select("endpoint").distinct().where("substr(endpoint, -1) in ('0', '5')").crossJoin(F.broadcast(newest))
        dormant = dormant.join(r.select("run", "endpoint").distinct(), ["run", "endpoint"], "left_anti")
        rows = readers.run_status(readers.index(current.current_readings(r), current.current_run(r), runs), done, dormant).withColumn("archive", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.select("archive", "endpoint", "metric", "unfinished", "not_reached", "newest_recorded_nothing", "declined_to_ask", "older_than_header")


def q_endpoint_content(spark, sf):
    samples = readings(spark, sf).where("observed_count > 500").select("endpoint", "metric", "run", "run_at", "observed_count")
    return readers.endpoint_content(samples, current.sample_pointers(samples)).drop("run_at")


def q_history(spark, sf):
    h = readers.history(fleet_readings(spark, sf), 48)
    one = lambda c: F.array_join(F.transform(c, lambda v: F.coalesce(v.cast("string"), F.lit("-"))), ",")
    return h.select("endpoint", "metric", one(F.col("verdicts")).alias("verdicts"), one(F.col("elapsed")).alias("elapsed"))


def q_fleet_grid(spark, sf):
    h = readers.history(readings(spark, sf).where("metric = 'm0'"), 100, ["endpoint"])
    return h.select("endpoint", F.array_join(F.transform("verdicts", lambda v: F.coalesce(v, F.lit("-"))), ",").alias("verdicts"))


def _triples(spark, sf):
    r = readings(spark, sf)
    return readers.describe_readings(readers.index(current.current_readings(r), current.current_run(r), _runs(r)), "urn:v:")


def q_describe(spark, sf):
    return _triples(spark, sf)


def q_narrow(spark, sf):
    c = _current(spark, sf).select("endpoint").distinct()
    kept = readers.narrow_triples(_triples(spark, sf), c, c.where(F.col("endpoint").endswith("1")), ("urn:v:computedOn", "urn:v:notMeasuredOn"))
    return kept.groupBy("p").agg(F.count("*").alias("n"))


def q_text_filter(spark, sf):
    from tidegauge.session import table

    return table(spark, sf, "pages").where(readers.text_matches("  EN/ ", F.col("url"))).select("page_id", "url")


def q_facet_filter(spark, sf):
    c = _current(spark, sf)
    states = rollup.availability(c, c.limit(0).select("endpoint"), c.limit(0).select("endpoint"), "m0")
    kept = readers.facet_filter(c, states, "available").withColumn("facet", F.lit("available"))
    return kept.unionByName(readers.facet_filter(c, states, "m1").withColumn("facet", F.lit("m1"))).unionByName(readers.facet_filter(c, states, "none-such").withColumn("facet", F.lit("x")))


def _top(order: str, where: str, columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY endpoint, metric ORDER BY {order}) AS k FROM readings WHERE {where}) WHERE k = 1"


_POS = "verdict IN ('verified', 'undeclared-but-verified')"
_DAILY_SQL = f"""counts AS (SELECT CAST(run_at AS DATE) AS day, endpoint, metric, verdict, count(*) AS n FROM {{source}} WHERE kind = 'measured' GROUP BY ALL),
timed AS (SELECT CAST(run_at AS DATE) AS day, endpoint, metric, list_sort(list(elapsed_ms) FILTER (WHERE {_POS})) AS ms, count(*) AS sweeps FROM {{source}} WHERE kind = 'measured' GROUP BY ALL),
per_day AS (SELECT day, endpoint, metric, string_agg(verdict || '=' || n, ',' ORDER BY verdict) AS verdicts FROM counts GROUP BY ALL),
daily AS (SELECT day, endpoint, metric, sweeps, verdicts, ms,
  CASE WHEN len(ms) > 0 THEN ms[least(greatest(CAST(round_even(0.5 * len(ms) + 0.5, 0) AS INT), 1), len(ms))] END AS median_ms,
  CASE WHEN len(ms) > 0 THEN ms[least(greatest(CAST(round_even(0.95 * len(ms) + 0.5, 0) AS INT), 1), len(ms))] END AS p95_ms
  FROM timed JOIN per_day USING (day, endpoint, metric))"""
_UPTIME_SQL = f"""uptime AS (SELECT CAST(run_at AS DATE) AS day, endpoint, metric, count(*) AS probes, count(*) FILTER (WHERE verdict <> 'indeterminate') AS answered,
  count(*) FILTER (WHERE {_POS}) AS up, list_sort(list(elapsed_ms) FILTER (WHERE {_POS})) AS ms FROM readings WHERE kind = 'measured' GROUP BY ALL)"""
_RATE = "round_even(100.0::DOUBLE * up / CASE WHEN answered > 0 THEN answered ELSE probes END, 1)"
_INDEX_SQL = f"""{READINGS_SQL}, {CURRENT_SQL}, {_RUNS_SQL},
pointers AS (SELECT endpoint, max(run_at) AS own_at FROM readings GROUP BY 1),
top AS (SELECT run AS newest_run, run_at AS newest_at, finalised AS newest_finalised FROM runs ORDER BY run_at DESC LIMIT 1),
idx AS (SELECT c.endpoint, c.metric, c.kind, c.verdict, c.reason, o.run AS own_run, o.run_at AS own_at, o.finalised AS own_finalised, c.run AS reading_run, m.run_at AS measured_at, top.*
  FROM current_readings c JOIN pointers p USING (endpoint) JOIN runs o ON o.run_at = p.own_at LEFT JOIN runs m ON m.run = c.run CROSS JOIN top)"""
def _status_sql() -> str:
    """One part for each archive; the newest run is the one of the latest instant."""
    parts = []
    for name, where in (("all", "true"), ("ended", "extract(hour FROM run_at) <> 23")):
        parts.append(f"""SELECT '{name}' AS archive, c.endpoint, c.metric, o.day >= 3 AND NOT o.finalised AS unfinished,
  n.run <> o.run AND n.day >= 3 AND NOT n.finalised AND NOT done AND NOT dorm AS not_reached, n.run <> o.run AND n.finalised AND NOT done AS newest_recorded_nothing,
  n.run <> o.run AND dorm AS declined_to_ask, c.run_at < o.run_at AS older_than_header
FROM (SELECT endpoint, metric, run_at, row_number() OVER (PARTITION BY endpoint, metric ORDER BY kind = 'measured' DESC, coalesce(reason, '') NOT IN ('cadence', 'cost-ceiling') DESC, run_at DESC) AS k FROM readings WHERE {where}) c
JOIN (SELECT endpoint, max(run_at) AS run_at FROM readings WHERE {where} GROUP BY 1) p ON p.endpoint = c.endpoint
JOIN rs o ON o.run_at = p.run_at JOIN rs n ON n.run_at = (SELECT max(run_at) FROM readings WHERE {where})
JOIN (SELECT e.endpoint, bool_or(coalesce(x.kind = 'measured', false)) AS done, e.endpoint[-1] IN ('0', '5') AND count(x.run) = 0 AS dorm FROM (SELECT DISTINCT endpoint FROM readings WHERE {where}) e
  LEFT JOIN (SELECT * FROM readings WHERE run_at = (SELECT max(run_at) FROM readings WHERE {where})) x ON x.endpoint = e.endpoint GROUP BY 1) d ON d.endpoint = c.endpoint
WHERE c.k = 1""")
    return f"{READINGS_SQL}, rs AS (SELECT DISTINCT run, run_at, extract(day FROM run_at) AS day, extract(hour FROM run_at) <> 23 AS finalised FROM readings) " + " UNION ALL ".join(parts)


_STATUS_SQL = _status_sql()
_STATE = "CASE WHEN kind = 'declined' THEN 'not-measured' ELSE verdict END"
_STATES = "(VALUES ('verified'), ('undeclared-but-verified'), ('declared-only'), ('absent'), ('declared-but-wrong'), ('indeterminate'), ('not-measured')) s(state)"
_MATRIX_SQL = f"""{READINGS_SQL}, {CURRENT_SQL}, cells AS (SELECT metric, {_STATE} AS state, count(*) AS cells FROM current_readings GROUP BY ALL),
matrix AS (SELECT m.metric, s.state, coalesce(c.cells, 0) AS cells FROM (SELECT DISTINCT metric FROM current_readings) m CROSS JOIN {_STATES} LEFT JOIN cells c ON c.metric = m.metric AND c.state = s.state)"""
_TRIPLES_SQL = f"""{_INDEX_SQL}, triples AS (
  SELECT 'urn:v:reading:' || sha256(endpoint || chr(1) || metric) AS s, 'urn:v:' || unnest(['computedOn', 'isMeasurementOf', 'value']) AS p, unnest([endpoint, metric, verdict]) AS o FROM idx WHERE kind = 'measured'
  UNION SELECT 'urn:v:reading:' || sha256(endpoint || chr(1) || metric), 'urn:v:' || unnest(['notMeasuredOn', 'notMeasuredMetric', 'notMeasuredReason']), unnest([endpoint, metric, reason]) FROM idx WHERE kind = 'declined'
  UNION SELECT own_run, 'urn:v:generatedAtTime', strftime(own_at, '%Y-%m-%dT%H:%M:%SZ') FROM idx
  UNION SELECT reading_run, 'urn:v:generatedAtTime', strftime(measured_at, '%Y-%m-%dT%H:%M:%SZ') FROM idx WHERE measured_at IS NOT NULL)"""


def _history_sql(keys: str, n: int, source: str, where: str) -> str:
    on = " AND ".join(f"r.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    return f"""{source}, src AS (SELECT * FROM readings {where}), spine AS (SELECT DISTINCT run, run_at FROM src ORDER BY run_at DESC LIMIT {n}),
pairs AS (SELECT DISTINCT {keys} FROM src JOIN spine USING (run)),
grid AS (SELECT {", ".join("p." + k.strip() for k in keys.split(","))}, s.run_at, r.verdict, r.kind, r.elapsed_ms FROM pairs p CROSS JOIN spine s LEFT JOIN src r ON r.run = s.run AND {on})"""


QUERIES = {
    "c1_current_run": (q_current_run, f"{READINGS_SQL} SELECT endpoint, arg_max(run, run_at) AS run, strftime(max(run_at), '%Y-%m-%d %H:%M:%S') AS run_at FROM readings GROUP BY 1"),
    "c2_newest_measured": (q_newest_measured, READINGS_SQL + " " + _top("run_at DESC", "kind = 'measured'", f"endpoint, metric, run, {_s('run_at')}, verdict, elapsed_ms")),
    "c3_newest_decline": (
        q_newest_decline,
        READINGS_SQL + " " + _top("reason IN ('cadence', 'cost-ceiling'), run_at DESC", "kind = 'declined'", f"endpoint, metric, run, {_s('run_at')}, reason"),
    ),
    "c4_current_readings": (
        q_current_readings,
        f"""{READINGS_SQL}, m AS ({_top("run_at DESC", "kind = 'measured'", "*")}), d AS ({_top("reason IN ('cadence', 'cost-ceiling'), run_at DESC", "kind = 'declined'", "*")})
SELECT endpoint, metric, run, {_s("run_at")}, kind, verdict, reason, elapsed_ms FROM (SELECT * FROM m UNION ALL SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.endpoint = d.endpoint AND m.metric = d.metric))""",
    ),
    "c5_sample_pointers": (q_sample_pointers, f"{READINGS_SQL} SELECT endpoint, metric, arg_max(run, run_at) AS run, strftime(max(run_at), '%Y-%m-%d %H:%M:%S') AS run_at FROM readings WHERE observed_count > 500 GROUP BY 1, 2"),
    "c6_document_pointers": (
        q_document_pointers,
        f"{READINGS_SQL} SELECT endpoint, CASE WHEN verdict = 'verified' THEN 'void' ELSE 'description' END AS doc_kind, arg_max(run, run_at) AS run, strftime(max(run_at), '%Y-%m-%d %H:%M:%S') AS run_at FROM readings WHERE kind = 'measured' GROUP BY 1, 2",
    ),
    "c7_latest_declarations": (
        q_latest_declarations,
        f"""{READINGS_SQL}, p AS (SELECT endpoint, arg_max(run, run_at) AS run, max(run_at) AS run_at FROM readings GROUP BY 1),
d AS (SELECT endpoint, run, bool_or(verdict = 'verified') AS read, count(*) AS classes FROM readings WHERE kind = 'measured' GROUP BY 1, 2)
SELECT endpoint, run, {_s("run_at")}, read, classes FROM p LEFT JOIN d USING (endpoint, run)""",
    ),
    "c9_merge_current": (q_merge_current, f"{READINGS_SQL}, {CURRENT_SQL} SELECT endpoint, metric, run, {_s('run_at')}, kind, verdict, reason, elapsed_ms FROM current_readings"),
    "c9_reloaded_run": (q_reloaded_run, f"{READINGS_SQL}, {CURRENT_SQL} SELECT endpoint, metric, run, {_s('run_at')}, kind, verdict, reason, elapsed_ms FROM current_readings"),
    "c10_check_current": (
        q_check_current,
        f"""{READINGS_SQL}, {CURRENT_SQL}, old_readings AS (SELECT * FROM readings WHERE run_at < '2024-01-25'), stored AS ({CURRENT_SQL.removeprefix("current_readings AS (").removesuffix(")").replace("FROM readings", "FROM old_readings")})
SELECT endpoint, string_agg(DISTINCT reason2, ',' ORDER BY reason2) AS reasons, count(*) AS pairs FROM (
  SELECT coalesce(s.endpoint, f.endpoint) AS endpoint, CASE WHEN s.endpoint IS NULL THEN 'missing' ELSE 'differs' END AS reason2 FROM current_readings f LEFT JOIN stored s ON s.endpoint = f.endpoint AND s.metric = f.metric
  WHERE s.endpoint IS NULL OR s.run <> f.run) GROUP BY 1""",
    ),
    "c11_kept_newer": (
        q_kept_newer,
        f"""{READINGS_SQL}, fresh AS (SELECT * FROM readings WHERE run_at >= '2024-01-10'), cur AS ({CURRENT_SQL.removeprefix("current_readings AS (").removesuffix(")").replace("FROM readings", "FROM fresh")}),
late AS (SELECT endpoint, metric, max(run_at) AS delta_at FROM readings WHERE run_at < '2024-01-10' GROUP BY 1, 2)
SELECT endpoint, metric, {_s("delta_at")}, {_s("current_at", "cur.run_at")} FROM late JOIN cur USING (endpoint, metric) WHERE cur.run_at > delta_at""",
    ),
    "c12_newest_sample": (
        q_newest_sample,
        f"{READINGS_SQL} SELECT endpoint, metric, run, {_s('run_at')}, observed_count FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY run_at DESC, metric = 'm1' DESC, metric DESC) AS k FROM readings WHERE observed_count IS NOT NULL) WHERE k = 1",
    ),
    "c14_prune_plan": (
        q_prune_plan,
        f"""{READINGS_SQL}, {CURRENT_SQL}, r AS (SELECT run, CAST(run_at AS DATE) AS day, count(*) AS quads FROM readings GROUP BY 1, 2)
SELECT CAST(day AS VARCHAR) AS day, count(*) AS runs, CAST(sum(quads) AS BIGINT) AS quads FROM r WHERE day <> '2024-01-05' AND run NOT IN (SELECT run FROM current_readings)
AND day NOT IN (SELECT DISTINCT CAST(run_at AS DATE) AS d FROM readings ORDER BY d DESC LIMIT 3) GROUP BY 1""",
    ),
    "v6_ties": (
        q_ties,
        f"""{READINGS_SQL}, t AS (SELECT endpoint, run_at, min(run || '/' || event_id % 2) AS run_a, max(run || '/' || event_id % 2) AS run_b FROM raw_readings GROUP BY 1, 2)
SELECT endpoint, {_s("run_at")}, run_a, run_b FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY run_at DESC) AS k FROM t) WHERE k = 1 AND run_a <> run_b""",
    ),
    "v7_conflicts": (
        q_conflicts,
        f"""{READINGS_SQL}, c AS (SELECT run, endpoint, metric FROM raw_readings GROUP BY 1, 2, 3 HAVING count(DISTINCT kind || '|' || coalesce(verdict, '') || '|' || coalesce(reason, '') || '|' || coalesce(elapsed_ms, -1)) > 1)
SELECT endpoint, count(*) AS dropped FROM c GROUP BY 1""",
    ),
    "v7_settled": (
        q_settled,
        f"""{READINGS_SQL}, c AS (SELECT run, endpoint, metric, min(kind) AS kind FROM raw_readings GROUP BY 1, 2, 3 HAVING count(DISTINCT kind || '|' || coalesce(verdict, '') || '|' || coalesce(reason, '') || '|' || coalesce(elapsed_ms, -1)) = 1)
SELECT metric, kind, count(*) AS kept FROM c GROUP BY 1, 2""",
    ),
    "a1_daily": (q_daily, f"{FLEET_SQL}, {_DAILY_SQL.format(source='readings')} SELECT CAST(day AS VARCHAR) AS day, endpoint, metric, sweeps, verdicts, median_ms, p95_ms FROM daily"),
    "a4_verify_summary": (
        q_verify_summary,
        f"""{FLEET_SQL}, kept AS (SELECT * FROM readings WHERE elapsed_ms IS NULL OR elapsed_ms % 97 <> 0),
a AS (SELECT CAST(run_at AS DATE) AS day, endpoint, metric, count(*) AS sweeps FROM kept WHERE kind = 'measured' GROUP BY ALL), b AS (SELECT CAST(run_at AS DATE) AS day, endpoint, metric, count(*) AS raw FROM readings WHERE kind = 'measured' GROUP BY ALL)
SELECT CAST(day AS VARCHAR) AS day, endpoint, metric, CASE WHEN sweeps IS NULL THEN 'not summarised' ELSE 'sweeps differ' END AS fault FROM b LEFT JOIN a USING (day, endpoint, metric) WHERE sweeps IS NULL OR sweeps <> raw""",
    ),
    "a5_closed_days": (q_closed_days, f"{READINGS_SQL}, d AS (SELECT DISTINCT CAST(run_at AS DATE) AS day FROM readings) SELECT CAST(day AS VARCHAR) AS day FROM (SELECT day, dense_rank() OVER (ORDER BY day DESC) AS k FROM d) WHERE k > 3"),
    "a6_endpoint_days": (
        q_endpoint_days,
        f"{FLEET_SQL}, {_DAILY_SQL.format(source='readings')} SELECT CAST(day AS VARCHAR) AS day, endpoint, metric, sweeps, verdicts, median_ms, p95_ms FROM daily WHERE endpoint = 'urn:user:3' AND metric = 'm1'",
    ),
    "a7_uptime": (
        q_uptime,
        f"""{FLEET_SQL}, {_UPTIME_SQL} SELECT CAST(day AS VARCHAR) AS day, endpoint, metric, {_RATE} AS uptime, answered, probes,
CASE WHEN len(ms) > 0 THEN ms[least(len(ms) - 1, CAST(round_even(0.5 * (len(ms) - 1), 0) AS INT)) + 1] END AS median_ms,
CASE WHEN len(ms) > 0 THEN ms[least(len(ms) - 1, CAST(round_even(0.95 * (len(ms) - 1), 0) AS INT)) + 1] END AS p95_ms FROM uptime""",
    ),
    "a7_uptime_of_summary": (
        q_uptime_summary,
        f"""{FLEET_SQL}, {_UPTIME_SQL}, {_DAILY_SQL.format(source="readings")} SELECT CAST(day AS VARCHAR) AS day, endpoint, metric, {_RATE} AS uptime, answered, probes, median_ms, p95_ms FROM uptime JOIN daily USING (day, endpoint, metric)""",
    ),
    "a8_calendar": (
        q_calendar,
        f"""{READINGS_SQL}, {_UPTIME_SQL}, span AS (SELECT endpoint, metric, greatest(min(day), max(day) - 29) AS a, max(day) AS b FROM uptime GROUP BY 1, 2),
spine AS (SELECT endpoint, metric, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span)
SELECT endpoint, metric, CAST(day AS VARCHAR) AS day, {_RATE} AS uptime, answered, probes FROM spine LEFT JOIN uptime USING (endpoint, metric, day)""",
    ),
    "a9_fleet_stats": (
        q_fleet_stats,
        f"""{READINGS_SQL}, w AS (SELECT * FROM readings WHERE metric = 'm0'), l AS (SELECT endpoint, verdict, lag(verdict) OVER (PARTITION BY endpoint ORDER BY run_at) AS b FROM w WHERE kind = 'measured'),
z AS (SELECT endpoint, arg_max(observed_count, run_at) AS n FROM readings WHERE metric = 'm1' AND observed_count IS NOT NULL GROUP BY 1)
SELECT (SELECT count(DISTINCT endpoint) FROM w) AS endpoints, (SELECT count(DISTINCT run) FROM w) AS sweeps, (SELECT strftime(min(run_at), '%Y-%m-%d %H:%M:%S') FROM w) AS first, (SELECT strftime(max(run_at), '%Y-%m-%d %H:%M:%S') FROM w) AS last,
(SELECT count(DISTINCT endpoint) FROM l WHERE b <> verdict) AS changed, (SELECT CAST(sum(n) AS BIGINT) FROM z) AS triples, (SELECT count(n) FROM z) AS counted""",
    ),
    "a10_changed": (
        q_changed,
        f"{READINGS_SQL}, l AS (SELECT endpoint, metric, verdict, lag(verdict) OVER (PARTITION BY endpoint, metric ORDER BY run_at) AS b FROM readings WHERE kind = 'measured') SELECT endpoint, metric, coalesce(bool_or(b <> verdict), false) AS changed FROM l GROUP BY 1, 2",
    ),
    "a10_changed_whole": (
        q_changed_whole,
        f"{READINGS_SQL}, l AS (SELECT endpoint, metric, verdict || elapsed_ms AS v, lag(verdict || elapsed_ms) OVER (PARTITION BY endpoint, metric ORDER BY run_at) AS b FROM readings WHERE kind = 'measured') SELECT endpoint, metric, coalesce(bool_or(b <> v), false) AS changed FROM l GROUP BY 1, 2",
    ),
    "a11_transitions": (
        q_transitions,
        f"""{FLEET_SQL}, runs AS (SELECT DISTINCT run_at FROM readings), pairs AS (SELECT endpoint, metric, min(run_at) AS first FROM readings GROUP BY 1, 2),
grid AS (SELECT p.endpoint, p.metric, r.run_at, coalesce({_STATE.replace("kind", "x.kind").replace("verdict", "x.verdict")}, 'not-measured') AS state FROM pairs p JOIN runs r ON r.run_at >= p.first LEFT JOIN readings x ON x.endpoint = p.endpoint AND x.metric = p.metric AND x.run_at = r.run_at),
l AS (SELECT *, lag(state) OVER (PARTITION BY endpoint, metric ORDER BY run_at) AS was FROM grid)
SELECT endpoint, metric, {_s("run_at")}, was, state AS now FROM l WHERE was IS NULL OR was <> state""",
    ),
    "a12_state_matrix": (q_state_matrix, f"{_MATRIX_SQL} SELECT metric, state, cells FROM matrix"),
    "a13_state_facets": (q_state_facets, f"{READINGS_SQL}, {CURRENT_SQL} SELECT {_STATE} AS state, count(DISTINCT endpoint) AS endpoints FROM current_readings GROUP BY 1"),
    "a14_legend": (q_legend, f"{_MATRIX_SQL} SELECT state, CAST(sum(cells) AS BIGINT) AS cells FROM matrix GROUP BY 1"),
    "a15_availability": (
        q_availability,
        f"""{READINGS_SQL}, {CURRENT_SQL}, e AS (SELECT endpoint, bool_or(metric = 'm0' AND coalesce({_POS}, false)) AS up, bool_or(kind = 'declined' AND reason = 'liveness-failed') AS asleep FROM current_readings GROUP BY 1)
SELECT CASE WHEN endpoint LIKE '%7' THEN 'inactive' WHEN asleep THEN 'dormant' WHEN up THEN 'available' ELSE 'unresponsive' END AS availability, count(*) AS endpoints FROM e GROUP BY 1""",
    ),
    "a16_row_size": (q_row_size, f"{READINGS_SQL}, {CURRENT_SQL} SELECT endpoint, max(observed_count) FILTER (WHERE metric = 'm0') AS n_m0, max(observed_count) FILTER (WHERE metric = 'm1') AS n_m1 FROM current_readings GROUP BY 1"),
    "a18_day_volume": (
        q_day_volume,
        f"""{FLEET_SQL}, c AS (SELECT CAST(run_at AS DATE) AS day, endpoint, metric, count(*) AS n, count(*) FILTER (WHERE kind = 'measured') AS m FROM readings GROUP BY ALL)
SELECT CAST(day AS VARCHAR) AS day, CAST(sum(n) AS BIGINT) AS raw_rows, count(*) FILTER (WHERE m > 0) AS summary_rows, round(sum(n) / count(*) FILTER (WHERE m > 0), 4) AS ratio FROM c GROUP BY 1""",
    ),
    "a19_cost_distribution": (
        q_cost_distribution,
        f"{READINGS_SQL} SELECT metric AS bucket, count(*) AS n, quantile_cont(elapsed_ms, 0.5) AS median_ms, round(avg(elapsed_ms), 4) AS mean_ms, max(elapsed_ms) AS max_ms, CAST(sum(elapsed_ms) AS BIGINT) AS total_ms, round(sum(elapsed_ms)::DOUBLE / sum(sum(elapsed_ms)) OVER (), 6) AS share FROM readings WHERE elapsed_ms IS NOT NULL GROUP BY 1",
    ),
    "a20_sweep_outcomes": (
        q_sweep_outcomes,
        f"""{READINGS_SQL}, o AS (SELECT run, endpoint, sum(coalesce(elapsed_ms, 0)) AS cost_ms, bool_or({_POS}) AS positive, bool_or(metric = 'm0' AND NOT {_POS}) AS liveness_failed, max(observed_count) AS observed, count(*) AS rows FROM readings WHERE kind = 'measured' GROUP BY 1, 2)
SELECT p.run, p.endpoint, CAST(coalesce(cost_ms, 0) AS BIGINT) AS cost_ms, coalesce(positive, false) AS positive, coalesce(liveness_failed, false) AS liveness_failed, observed, coalesce(rows, 0) AS rows FROM (SELECT DISTINCT run, endpoint FROM readings) p LEFT JOIN o USING (run, endpoint)""",
    ),
    "a21_stretches": (
        q_stretches,
        f"""{READINGS_SQL}, d AS (SELECT DISTINCT CAST(run_at AS DATE) AS day, endpoint, metric FROM readings WHERE kind = 'measured'), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY endpoint, metric ORDER BY day) AS INT) AS island FROM d)
SELECT endpoint, metric, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last, count(*) AS days FROM i GROUP BY endpoint, metric, island""",
    ),
    "a23_agreement": (q_agreement, "SELECT quality, CAST(n_chars > 1000 AS INT) AS long, count(*) AS n FROM documents FULL JOIN labels USING (doc_id) GROUP BY 1, 2"),
    "r1_index": (q_index, f"{_INDEX_SQL} SELECT endpoint, metric, kind, verdict, own_run, {_s('own_at')}, {_s('measured_at')}, newest_run FROM idx"),
    "r2_endpoint_measurements": (q_endpoint_measurements, f"{_INDEX_SQL} SELECT endpoint, metric, verdict, reason, own_run, reading_run FROM idx WHERE endpoint = 'urn:user:42'"),
    "r3_run_status": (
        q_run_status,
        _STATUS_SQL,
    ),
    "r4_endpoint_content": (q_endpoint_content, READINGS_SQL + " " + _top("run_at DESC", "observed_count > 500", "endpoint, metric, run, observed_count")),
    "r5_history": (
        q_history,
        _history_sql("endpoint, metric", 48, FLEET_SQL, "") + " SELECT endpoint, metric, string_agg(coalesce(verdict, kind, '-'), ',' ORDER BY run_at) AS verdicts, string_agg(coalesce(CAST(elapsed_ms AS VARCHAR), '-'), ',' ORDER BY run_at) AS elapsed FROM grid GROUP BY 1, 2",
    ),
    "r6_fleet_grid": (q_fleet_grid, _history_sql("endpoint", 100, READINGS_SQL, "WHERE metric = 'm0'") + " SELECT endpoint, string_agg(coalesce(verdict, kind, '-'), ',' ORDER BY run_at) AS verdicts FROM grid GROUP BY 1"),
    "r7_describe": (q_describe, f"{_TRIPLES_SQL} SELECT s, p, o FROM triples"),
    "r8_narrow": (
        q_narrow,
        f"""{_TRIPLES_SQL}, outside AS (SELECT DISTINCT endpoint FROM idx WHERE NOT endpoint LIKE '%1'), nodes AS (SELECT s FROM triples WHERE p IN ('urn:v:computedOn', 'urn:v:notMeasuredOn') AND o IN (SELECT endpoint FROM outside))
SELECT p, count(*) AS n FROM triples WHERE s NOT IN (SELECT endpoint FROM outside) AND o NOT IN (SELECT endpoint FROM outside) AND s NOT IN (SELECT s FROM nodes) GROUP BY 1""",
    ),
    "r10_text_filter": (q_text_filter, "SELECT page_id, url FROM pages WHERE instr(lower(url), 'en/') > 0"),
    "r11_facet_filter": (
        q_facet_filter,
        f"{READINGS_SQL}, {CURRENT_SQL} SELECT DISTINCT endpoint, CASE metric WHEN 'm0' THEN 'available' ELSE 'm1' END AS facet FROM current_readings WHERE metric IN ('m0', 'm1') AND {_POS}",
    ),
}
