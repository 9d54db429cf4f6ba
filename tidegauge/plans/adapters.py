"""The driver's tables in the shapes of the observation archive, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.session import table

RUN_TEXT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def raw_readings(spark: SparkSession, sf_dir: str, endpoint: Column | None = None, by_run: bool = False) -> DataFrame:
    """events as readings, before runs that state a pair twice are settled; on demand with a run's rows in one task."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("run_at"))
    # An event becomes many lines, so tasks are cut by number: by the size of events they would be too large.
    e, at = e.repartition(8 * spark.sparkContext.defaultParallelism, "run_at") if by_run else e, F.col("run_at")
    declined = F.col("event_type") == "purchase"
    verdict = F.when(F.col("event_type") == "view", "verified").when(F.col("event_type") == "click", "undeclared-but-verified")
    verdict = verdict.when(F.col("event_type") == "signup", "absent").when(F.col("event_type") == "error", "indeterminate")
    never = declined & (F.col("user_id") % 3 == 0)
    policy = (F.col("user_id") % 6 == 0) | (F.col("event_id") % 2 == 0)
    name = endpoint if endpoint is not None else F.concat(F.lit("urn:user:"), F.col("user_id"))
    ms = F.floor(F.col("value") * 100).cast("long")
    return e.select(
        "event_id", F.concat(F.lit("urn:run:"), F.date_format(at, RUN_TEXT)).alias("run"), "run_at", name.alias("endpoint"),
        F.when(never, "m-declined").otherwise(F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string"))).alias("metric"),
        F.when(declined, "declined").otherwise("measured").alias("kind"), F.when(~declined, verdict).alias("verdict"),
        F.when(declined, F.when(policy, "cadence").otherwise("liveness-failed")).alias("reason"), F.lit(None).cast("int").alias("level"),
        F.when(~declined, ms).alias("elapsed_ms"), F.lit(None).cast("long").alias("declared_count"), F.when(~declined, ms % 1000).alias("observed_count"),
    )


def readings(spark: SparkSession, sf_dir: str, endpoint: Column | None = None) -> DataFrame:
    """One reading of a pair per run: the first event."""
    raw = raw_readings(spark, sf_dir, endpoint)
    keys = ["endpoint", "metric", "run"]
    rest = [c for c in raw.columns if c not in keys]
    first = raw.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r"))
    return first.select(*keys, "r.*").drop("event_id")


def readings_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same readings, all of a run in one task and sorted by endpoint and metric: one shuffle of the events, one sort."""
    raw = raw_readings(spark, sf_dir, by_run=True)
    first = F.row_number().over(Window.partitionBy("run_at", "endpoint", "metric").orderBy("event_id"))
    return raw.withColumn("_k", first).where("_k = 1").drop("_k", "event_id")


def fleet_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of ten endpoints, so that a day holds many."""
    return readings(spark, sf_dir, F.concat(F.lit("urn:user:"), F.col("user_id") % 10))


RAW_SQL = """raw_readings AS (
  SELECT event_id, 'urn:run:' || strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS run, date_trunc('hour', ts) AS run_at,
    'urn:user:' || {user} AS endpoint,
    CASE WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN 'm-declined' ELSE 'm' || (event_id % 3) END AS metric,
    CASE WHEN event_type = 'purchase' THEN 'declined' ELSE 'measured' END AS kind,
    CASE event_type WHEN 'view' THEN 'verified' WHEN 'click' THEN 'undeclared-but-verified' WHEN 'signup' THEN 'absent' WHEN 'error' THEN 'indeterminate' END AS verdict,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN user_id % 6 = 0 OR event_id % 2 = 0 THEN 'cadence' ELSE 'liveness-failed' END END AS reason,
    CASE WHEN event_type <> 'purchase' THEN CAST(floor(value * 100) AS BIGINT) END AS elapsed_ms,
    CASE WHEN event_type <> 'purchase' THEN CAST(floor(value * 100) AS BIGINT) % 1000 END AS observed_count
  FROM events),
readings AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY endpoint, metric, run ORDER BY event_id) AS n FROM raw_readings) WHERE n = 1)"""
READINGS_SQL = "WITH " + RAW_SQL.format(user="user_id")
FLEET_SQL = "WITH " + RAW_SQL.format(user="(user_id % 10)")
CURRENT_SQL = """current_readings AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY endpoint, metric
  ORDER BY kind = 'measured' DESC, coalesce(reason, '') NOT IN ('cadence', 'cost-ceiling') DESC, run_at DESC) AS n FROM readings) WHERE n = 1)"""

#: Tables that stand for archive graphs: (table, key column, columns).
GRAPHS = (
    ("customer", "c_custkey", ("c_name", "c_nationkey", "c_mktsegment", "c_acctbal")),
    ("supplier", "s_suppkey", ("s_name", "s_nationkey", "s_acctbal")),
    ("nation", "n_nationkey", ("n_name", "n_regionkey")),
    ("part", "p_partkey", ("p_name", "p_brand", "p_type", "p_size")),
)


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension tables as quads: a type and one quad per column; numbers carry a datatype."""
    out = None
    for name, key, columns in GRAPHS:
        rows = table(spark, sf_dir, name)
        cell = [F.struct(F.lit("rdf:type").alias("p"), F.lit(f"urn:class:{name}").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"))]
        for c in columns:
            kind = rows.schema[c].dataType.simpleString()
            whole = kind in ("int", "bigint")
            text = F.col(c).cast("string") if whole or kind == "string" else F.floor(F.col(c)).cast("long").cast("string")
            cell.append(F.struct(F.lit(f"urn:p:{c}").alias("p"), text.alias("o"), F.lit("literal").alias("o_kind"), F.lit("string" if kind == "string" else "integer").alias("o_datatype")))
        part = rows.select(F.concat(F.lit(f"urn:{name}:"), F.col(key)).alias("s"), F.explode(F.array(*cell)).alias("c"), F.lit(f"urn:g:{name}").alias("g"))
        part = part.select("s", "c.p", "c.o", "c.o_kind", "c.o_datatype", "g").where("o is not null")
        out = part if out is None else out.unionByName(part)
    return out


def _quads_sql() -> str:
    arms = []
    for name, key, columns in GRAPHS:
        arms.append(f"SELECT 'urn:{name}:' || {key} AS s, 'rdf:type' AS p, 'urn:class:{name}' AS o, 'iri' AS o_kind, NULL AS o_datatype, 'urn:g:{name}' AS g FROM {name}")
        for c in columns:
            text = c.endswith(("name", "segment", "brand", "type"))
            value = f"CAST({c} AS VARCHAR)" if text or c.endswith(("key", "size")) else f"CAST(CAST(floor({c}) AS BIGINT) AS VARCHAR)"
            arms.append(f"SELECT 'urn:{name}:' || {key}, 'urn:p:{c}', {value}, 'literal', '{'string' if text else 'integer'}', 'urn:g:{name}' FROM {name} WHERE {c} IS NOT NULL")
    return "quads AS (" + " UNION ALL ".join(arms) + ")"


QUADS_SQL = "WITH " + _quads_sql()
