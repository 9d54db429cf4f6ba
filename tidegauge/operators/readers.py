"""Readers: the index, histories, grids, filters and facet rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.schemas import is_positive

PAIR = ["endpoint", "metric"]


def index(current: DataFrame, pointers: DataFrame, runs: DataFrame) -> DataFrame:
    """Every current reading with its endpoint's run, its own run and the newest run.

    Rows whose endpoint's run has no instant go; rows whose reading's run is
    unknown stay.
    """
    own = runs.select(F.col("run").alias("own_run"), F.col("run_at").alias("own_at"), F.col("emission").alias("own_emission"), F.col("finalised").alias("own_finalised"))
    read = runs.select(F.col("run").alias("reading_run"), F.col("run_at").alias("measured_at"))
    newest = runs.agg(F.max(F.struct("run_at", "run", "emission", "finalised")).alias("n"))
    newest = newest.select(F.col("n.run").alias("newest_run"), F.col("n.run_at").alias("newest_at"), F.col("n.emission").alias("newest_emission"), F.col("n.finalised").alias("newest_finalised"))
    rows = current.drop("run_at").withColumnRenamed("run", "reading_run")
    joined = rows.join(pointers.select("endpoint", F.col("run").alias("own_run")), "endpoint").join(own, "own_run")
    return joined.where("own_at is not null").join(read, "reading_run", "left").crossJoin(F.broadcast(newest))  # newest is one row


def endpoint_measurements(index_rows: DataFrame, endpoint: str) -> DataFrame:
    """R2: one endpoint's rows; the filter reaches the scan."""
    return index_rows.where(F.col("endpoint") == endpoint)


def run_status(index_rows: DataFrame, completions: DataFrame, dormancy: DataFrame) -> DataFrame:
    """What the endpoint's own run and the newest run say of a row, all null-safe.

    ``completions`` and ``dormancy`` have run and endpoint: what a run finished, and
    what it declared dormant.

    * ``unfinished``: the own run says how it is written (emission) and lacks its end.
    * ``not_reached``: a newer such run stopped before this endpoint, without having
      declared it dormant.
    * ``newest_recorded_nothing``: a newer run finished, but not this endpoint.
    * ``declined_to_ask``: a newer run declared this endpoint dormant, finished or not.
    * ``older_than_header``: the reading is older than the own run.
    """
    of_newest = lambda facts, flag: facts.select(F.col("run").alias("newest_run"), "endpoint").distinct().withColumn(flag, F.lit(True))
    rows = index_rows
    for facts, flag in ((completions, "newest_completed"), (dormancy, "newest_dormant")):
        rows = rows.join(of_newest(facts, flag), ["newest_run", "endpoint"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    newer = F.col("newest_run").isNotNull() & ~F.col("newest_run").eqNullSafe(F.col("own_run"))
    return rows.withColumns(
        {
            "unfinished": F.col("own_emission").isNotNull() & ~yes("own_finalised"),
            "not_reached": newer & F.col("newest_emission").isNotNull() & ~yes("newest_finalised") & ~F.col("newest_completed") & ~F.col("newest_dormant"),
            "newest_recorded_nothing": newer & yes("newest_finalised") & ~F.col("newest_completed"),
            "declined_to_ask": newer & F.col("newest_dormant"),
            "older_than_header": F.coalesce(F.col("measured_at") < F.col("own_at"), F.lit(False)),
        }
    )


def endpoint_content(samples: DataFrame, pointers: DataFrame) -> DataFrame:
    """The samples that the pointers name."""
    return samples.join(pointers.select(*PAIR, "run"), [*PAIR, "run"], "left_semi")


def newest_runs(readings: DataFrame, n: int) -> DataFrame:
    """The newest n runs, numbered from the oldest of them; at most n rows."""
    runs = readings.select("run", "run_at").distinct().orderBy(F.desc("run_at"), F.desc("run")).limit(n)
    place = F.array_sort(F.collect_list(F.struct("run_at", "run")))
    return runs.agg(place.alias("all")).select(F.posexplode("all").alias("place", "r")).select("place", "r.run", "r.run_at")


def history(readings: DataFrame, n: int, keys: list[str] = PAIR) -> DataFrame:
    """Each key's readings over the newest n runs, aligned; a gap is null.

    ``verdicts`` and ``elapsed`` are arrays with one place per run, oldest first.
    """
    spine = newest_runs(readings, n)
    own = readings.join(F.broadcast(spine.select("run", "place")), "run")
    per_key = own.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("place", F.struct(F.coalesce("verdict", "kind").alias("verdict"), "elapsed_ms"))))).alias("at")
    )
    width = spine.agg(F.count("*").alias("width"))
    at = per_key.crossJoin(F.broadcast(width))  # one row
    cells = F.transform(F.sequence(F.lit(0), F.col("width").cast("int") - 1), lambda i: F.try_element_at("at", i))
    return at.select(*keys, F.transform(cells, lambda c: c["verdict"]).alias("verdicts"), F.transform(cells, lambda c: c["elapsed_ms"]).alias("elapsed"))


def describe_readings(index_rows: DataFrame, namespace: str) -> DataFrame:
    """The readings as triples: two arms of facts and two of the runs they name."""
    node = F.concat(F.lit(f"{namespace}reading:"), F.sha2(F.concat_ws("\u0001", "endpoint", "metric"), 256))
    arms = []
    for kind, pairs in (
        ("measured", (("computedOn", "endpoint"), ("isMeasurementOf", "metric"), ("value", "verdict"))),
        ("declined", (("notMeasuredOn", "endpoint"), ("notMeasuredMetric", "metric"), ("notMeasuredReason", "reason"))),
    ):
        facts = F.explode(F.array(*[F.struct(F.lit(namespace + p).alias("p"), F.col(c).alias("o")) for p, c in pairs]))
        arms.append(index_rows.where(F.col("kind") == kind).select(node.alias("s"), facts.alias("f")).select("s", "f.p", "f.o"))
    for run, at in (("own_run", "own_at"), ("reading_run", "measured_at")):
        arms.append(index_rows.where(F.col(at).isNotNull()).select(F.col(run).alias("s"), F.lit(f"{namespace}generatedAtTime").alias("p"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("o")))
    out = arms[0]
    for arm in arms[1:]:
        out = out.unionByName(arm)
    return out.where("o is not null").distinct()


def narrow_triples(triples: DataFrame, all_endpoints: DataFrame, matching: DataFrame, links: tuple[str, ...]) -> DataFrame:
    """Without triples about endpoints that do not match, or nodes linked to one."""
    outside = all_endpoints.select("endpoint").join(matching.select("endpoint"), "endpoint", "left_anti").distinct()
    nodes = triples.where(F.col("p").isin(*links)).join(outside, F.col("o") == F.col("endpoint"), "left_semi").select(F.col("s").alias("node")).distinct()
    kept = triples.join(outside, F.col("s") == F.col("endpoint"), "left_anti").join(outside, F.col("o") == F.col("endpoint"), "left_anti")
    return kept.join(nodes, F.col("s") == F.col("node"), "left_anti")


def text_matches(query: str, *columns: Column) -> Column:
    """Whether a trimmed query stands in any column, case ignored; empty matches all."""
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(True)
    found = F.lit(False)
    for column in columns:
        found = found | F.coalesce(F.contains(F.lower(column), F.lit(wanted)), F.lit(False))
    return found


def facet_filter(current: DataFrame, availability: DataFrame, facet: str) -> DataFrame:
    """Endpoints in an availability state, or positive in a metric; unknown names match none."""
    if facet == "all":
        return availability.select("endpoint")
    if facet in ("available", "unresponsive", "dormant", "inactive"):
        return availability.where(F.col("availability") == facet).select("endpoint")
    return current.where((F.col("metric") == facet) & is_positive(F.col("verdict"))).select("endpoint").distinct()


def bounded(df: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """At most n rows, and whether there were more."""
    return df.limit(n), df.limit(n + 1).count() > n


def void_rows(class_profiles: DataFrame, property_profiles: DataFrame, declarations: DataFrame, documents: DataFrame) -> DataFrame:
    """What is known of datasets, one row per statement and its kind."""
    cols = ["run", "endpoint", "kind", "class", "property", "n"]
    arms = [
        class_profiles.select("run", "endpoint", F.lit("class").alias("kind"), "class", F.lit(None).cast("string").alias("property"), F.col("denominator").alias("n")),
        property_profiles.select("run", "endpoint", F.lit("property").alias("kind"), "class", "property", F.col("subjects").alias("n")),
        declarations.select("run", "endpoint", F.explode("classes").alias("class")).select("run", "endpoint", F.lit("declared-class").alias("kind"), "class"),
        declarations.select("run", "endpoint", F.explode("properties").alias("property")).select("run", "endpoint", F.lit("declared-property").alias("kind"), "property"),
        documents.where("triples is not null").select("run", "endpoint", F.lit("document").alias("kind"), F.col("triples").alias("n")),
        documents.where("declared_triples is not null").select("run", "endpoint", F.lit("claimed").alias("kind"), F.col("declared_triples").alias("n")),
    ]
    out = arms[0]
    for arm in arms[1:]:
        out = out.unionByName(arm, allowMissingColumns=True)
    return out.select(*cols)
