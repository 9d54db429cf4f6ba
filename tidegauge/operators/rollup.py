"""Time series: daily summaries, uptime, changes, matrices and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.schemas import NAMESPACE, NOT_MEASURED, POSITIVE, PROV, UNREACHED, UNRECOGNISED, VERDICTS, display_state, is_positive

PAIR = ["endpoint", "metric"]
DAY = ["day", *PAIR]


def summary_percentile(ordered: Column, share: float) -> Column:
    """A2: nearest rank for stored summaries: half-even of share * n + 0.5, within 1 and n."""
    n = F.size(ordered)
    rank = F.least(F.greatest(F.bround(share * n + F.lit(0.5)).cast("int"), F.lit(1)), n)
    return F.when(n > 0, F.element_at(ordered, F.greatest(rank, F.lit(1))))


def chart_percentile(ordered: Column, share: float) -> Column:
    """A3: nearest rank for live charts: index half-even of share * (n - 1)."""
    n = F.size(ordered)
    at = F.least(n - 1, F.bround(share * (n - F.lit(1.0))).cast("int"))
    return F.when(n > 0, F.element_at(ordered, F.greatest(at, F.lit(0)) + 1))


def daily(readings: DataFrame) -> DataFrame:
    """A1: one row per day and pair over measured sweeps.

    Durations are those of positive verdicts; a pair has at most one reading a run,
    so the arrays hold a day's sweeps.
    """
    measured = readings.where("kind = 'measured'").withColumn("day", F.to_date("run_at"))
    timing = F.when(is_positive(F.col("verdict")), F.col("elapsed_ms"))
    per_verdict = measured.groupBy(*DAY, "verdict").agg(F.count("*").alias("n"), F.collect_list(timing).alias("ms"))
    days = per_verdict.groupBy(*DAY).agg(
        F.sum("n").alias("sweeps"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("verdict", "n")))).alias("verdicts"),
        F.array_sort(F.flatten(F.collect_list("ms"))).alias("ms"),
    )
    return days.select(
        *DAY, "sweeps", "verdicts", summary_percentile(F.col("ms"), 0.5).alias("median_ms"), summary_percentile(F.col("ms"), 0.95).alias("p95_ms")
    )


def verdict_text(verdicts: Column) -> Column:
    """A verdict map as sorted text, for comparison."""
    entries = F.array_sort(F.map_entries(verdicts))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


def verify_summary(summary: DataFrame, readings: DataFrame) -> DataFrame:
    """A4: where a stored summary and the raw readings disagree, and how."""
    raw = daily(readings).select(*DAY, F.col("sweeps").alias("raw_sweeps"), verdict_text(F.col("verdicts")).alias("raw_verdicts"))
    kept = summary.select(*DAY, "sweeps", verdict_text(F.col("verdicts")).alias("kept_verdicts"))
    fault = (
        F.when(F.col("raw_sweeps").isNull(), "not in raw").when(F.col("sweeps").isNull(), "not summarised")
        .when(F.col("sweeps") != F.col("raw_sweeps"), "sweeps differ").when(F.col("kept_verdicts") != F.col("raw_verdicts"), "verdicts differ")
    )
    return kept.join(raw, DAY, "full_outer").withColumn("fault", fault).where("fault is not null").select(*DAY, "fault")


def days_in(readings: DataFrame) -> DataFrame:
    return readings.select(F.to_date("run_at").alias("day")).distinct()


def closed_days(readings: DataFrame, keep: int = 3) -> DataFrame:
    """A5: all days but the newest ``keep``."""
    days = days_in(readings)
    newest = days.orderBy(F.desc("day")).limit(keep)
    return days.join(F.broadcast(newest), "day", "left_anti")


def endpoint_days(summary: DataFrame, endpoint: str, metric: str) -> DataFrame:
    """The whole summary history of a pair."""
    return summary.where((F.col("endpoint") == endpoint) & (F.col("metric") == metric))


def uptime(readings: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Share of positive sweeps a day, of those answered, or of all asked if none was."""
    asked = readings.where("kind = 'measured' and verdict is not null").withColumn("day", F.to_date("run_at"))
    timing = F.when(is_positive(F.col("verdict")), F.col("elapsed_ms"))
    days = asked.groupBy("day", *keys).agg(
        F.count("*").alias("probes"),
        F.count_if(F.col("verdict") != UNREACHED).alias("answered"),
        F.count_if(is_positive(F.col("verdict"))).alias("up"),
        F.array_sort(F.collect_list(timing)).alias("ms"),
    )
    counted = F.when(F.col("answered") > 0, F.col("answered")).otherwise(F.col("probes"))
    return days.select(
        "day", *keys, F.bround(100.0 * F.col("up") / counted, 1).alias("uptime"), "answered", "probes",
        chart_percentile(F.col("ms"), 0.5).alias("median_ms"), chart_percentile(F.col("ms"), 0.95).alias("p95_ms"),
    )


def uptime_of_summary(summary: DataFrame) -> DataFrame:
    """A7 from stored summaries: the same split applied to the counts."""
    values = F.map_entries("verdicts")
    total = lambda keep: F.aggregate(F.filter(values, keep), F.lit(0).cast("long"), lambda a, e: a + e["value"])
    counted = summary.select(
        *DAY, total(lambda e: e["key"] != UNREACHED).alias("answered"), total(lambda e: F.lit(True)).alias("probes"),
        total(lambda e: e["key"].isin(*POSITIVE)).alias("up"), "median_ms", "p95_ms",
    )
    base = F.when(F.col("answered") > 0, F.col("answered")).otherwise(F.col("probes"))
    return counted.where("probes > 0").select("day", *PAIR, F.bround(100.0 * F.col("up") / base, 1).alias("uptime"), "answered", "probes", "median_ms", "p95_ms")


def calendar_series(raw: DataFrame, summarised: DataFrame, keys: list[str] = PAIR, days: int = 30) -> DataFrame:
    """Every day from a key's first to its last, the newest ``days`` of them.

    A summary wins over raw readings of its day; a day with neither is a gap, not
    a zero.
    """
    columns = [*keys, "day", "uptime", "answered", "probes", "median_ms", "p95_ms"]
    known = summarised.select(*columns, F.lit(1).alias("won")).unionByName(raw.select(*columns, F.lit(0).alias("won")))
    best = known.groupBy(*keys, "day").agg(F.max(F.struct("won", *columns[len(keys) + 1 :])).alias("b")).select(*keys, "day", "b.*").drop("won")
    span = best.groupBy(*keys).agg(F.min("day").alias("first"), F.max("day").alias("last"))
    first = F.greatest(F.col("first"), F.date_sub("last", days - 1))
    spine = span.select(*keys, F.explode(F.sequence(first, F.col("last"))).alias("day"))
    return spine.join(best, [*keys, "day"], "left")


def fleet_stats(readings: DataFrame, availability: str, size_metric: str | None = None) -> DataFrame:
    """One row about the fleet; the size is null if no endpoint was counted."""
    own = readings.where(F.col("metric") == availability)
    head = own.agg(F.count_distinct("endpoint").alias("endpoints"), F.count_distinct("run").alias("sweeps"), F.min("run_at").alias("first"), F.max("run_at").alias("last"))
    changed = changed_pairs(own).agg(F.count_if("changed").alias("changed"))
    sized = readings.where((F.col("metric") == (size_metric or availability)) & F.col("observed_count").isNotNull())
    latest = sized.groupBy("endpoint").agg(F.max_by("observed_count", "run_at").alias("n"))
    size = latest.agg(F.sum("n").alias("triples"), F.count("n").alias("counted"))
    return head.crossJoin(changed).crossJoin(size)  # one row each


def changed_pairs(readings: DataFrame, whole: bool = False) -> DataFrame:
    """A10: whether a pair ever differed between consecutive readings; gaps are skipped.

    ``whole`` compares the whole reading with its duration, else the verdict. Readings in
    a row differ somewhere just if not all are equal, so least and greatest decide.
    """
    value = F.struct("verdict", "level", "elapsed_ms") if whole else F.col("verdict")
    seen = readings.where("kind = 'measured' and verdict is not null").withColumn("value", value)
    return seen.groupBy(*PAIR).agg((F.min("value") != F.max("value")).alias("changed"))


def _following(readings: DataFrame) -> DataFrame:
    """The next run of the archive after each (run_at, next_at): inside its day, else the first of the next day with runs."""
    days = readings.select("run_at").distinct().groupBy(F.to_date("run_at").alias("day")).agg(F.array_sort(F.collect_list("run_at")).alias("all"))
    # One row: an entry for each day of the archive.
    firsts = days.agg(F.array_sort(F.collect_list(F.struct("day", F.col("all")[0].alias("first")))).alias("days"))
    after = firsts.select("days", F.posexplode("days").alias("k", "d")).select(F.col("d.day").alias("day"), F.get("days", F.col("k") + 1)["first"].alias("next_day"))
    rows = days.join(after, "day").select("all", "next_day", F.posexplode("all").alias("k", "run_at"))
    return rows.select("run_at", F.coalesce(F.get("all", F.col("k") + 1), "next_day").alias("next_at"))


def transitions(readings: DataFrame) -> DataFrame:
    """First sightings, changes and disappearances of each pair, run by run.

    A pair that a later run does not state has vanished (``not-measured``) at the
    next run of the archive. Only runs where something changed come back. Neighbours
    are found within a pair's day, and at its borders among the pair's days, so no task
    holds a pair's whole history.
    """
    state = readings.select(*PAIR, "run_at", display_state(F.col("kind"), F.col("verdict")).alias("state"))
    placed = state.join(_following(readings), "run_at").withColumn("day", F.to_date("run_at"))
    own = F.struct("state", "next_at")
    in_day, by_day = Window.partitionBy(*PAIR, "day").orderBy("run_at"), Window.partitionBy(*PAIR).orderBy("day")
    steps = placed.withColumns({"last": F.lag(own).over(in_day), "after": F.lead("run_at").over(in_day)})
    days = placed.groupBy(*PAIR, "day").agg(F.min("run_at").alias("first_at"), F.max_by(own, "run_at").alias("left"))
    borders = days.select(*PAIR, "day", F.lag("left").over(by_day).alias("day_before"), F.lead("first_at").over(by_day).alias("day_after"))
    steps = steps.join(borders, [*PAIR, "day"]).withColumn("last", F.coalesce("last", "day_before"))
    steps = steps.select(*PAIR, "run_at", "state", "next_at", F.col("last.state").alias("before"), F.col("last.next_at").alias("before_next"), F.coalesce("after", "day_after").alias("after_at"))
    gap = (F.col("before_next") < F.col("run_at")) & F.col("before").isNotNull()
    from_state = F.when(gap, F.lit(NOT_MEASURED)).otherwise(F.col("before"))
    seen = steps.select(*PAIR, "run_at", from_state.alias("was"), F.col("state").alias("now")).where("was is null or was <> now")
    gone = steps.where("next_at is not null and (after_at is null or after_at > next_at)").where(F.col("state") != NOT_MEASURED)
    return seen.unionByName(gone.select(*PAIR, F.col("next_at").alias("run_at"), F.col("state").alias("was"), F.lit(NOT_MEASURED).alias("now")))


def state_matrix(current: DataFrame) -> DataFrame:
    """Cells per metric and state, every known state for every metric.

    An unknown value is shown under ``unrecognised``, and only if there is one.
    """
    cells = current.groupBy("metric", display_state(F.col("kind"), F.col("verdict")).alias("state")).agg(F.count("*").alias("cells"))
    metrics = current.select("metric").distinct()
    states = F.explode(F.array(*[F.lit(s) for s in (*VERDICTS, NOT_MEASURED)]))
    full = metrics.withColumn("state", states).join(cells, ["metric", "state"], "left").withColumn("cells", F.coalesce("cells", F.lit(0)))
    return full.unionByName(cells.where(F.col("state") == UNRECOGNISED))


def state_facets(current: DataFrame) -> DataFrame:
    """Endpoints with at least one cell in each state."""
    return current.groupBy(display_state(F.col("kind"), F.col("verdict")).alias("state")).agg(F.count_distinct("endpoint").alias("endpoints"))


def legend(current: DataFrame) -> DataFrame:
    """Cells per state, with zeros."""
    return state_matrix(current).groupBy("state").agg(F.sum("cells").alias("cells"))


def availability(current: DataFrame, dormant: DataFrame, inactive: DataFrame, metric: str) -> DataFrame:
    """Exactly one of inactive, dormant, available, unresponsive for each endpoint."""
    own = current.groupBy("endpoint").agg(F.bool_or((F.col("metric") == metric) & is_positive(F.col("verdict"))).alias("up"))
    flags = own.join(inactive.select("endpoint", F.lit(True).alias("off")).distinct(), "endpoint", "left")
    flags = flags.join(dormant.select("endpoint", F.lit(True).alias("asleep")).distinct(), "endpoint", "left")
    state = F.when(F.col("off"), "inactive").when(F.col("asleep"), "dormant").when(F.col("up"), "available").otherwise("unresponsive")
    return flags.select("endpoint", state.alias("availability"))


def row_size(current: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Each endpoint's observed counts, null where it was not counted."""
    return current.groupBy("endpoint").agg(*[F.max(F.when(F.col("metric") == m, F.col("observed_count"))).alias(f"n_{m}") for m in metrics])


def distinct_sizes(values: dict[str, DataFrame]) -> DataFrame:
    """One row: how many distinct values each single column has, nulls left out.

    Each is made distinct by itself and then counted, so no row is copied for every
    count, and a scan reads its own column only.
    """
    every = None
    for name, column in values.items():
        part = column.toDF("value").where("value is not null").distinct().select(F.lit(name).alias("name"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("name").agg(F.count("*").alias("n")).agg(*[F.coalesce(F.max(F.when(F.col("name") == k, F.col("n"))), F.lit(0).cast("long")).alias(k) for k in values])


def archive_statistics(quads: DataFrame, type_iri: str, namespace: str = NAMESPACE) -> DataFrame:
    """One row of what the named graphs hold: triples, distinct subjects, predicates, classes and
    graphs, the triples of the current graph, and the newest instant of a run (null: none)."""
    named = quads.where("g is not null")
    plain = named.agg(
        F.count("*").alias("triples"), F.count_if(F.col("g") == f"{namespace}current").alias("current"), F.max(F.when(F.col("p") == f"{PROV}generatedAtTime", F.col("o"))).alias("newest")
    )
    sizes = distinct_sizes({"subjects": named.select("s"), "predicates": named.select("p"), "classes": named.where(F.col("p") == type_iri).select("o"), "graphs": named.select("g")})
    return plain.crossJoin(sizes).select("triples", "subjects", "predicates", "classes", "graphs", "current", "newest")  # one row each


#: Bits of the register number of a sketch: about 3 % of error in 1 KB.
SKETCH_BITS = 10
SKETCHED = ("subjects", "predicates", "classes")


def run_sketches(quads: DataFrame, type_iri: str) -> DataFrame:
    """Rows (g, triples, subjects, predicates, classes): sketches of each run's distinct values, to be merged."""
    sketch = lambda c: F.hll_sketch_agg(c, F.lit(SKETCH_BITS))
    return quads.groupBy("g").agg(
        F.count("*").alias("triples"), sketch(F.col("s")).alias("subjects"), sketch(F.col("p")).alias("predicates"), sketch(F.when(F.col("p") == type_iri, F.col("o"))).alias("classes")
    )


def merged_statistics(sketches: DataFrame) -> DataFrame:
    """The approximate counts of all runs together, from their sketches alone."""
    merged = [F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in SKETCHED]
    return sketches.agg(F.coalesce(F.sum("triples"), F.lit(0)).alias("triples"), *merged, F.count("*").alias("graphs"))


def day_volume(readings: DataFrame) -> DataFrame:
    """Raw rows and summary cells of each day, and their ratio."""
    days = readings.withColumn("day", F.to_date("run_at")).groupBy("day", *PAIR).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "measured").alias("m"))
    per_day = days.groupBy("day").agg(F.sum("n").alias("raw_rows"), F.count_if(F.col("m") > 0).alias("summary_rows"))
    return per_day.withColumn("ratio", F.round(F.col("raw_rows") / F.col("summary_rows"), 4))


def cost_distribution(readings: DataFrame, bucket: Column) -> DataFrame:
    """Durations by bucket: n, median, mean, max and share of all."""
    rows = readings.where("elapsed_ms is not null").groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.percentile("elapsed_ms", F.lit(0.5)).alias("median_ms"), F.round(F.avg("elapsed_ms"), 4).alias("mean_ms"),
        F.max("elapsed_ms").alias("max_ms"), F.sum("elapsed_ms").alias("total_ms"),
    )
    total = rows.agg(F.sum("total_ms").alias("all_ms"))
    return rows.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("total_ms") / F.col("all_ms"), 6)).drop("all_ms")


def sweep_outcomes(readings: DataFrame, probed: DataFrame, liveness: str) -> DataFrame:
    """What a sweep found of each endpoint it asked; no reading costs nothing."""
    own = readings.groupBy("run", "endpoint").agg(
        F.sum(F.coalesce("elapsed_ms", F.lit(0))).alias("cost_ms"), F.bool_or(is_positive(F.col("verdict"))).alias("positive"),
        F.bool_or((F.col("metric") == liveness) & ~is_positive(F.col("verdict"))).alias("liveness_failed"), F.max("observed_count").alias("observed"),
        F.count("*").alias("rows"),
    )
    full = probed.select("run", "endpoint").distinct().join(own, ["run", "endpoint"], "left")
    none = F.lit(False)
    return full.select("run", "endpoint", F.coalesce("cost_ms", F.lit(0)).alias("cost_ms"), F.coalesce("positive", none).alias("positive"), F.coalesce("liveness_failed", none).alias("liveness_failed"), "observed", F.coalesce("rows", F.lit(0)).alias("rows"))


def stretches(days: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Runs of consecutive days; a run of one is an isolated day."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("day"))
    islands = days.select(*keys, "day").distinct().withColumn("island", F.date_sub("day", number))
    return islands.groupBy(*keys, "island").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days")).drop("island")


def agreement(catalogue: DataFrame, verdicts: DataFrame, key: str, flag: str, verdict: str) -> DataFrame:
    """Counts of (external flag, own verdict) over the keys either side knows."""
    joined = catalogue.select(key, flag).join(verdicts.select(key, verdict), key, "full_outer")
    return joined.groupBy(flag, verdict).agg(F.count("*").alias("n"))
