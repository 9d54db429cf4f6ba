"""Verdict scoring: observations joined to metrics and declarations, as CASE columns.

An observation row has kind, status, error, body_kind, boolean, expect, bindings,
cors, allow_origin, allow_methods; the metric adds declared_by and tolerance; the
declarations add claimed and stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.schemas import VERDICTS, severity

COSTS = ("cheap", "expensive", "exhaustive")
CADENCES = ("hourly", "daily")
#: Who asks: the origin a cross-origin grant must name.
ORIGIN = "https://example.org"


def _ok() -> Column:
    return F.coalesce(F.col("status").between(200, 299), F.lit(False))


def confirmed() -> Column:
    """Verified if nothing declares the metric or the endpoint claims it."""
    return F.when(F.col("declared_by").isNull() | F.coalesce("claimed", F.lit(False)), "verified").otherwise("undeclared-but-verified")


def within_tolerance(stated: Column, found: Column, tolerance: Column) -> Column:
    """Equal, or within a relative drift of a stated count above zero."""
    drift = F.abs(found.cast("double") - stated.cast("double")) / F.when(stated != 0, stated.cast("double"))
    return (stated == found) | F.coalesce(drift <= tolerance, F.lit(False))


def grants_origin(allow_origin: Column, origin: str = ORIGIN) -> Column:
    """Whether the header is ``*`` or names our origin."""
    value = F.trim(allow_origin)
    return F.coalesce((value == "*") | (F.lower(value) == origin.lower()), F.lit(False))


def allows_get(allow_methods: Column) -> Column:
    """A missing list grants; else ``*`` or an entry GET."""
    entries = F.transform(F.split(allow_methods, ","), lambda m: F.upper(F.trim(m)))
    return F.coalesce((F.trim(allow_methods) == "*") | F.array_contains(entries, "GET"), F.lit(True))


def grade(d: str = "") -> Column:
    """0 without triples, 4 with entailment, functions or examples, 3 partitions, 2 a dataset, else 1."""
    c = lambda n: F.coalesce(F.col(d + n), F.lit(False))
    return (
        F.when(F.coalesce(F.col(d + "triples"), F.lit(0)) == 0, 0).when(c("has_entailment") | c("has_functions") | c("has_examples"), 4)
        .when(c("has_partitions"), 3).when(c("names_dataset"), 2).otherwise(1)
    )


def resolve() -> Column:
    """The verdict of an observation of any probe kind; absence only from an answered 2xx."""
    ok, claimed = _ok(), F.coalesce(F.col("claimed"), F.lit(False))
    readable = (F.col("body_kind") == "sparql-json") & ok
    some = F.size(F.coalesce("bindings", F.array().cast("array<string>"))) > 0
    got, want = F.col("boolean"), F.col("expect")
    unknown = F.lit("indeterminate")
    matched = F.when(ok, confirmed()).otherwise(unknown)
    ask = (
        F.when(got.isNull(), F.when(claimed, "declared-only").otherwise(unknown))
        .when(want.isNotNull() & (got == want), matched)
        .when(want.isNotNull(), F.when(~ok, unknown).when(claimed, "declared-but-wrong").otherwise("absent"))
        .when(got, matched)
        .otherwise(F.when(ok, "absent").otherwise(unknown))
    )
    void = F.when(~ok, unknown).when(F.col("body_kind") == "rdf", "undeclared-but-verified").otherwise("declared-but-wrong")
    cors = F.when(F.coalesce("cors", F.lit(False)), confirmed()).when(ok, "absent").otherwise(unknown)
    preflight = (
        F.when(F.col("status").isin(405, 501), "absent").when(~ok, unknown)
        .when(grants_origin(F.col("allow_origin")) & allows_get(F.col("allow_methods")), confirmed()).otherwise("absent")
    )
    live = F.when(F.col("body_kind") == "sparql-json", matched).when(ok, "absent").otherwise(unknown)
    described = F.when(some, confirmed()).when(readable, F.when(claimed, "declared-only").otherwise("absent")).otherwise(unknown)
    count = F.when(readable, F.when(F.trim(F.try_element_at("bindings", F.lit(1))).rlike(r"^\+?\d+$"), F.trim(F.try_element_at("bindings", F.lit(1))).try_cast("long")))
    stated = F.col("stated")
    counted = (
        F.when(stated.isNotNull() & count.isNotNull(), F.when(within_tolerance(stated, count, F.col("tolerance")), "verified").otherwise("declared-but-wrong"))
        .when(stated.isNotNull(), "declared-only").when(count == 0, "absent").when(count.isNotNull(), confirmed()).otherwise(unknown)
    )
    select = F.when(some, matched).when(readable, "absent").otherwise(unknown)
    deref = F.when((F.col("body_kind") == "rdf") & ok, "verified").when(F.col("status").isin(404, 410), "absent").otherwise(unknown)
    kind = F.col("kind")
    return (
        F.when(F.coalesce(F.col("expired"), F.lit(False)), unknown)
        .when((kind == "fetch-void") & F.col("error").isNull() & F.col("status").isin(404, 410), "absent")
        .when(F.col("error").isNotNull() | (F.col("body_kind") == "html"), unknown)
        .when(kind.isin("ask-filter", "ask-data"), ask).when(kind == "fetch-void", void).when(kind == "cors", cors).when(kind == "cors-preflight", preflight)
        .when(kind == "liveness", live).when(kind == "vocabulary-described", described).when(kind == "counted", counted)
        .when(kind == "select-iris", select).when(kind == "dereference-endpoint", deref).otherwise(unknown)
    )


def description_level(verdict: Column) -> Column:
    """The level of a fetched description: its grade, 0 if absent, else none."""
    return F.when(verdict == "verified", grade()).when(verdict == "absent", 0)


def with_declared(observations: DataFrame, metrics: DataFrame, declarations: DataFrame) -> DataFrame:
    """Observations with their metric and what the endpoint declares of it.

    ``declarations`` has endpoint, declared ARRAY<STRING>, counts MAP<STRING, LONG>.
    """
    rows = observations.join(metrics, "metric").join(declarations, "endpoint", "left")
    stated = F.when(F.col("kind") == "counted", F.try_element_at("counts", "declared_by"))
    claimed = F.when(F.col("kind") == "counted", stated.isNotNull()).otherwise(F.coalesce(F.array_contains("declared", F.col("declared_by")), F.lit(False)))
    return rows.withColumns({"stated": stated, "claimed": claimed}).drop("declared", "counts")


def score(observations: DataFrame, metrics: DataFrame, declarations: DataFrame) -> DataFrame:
    """A verdict and its severity for every observation."""
    judged = with_declared(observations, metrics, declarations).withColumn("verdict", resolve())
    return judged.withColumn("severity", severity(F.col("verdict")))


def described_from_profiles(profiles: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Whether an endpoint describes its vocabulary, from its property profiles."""
    found = profiles.groupBy("endpoint").agg(F.count("*").alias("n"), F.bool_or(F.col("described")).alias("described"))
    rows = endpoints.select("endpoint", "claimed").join(found, "endpoint", "left")
    return rows.withColumn(
        "verdict",
        F.when(F.col("n").isNull(), "indeterminate").when(F.col("described"), F.when(F.col("claimed"), "verified").otherwise("undeclared-but-verified"))
        .when(F.col("claimed"), "declared-only").otherwise("absent"),
    ).select("endpoint", "verdict")


def _rank(column: Column, values: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("int")
    for k, v in enumerate(values):
        out = F.when(column == v, k).otherwise(out)
    return out


def admit(metrics: DataFrame, max_cost: str, cadence: str) -> DataFrame:
    """The metrics a sweep asks; declined ones with the reason, cost before cadence."""
    reason = (
        F.when(_rank(F.col("cost"), COSTS) > COSTS.index(max_cost), "cost-ceiling")
        .when(_rank(F.col("cadence"), CADENCES) > CADENCES.index(cadence), "cadence")
    )
    return metrics.withColumn("reason", reason)


def liveness_gate(observations: DataFrame, metrics: DataFrame, liveness: str) -> DataFrame:
    """Declines of all other metrics where liveness completed without an HTTP status.

    A failed prober (error ``prober-failed``) declines everything.
    """
    gate = observations.where(F.col("metric") == liveness)
    reason = F.when(F.col("error") == "prober-failed", "prober-failed").when(F.col("status").isNull() & ~F.coalesce(F.col("expired"), F.lit(False)), "liveness-failed")
    closed = gate.withColumn("reason", reason).where("reason is not null").select("endpoint", "reason")
    rows = closed.crossJoin(metrics.select("metric"))
    return rows.where((F.col("reason") == "prober-failed") | (F.col("metric") != liveness)).select("endpoint", "metric", "reason")


def fill_budget(dispatched: DataFrame, readings: DataFrame) -> DataFrame:
    """Dispatched pairs without a row, as indeterminate with no duration."""
    missing = dispatched.select("endpoint", "metric").join(readings.select("endpoint", "metric"), ["endpoint", "metric"], "left_anti")
    return missing.withColumns({"verdict": F.lit("indeterminate"), "elapsed_ms": F.lit(None).cast("long")})


def definition_fingerprint(metrics: DataFrame, columns: list[str], position: str = "position") -> DataFrame:
    """One digest of a metric list; the order counts. The list is a small dimension."""
    line = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns])
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("k"), line.alias("v"))))
    return metrics.agg(F.sha2(F.array_join(F.transform(ordered, lambda s: s["v"]), "\u0003"), 256).alias("fingerprint"))


def term_state(declared: Column, observed: Column) -> Column:
    """Verified, undeclared-but-verified or declared-only."""
    return F.when(declared & observed, VERDICTS[0]).when(observed, VERDICTS[1]).when(declared, VERDICTS[2])


def decisive_term_state(declared: Column, observed: Column, used_decides: Column, declared_decides: Column) -> Column:
    """The same, but indeterminate where the other question did not decide."""
    return (
        F.when(declared & observed, VERDICTS[0]).when(observed, F.when(declared_decides, VERDICTS[1]).otherwise(VERDICTS[5]))
        .when(declared, F.when(used_decides, VERDICTS[2]).otherwise(VERDICTS[5]))
    )
