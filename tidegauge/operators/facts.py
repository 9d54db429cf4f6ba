"""Typed facts out of quads. A node's properties come together in one aggregate.

The star joins of the query language become conditional aggregation: one shuffle
by (graph, subject), whatever the number of properties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.schemas import DQV, NAMESPACE, PROV, RDF_TYPE, VOID
from tidegauge.functions.text import same_endpoint_key


def star(quads: DataFrame, one: dict[str, str], many: dict[str, str] | None = None, types: tuple[str, ...] = ()) -> DataFrame:
    """Nodes (g, s) with a column for each property, and sorted arrays for repeated ones.

    Only quads of the wanted properties are shuffled.
    """
    many = many or {}
    wanted = [*one.values(), *many.values(), *([RDF_TYPE] if types else [])]
    columns = [F.max(F.when(F.col("p") == p, F.col("o"))).alias(c) for c, p in one.items()]
    columns += [F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o")))).alias(c) for c, p in many.items()]
    if types:
        columns.append(F.bool_or((F.col("p") == RDF_TYPE) & F.col("o").isin(*types)).alias("_typed"))
    nodes = quads.where(F.col("p").isin(*wanted)).groupBy("g", "s").agg(*columns)
    return nodes.where("_typed").drop("_typed") if types else nodes


def _required(df: DataFrame, *names: str) -> DataFrame:
    return df.where(reduce(Column.__and__, [F.col(n).isNotNull() for n in names]))


def _last(column: Column) -> Column:
    return F.regexp_extract(column, "([^:/#]+)$", 1)


def truth(column: Column) -> Column:
    """``true`` and ``1`` are both true."""
    return F.when(column.isNotNull(), column.isin("true", "1"))


def runs(quads: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """one row per run."""
    one = {
        "at": f"{PROV}generatedAtTime", "emission": f"{ns}emission", "fin": f"{ns}finalised", "max_cost": f"{ns}maxCost", "conc": f"{ns}concurrency",
        "failed": f"{ns}failedEndpoints", "dorm": f"{ns}dormantCount", "prober_version": f"{ns}proberVersion", "metric_revision": f"{ns}metricDefinitionRevision",
    }
    rows = _required(star(quads, one, types=(f"{PROV}Activity",)), "at")
    return rows.select(
        F.col("g").alias("run"), F.col("s").alias("activity"), F.to_timestamp("at").alias("run_at"), "emission", truth(F.col("fin")).alias("finalised"), "max_cost",
        F.col("conc").cast("int").alias("concurrency"), F.col("failed").cast("int").alias("failed_endpoints"), F.col("dorm").cast("int").alias("dormant_count"),
        "prober_version", "metric_revision",
    )


def measurements(quads: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """measurements; endpoint, metric and verdict are required, the rest optional."""
    one = {
        "endpoint": f"{DQV}computedOn", "of": f"{DQV}isMeasurementOf", "verdict": f"{DQV}value", "lv": f"{ns}level", "ms": f"{ns}elapsedMs",
        "dc": f"{ns}declaredCount", "oc": f"{ns}observedCount",
    }
    rows = _required(star(quads, one, types=(f"{DQV}QualityMeasurement",)), "endpoint", "of", "verdict")
    return rows.select(
        F.col("g").alias("run"), "endpoint", _last(F.col("of")).alias("metric"), F.lit("measured").alias("kind"), "verdict", F.col("lv").cast("int").alias("level"),
        F.col("ms").cast("long").alias("elapsed_ms"), F.col("dc").cast("long").alias("declared_count"), F.col("oc").cast("long").alias("observed_count"),
    )


def declines(quads: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """what a run did not measure, and why."""
    one = {"endpoint": f"{ns}notMeasuredOn", "of": f"{ns}notMeasuredMetric", "reason": f"{ns}notMeasuredReason"}
    rows = _required(star(quads, one, types=(f"{ns}NotMeasured",)), "endpoint", "of", "reason")
    return rows.select(F.col("g").alias("run"), "endpoint", _last(F.col("of")).alias("metric"), F.lit("declined").alias("kind"), "reason")


def readings(quads: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """measurements and declines with the instant of their run."""
    both = measurements(quads, ns).unionByName(declines(quads, ns), allowMissingColumns=True)
    return both.join(runs(quads, ns).select("run", "run_at"), "run", "left")


def samples(quads: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """content samples; one without values stays, with an empty list."""
    one = {"endpoint": f"{ns}sampledFrom", "by": f"{ns}sampledBy", "sz": f"{ns}sampleSize", "tr": f"{ns}sampleTruncated"}
    rows = _required(star(quads, one, {"values": f"{ns}sampledValue"}, (f"{ns}ContentSample",)), "endpoint", "by")
    return rows.select(F.col("g").alias("run"), "endpoint", _last(F.col("by")).alias("metric"), F.col("sz").cast("long").alias("size"), truth(F.col("tr")).alias("truncated"), "values")


def class_profiles(quads: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """class profiles."""
    one = {
        "endpoint": f"{ns}profiledFrom", "by": f"{ns}profiledBy", "class": f"{ns}profiledClass", "sampling": f"{ns}profileSampling",
        "sampling_prefix": f"{ns}profileSamplingPrefix", "dn": f"{ns}profileDenominator",
    }
    rows = _required(star(quads, one), "endpoint", "class", "sampling")
    return rows.select(F.col("g").alias("run"), F.col("s").alias("node"), "endpoint", _last(F.col("by")).alias("metric"), "class", "sampling", "sampling_prefix", F.col("dn").cast("long").alias("denominator"))


def property_profiles(quads: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """property rows of the class profiles."""
    one = {"property": f"{ns}property", "sc": f"{ns}subjectCount", "dc": f"{ns}datatypeCount", "any_datatype": f"{ns}anyDatatype"}
    rows = _required(star(quads, one), "property", "sc").select(F.col("g").alias("run"), F.col("s").alias("row"), "property", F.col("sc").cast("long").alias("subjects"), F.col("dc").cast("long").alias("datatypes"), "any_datatype")
    held = quads.where(F.col("p") == f"{ns}profileProperty").select(F.col("g").alias("run"), F.col("s").alias("node"), F.col("o").alias("row"))
    parents = class_profiles(quads, ns).select("run", "node", "endpoint", "class", "sampling")
    return rows.join(held, ["run", "row"]).join(parents, ["run", "node"]).drop("row", "node")


def declarations(quads: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """whether declarations were read, from where, and what they name."""
    rows = star(quads, {"rd": f"{ns}declarationsRead", "source": f"{ns}descriptionSource"}, {"classes": f"{ns}declaredClass", "properties": f"{ns}declaredProperty"})
    return _required(rows, "rd").select(F.col("g").alias("run"), F.col("s").alias("endpoint"), truth(F.col("rd")).alias("read"), "source", "classes", "properties")


def documents(quads: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """F8: pointers to copied documents; all but the source is optional."""
    one = {
        "vs": f"{ns}voidSource", "vv": f"{ns}voidValid", "vg": f"{ns}voidGraph", "vt": f"{ns}voidTriples", "vd": f"{ns}voidDataset", "vn": f"{ns}voidDeclaredTriples",
        "ds": f"{ns}descriptionSource", "dg": f"{ns}descriptionGraph",
    }
    rows = star(quads, one)
    none = F.lit(None)
    void = rows.where("vs is not null").select(
        F.col("g").alias("run"), F.col("s").alias("endpoint"), F.lit("void").alias("doc_kind"), F.col("vs").alias("source"), truth(F.col("vv")).alias("valid"), F.col("vg").alias("graph"),
        F.col("vt").cast("long").alias("triples"), F.col("vd").alias("dataset"), F.col("vn").cast("long").alias("declared_triples"),
    )
    described = rows.where("ds is not null").select(
        F.col("g").alias("run"), F.col("s").alias("endpoint"), F.lit("description").alias("doc_kind"), F.col("ds").alias("source"), none.cast("boolean").alias("valid"), F.col("dg").alias("graph"),
        none.cast("long").alias("triples"), none.cast("string").alias("dataset"), none.cast("long").alias("declared_triples"),
    )
    return void.unionByName(described)


def dormancy(quads: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """endpoints a run did not ask."""
    rows = _required(star(quads, {"reason": f"{ns}dormancyReason", "since": f"{ns}dormantSince", "probed": f"{ns}lastProbed"}), "reason")
    return rows.select(F.col("g").alias("run"), F.col("s").alias("endpoint"), "reason", F.to_timestamp("since").alias("dormant_since"), F.to_timestamp("probed").alias("last_probed"))


def completions(quads: DataFrame, ns: str = NAMESPACE) -> DataFrame:
    """endpoints a run finished."""
    return quads.where(F.col("p") == f"{ns}completedEndpoint").select(F.col("g").alias("run"), F.col("o").alias("endpoint")).distinct()


def document_triples(quads: DataFrame, graphs: DataFrame) -> DataFrame:
    """the triples of copied documents (graphs: column graph)."""
    return quads.join(graphs.select(F.col("graph").alias("g")).distinct(), "g", "left_semi")


def void_claims(quads: DataFrame, endpoints: DataFrame, exact: bool = True) -> DataFrame:
    """for each copied document, the dataset that names exactly this endpoint, and its triples.

    ``endpoints`` has g (the document's graph) and endpoint. The first such dataset
    by line counts; its void:triples may stand anywhere in the document.
    """
    named = quads.where(F.col("p") == f"{VOID}sparqlEndpoint").select("g", F.col("s").alias("dataset"), F.col("o").alias("named"), "line_no").join(endpoints, "g")
    same = (F.col("named") == F.col("endpoint")) if exact else same_endpoint_key(F.col("named")) == same_endpoint_key(F.col("endpoint"))
    first = named.where(same).groupBy("g", "endpoint").agg(F.min_by("dataset", "line_no").alias("dataset"))
    count = quads.where(F.col("p") == f"{VOID}triples").select("g", F.col("s").alias("dataset"), F.col("o").try_cast("long").alias("n"), "line_no").where("n >= 0")
    count = count.groupBy("g", "dataset").agg(F.min_by("n", "line_no").alias("declared_triples"))
    return endpoints.join(first, ["g", "endpoint"], "left").join(count, ["g", "dataset"], "left").select("g", "endpoint", "dataset", "declared_triples")
