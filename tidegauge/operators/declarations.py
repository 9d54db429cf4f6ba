"""What description documents declare, read from their triples, one document per graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.text import same_endpoint_key
from tidegauge.schemas import RDF_TYPE, SD, VOID
from tidegauge.session import materialise

#: Predicates that lead from a service to the nodes that describe it.
LINKING = (
    f"{VOID}classPartition", f"{VOID}propertyPartition", f"{SD}defaultDataset", f"{SD}availableGraphs",
    f"{SD}namedGraph", f"{SD}defaultGraph", f"{SD}graph", f"{SD}graphCollection",
)


def document_flags(triples: DataFrame) -> DataFrame:
    """What each document states anywhere, and its triples."""
    has = lambda *p: F.bool_or(F.col("p").isin(*p))
    return triples.groupBy("g").agg(
        F.count("*").alias("triples"), has(f"{SD}defaultDataset", f"{SD}graph").alias("names_dataset"), has(f"{SD}defaultEntailmentRegime").alias("has_entailment"),
        has(f"{VOID}exampleResource").alias("has_examples"), has(f"{SD}extensionFunction").alias("has_functions"),
        has(f"{VOID}classPartition", f"{VOID}propertyPartition").alias("has_partitions"),
    )


def scope(triples: DataFrame, endpoints: DataFrame, rounds: int = 64) -> DataFrame:
    """The subjects (g, s) of each document that speak of its endpoint.

    ``endpoints`` has g and endpoint. Without a service, or with a single one that
    does not match, the whole document counts; with several of which none matches,
    nothing does. Otherwise: the matched services and what they reach over linking
    predicates, not through another service. All documents are closed together, a
    round per step; a chain longer than ``rounds`` is an error.
    """
    service = triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == f"{SD}Service") & (F.col("o_kind") == "iri")).select("g", "s")
    named = triples.where(F.col("p") == f"{SD}endpoint").select("g", "s", "o", "o_kind")
    services = materialise(service.unionByName(named.select("g", "s")).distinct(), "services")
    matched = named.where("o_kind = 'iri'").join(endpoints, "g").where(same_endpoint_key(F.col("o")) == same_endpoint_key(F.col("endpoint"))).select("g", "s").distinct()
    matched = materialise(matched, "reached")
    counts = services.groupBy("g").agg(F.count("*").alias("services")).join(matched.groupBy("g").agg(F.count("*").alias("matches")), "g", "left")
    several = materialise(endpoints.select("g").distinct().join(counts, "g", "left"), "scopes")
    whole = several.where("services is null or (matches is null and services = 1)").select("g")

    links = triples.where(F.col("p").isin(*LINKING) & (F.col("o_kind") != "literal")).select("g", "s", F.col("o").alias("next"))
    foreign = services.join(matched, ["g", "s"], "left_anti").withColumnRenamed("s", "next")
    links = materialise(links.join(foreign, ["g", "next"], "left_anti"), "links")
    reached = frontier = matched
    for _ in range(rounds):
        step = links.join(frontier, ["g", "s"]).select("g", F.col("next").alias("s")).distinct().join(reached, ["g", "s"], "left_anti")
        frontier = materialise(step, "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    else:
        raise ValueError(f"descriptions are linked over more than {rounds} steps")
    every = triples.join(whole, "g", "left_semi").select("g", "s").distinct()
    return every.unionByName(reached)


def scoped_sets(triples: DataFrame, scoped: DataFrame) -> DataFrame:
    """Features, functions, languages and partitioned terms in scope; IRIs only."""
    names = {
        "features": f"{SD}feature", "functions": f"{SD}extensionFunction", "languages": f"{SD}supportedLanguage", "classes": f"{VOID}class", "properties": f"{VOID}property",
    }
    rows = triples.where(F.col("p").isin(*names.values()) & (F.col("o_kind") == "iri")).join(scoped, ["g", "s"], "left_semi")
    return rows.groupBy("g").agg(*[F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o")))).alias(n) for n, p in names.items()])


def scoped_counts(triples: DataFrame, scoped: DataFrame) -> DataFrame:
    """D3: declared triples, classes and entities (the last that parses), and named graphs."""
    names = {"triples": f"{VOID}triples", "classes": f"{VOID}classes", "entities": f"{VOID}entities"}
    rows = triples.where(F.col("p").isin(*names.values(), f"{SD}namedGraph")).join(scoped, ["g", "s"], "left_semi")
    value = F.when(F.col("o_kind") == "literal", F.when(F.trim("o").rlike(r"^\+?\d+$"), F.trim("o").try_cast("long")))
    last = [F.max(F.when((F.col("p") == p) & value.isNotNull(), F.struct("line_no", value.alias("v"))))["v"].alias(n) for n, p in names.items()]
    graphs = F.count_if(F.col("p") == f"{SD}namedGraph")
    return rows.groupBy("g").agg(*last, F.when(graphs > 0, graphs).alias("named_graphs"))
