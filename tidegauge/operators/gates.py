"""Validation gates of an archive: each gives the violations, none means pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.schemas import DQV, NAMESPACE, PROV, RDF_TYPE

#: The predicates that close a section: header, dormancy, endpoint chunk, footer.
TERMINATORS = ("emission", "dormantCount", "completedEndpoint", "finalised")


def _is_activity(subject: Column, namespace: str) -> Column:
    return subject.startswith(f"{namespace}activity:")


def is_terminator(namespace: str = NAMESPACE) -> Column:
    return F.col("p").isin(*[namespace + t for t in TERMINATORS]) & _is_activity(F.col("s"), namespace)


def cuts(quads: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """V1, V2: for each file its last terminator, the tail after it, and whether to refuse it.

    A file without a terminator is kept whole, unless all it states is activities:
    then it is the fragment of a header.
    """
    end = F.max(F.when(is_terminator(namespace), F.col("line_no")))
    files = quads.groupBy("src_file").agg(
        end.alias("cut"), F.max("line_no").alias("lines"), F.bool_and(_is_activity(F.col("s"), namespace)).alias("only_header"), F.count("*").alias("n")
    )
    refused = F.col("cut").isNull() & F.col("only_header")
    return files.select("src_file", F.coalesce("cut", "lines").alias("cut"), (F.col("lines") - F.coalesce("cut", "lines")).alias("discarded"), refused.alias("refused"))


def cut_to_last_terminator(quads: DataFrame, namespace: str = NAMESPACE, ends: DataFrame | None = None) -> DataFrame:
    """V1: the quads up to each file's last terminator; refused files are left out.

    ``ends`` has what ``cuts`` gives, where it is known.
    """
    ends = (cuts(quads, namespace) if ends is None else ends).where("not refused").select("src_file", "cut")
    return quads.join(ends, "src_file").where("line_no <= cut").drop("cut")


def graph_faults(quads: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """V3: files with default-graph quads, or quads of the derived graph."""
    fault = F.when(F.col("g").isNull() | (F.col("g") == ""), "default graph").when(F.col("g") == f"{namespace}current", "derived graph")
    return quads.withColumn("fault", fault).where("fault is not null").groupBy("src_file", "fault").agg(F.count("*").alias("n"))


def governed(quads: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """Endpoints a graph states facts about, in any of four shapes."""
    p, iri = F.col("p"), F.col("o_kind") == "iri"
    objects = quads.where(p.isin(f"{DQV}computedOn", f"{namespace}notMeasuredOn") & iri).select("g", F.col("o").alias("endpoint"))
    subjects = quads.where(p == f"{namespace}declarationsRead").select("g", F.col("s").alias("endpoint"))
    sampled = quads.where(p == f"{namespace}sampledFrom").select("g", "s", F.col("o").alias("endpoint"))
    by = quads.where(p == f"{namespace}sampledBy").select("g", "s").distinct()
    return objects.unionByName(subjects).unionByName(sampled.join(by, ["g", "s"], "left_semi").select("g", "endpoint")).distinct()


def asked(quads: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """The quads that ``governed``, ``dormant`` and the instants of runs are made of, one in six or so of an archive's."""
    named = [f"{DQV}computedOn", f"{PROV}generatedAtTime", *[namespace + n for n in ("notMeasuredOn", "declarationsRead", "sampledFrom", "sampledBy", "dormantEndpoint")]]
    return quads.where(F.col("p").isin(*named) | ((F.col("p") == RDF_TYPE) & (F.col("o") == f"{PROV}Activity")))


def dormant(quads: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    return quads.where(F.col("p") == f"{namespace}dormantEndpoint").select("g", F.col("o").alias("endpoint")).distinct()


def contradictions(quads: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """V4: endpoints that one graph calls dormant and also states facts about."""
    return dormant(quads, namespace).join(governed(quads, namespace), ["g", "endpoint"], "left_semi")


def rewrites(incoming: DataFrame, stored: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """V5: incoming dormancy of endpoints whose stored graph has facts."""
    return dormant(incoming, namespace).join(governed(stored, namespace), ["g", "endpoint"], "left_semi")


def conflicting(facts: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """V7: keys that carry more than one payload."""
    values = facts.groupBy(*keys).agg(F.min(F.struct(*payload)).alias("a"), F.max(F.struct(*payload)).alias("b"))
    return values.where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)


def without_conflicts(facts: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """V7: one row of each key that says one thing; keys that conflict go whole."""
    rest = [c for c in facts.columns if c not in keys and c not in payload]
    values = facts.groupBy(*keys).agg(F.min(F.struct(*payload)).alias("a"), F.max(F.struct(*payload)).alias("b"), *([F.min(F.struct(*rest)).alias("r")] if rest else []))
    return values.where(F.col("a").eqNullSafe(F.col("b"))).select(*keys, "a.*", *(["r.*"] if rest else [])).select(*facts.columns)


def drifted(pointers: DataFrame, facts: DataFrame) -> DataFrame:
    """V8: pointers to a run that no longer states the endpoint's facts."""
    return pointers.join(facts.select("endpoint", "run").distinct(), ["endpoint", "run"], "left_anti")


def dangling(pointers: DataFrame, runs: DataFrame) -> DataFrame:
    """V9: pointers to runs the archive lacks."""
    return pointers.join(runs.select("run"), "run", "left_anti")


def registry_conflicts(claims: DataFrame) -> DataFrame:
    """URLs claimed in more than one role or by more than one owner."""
    return claims.groupBy("url").agg(F.count_distinct("owner", "role").alias("claims")).where("claims > 1")


def outcome_faults(outcomes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Outcomes reported twice, and outcomes of URLs outside the list."""
    twice = outcomes.groupBy("url").agg(F.count("*").alias("n")).where("n > 1").select("url", F.lit("twice").alias("fault"))
    return twice.unionByName(outcomes.join(endpoints.select("url"), "url", "left_anti").select("url", F.lit("not listed").alias("fault")).distinct())


def shape_faults(rows: DataFrame, instant: str, url: str, metric: str) -> DataFrame:
    """Instants, URLs and metric ids that are not of the strict shape."""
    at = F.col(instant).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$") & F.try_to_timestamp(F.col(instant)).isNotNull()
    fault = (
        F.when(~F.coalesce(at, F.lit(False)), "instant")
        .when(~F.coalesce(F.col(url).rlike(r"^https?://[^\s/?#]+\S*$"), F.lit(False)), "url")
        .when(~F.coalesce(F.col(metric).rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False)), "metric")
    )
    return rows.withColumn("fault", fault).where("fault is not null")
