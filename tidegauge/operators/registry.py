"""Registry cleaning: dedupe, refusals with counts, names, aliases and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import text as t
from tidegauge.schemas import is_positive

SEED_RULES = ("credentials", "excluded", "unroutable", "reserved", "unpublishable")
LOAD_RULES = ("credentials", "excluded", "reserved", "unpublishable")


def dedupe(candidates: DataFrame) -> DataFrame:
    """G1: the first row of each URL by position."""
    rest = [c for c in candidates.columns if c not in ("url", "position")]
    first = candidates.groupBy("url").agg(F.min(F.struct("position", *rest)).alias("r"))
    return first.select("url", "r.*").select(*candidates.columns)


def _rule(name: str) -> Column:
    url = F.col("url")
    if name == "credentials":
        return t.userinfo(url) != ""
    if name == "excluded":
        return F.col("_excluded").isNotNull()
    if name == "unroutable":
        return t.unroutable(url).isNotNull()
    if name == "reserved":
        return t.reserved_name(url).isNotNull()
    if name == "unpublishable":
        return ~F.coalesce(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:[^\\x00-\\x20<>\"{}|\\\\^`]+$"), F.lit(False))
    raise ValueError(f"no such rule: {name}")


def refusals(candidates: DataFrame, exclusions: DataFrame, rules: tuple[str, ...] = SEED_RULES) -> DataFrame:
    """Each candidate with the first rule that refuses it, or null.

    The order of the rules decides which one is charged.
    """
    hosts = exclusions.select(F.lower("host").alias("_excluded")).distinct()
    keyed = candidates.withColumn("_host", F.regexp_replace(t.host(F.col("url")), "\\.$", "")).join(hosts, F.col("_host") == F.col("_excluded"), "left")
    refused = F.lit(None).cast("string")
    for name in reversed(rules):
        refused = F.when(_rule(name), name).otherwise(refused)
    return keyed.withColumn("refused", refused).drop("_host", "_excluded")


def refusal_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("refused", F.lit("kept")).alias("rule")).agg(F.count("*").alias("n"))


def balanced(candidates: DataFrame, judged: DataFrame) -> DataFrame:
    """One row: distinct, refused, kept, and whether the first is the sum of the others."""
    total = candidates.agg(F.count_distinct("url").alias("distinct"))
    parts = judged.agg(F.count("refused").alias("refused"), F.count_if(F.col("refused").isNull()).alias("kept"))
    return total.crossJoin(parts).withColumn("balanced", F.col("distinct") == F.col("refused") + F.col("kept"))  # one row each


def dump_digests(files: DataFrame, claims: DataFrame) -> DataFrame:
    """Dump files (path, content) whose digest is not the one claimed (path, sha256)."""
    own = files.select("path", F.sha2("content", 256).alias("found"))
    return claims.join(own, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("found")))


def candidate_attributes(candidates: DataFrame) -> DataFrame:
    """A title if exactly one dataset names the URL, else the number of datasets; the first domain."""
    per_url = candidates.groupBy("url").agg(
        F.count_distinct("dataset").alias("datasets"), F.min_by("title", "position").alias("title"),
        F.min(F.when(F.col("domain").isNotNull(), F.struct("position", "domain"))).alias("d"),
    )
    one = F.col("datasets") == 1
    return per_url.select("url", F.when(one, F.col("title")).alias("title"), F.when(~one, F.col("datasets")).alias("datasets"), F.col("d.domain").alias("domain"))


def merge_names(entries: DataFrame) -> DataFrame:
    """One name per URL out of several files, folded in order of position.

    The domain is the first known one. Title and dataset count travel together
    when only one side has a title; else each keeps its first known value.
    """
    row = F.struct("position", "title", "domain", "datasets")

    def first(known: Column) -> Column:
        return F.min(F.when(known, row))

    # With a title anywhere, counts of entries without one do not survive the fold.
    titled, counted = F.col("title").isNotNull(), F.col("datasets").isNotNull()
    firsts = entries.groupBy("url").agg(first(titled).alias("t"), first(F.col("domain").isNotNull()).alias("d"), first(counted).alias("n"), first(titled & counted).alias("tn"))
    datasets = F.when(F.col("t").isNotNull(), F.col("tn.datasets")).otherwise(F.col("n.datasets"))
    return firsts.select("url", "t.title", "d.domain", datasets.alias("datasets"))


def resolve_aliases(readings: DataFrame, aliases: DataFrame) -> DataFrame:
    """Readings under the preferred endpoint of each alias (url, preferred)."""
    named = aliases.select(F.col("url").alias("endpoint"), "preferred").dropDuplicates(["endpoint"])
    return readings.join(named, "endpoint", "left").withColumn("endpoint", F.coalesce("preferred", "endpoint")).drop("preferred")


def narrow(registry: DataFrame, requested: DataFrame) -> DataFrame:
    """The active entries that are asked for; an unknown request is an error."""
    unknown = requested.select("url").join(registry, "url", "left_anti").limit(3).collect()
    if unknown:
        raise ValueError(f"not in the registry: {[r['url'] for r in unknown]}")
    return registry.where("inactive is null").join(requested.select("url"), "url", "left_semi")


def alive_candidates(candidates: DataFrame, readings: DataFrame, swept: DataFrame, metric: str) -> DataFrame:
    """Candidates that answered and are not swept yet."""
    up = readings.where((F.col("metric") == metric) & is_positive(F.col("verdict"))).select(F.col("endpoint").alias("url")).distinct()
    return candidates.join(up, "url", "left_semi").join(swept.select("url"), "url", "left_anti")


def host_groups(rows: DataFrame) -> DataFrame:
    """Endpoints of each host and their serial cost (columns url, cost_ms)."""
    return rows.groupBy(t.host_key(F.col("url")).alias("host")).agg(F.count_distinct("url").alias("endpoints"), F.sum("cost_ms").alias("serial_ms"))
