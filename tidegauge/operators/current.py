"""Newest-wins state: one row per key out of the whole history.

Every top-1 is a maximum of a struct, not a window: Spark combines it before the
shuffle, so a key with most of the history costs one row per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.schemas import NAMESPACE, is_policy
from tidegauge.session import materialise

PAIR = ["endpoint", "metric"]


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that is greatest by ``order``; ties go to the greater row."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], F.struct(*rest).alias("row"))
    return df.groupBy(*keys).agg(F.max(rank).alias("top")).select(*keys, "top.row.*").select(*df.columns)


def current_run(facts: DataFrame) -> DataFrame:
    """The newest run that recorded anything of each endpoint."""
    return facts.groupBy("endpoint").agg(F.max(F.struct("run_at", "run")).alias("m")).select("endpoint", "m.run", "m.run_at")


def newest_measured(readings: DataFrame) -> DataFrame:
    """The newest measured reading of each pair."""
    return newest(readings.where("kind = 'measured'"), PAIR, [F.col("run_at")])


def newest_decline(readings: DataFrame) -> DataFrame:
    """The newest decline of each pair; what was seen beats what was chosen, however old."""
    return newest(readings.where("kind = 'declined'"), PAIR, [~is_policy(F.col("reason")), F.col("run_at")])


def current_readings(readings: DataFrame) -> DataFrame:
    """C4: a measurement if the pair ever had one, else its best decline."""
    return newest(readings, PAIR, [F.col("kind") == "measured", ~is_policy(F.col("reason")), F.col("run_at")])


def ties(facts: DataFrame, keys: list[str]) -> DataFrame:
    """V6: keys whose newest instant is stated by more than one run."""
    per_instant = facts.groupBy(*keys, "run_at").agg(F.min("run").alias("a"), F.max("run").alias("b"))
    top = per_instant.groupBy(*keys).agg(F.max(F.struct("run_at", "a", "b")).alias("m"))
    return top.where("m.a <> m.b").select(*keys, "m.run_at", F.col("m.a").alias("run_a"), F.col("m.b").alias("run_b"))


def refuse_ties(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The facts, or an error when a newest run cannot be told."""
    found = ties(facts, keys).limit(3).collect()
    if found:
        raise ValueError(f"runs with one instant are both newest: {found}")
    return facts


def sample_pointers(samples: DataFrame) -> DataFrame:
    """The newest run that sampled each pair."""
    return samples.groupBy(*PAIR).agg(F.max(F.struct("run_at", "run")).alias("m")).select(*PAIR, "m.run", "m.run_at")


def document_pointers(documents: DataFrame) -> DataFrame:
    """The newest run of each endpoint for each kind of document, independently."""
    return documents.groupBy("endpoint", "doc_kind").agg(F.max(F.struct("run_at", "run")).alias("m")).select("endpoint", "doc_kind", "m.run", "m.run_at")


def latest_declarations(facts: DataFrame, declarations: DataFrame) -> DataFrame:
    """The declarations of each endpoint's current run, null where it has none."""
    return current_run(facts).join(declarations.drop("run_at"), ["endpoint", "run"], "left")


def rebuild_current(quads: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """Current readings from all quads of an archive; runs that tie for newest are refused."""
    from tidegauge.operators import facts, gates

    # Both the check and the result read them.
    readings = materialise(facts.readings(gates.cut_to_last_terminator(quads, namespace), namespace), "readings")
    return current_readings(refuse_ties(readings, PAIR))


def merge_current(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Current state with new runs; the order of arrival does not matter.

    What a run that is loaded again says of a pair takes the place of what it said
    before; where the old text made the state, ``advance_current`` derives it anew.
    """
    again = delta.select(*PAIR, "run").distinct()
    return current_readings(current.join(again, [*PAIR, "run"], "left_anti").unionByName(delta))


def advance_current(current: DataFrame, delta: DataFrame, reloaded: DataFrame, archive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Current state with new runs, some of them (``reloaded``, column run) loaded again.

    Only pairs whose state came from a reloaded run can change otherwise than by a
    merge: what it said before may have hidden an older run. They are derived from
    ``archive``, which gets their keys (endpoint, metric) and gives the readings of the
    whole history that state them, the new text in place.
    """
    again = reloaded.select("run").distinct()
    stale = current.join(again, "run", "left_semi").select(*PAIR).distinct()
    kept = current.join(again, "run", "left_anti").select(*current.columns)
    merged = current_readings(kept.unionByName(delta.join(stale, PAIR, "left_anti")))
    return merged.unionByName(current_readings(archive(stale).join(stale, PAIR, "left_semi")))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("endpoint"), F.lit(buckets))


def differing_buckets(current: DataFrame, derived: DataFrame, buckets: int) -> list[int]:
    """Buckets of endpoints whose rows differ, by checksums that do not hang on order; ``buckets`` numbers at most."""
    content = F.xxhash64(*sorted(current.columns))
    sums = [df.groupBy(_bucket(buckets).alias("bucket")).agg(F.struct(F.count("*"), F.bit_xor(content), F.sum(F.shiftright(content, 24))).alias(name)) for df, name in ((current, "stored"), (derived, "fresh"))]
    both = sums[0].join(sums[1], "bucket", "full_outer").where(~F.col("stored").eqNullSafe(F.col("fresh")))
    return sorted(r["bucket"] for r in both.select("bucket").collect())


def check_current(current: DataFrame, derived: DataFrame, buckets: int = 1024) -> DataFrame:
    """Endpoints whose stored state differs from a fresh derivation, and how.

    Checksums of buckets of endpoints are compared first; only rows of buckets that
    differ are then joined, and derived again.
    """
    wanted = _bucket(buckets).isin(differing_buckets(current, derived, buckets))
    frames = ((current.where(wanted), "stored"), (derived.where(wanted), "fresh"))
    left, right = (df.select(*PAIR, F.struct(*[c for c in current.columns if c not in PAIR]).alias(n)) for df, n in frames)
    both = left.join(right, PAIR, "full_outer")
    reason = (
        F.when(F.col("fresh").isNull(), "not in the archive").when(F.col("stored").isNull(), "missing").when(~F.col("stored").eqNullSafe(F.col("fresh")), "differs")
    )
    return both.withColumn("reason", reason).where("reason is not null").groupBy("endpoint").agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.count("*").alias("pairs"))


def kept_newer(current: DataFrame, delta: DataFrame) -> DataFrame:
    """C11: pairs of a delta that current already states from a newer run."""
    newer = current.select(*PAIR, F.col("run_at").alias("current_at"))
    late = delta.groupBy(*PAIR).agg(F.max("run_at").alias("delta_at"))
    return late.join(newer, PAIR).where("current_at > delta_at")


def newest_sample(samples: DataFrame, preferred: str = "class-profiles") -> DataFrame:
    """The newest sample of each endpoint across metrics; equal instants prefer one metric."""
    return newest(samples, ["endpoint"], [F.col("run_at"), F.col("metric") == preferred])


def pinned_runs(current_quads: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs that current names, by run or activity, as subject or object."""
    named = current_quads.select(F.col("s").alias("name")).union(current_quads.select("o")).distinct()
    long = runs.select("run", F.explode(F.array("run", "activity")).alias("name"))
    return long.join(named, "name", "left_semi").select("run").distinct()


def prune_plan(runs: DataFrame, pinned: DataFrame, verified_days: DataFrame, keep_days: int = 3) -> DataFrame:
    """C14: runs of closed, verified days that nothing pins; with the quads each day frees.

    ``runs`` has run, day, quads; ``verified_days`` has day.
    """
    open_days = runs.select("day").distinct().orderBy(F.desc("day")).limit(keep_days)
    closed = runs.join(F.broadcast(open_days), "day", "left_anti")
    free = closed.join(verified_days.select("day").distinct(), "day", "left_semi").join(pinned.select("run"), "run", "left_anti")
    return free.groupBy("day").agg(F.count("*").alias("runs"), F.sum("quads").alias("quads"))
