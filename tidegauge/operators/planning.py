"""Sweep planning: what to ask, and the keyed state that decides it.

State columns: url, strikes, strikes_before_last, last_probed, last_cost_ms,
last_triples, last_classes, last_profiled_at, dormant_since (timestamps),
hold STRUCT<state, reason, until>, lapsed_hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.rotation import due_today
from tidegauge.operators.gates import outcome_faults

STATE = (
    "url string, strikes int, strikes_before_last int, last_probed timestamp, last_cost_ms long, last_triples long, last_classes long, "
    "last_profiled_at timestamp, dormant_since timestamp, hold struct<state: string, reason: string, until: timestamp>, lapsed_hold string"
)


@dataclass(frozen=True)
class Thresholds:
    """strikes and cost make an endpoint dormant; dormant ones are asked every cadence_days."""

    strikes: int = 3
    cost_ms: int = 30_000
    cadence_days: int = 7
    grace_days: int = 14


def _hold(now: Column) -> Column:
    """none, dormant, awake or lapsed."""
    held = F.col("hold.state")
    return (
        F.when(held == "dormant", "dormant").when((held == "awake") & (F.col("hold.until").isNull() | (F.to_date("hold.until") >= F.to_date(now))), "awake")
        .when(held == "awake", "lapsed").otherwise("none")
    )


def _places(queue: DataFrame) -> DataFrame:
    """The place of each url in the order of (last_probed, url), nulls first, without one sort of them all.

    Counted by days (in one row), inside a day by instants and the first letters of
    the URLs, and sorted only inside these.
    """
    rows = queue.withColumns({"day": F.to_date("last_probed"), "part": F.substring("url", 1, 16)})
    parts = rows.groupBy("day", "last_probed", "part").agg(F.count("*").alias("n"))
    days = parts.groupBy("day").agg(F.sum("n").alias("n")).agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("all"))
    days = days.select("all", F.posexplode("all").alias("k", "d")).select(
        F.col("d.day").alias("that"), F.aggregate(F.slice("all", 1, F.col("k")), F.lit(0).cast("long"), lambda total, d: total + d["n"]).alias("earlier")
    )
    inside = Window.partitionBy("day").orderBy(F.col("last_probed").asc_nulls_first(), "part")
    parts = parts.withColumn("before", F.sum("n").over(inside) - F.col("n")).join(days, F.col("day").eqNullSafe(F.col("that")))
    parts = parts.select(F.col("last_probed").alias("at"), F.col("part").alias("in"), (F.col("before") + F.col("earlier")).alias("before"))
    placed = rows.withColumn("k", F.row_number().over(Window.partitionBy("last_probed", "part").orderBy("url")))
    return placed.join(parts, F.col("last_probed").eqNullSafe(F.col("at")) & (F.col("part") == F.col("in"))).select("url", (F.col("k") + F.col("before")).alias("place"))


def plan(state: DataFrame, endpoints: DataFrame, now: Column, thresholds: Thresholds = Thresholds(), full: bool = True, last_sweep: Column | None = None) -> DataFrame:
    """Each endpoint with action (probe or skip) and the reason of a skip.

    A cheap sweep skips only what an operator holds. A replayed instant asks what it
    asked before. Dormant endpoints are asked in slices: those due, oldest first, as
    many as the cadence needs for the gap since the last sweep.
    """
    rows = endpoints.select("url").distinct().join(state, "url", "left").withColumn("effect", _hold(now))
    governed = F.col("dormant_since").isNotNull() & F.col("effect").isin("none", "lapsed")
    due = governed & (F.col("last_probed").isNull() | (F.datediff(now, "last_probed") >= thresholds.cadence_days))
    gap = F.lit(1) if last_sweep is None else F.greatest(F.coalesce(F.datediff(now, last_sweep), F.lit(1)), F.lit(1))
    totals = rows.agg(F.count_if(governed).alias("governed"), F.coalesce(F.bool_or(F.col("last_probed") == now), F.lit(False)).alias("replay"))
    size = F.greatest(F.least(F.ceil(F.col("governed") * gap / F.lit(float(thresholds.cadence_days))), F.col("governed")), F.lit(1))
    totals = totals.select("replay", F.when(F.col("governed") > 0, size).otherwise(0).alias("slice"))
    # The slice is the due endpoints up to a place; the order is total.
    admitted = _places(rows.where(due).select("url", "last_probed"))
    judged = rows.join(admitted, "url", "left").crossJoin(F.broadcast(totals))  # one row
    reason = F.when(F.col("effect") == "dormant", "operator-hold")
    if full:
        reason = (
            reason.when(F.col("replay"), F.when(F.col("last_probed").eqNullSafe(now), None).otherwise("not-in-this-sweep"))
            .when((F.col("effect") == "awake") | F.col("dormant_since").isNull(), None)
            .when(F.coalesce(F.col("place") <= F.col("slice"), F.lit(False)), None).otherwise("automatic")
        )
    return judged.withColumn("reason", reason).select("url", F.when(F.col("reason").isNull(), "probe").otherwise("skip").alias("action"), "reason", "dormant_since", "last_probed")


def update(state: DataFrame, endpoints: DataFrame, outcomes: DataFrame, now: Column, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """The state after a sweep.

    ``outcomes`` has url, cost_ms, positive, triples, classes, profiled,
    liveness_failed. An older sweep than an endpoint's newest changes nothing; the
    same instant again counts from the strikes before it.
    """
    faults = outcome_faults(outcomes, endpoints).limit(3).collect()
    if faults:
        raise ValueError(f"outcomes that cannot be applied: {faults}")
    mine = outcomes.join(endpoints.select("url").distinct(), "url", "left_semi").withColumn("_seen", F.lit(True))
    rows = state.withColumn("_known", F.lit(True)).join(mine, "url", "full_outer").withColumn("_effect", _hold(now))
    lapsed = F.col("_effect") == "lapsed"
    zero = F.lit(0)
    strikes = F.when(lapsed, zero).otherwise(F.coalesce("strikes", zero))
    before = F.when(lapsed, zero).otherwise(F.coalesce("strikes_before_last", zero))
    replay = F.coalesce(F.col("last_probed") == now, F.lit(False))
    applied = F.coalesce(F.col("_seen"), F.lit(False)) & (F.col("_effect") != "dormant") & ~F.coalesce(F.col("last_probed") > now, F.lit(False))
    base = F.when(replay, before).otherwise(strikes)
    struck = ~F.col("positive") & ((F.col("cost_ms") > thresholds.cost_ms) | F.col("liveness_failed"))
    after = F.when(struck, base + 1).otherwise(zero)
    asleep = struck & (after >= thresholds.strikes) & F.col("dormant_since").isNull() & (F.col("_effect") != "awake")
    take = lambda new, old: F.when(applied, new).otherwise(old)
    return rows.select(
        "url", take(after, strikes).cast("int").alias("strikes"), take(base, before).cast("int").alias("strikes_before_last"),
        take(now.cast("timestamp"), F.col("last_probed")).alias("last_probed"), take(F.col("cost_ms"), F.col("last_cost_ms")).alias("last_cost_ms"),
        take(F.coalesce("triples", "last_triples"), F.col("last_triples")).alias("last_triples"), take(F.coalesce("classes", "last_classes"), F.col("last_classes")).alias("last_classes"),
        F.when(applied & F.col("profiled"), now.cast("timestamp")).otherwise(F.col("last_profiled_at")).alias("last_profiled_at"),
        F.when(applied & F.col("positive"), F.lit(None).cast("timestamp")).when(applied & asleep, now.cast("timestamp")).otherwise(F.col("dormant_since")).alias("dormant_since"),
        F.when(~lapsed, F.col("hold")).alias("hold"), F.when(lapsed, F.col("hold.reason")).otherwise(F.col("lapsed_hold")).alias("lapsed_hold"),
    )


def replay(outcomes: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """W3 over history: the state of each endpoint after all its outcomes in time order.

    ``outcomes`` has url, at, cost_ms, positive, liveness_failed. Of two outcomes of
    one instant the greater row counts.

    Days are summed up first: whether an outcome cleared the strikes, how many stand
    before the first clearing, how many after the last. What a day inherits follows from
    the summaries of the days before it, so no task holds more of an endpoint than its
    outcomes of a day, or a row for each of its days.
    """
    once = outcomes.groupBy("url", "at").agg(F.max(F.struct("positive", "cost_ms", "liveness_failed")).alias("o"))
    struck = ~F.col("o.positive") & ((F.col("o.cost_ms") > thresholds.cost_ms) | F.col("o.liveness_failed"))
    rows = once.select("url", F.to_date("at").alias("day"), "at", F.coalesce(struck, F.lit(False)).alias("struck"), F.coalesce(F.col("o.positive"), F.lit(False)).alias("positive"))
    in_day = Window.partitionBy("url", "day").orderBy("at")
    rows = rows.withColumn("cleared", F.sum((~F.col("struck")).cast("int")).over(in_day))
    # Strikes in a row within the day.
    rows = rows.withColumn("k", F.sum(F.col("struck").cast("int")).over(Window.partitionBy("url", "day", "cleared").orderBy("at")))
    days = rows.groupBy("url", "day").agg(
        F.max("at").alias("last"), F.max(F.when(F.col("positive"), F.col("at"))).alias("positive_at"), (F.max("cleared") > 0).alias("clears"),
        F.max_by(F.when(F.col("struck"), F.col("k")).otherwise(0), "at").alias("trail"),
    )
    by_day = Window.partitionBy("url").orderBy("day")
    days = days.withColumn("since_clear", F.sum(F.col("clears").cast("int")).over(by_day))
    days = days.withColumn("strikes", F.sum("trail").over(Window.partitionBy("url", "since_clear").orderBy("day")))
    days = days.withColumns({"inherited": F.coalesce(F.lag("strikes").over(by_day), F.lit(0)), "last_positive": F.max("positive_at").over(Window.partitionBy("url"))})
    # The outcomes that may be the one at which the strikes reach the threshold.
    near = rows.where(F.col("struck") & (F.col("k") <= thresholds.strikes)).select("url", "day", "at", "k", "cleared")
    reached = near.join(days.select("url", "day", "inherited", "last_positive"), ["url", "day"])
    reached = reached.where(F.col("k") + F.when(F.col("cleared") == 0, F.col("inherited")).otherwise(0) == thresholds.strikes)
    since = reached.where(F.col("last_positive").isNull() | (F.col("at") > F.col("last_positive"))).groupBy("url").agg(F.min("at").alias("dormant_since"))
    state = days.groupBy("url").agg(F.max_by("strikes", "day").cast("int").alias("strikes"), F.max("last").alias("last_probed"))
    return state.join(since, "url", "left").select("url", "strikes", "dormant_since", "last_probed")


def wake(state: DataFrame, requests: DataFrame, now: Column, permanent: bool = False, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Holds endpoints awake (requests: url, reason), for the grace days or for good."""
    until = F.lit(None).cast("timestamp") if permanent else (now + F.make_dt_interval(F.lit(thresholds.grace_days))).cast("timestamp")
    rows = state.join(requests.select("url", F.col("reason").alias("_why")), "url", "full_outer")
    asked = F.col("_why").isNotNull()
    hold = F.struct(F.lit("awake").alias("state"), F.col("_why").alias("reason"), until.alias("until"))
    own = [c for c in state.columns if c not in ("hold", "strikes", "strikes_before_last", "dormant_since", "lapsed_hold")]
    return rows.select(
        *own, F.when(asked, 0).otherwise(F.col("strikes")).alias("strikes"), F.when(asked, 0).otherwise(F.col("strikes_before_last")).alias("strikes_before_last"),
        F.when(~asked, F.col("dormant_since")).alias("dormant_since"), F.when(asked, hold).otherwise(F.col("hold")).alias("hold"), F.when(~asked, F.col("lapsed_hold")).alias("lapsed_hold"),
    ).select(*state.columns)


def sleep(state: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Holds endpoints dormant (requests: url, reason)."""
    rows = state.join(requests.select("url", F.col("reason").alias("_why")), "url", "full_outer")
    asked = F.col("_why").isNotNull()
    hold = F.struct(F.lit("dormant").alias("state"), F.col("_why").alias("reason"), F.lit(None).cast("timestamp").alias("until"))
    since = F.when(asked, F.coalesce("dormant_since", now.cast("timestamp"))).otherwise(F.col("dormant_since"))
    return rows.withColumns({"hold": F.when(asked, hold).otherwise(F.col("hold")), "dormant_since": since, "strikes": F.coalesce("strikes", F.lit(0)), "strikes_before_last": F.coalesce("strikes_before_last", F.lit(0))}).select(*state.columns)


def prunable(state: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Endpoints no list names any more and nobody holds."""
    return state.where("hold is null").join(endpoints.select("url"), "url", "left_anti").select("url")


def rotation_split(endpoints: DataFrame, metrics: DataFrame, at: Column, every: int) -> DataFrame:
    """Exhaustive metrics wait for the endpoint's day; the rest are due each time."""
    slots = endpoints.select("url").distinct().withColumn("slot", due_today(F.col("url"), at, every))
    pairs = slots.crossJoin(metrics.select("metric", "cost"))
    return pairs.select("url", "metric", F.when(~F.col("slot") & (F.col("cost") == "exhaustive"), "cadence").alias("reason"))


def dormancy_facts(planned: DataFrame, inactive: DataFrame, run: str) -> DataFrame:
    """The endpoints a run leaves alone: skipped ones and inactive ones."""
    skipped = planned.where("action = 'skip'").select("url", "reason", "dormant_since", "last_probed")
    off = inactive.select("url", F.lit("inactive").alias("reason")).join(skipped.select("url"), "url", "left_anti")
    return skipped.unionByName(off, allowMissingColumns=True).withColumn("run", F.lit(run)).withColumnRenamed("url", "endpoint")
