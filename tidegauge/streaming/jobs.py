"""Structured Streaming jobs: ingest, daily roll-up, keyed state, transitions, de-duplication."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidegauge.operators import current as cur
from tidegauge.operators import facts, gates
from tidegauge.operators.planning import Thresholds
from tidegauge.schemas import NAMESPACE
from tidegauge.session import children, exists, materialise, release, remove
from tidegauge.sources.quads import parse_lines, pending_files, read_lines
from tidegauge.sources.store import RunStore


def archive_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Run files as they arrive (src_file, file, value), each read whole, for its digest.

    The source goes by path: a file rewritten under its name is not seen again and
    needs the batch load that goes by digest.
    """
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=True)
    return files.select(F.regexp_replace(F.col("_metadata.file_path"), "\\.gz$", "").alias("src_file"), F.col("_metadata.file_path").alias("file"), "value")


def load_faults(
    quads: DataFrame, stored: RunStore | None, namespace: str = NAMESPACE, ends: DataFrame | None = None, asked: DataFrame | None = None
) -> DataFrame:
    """Rows (src_file, fault) of run files that must not be loaded.

    Lines that do not parse; V2 fragments of a header; V3 wrong graphs; V4 a graph
    that contradicts itself; V5 dormancy of what a stored graph has facts of; V6 a
    run at the instant of another run. Only what stands before the last terminator
    counts, but for lines that do not parse and graphs.

    Of what is stored, the catalogue gives the instants, and tells which runs might have
    facts of endpoints now said to be dormant; only those runs are read. ``ends`` and
    ``asked`` have what ``gates.cuts`` and ``gates.asked`` give of these quads, where it
    is written already.
    """
    good = quads.where("bad is null")
    ends = gates.cuts(good, namespace) if ends is None else ends
    kept = gates.cut_to_last_terminator(good, namespace, ends)
    asked = gates.asked(kept, namespace) if asked is None else asked
    graphs = kept.select("g", "src_file").distinct()
    of_graph = lambda found, fault: found.select("g").distinct().join(graphs, "g").select("src_file", F.lit(fault).alias("fault"))
    runs = facts.runs(asked, namespace).select("run", "run_at")
    instants = runs if stored is None else runs.unionByName(stored.catalogue().where("run_at is not null").select("run", "run_at"))
    tied = instants.groupBy("run_at").agg((F.min("run") != F.max("run")).alias("tied")).where("tied").join(runs, "run_at").select(F.col("run").alias("g"))
    found = [
        quads.where("bad is not null").select("src_file", F.lit("line").alias("fault")), ends.where("refused").select("src_file", F.lit("header fragment").alias("fault")),
        gates.graph_faults(good, namespace).select("src_file", "fault"), of_graph(gates.contradictions(asked, namespace), "contradiction"), of_graph(tied, "tie"),
    ]
    if stored is not None:
        # As many as the batch has runs, at most.
        suspects = [r["g"] for r in stored.may_govern(gates.dormant(asked, namespace)).select("g").distinct().collect()]
        if suspects:
            found.append(of_graph(gates.rewrites(asked, stored.read(suspects), namespace), "rewritten history"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct()


def ingest(
    stream: DataFrame, store: str, checkpoint: str, namespace: str = NAMESPACE, on_refused: Callable[[DataFrame], None] | None = None, current: str | None = None
) -> StreamingQuery:
    """Validates each micro-batch and writes the graphs of its sound files; a stored graph is replaced whole.

    Files whose digest the store knows are passed over (S3). A batch is parsed once, by
    lines: its files are opened again, so that no task holds the lines of a whole file.
    ``on_refused`` gets the violations (src_file, fault). With ``current``, current
    readings are kept at that path, repaired where a run comes late or again (C9).
    """

    def load(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        archive = RunStore(spark, store, namespace)
        digests = batch.select(F.col("src_file").alias("key"), F.sha2(F.col("value").cast("binary"), 256).alias("digest"), "file")
        pending = materialise(pending_files(digests, archive.files()), "pending")
        # As many as the batch has files, at most; given as URLs.
        places = [re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(r["file"])) for r in pending.select("file").collect()]
        lines = read_lines(spark, places, few=True) if places else spark.createDataFrame([], "src_file string, line_no long, value string")
        quads = materialise(parse_lines(lines), "incoming")
        # A row for each file of the batch, so what is kept is a filter of the lines and no copy of them.
        good = quads.where("bad is null")
        ends = materialise(gates.cuts(good, namespace), "ends")
        kept = gates.cut_to_last_terminator(good, namespace, F.broadcast(ends))
        asked = materialise(gates.asked(kept, namespace).select("g", "s", "p", "o", "o_kind"), "asked")
        refused = materialise(load_faults(quads, archive if archive.version() >= 0 else None, namespace, F.broadcast(ends), asked), "refused")
        if on_refused:
            on_refused(refused)
        bad = refused.select("src_file").distinct()
        sound = kept.join(bad, "src_file", "left_anti")
        archive.write(sound, pending.join(bad, F.col("key") == F.col("src_file"), "left_anti"))
        if current:
            follow(archive, current)
        for frame in (pending, quads, ends, asked, refused):
            release(frame)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _generations(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("gen=")) for n in children(spark, path, "gen=") if exists(spark, f"{path}/{n}/_SUCCESS"))


def advance(path: str, delta: DataFrame, changed: DataFrame, archive: Callable[[DataFrame], DataFrame], generation: int, keep: int = 2) -> None:
    """Writes a generation of current readings from the one before it; runs that tie for newest are refused.

    ``changed`` (run) names the runs that are new or loaded again, ``delta`` holds all
    that they state now. Generations before the newest ``keep`` go. One that is written
    again (after a failure) starts from the same predecessor.
    """
    spark = delta.sparkSession
    known = [g for g in _generations(spark, path) if g < generation]
    if not known:
        new = cur.current_readings(cur.refuse_ties(delta, cur.PAIR))
    else:
        stored = spark.read.schema(delta.schema).parquet(f"{path}/gen={known[-1]:09d}")
        cur.refuse_ties(stored.join(changed, "run", "left_anti").unionByName(delta), cur.PAIR)
        again = not stored.join(changed, "run", "left_semi").isEmpty()
        new = cur.advance_current(stored, delta, changed, archive) if again else cur.merge_current(stored, delta)
    new.write.mode("overwrite").parquet(f"{path}/gen={generation:09d}")
    for old in known[: max(0, len(known) + 1 - keep)]:
        remove(spark, f"{path}/gen={old:09d}")


def follow(archive: RunStore, path: str, keep: int = 2) -> None:
    """Brings current readings up to the store's newest version, by the runs written since.

    A generation has the number of the version it tells of, so a job that failed between
    the two goes on from there.
    """
    known, version = _generations(archive.spark, path), archive.version()
    if version > max(known, default=-1):
        changed, quads = archive.changes(max(known, default=-1))
        readings = facts.readings(quads, archive.namespace)
        advance(path, readings, changed, lambda stale: facts.readings(archive.read(), archive.namespace), version, keep)


def daily_stream(readings: DataFrame, keep_days: int = 3) -> DataFrame:
    """Sweeps by day, pair and verdict, in long form, once a day is closed.

    Rows later than the watermark are dropped by the engine; the batch check of the
    summary against raw readings (A4) is what finds such days.
    """
    measured = readings.where("kind = 'measured'").withWatermark("run_at", f"{keep_days} days")
    counted = measured.groupBy(F.window("run_at", "1 day"), "endpoint", "metric", "verdict").agg(F.count("*").alias("n"))
    return counted.select(F.to_date("window.start").alias("day"), "endpoint", "metric", "verdict", "n")


def dedupe_stream(readings: DataFrame, delay: str = "3 days") -> DataFrame:
    """One row of a (run, endpoint, metric) that is delivered again.

    Only for re-deliveries with the same payload: which row stays is not defined.
    """
    return readings.withWatermark("run_at", delay).dropDuplicatesWithinWatermark(["run", "endpoint", "metric"])


class StrikeCounter(StatefulProcessor):
    """Strikes, dormancy and holds of one endpoint; late outcomes change nothing.

    A hold keeps an endpoint awake until its end, which a timer marks: it lapses then,
    with or without new outcomes, and the strikes start anew. State that nothing has
    touched for ``keep_days`` goes.
    """

    def __init__(self, thresholds: Thresholds, keep_days: int) -> None:
        self.thresholds, self.keep_ms = thresholds, keep_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "strikes int, dormant_since timestamp, last_probed timestamp, hold string, held_until timestamp, touched long")

    def _row(self, url: str, strikes: int, since, last, lapsed: str | None = None) -> pd.DataFrame:  # noqa: ANN001
        return pd.DataFrame({"url": [url], "strikes": [strikes], "dormant_since": pd.to_datetime([since]), "last_probed": pd.to_datetime([last]), "lapsed_hold": pd.Series([lapsed], dtype=object)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        strikes, since, last, hold, until, touched = self.state.get() if self.state.exists() else (0, None, None, None, None, 0)
        every = pd.concat(list(rows)).sort_values(["at", "hold", "positive", "cost_ms"])
        for row in every.drop_duplicates(["at", "hold"], keep="last").itertuples(index=False):
            at = int(row.at.timestamp() * 1000)
            if touched and at > touched + self.keep_ms:  # gone by then, whether its timer has fired or not
                strikes, since, last, hold, until = 0, None, None, None, None
            touched = max(touched, at)
            if isinstance(row.hold, str):
                strikes, since, hold, until = 0, None, row.hold, None if pd.isna(row.held_until) else row.held_until.to_pydatetime()
                if until is not None:
                    self.handle.registerTimer(int(pd.Timestamp(until).timestamp() * 1000))
                continue
            if last is not None and row.at <= pd.Timestamp(last):
                continue
            if hold is not None and until is not None and row.at > pd.Timestamp(until):
                strikes, hold, until = 0, None, None  # its timer has yet to fire
            struck = not row.positive and (row.cost_ms > self.thresholds.cost_ms or row.liveness_failed)
            strikes = strikes + 1 if struck else 0
            if row.positive:
                since = None
            elif struck and strikes >= self.thresholds.strikes and since is None and hold is None:
                since = row.at.to_pydatetime()
            last = row.at.to_pydatetime()
        self.handle.registerTimer(touched + self.keep_ms)
        self.state.update((strikes, since, last, hold, until, touched))
        yield self._row(key[0], strikes, since, last)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if not self.state.exists():
            return
        strikes, since, last, hold, until, touched = self.state.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if hold is not None and until is not None and int(pd.Timestamp(until).timestamp() * 1000) <= now:
            self.state.update((0, since, last, None, None, touched))
            yield self._row(key[0], 0, since, last, hold)
        if touched + self.keep_ms <= now:
            self.state.clear()

    def close(self) -> None:
        pass


def strikes_stream(outcomes: DataFrame, thresholds: Thresholds = Thresholds(), delay: str = "3 days", keep_days: int = 90) -> DataFrame:
    """The state of each endpoint whenever it gets outcomes or its hold lapses (update mode).

    ``outcomes`` has url, at, cost_ms, positive, liveness_failed, and, where endpoints are
    held awake in the stream, hold (the reason; null for an outcome) and held_until.
    Time goes on with ``at``: what is later than ``delay`` is left out.
    """
    held = {"hold": "string", "held_until": "timestamp"}
    rows = outcomes.withColumns({c: F.lit(None).cast(kind) for c, kind in held.items() if c not in outcomes.columns}).withWatermark("at", delay)
    return rows.groupBy("url").transformWithStateInPandas(
        statefulProcessor=StrikeCounter(thresholds, keep_days), outputStructType="url string, strikes int, dormant_since timestamp, last_probed timestamp, lapsed_hold string",
        outputMode="Update", timeMode="EventTime",
    )


def _last_states(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
    was, at = state.get if state.exists else (None, None)
    out = []
    rows = pd.concat(list(batches)).sort_values("run_at")
    for row in rows.itertuples(index=False):
        if at is not None and row.run_at <= pd.Timestamp(at):
            continue
        if row.state != was:
            out.append((*key, row.run_at, was, row.state))
        was, at = row.state, row.run_at.to_pydatetime()
    if at is not None:
        state.update((was, at))
    yield pd.DataFrame(out, columns=["endpoint", "metric", "run_at", "was", "now"])


def transition_stream(readings: DataFrame) -> DataFrame:
    """First sightings and changes of a pair's state as runs arrive (append mode).

    ``readings`` has endpoint, metric, run_at, state.
    """
    return readings.groupBy("endpoint", "metric").applyInPandasWithState(
        _last_states, "endpoint string, metric string, run_at timestamp, was string, now string", "was string, at timestamp", "append", "NoTimeout"
    )


def current_stream(readings: DataFrame, path: str, checkpoint: str, keep: int = 2) -> StreamingQuery:
    """Keeps current state up to date, whatever the order of arrival; a run that comes again is repaired.

    A batch holds its runs whole; a run that an earlier batch had replaces all that it
    said. Batches are kept beside the state (_history), so what a replaced run had hidden
    is found again, from the rows of the pairs concerned only. Two runs that are both
    newest stop the job. Each batch writes a new generation; the newest ``keep`` stay.
    """
    spark = readings.sparkSession
    history = f"{path}/_history"

    def merge(batch: DataFrame, number: int) -> None:
        batch.sortWithinPartitions(*cur.PAIR).write.mode("overwrite").parquet(f"{history}/gen={number:09d}")
        delta = spark.read.schema(batch.schema).parquet(f"{history}/gen={number:09d}")
        past = spark.read.schema(f"{_ddl(batch)}, gen int").option("basePath", history).parquet(f"{history}/gen=*").where(F.col("gen") <= number)
        live = past.groupBy("run").agg(F.max("gen").alias("gen"))

        def whole(stale: DataFrame) -> DataFrame:
            return past.join(stale, cur.PAIR, "left_semi").join(live, ["run", "gen"]).select(*batch.columns)

        advance(path, delta, delta.select("run").distinct(), whole, number, keep)

    return readings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def staleness(runs: DataFrame, now, hours: int = 2) -> DataFrame:  # noqa: ANN001
    """Age of the newest run and whether it is too old."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.max("run_at"))).alias("age_s")
    return runs.agg(F.max("run_at").alias("newest"), age).withColumn("stale", F.col("age_s") > hours * 3600)


def summary_gaps(closed: DataFrame, summary: DataFrame) -> DataFrame:
    """Closed days that the stream has not summarised."""
    return closed.select("day").join(summary.select("day").distinct(), "day", "left_anti")
