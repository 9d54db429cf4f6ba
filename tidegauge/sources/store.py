"""Stored archives and dimensions: runs with a catalogue, checks, published generations."""

from __future__ import annotations

import time
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import facts, gates, rollup
from tidegauge.schemas import NAMESPACE, RDF_TYPE
from tidegauge.session import children, exists, modified_at, remove

QUAD = ["s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang", "g"]
_STORED = ", ".join(f"{c} string" for c in QUAD[:-1]) + ", gen string, g string"
CATALOGUE = "run string, gen string, quads long, digest string, run_at timestamp, bloom map<int, long>, subjects binary, predicates binary, classes binary"
#: Bits of the filter of a run's endpoints (a power of two), and places of an endpoint in it.
BLOOM_BITS, BLOOM_PLACES = 4096, 3


def _bloom_places(endpoint: Column) -> Column:
    """The places of an endpoint in a run's filter, as (word, bit)."""
    places = [F.pmod(F.xxhash64(endpoint, F.lit(k)), F.lit(BLOOM_BITS)) for k in range(BLOOM_PLACES)]
    return F.array(*[F.struct(F.floor(p / 64).cast("int").alias("word"), (p % 64).cast("int").alias("bit")) for p in places])


class RunStore:
    """An archive of whole runs that changes all at once.

    A write puts its runs into a generation of their own (gen=N/g=RUN) and then a new
    version of the catalogue beside the data; the success mark of that version is what
    makes the runs count, all of them or none. Readers follow the newest version, so a
    write that fails leaves the old state. The catalogue has a row for each run: its
    generation, size, digest, instant, and a filter of the endpoints it has facts of, so
    that gates need not open the archive.
    """

    def __init__(self, spark: SparkSession, path: str, namespace: str = NAMESPACE) -> None:
        self.spark, self.path, self.namespace = spark, path.rstrip("/"), namespace

    def _versions(self) -> list[int]:
        return sorted(int(n.removeprefix("v=")) for n in children(self.spark, f"{self.path}/_catalogue") if n.startswith("v="))

    def version(self) -> int:
        """The newest version that is whole, or -1."""
        return next((v for v in reversed(self._versions()) if exists(self.spark, f"{self._at(v)}/_SUCCESS")), -1)

    def _at(self, version: int, name: str = "_catalogue") -> str:
        return f"{self.path}/{name}/v={version:09d}"

    def catalogue(self, version: int | None = None) -> DataFrame:
        """A row for each run; none before the first write."""
        at = self.version() if version is None else version
        return self.spark.createDataFrame([], CATALOGUE) if at < 0 else self.spark.read.schema(CATALOGUE).parquet(self._at(at))

    def files(self) -> DataFrame:
        """S3: key and digest of the files that were loaded."""
        at = self.version()
        known = at >= 0 and exists(self.spark, f"{self._at(at, '_files')}/_SUCCESS")
        return self.spark.read.schema("key string, digest string").parquet(self._at(at, "_files")) if known else self.spark.createDataFrame([], "key string, digest string")

    def _stored(self, generation: int | None = None) -> DataFrame:
        place = f"{self.path}/gen={generation:09d}" if generation is not None else f"{self.path}/gen=*"
        return self.spark.read.schema(_STORED).option("basePath", self.path).parquet(place)

    def read(self, runs: list[str] | None = None) -> DataFrame:
        """The archive, or the named runs of it: then only their partitions are opened."""
        catalogue = self.catalogue()
        if runs is None:
            live = catalogue.select(F.col("run").alias("live_run"), F.col("gen").alias("live_gen"))
            rows = self._stored() if self.version() >= 0 else self.spark.createDataFrame([], _STORED)
            return rows.join(live, F.col("g").eqNullSafe(F.col("live_run")) & (F.col("gen") == F.col("live_gen")), "left_semi").select(*QUAD)
        places = catalogue.where(F.col("run").isin(*runs)).groupBy("gen").agg(F.collect_set("run").alias("runs")).collect() if runs else []
        if not places:
            return self.spark.createDataFrame([], _STORED).select(*QUAD)
        wanted = F.lit(False)
        for row in places:
            wanted = wanted | ((F.col("gen") == row["gen"]) & F.col("g").isin(*row["runs"]))
        return self._stored().where(wanted).select(*QUAD)

    def changes(self, since: int) -> tuple[DataFrame, DataFrame]:
        """The runs written after a version (run), and their quads; only their generations are opened."""
        runs = self.catalogue().where(F.col("gen") > f"{since:09d}").select("run", "gen") if since >= 0 else self.catalogue().select("run", "gen")
        live = runs.select(F.col("run").alias("live_run"), F.col("gen").alias("live_gen"))
        rows = self._stored().where(F.col("gen") > f"{since:09d}") if since >= 0 else self._stored()
        return runs.select("run"), rows.join(live, F.col("g").eqNullSafe(F.col("live_run")) & (F.col("gen") == F.col("live_gen")), "left_semi").select(*QUAD)

    def write(self, quads: DataFrame, files: DataFrame | None = None) -> None:
        """Writes whole runs; a run that is there already is replaced, others stay.

        A run's rows go to one task, or to several where it is larger than a partition
        should be (adaptive rebalancing), so its files are as many as its size asks for.
        ``files`` (key, digest) are recorded with the runs.
        """
        before = self.version()
        number = max([before, *self._versions()]) + 1
        rows = quads.select(*QUAD).dropDuplicates().hint("rebalance", "g")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("g").parquet(f"{self.path}/gen={number:09d}")
        new = self._described(number)
        old = self.catalogue(before).join(new.select(F.col("run").alias("again")), F.col("run").eqNullSafe(F.col("again")), "left_anti")
        known = self.files()
        if files is not None:
            known = known.join(files.select("key").distinct(), "key", "left_anti").unionByName(files.select("key", "digest").distinct())
        known.hint("rebalance").write.mode("overwrite").parquet(self._at(number, "_files"))
        old.unionByName(new).hint("rebalance").write.mode("error").parquet(self._at(number))

    def _described(self, generation: int) -> DataFrame:
        """The catalogue's rows of what a generation holds."""
        rows = self._stored(generation)
        if not children(self.spark, f"{self.path}/gen={generation:09d}", "g="):
            return self.spark.createDataFrame([], CATALOGUE)
        content = F.xxhash64(*QUAD)
        sizes = rows.groupBy("g").agg(F.count("*").alias("quads"), F.concat_ws("-", F.hex(F.bit_xor(content)), F.hex(F.sum(F.shiftright(content, 24)))).alias("digest"))
        at = facts.runs(rows, self.namespace).select(F.col("run").alias("at_run"), "run_at")
        held = gates.governed(rows, self.namespace).select("g", F.explode(_bloom_places(F.col("endpoint"))).alias("place"))
        words = held.groupBy("g", "place.word").agg(F.expr("bit_or(shiftleft(1L, place.bit))").alias("bits"))
        blooms = words.groupBy(F.col("g").alias("bloom_run")).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bloom"))  # BLOOM_BITS / 64 entries at most
        sketches = rollup.run_sketches(rows, RDF_TYPE).select(F.col("g").alias("sketch_run"), *rollup.SKETCHED)
        found = sizes.join(at, F.col("g") == F.col("at_run"), "left").join(blooms, F.col("g") == F.col("bloom_run"), "left").join(sketches, F.col("g").eqNullSafe(F.col("sketch_run")), "left")
        return found.select(F.col("g").alias("run"), F.lit(f"{generation:09d}").alias("gen"), "quads", "digest", "run_at", "bloom", *rollup.SKETCHED)

    def statistics(self) -> DataFrame:
        """Approximate counts of the whole archive, from the sketches of its runs; no data is read."""
        return rollup.merged_statistics(self.catalogue().select(F.col("quads").alias("triples"), *rollup.SKETCHED))

    def may_govern(self, pairs: DataFrame) -> DataFrame:
        """Of rows (g, endpoint): those whose stored run may have facts of the endpoint; one that has is never left out."""
        stored = self.catalogue().select(F.col("run").alias("g"), "bloom")
        word = lambda p: F.coalesce(F.try_element_at("bloom", p["word"]), F.lit(0).cast("long"))
        inside = F.forall(_bloom_places(F.col("endpoint")), lambda p: F.call_function("shiftright", word(p), p["bit"]).bitwiseAND(1) == 1)
        return pairs.join(stored, "g").where(inside).drop("bloom")

    def reap(self, keep: int = 2, grace_s: float = 3600) -> int:
        """Removes what only versions name that are neither among the newest ``keep`` nor younger than ``grace_s``.

        A reader that began with an older version within that time is spared. Gives the
        number of files removed.
        """
        whole = [v for v in self._versions() if exists(self.spark, f"{self._at(v)}/_SUCCESS")]
        now, old = time.time(), []
        for version, following in zip(whole, whole[1:], strict=False):
            if version in whole[:-keep] and now - modified_at(self.spark, f"{self._at(following)}/_SUCCESS") >= grace_s:
                old.append(version)
        if not old:
            return 0
        named = lambda versions: [self.catalogue(v).select(F.col("run").alias("g"), "gen") for v in versions]
        gone, kept = named(old), named([v for v in whole if v not in old])
        pairs = _union(gone).distinct().join(_union(kept).distinct(), ["g", "gen"], "left_anti")
        places = self._stored().select("g", "gen", F.col("_metadata.file_path").alias("file"))
        dead = places.join(pairs, ["g", "gen"], "left_semi").select("file").distinct()
        removed = 0
        for row in dead.toLocalIterator():
            remove(self.spark, unquote(row["file"]))  # given as a URL
            removed += 1
        for version in old:
            remove(self.spark, self._at(version))
            remove(self.spark, self._at(version, "_files"))
        return removed


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def write_runs(quads: DataFrame, path: str) -> None:
    """Writes whole graphs into a store; see ``RunStore.write``."""
    RunStore(quads.sparkSession, path).write(quads)


def read_runs(spark: SparkSession, path: str, runs: list[str] | None = None) -> DataFrame:
    """The archive of a store, or the named graphs of it."""
    return RunStore(spark, path).read(runs)


def incomplete_graphs(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """Graphs whose distinct parsed quads are not as many as those stored.

    Quads are told apart by a digest of 128 bits, so a task holds digests and no texts; two
    different quads of a graph pass for one with a chance of about 2^-128.
    """
    term = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    digest = F.unhex(F.md5(F.concat(*[term(c) for c in QUAD[:-1]])))
    left = parsed.select("g", digest.alias("digest")).distinct().groupBy("g").agg(F.count("*").alias("parsed"))
    right = stored.groupBy(F.col("g").cast("string").alias("g")).agg(F.count("*").alias("stored"))
    return left.join(right, "g", "left").where(~F.col("parsed").eqNullSafe(F.col("stored")))


def registry_candidates(dump: DataFrame, column: str = "value") -> DataFrame:
    """Candidate rows of a registry dump: a JSON map of datasets to their services.

    position is the order in the dump, by dataset key and place.
    """
    service = "STRUCT<access_url: STRING, status: STRING, title: STRING>"
    shape = f"MAP<STRING, STRUCT<title: STRING, domain: STRING, sparql: ARRAY<{service}>>>"
    sets = dump.select(F.explode(F.from_json(F.col(column), shape)).alias("dataset", "d"))
    rows = sets.select("dataset", "d.title", "d.domain", F.posexplode("d.sparql").alias("k", "x"))
    return rows.select("dataset", "title", "domain", F.trim("x.access_url").alias("url"), "x.status", F.concat_ws("#", "dataset", F.lpad(F.col("k").cast("string"), 6, "0")).alias("position")).where("url <> ''")


def registry_table(entries: DataFrame) -> DataFrame:
    """A flat table (url, role, preferred) of described entries and their aliases.

    ``entries`` has url, alternatives ARRAY<STRING>, invalid ARRAY<STRING>.
    """
    own = entries.select("url", F.lit("preferred").alias("role"), F.col("url").alias("preferred"))
    out = own
    for role, column in (("alternative", "alternatives"), ("invalid", "invalid")):
        out = out.unionByName(entries.select(F.explode(column).alias("a"), F.col("url").alias("preferred")).select(F.col("a").alias("url"), F.lit(role).alias("role"), "preferred"))
    return out


def metric_faults(metrics: DataFrame) -> DataFrame:
    """Metric definitions that break a constraint, with the first it breaks."""
    kinds = ("ask-filter", "ask-data", "fetch-void", "cors", "cors-preflight", "liveness", "vocabulary-described", "counted", "select-iris", "class-profile", "dereference-endpoint")
    fault = (
        F.when(~F.coalesce(F.col("metric").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False)), "id")
        .when(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "kind")
        .when(~F.coalesce(F.col("cost").isin("cheap", "expensive", "exhaustive"), F.lit(False)), "cost")
        .when(~F.coalesce(F.col("cadence").isin("hourly", "daily"), F.lit(False)), "cadence")
        .when((F.col("kind") != "counted") & F.col("tolerance").isNotNull(), "tolerance without a count").when(F.col("tolerance") < 0, "tolerance")
    )
    twice = metrics.groupBy("metric").agg(F.count("*").alias("n")).where("n > 1").select("metric", F.lit("twice").alias("fault"))
    return metrics.withColumn("fault", fault).where("fault is not null").select("metric", "fault").unionByName(twice)


def publish(df: DataFrame, path: str, generation: int) -> None:
    """Writes a generation and then a pointer to it; readers follow the newest pointer."""
    df.write.mode("overwrite").parquet(f"{path}/gen={generation:09d}")
    spark = df.sparkSession
    pointer = spark.range(1).select(F.lit(generation).cast("long").alias("generation"), F.current_timestamp().alias("published_at"))
    pointer.write.mode("append").parquet(f"{path}/pointers")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest published generation."""
    newest = spark.read.parquet(f"{path}/pointers").agg(F.max("generation").alias("g")).first()["g"]
    return spark.read.parquet(f"{path}/gen={newest:09d}")


def reapable(pointers: DataFrame, keep: int) -> DataFrame:
    """Generations that are no longer among the newest ``keep``."""
    newest = pointers.select("generation").distinct().orderBy(F.desc("generation")).limit(keep)
    return pointers.select("generation").distinct().join(F.broadcast(newest), "generation", "left_anti")


def reap(spark: SparkSession, path: str, keep: int = 2, grace_s: float = 3600) -> list[int]:
    """Removes generations beyond the newest ``keep`` whose successor is at least ``grace_s`` old.

    A reader that took the pointer within that time still finds its generation.
    """
    pointers = spark.read.parquet(f"{path}/pointers")
    newer = pointers.groupBy("generation").agg(F.min("published_at").alias("at")).orderBy("generation").collect()
    gone, known = [], {r["generation"] for r in reapable(pointers, keep).collect()}
    for row, following in zip(newer, newer[1:], strict=False):
        if row["generation"] in known and time.time() - following["at"].timestamp() >= grace_s and exists(spark, f"{path}/gen={row['generation']:09d}"):
            remove(spark, f"{path}/gen={row['generation']:09d}")
            gone.append(row["generation"])
    return gone
