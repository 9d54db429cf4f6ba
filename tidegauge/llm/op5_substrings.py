"""Substring deduplication over a log-structured index of window hashes.

Every 20-word window holds 13 eight-word grams; the one with the least hash is the
window's anchor. Equal windows have equal anchors at equal offsets, so a window
can only repeat if its anchor does, and about one word in seven is an anchor.

1. Each batch of documents becomes a run: its anchor hashes with the documents that
   hold them, in a bucketed table sorted by hash that is never changed. The new run
   is merge-joined with the historical ones (no shuffle: same buckets) to find the
   anchors that it repeats, and the earlier documents that hold them. More than
   ``fan_in`` runs are first compacted into one.
2. Windows at repeated anchors are verified: rows with the anchor, the offset and a
   64-bit digest of the whole window are sorted by document, and all but the first
   of equal ones are marked. The digest is made of other word hashes than the
   anchor, so two words that collide in one differ in the other. Anchors that occur
   often are dealt over several groups; the windows that are first in their group
   meet in a second round, each with its equals only.
3. The marked windows' words are taken out of each text.

The index is a folder (by default in the shared one). It can be opened again later,
and a batch is then judged against all that was added before, whatever the ids.

Per-word work is numpy inside Arrow passes; everything between is Spark joins and
aggregates over written tables.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidegauge.llm.columns import column, fresh
from tidegauge.session import exists, materialise, remove, shared_dir, ship, table

WINDOW, GRAM = 20, 8
#: Historical runs up to which none is compacted.
FAN_IN = 4
#: Where the query cuts the documents, by id, into the batches that it loads one after another. The
#: first two are small, since a batch reads again what stands before it; the third compacts their runs.
BATCHES, QUERY_FAN_IN = (0.125, 0.25), 1
#: Occurrences of an anchor that go to one group.
GROUP = 2000
NO_ID = (1 << 63) - 1
#: Bytes of words that a task remembers the hashes of.
_REMEMBERED = 8 << 20
_B = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    """Codes of words, with one or two independent 64-bit hashes each, remembered up to a number of bytes."""

    def __init__(self, both: bool = True) -> None:
        super().__init__()
        self.both, self.held, self.first, self.second = both, 0, array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        self.held += len(word)
        self[word] = code = len(self.first)
        self.first.append(xxhash.xxh64_intdigest(word, 20))
        if self.both:
            self.second.append(xxhash.xxh3_64_intdigest(word, 21))
        return code

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Of the words of one text; they hold until the next text."""
        if self.held > _REMEMBERED:
            self.clear()
            self.__init__(self.both)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hashes(self, codes: np.ndarray, which: int) -> np.ndarray:
        return np.frombuffer(self.second if which else self.first, np.uint64)[codes]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(h: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of all runs of ``size`` values, by doubling."""
    powers, have = {1: (h, base)}, 1
    while have * 2 <= size:
        p, b = powers[have]
        powers[have * 2] = (p[:-have] * b + p[have:], np.uint64(int(b) ** 2 % (1 << 64)))
        have *= 2
    total, done = None, 0
    for width in sorted(powers, reverse=True):
        if size - done >= width:
            p, b = powers[width]
            n = len(h) - size + 1
            part = p[done : done + n]
            total = part.copy() if total is None else total * b + part
            done += width
    return _mix(total)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The place of the first least value in each run of ``size`` values, by doubling."""
    at, have = np.arange(len(values)), 1
    while have < size:
        step = min(have, size - have)
        a, b = at[:-step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        have += step
    return at


def anchors(words: list[bytes], known: _WordHashes, digests: bool = True, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """For each window start: its anchor's position, the anchor's hash, the window's digest if asked for."""
    none = np.zeros(0, np.uint64)
    if len(words) < window:
        return none.astype(np.int64), none, none
    codes = known.codes(words)
    grams = _rolling(known.hashes(codes, 0), gram, _B)
    at = _least(grams, window - gram + 1)
    return at, grams[at], _rolling(known.hashes(codes, 1), window, _C) if digests else None


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (anchor, key, n): the anchors of each text and how often each occurs."""
    known = _WordHashes(both=False)
    for batch in batches:
        names = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, batch.num_rows, 512):
            key, found, counts = [], [], []
            for k, text in enumerate(batch.column(1).slice(at, 512).to_pylist(), at):
                where, hashes, _ = anchors(_words(text), known, digests=False)
                if len(where):
                    new = np.concatenate(([True], where[1:] != where[:-1]))
                    values, n = np.unique(hashes[new], return_counts=True)
                    found.append(values.view(np.int64))
                    counts.append(n.astype(np.int32))
                    key.append(np.full(len(values), names[k], np.int64))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found, key, counts)], ["anchor", "key", "n"])


class WindowIndex:
    """Sorted immutable runs of window anchors in a folder, to which batches of documents are added.

    ``folder`` holds the runs (run-*), with ``keep_texts`` the documents of each batch
    (texts-*), and the log, one version each change, which names the runs and batches
    that count. A batch that fails leaves nothing the log names; when it is added again
    it takes the place of what it left. Opening the folder of an earlier session
    continues it; its number of buckets then holds. ``close`` takes the session's table
    names back, ``drop`` the files as well.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, fan_in: int = FAN_IN, keep_texts: bool = True) -> None:
        ship(spark)
        self.spark, self.fan_in, self.keep_texts = spark, fan_in, keep_texts
        self.folder = folder or f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix, self.runs, self.made, self.version = f"windows_{uuid.uuid4().hex}", {}, 0, -1
        self.tables: set[str] = set()
        self.batches: list[int] = []
        if folder and exists(spark, f"{folder}/log"):
            last = spark.read.parquet(f"{folder}/log").orderBy(F.desc("version")).first()
            self.version, self.buckets, self.made, self.batches = last["version"], last["buckets"], last["made"], list(last["batches"])
            for number in last["runs"]:
                name = f"{self.prefix}_{number}"
                spark.sql(
                    f"CREATE TABLE {name} (anchor BIGINT, key BIGINT, n INT) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) "
                    f"INTO {self.buckets} BUCKETS LOCATION '{folder}/run-{number:06d}'"
                )
                self.runs[number] = name
                self.tables.add(name)

    def __enter__(self) -> WindowIndex:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _write(self, rows: DataFrame) -> tuple[int, str]:
        number, name = self.made, f"{self.prefix}_{self.made}"
        self.tables.add(name)
        dealt = rows.repartition(self.buckets, "anchor").write.mode("overwrite").bucketBy(self.buckets, "anchor").sortBy("anchor")
        dealt.option("path", f"{self.folder}/run-{number:06d}").saveAsTable(name)
        return number, name

    def _log(self, runs: dict[int, str], batches: list[int]) -> None:
        """Makes a change count: from here on the index has these runs and batches."""
        row = [(self.version + 1, self.buckets, self.made + 1, sorted(runs), batches)]
        shape = "version int, buckets int, made int, runs array<int>, batches array<int>"
        self.spark.createDataFrame(row, shape).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        self.version, self.made, self.runs, self.batches = self.version + 1, self.made + 1, runs, batches

    def _texts(self, number: int) -> str:
        return f"{self.folder}/texts-{number:06d}"

    def compact(self) -> None:
        """Merges all runs into one that takes their place."""
        if len(self.runs) > 1:
            every = None
            for name in self.runs.values():
                every = self.spark.table(name) if every is None else every.unionByName(self.spark.table(name))
            number, name = self._write(every)
            old = self.runs
            self._log({number: name}, self.batches)
            for number, name in old.items():
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                remove(self.spark, f"{self.folder}/run-{number:06d}")

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", earlier: DataFrame | None = None, group: int = GROUP) -> DataFrame:
        """Adds a batch; rows (id, print, start, mask): its windows that stand earlier in it or in the index.

        ``earlier`` holds the documents of all earlier batches where the caller has
        them; by default they are read from what the index keeps.
        """
        rows = _documents(docs, doc_id, text)
        if len(self.runs) > self.fan_in:
            self.compact()
        old = list(self.runs.values())
        number, new = self._write(rows.select("key", "text").mapInArrow(_emit_anchors, "anchor long, key long, n int"))
        run = self.spark.table(new)
        total = run.groupBy("anchor").agg(F.sum("n").alias("n"))
        for k, name in enumerate(old):
            past = self.spark.table(name).groupBy("anchor").agg(F.sum("n").alias(f"n{k}"))
            total = total.join(past, "anchor", "left").withColumn("n", F.col("n") + F.coalesce(f"n{k}", F.lit(0))).drop(f"n{k}")
        repeated = total.where("n > 1").select("anchor", F.ceil(F.col("n") / group).cast("int").alias("groups"))
        found = None
        for name in [new, *old]:
            part = self.spark.table(name).join(repeated, "anchor").select("key", F.struct("anchor", "groups").alias("hit"))
            found = part if found is None else found.unionByName(part)
        # Sets, so that repeated rows of one document do not multiply.
        hits = found.groupBy("key").agg(F.collect_set("hit").alias("hits"))
        rows = rows.withColumn("gen", F.lit(1))
        if old:
            past = self.spark.read.parquet(*map(self._texts, self.batches)) if earlier is None else _documents(earlier, doc_id, text)
            rows = rows.unionByName(past.withColumn("gen", F.lit(0)))
        packed = rows.join(hits, "key").select("gen", "id", "print", "key", "text", "hits.anchor", "hits.groups").mapInArrow(_emit_windows, _PACKED)
        first = materialise(_first_round(packed).where("(mask <> 0 and gen = 1) or (keep and groups > 1)"), "judged")
        second = _second_round(first.where("keep and groups > 1"))
        marks = first.where("mask <> 0 and gen = 1").select("id", "print", "start", "mask").unionByName(second)
        if self.keep_texts:
            _documents(docs, doc_id, text).write.mode("overwrite").option("compression", "zstd").parquet(self._texts(number))
        out = materialise(marks, "marks")
        self._log(self.runs | {number: new}, [*self.batches, number])
        return out

    def close(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs, self.tables = {}, set()

    def drop(self) -> None:
        self.close()
        remove(self.spark, self.folder)


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (id, print, key, text) of the documents with a text.

    A document is an id and a text: null ids share one id. Documents whose keys
    collide share their hits, which are only candidates.
    """
    name, mark = _named(doc_id, text)
    rows = docs.select(name.alias("id"), mark.alias("print"), column(text).cast("string").alias("text")).where("text is not null")
    return rows.select("id", "print", F.xxhash64("id", "print").alias("key"), "text")


_PACKED = "anchor long, salt int, groups int, gen int, id long, print long, start int, at int, windows binary"


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (gen, id, print, key, text, anchors hit, their groups): a row for each occurrence of a repeated anchor.

    Groups are dealt by key, so copies under different ids spread and repeated rows
    of one document meet. Of these only the first is read where they stand together.
    """
    known, last = _WordHashes(), None
    schema = pa.schema([("anchor", pa.int64()), ("salt", pa.int32()), ("groups", pa.int32()), ("gen", pa.int32()), ("id", pa.int64()), ("print", pa.int64()), ("start", pa.int32()), ("at", pa.int32()), ("windows", pa.binary())])
    for batch in batches:
        gens, ids, prints, keys = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in range(4))
        for low in range(0, batch.num_rows, 256):
            rows, part = [], batch.slice(low, 256)
            for k, text in enumerate(part.column(4).to_pylist()):
                own = gens[low + k], ids[low + k], prints[low + k]
                if own == last:
                    continue
                last = own
                where, hashes, digests = anchors(_words(text), known)
                if not len(where):
                    continue
                edges = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1], [True])))
                names = hashes.view(np.int64)[edges[:-1]]
                hit, groups = (part.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (5, 6))
                order = np.argsort(hit)
                place = np.minimum(np.searchsorted(hit, names, sorter=order), len(hit) - 1)
                dealt = order[place]
                for e in np.flatnonzero(hit[dealt] == names).tolist():
                    n, a, b = int(groups[dealt[e]]), int(edges[e]), int(edges[e + 1])
                    rows.append((int(names[e]), keys[low + k] % n, n, *own, a, int(where[a]), digests[a:b].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)



def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (anchor, salt, gen, id, print, start): marks all but the first of equal windows.

    Adds mask with a bit for each marked window, and keep where one is unmarked.
    """
    group, seen = None, {}
    for batch in batches:
        keep, masks = [], []
        columns = [batch.column(c).to_pylist() for c in ("anchor", "salt", "gen", "id", "print", "start", "at", "windows")]
        for anchor, salt, gen, own, text, start, at, packed in zip(*columns, strict=True):
            if (anchor, salt) != group:
                group, seen = (anchor, salt), {}
            mask, me = 0, None
            for k, digest in enumerate(memoryview(packed).cast("Q").tolist()):
                me = (gen, own, text, start + k)
                if seen.setdefault((at - start - k, digest), me) != me:
                    mask |= 1 << k
            masks.append(mask)
            keep.append(mask + 1 < 1 << len(packed) // 8)
        arrays = [*batch.columns, pa.array(masks, pa.int32()), pa.array(keep, pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "mask", "keep"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each unmarked window of judged rows."""
    schema = pa.schema([("anchor", pa.int64()), ("offset", pa.int32()), ("digest", pa.int64()), ("gen", pa.int32()), ("id", pa.int64()), ("print", pa.int64()), ("start", pa.int32())])
    for batch in batches:
        for low in range(0, batch.num_rows, 2048):
            part = batch.slice(low, 2048)
            columns = [part.column(c).to_pylist() for c in ("anchor", "gen", "id", "print", "start", "at", "windows", "mask")]
            rows = [
                (anchor, at - start - k, digest, gen, own, text, start + k)
                for anchor, gen, own, text, start, at, packed, mask in zip(*columns, strict=True)
                for k, digest in enumerate(memoryview(packed).cast("q").tolist())
                if not mask >> k & 1
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _first_round(packed: DataFrame) -> DataFrame:
    dealt = packed.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "gen", "id", "print", "start")
    return dealt.mapInArrow(_judge, _PACKED + ", mask int, keep boolean")


def _second_round(judged: DataFrame) -> DataFrame:
    """Marks (id, print, start, mask) of windows that are first in their group but not of all.

    Windows are keyed by what makes them equal, so an anchor with a different window
    in each text is spread, and a window has at most one document for each group.
    """
    windows = judged.mapInArrow(_unpack, "anchor long, offset int, digest long, gen int, id long, print long, start int")
    order = Window.partitionBy("anchor", "offset", "digest").orderBy("gen", "id", "print", "start")
    # Equal ranks are repeated rows of one document, which do not mark each other.
    return windows.withColumn("place", F.rank().over(order)).where("place > 1 and gen = 1").select("id", "print", "start", F.lit(1).alias("mask"))


def _named(doc_id: str, text: str) -> tuple[Column, Column]:
    return F.coalesce(column(doc_id).cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(column(text).cast("string"), F.lit("")))


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int | tuple[float, ...] = BATCHES, group: int = GROUP, fan_in: int = QUERY_FAN_IN) -> DataFrame:
    """Rows (id, print, start, mask): windows whose words also start earlier.

    id is the doc_id (null ids count as the largest), print a hash of the text,
    start the first window of a run of at most 13; mask has a bit for each of them.
    Batches are ranges of ids, cut at the given shares (or into equal ones), added to
    an index one after another.
    """
    spark = docs.sparkSession
    ship(spark)
    name, _ = _named(doc_id, text)
    shares = [k / batches for k in range(1, batches)] if isinstance(batches, int) else list(batches)
    bounds = docs.agg(F.percentile_approx(name, shares).alias("cut")).first()["cut"] if shares else []
    bounds = sorted({b for b in bounds or []})
    index, marks = WindowIndex(spark, fan_in=fan_in, keep_texts=False), None
    try:
        for low, high in zip([None, *bounds], [*bounds, None], strict=True):
            part = docs if low is None else docs.where(name > low)
            part = part if high is None else part.where(name <= high)
            new = index.add(part, doc_id, text, None if low is None else docs.where(name <= low), group)
            marks = new if marks is None else marks.unionByName(new)
    finally:
        index.drop()
    return marks


def _covered(n: int, starts: np.ndarray, masks: np.ndarray, width: int) -> np.ndarray:
    """Which of ``n`` words stand in a marked window."""
    mark, bit = np.nonzero(masks[:, None] >> np.arange(width) & 1)
    first = starts[mark] + bit
    steps = np.bincount(first, minlength=n + 1) - np.bincount(first + width, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def _strip(at: int, spans: int, width: int, names: list[str]):
    """Adds (n_words, n_removed, kept) from the text column and the marked windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                marks = part.column(spans)
                counts = marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = marks.flatten()
                starts, masks = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "mask"))
                sizes, removed, kept, low = [], [], [], 0
                for text, n in zip(part.column(at).to_pylist(), counts.tolist(), strict=True):
                    words = _words(text)
                    out, gone = words, 0
                    if n:
                        stay = ~_covered(len(words), starts[low : low + n], masks[low : low + n], width)
                        out = [w for w, ok in zip(words, stay.tolist(), strict=True) if ok]
                        gone = len(words) - len(out)
                    low += n
                    sizes.append(len(words))
                    removed.append(gone)
                    kept.append(b" ".join(out).decode())
                new = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(part.columns) if i != spans], *new], [*[n for i, n in enumerate(part.schema.names) if i != spans], *names])

    return run


def _stripped(docs: DataFrame, names: list[str], doc_id: str, text: str, batches: int | tuple[float, ...], group: int, fan_in: int) -> DataFrame:
    """The rows with three more columns of the given names: words, removed words, what is kept."""
    marks = repeated_windows(docs, doc_id, text, batches, group, fan_in)
    own_id, own_print, spans = fresh(docs, "key_id", "key_print", "key_spans")
    found = marks.groupBy(F.col("id").alias(own_id), F.col("print").alias(own_print)).agg(F.collect_set(F.struct("start", "mask")).alias(spans))
    name, mark = _named(doc_id, text)
    joined = docs.join(found, (name == F.col(own_id)) & (mark == F.col(own_print)), "left").select(*map(column, docs.columns), spans)
    added = [T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.LongType(), T.StringType()), strict=True)]
    return joined.mapInArrow(_strip(docs.columns.index(text), len(docs.columns), WINDOW, names), T.StructType([*docs.schema.fields, *added]))


def strip_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int | tuple[float, ...] = BATCHES, group: int = GROUP, fan_in: int = QUERY_FAN_IN) -> DataFrame:
    """The rows with n_words, n_removed and kept: the words not in a repeated window.

    A window is repeated if its word sequence also starts earlier: at a smaller
    doc_id, or before in the same document; null ids come last, and of rows with
    one id those with different texts are ordered by a hash of the text. Repeated
    rows (equal id and text) are one document and come back repeated. Null, empty
    and short texts keep all they have. An empty table gives no rows. Input columns
    named n_words, n_removed or kept are left out.
    """
    names = ["n_words", "n_removed", "kept"]
    own = docs.select(*[column(c) for c in docs.columns if c.lower() not in names])
    return _stripped(own, names, doc_id, text, batches, group, fan_in)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows that stand earlier."""
    found = strip_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def substring_stage(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut out; those left without a word go.

    n_chars, where there is one, follows the text; other columns, of any name, stay as
    they are. Null and empty texts stay.
    """
    words, removed, kept = fresh(docs, "n_words", "n_removed", "kept")
    found = _stripped(docs, [words, removed, kept], "doc_id", "text", BATCHES, GROUP, QUERY_FAN_IN).where((F.col(removed) == 0) | (F.col(removed) < F.col(words)))
    cut = F.col(removed) > 0
    out = []
    for field in docs.schema.fields:
        own = column(field.name)
        if field.name == "text":
            own = F.when(cut, F.col(kept)).otherwise(own)
        elif field.name == "n_chars":
            own = F.when(cut, F.length(kept).cast(field.dataType)).otherwise(own)
        out.append(own.alias(field.name))
    return found.select(*out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op5_substrings": op5_substrings}


ORACLE_SQL = {
    "op5_substrings": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
}
