"""Phrase collocation mining by HAT-trie counting.

Phrases of one to three words are counted per language, one length after another.
A task keeps a shallow trie over its word ids: hash containers of counts that burst
into children by the next word when they grow. When it holds too many entries, its
largest subtrees are spilled whole as sorted runs. The runs are written once and
merged per range of phrases, that is per prefix partition, where a frequent prefix
spreads over as many ranges as it needs.

A phrase with ``least`` occurrences consists of parts with as many. So each length is
counted only where the two parts one word shorter may have enough, as a bit array of
fixed size tells (it can err towards counting more, never less).

The most frequent words (a bounded number) have ids that all tasks share, so phrases of
them travel as one packed number, first word on top; a phrase with any other word
travels as text. Both are counted exactly.

Scores are integer quotients of 38-digit decimals.
"""

from __future__ import annotations

import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm.batches import blocks
from tidegauge.llm.columns import column
from tidegauge.llm.selection import threshold
from tidegauge.session import materialise, release, ship, table

LEAST, COVERED, TOP = 10, 50, 2000
#: Entries of a container before it bursts, entries and words that a task holds.
BURST, HELD, HELD_WORDS = 16_384, 400_000, 200_000
#: Words with an id that all tasks share: the bound of what comes to the driver.
HEAD_WORDS = 1 << 18
#: Bits of the array that tells which parts may be frequent enough (as a power of two).
MARK_BITS = 27
#: Bits of a word's id, and words that are counted at once.
ID_BITS, STEP = 20, 1 << 18
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _BREAKS, b"abcdefghijklmnopqrstuvwxyz" + b"." * len(_BREAKS))


class _Words(dict):
    """Ids and hashes of the words of one language.

    0 is a break between pieces, or a word that no phrase can need; then come the words
    that all tasks know, then those of this task.
    """

    def __init__(self, lang: str, head: _Head, marks: np.ndarray | None, held: int) -> None:
        super().__init__({b".": 0})
        self.update(head.of(lang))
        self.seed, self.shared, self.marks, self.held = _seed(lang), head.size + 1, marks, held
        self.names, self.hashes, self.idle = [], array("Q", head.hashes.tobytes()), 0

    def __missing__(self, word: bytes) -> int:
        own = xxhash.xxh64_intdigest(word, self.seed)
        if self.marks is not None:
            at = _place(own)
            if not int(self.marks[at >> 3]) >> (at & 7) & 1:
                if self.idle < self.held:
                    self.idle += 1
                    self[word] = 0
                return 0
        self[word] = new = len(self.hashes)
        self.names.append(word)
        self.hashes.append(own)
        return new

    def name(self, i: int) -> bytes:
        return self.names[i - self.shared]


class _Head:
    """The words that all tasks know, from 1 on, with hashes; hashes[0] is that of a break."""

    def __init__(self, langs: list[str], words: list[bytes]) -> None:
        self.size, self.langs, self.words = len(words), langs, words
        seeds = {lang: _seed(lang) for lang in set(langs)}
        self.hashes = np.array([0, *(xxhash.xxh64_intdigest(w, seeds[lang]) for lang, w in zip(langs, words, strict=True))], np.uint64)

    def of(self, lang: str) -> dict[bytes, int]:
        return {w: i for i, (own, w) in enumerate(zip(self.langs, self.words, strict=True), 1) if own == lang}


_heads: dict[str, _Head] = {}


def _head(file: str | None) -> _Head:
    """One per worker process."""
    if file is None:
        return _Head([], [])
    if file not in _heads:
        _heads.clear()
        table_ = pq.read_table(SparkFiles.get(file))
        _heads[file] = _Head(table_["lang"].to_pylist(), [w.encode() for w in table_["word"].to_pylist()])
    return _heads[file]


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


_BASE = 0x9E3779B97F4A7C15


def _mark(hashes: np.ndarray) -> np.ndarray:
    """Places in the bit array."""
    x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) & np.uint64((1 << MARK_BITS) - 1)).astype(np.int64)


def _place(x: int) -> int:
    """``_mark`` of one value."""
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return (x ^ x >> 29) & (1 << MARK_BITS) - 1


def _joint(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` values."""
    total = hashes[: len(hashes) - length + 1]
    for k in range(1, length):
        total = total * np.uint64(_BASE) + hashes[k : len(hashes) - length + 1 + k]
    return total


class HatTrie:
    """Counts of keys of ``length`` ids, packed with the first id on top.

    Containers are hash tables of the keys with a range of prefixes, in the order of the
    prefixes. One that grows beyond ``burst`` bursts into two: between first words, within
    one first word between second words, and so on; the keys of one prefix that is all but
    the last word stay together.
    """

    def __init__(self, length: int, burst: int = BURST) -> None:
        self.length, self.burst, self.held = length, burst, 0
        self.edges, self.parts = [0], [{}]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds distinct sorted keys."""
        cuts = [0, *np.searchsorted(keys, self.edges[1:]).tolist(), len(keys)]
        grown = []
        for k, part in enumerate(self.parts):
            low, high = cuts[k], cuts[k + 1]
            if low == high:
                continue
            before, get = len(part), part.get
            for key, n in zip(keys[low:high].tolist(), counts[low:high].tolist(), strict=True):
                part[key] = get(key, 0) + n
            self.held += len(part) - before
            if len(part) > self.burst:
                grown.append(k)
        for k in reversed(grown):
            self._split(k)

    def _split(self, k: int) -> None:
        """Bursts a container at the shortest prefix that parts it, as near its middle as that allows."""
        todo = [(self.edges[k], self.parts[k])]
        done: list[tuple[int, dict]] = []
        while todo:
            edge, part = todo.pop()
            at = self._cut(part) if len(part) > self.burst else None
            if at is None:
                done.append((edge, part))
            else:
                todo += [(at, {key: n for key, n in part.items() if key >= at}), (edge, {key: n for key, n in part.items() if key < at})]
        self.edges[k : k + 1], self.parts[k : k + 1] = [e for e, _ in done], [p for _, p in done]

    def _cut(self, part: dict) -> int | None:
        keys = np.sort(np.fromiter(part, np.int64, len(part)))
        for below in range(self.length - 1, 0, -1):
            prefixes = keys >> ID_BITS * below
            starts = np.flatnonzero(prefixes[1:] != prefixes[:-1]) + 1
            if len(starts):
                return int(prefixes[starts[np.argmin(np.abs(starts - len(keys) // 2))]]) << ID_BITS * below
        return None

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes the largest containers out, whole and each as a sorted run, until at most ``keep`` entries are left."""
        for k in sorted(range(len(self.parts)), key=lambda k: -len(self.parts[k])):
            if self.held <= keep:
                break
            part, self.parts[k] = self.parts[k], {}
            self.held -= len(part)
            keys, counts = np.fromiter(part.keys(), np.int64, len(part)), np.fromiter(part.values(), np.int64, len(part))
            order = np.argsort(keys)
            yield keys[order], counts[order]


class _Counting:
    """One language of a task: its words, and the trie of phrases of one length."""

    def __init__(self, lang: str, length: int, head: _Head | None = None, marks: tuple[np.ndarray | None, np.ndarray | None] = (None, None), held_words: int = HELD_WORDS) -> None:
        self.lang, self.length, self.head, self.marks, self.held_words = lang, length, head or _Head([], []), marks, held_words
        self.clear()

    def clear(self) -> None:
        self.words, self.trie = _Words(self.lang, self.head, self.marks[0], self.held_words), HatTrie(self.length)

    def add(self, texts: list[str]) -> Iterator[pa.RecordBatch]:
        """Counts texts; gives what is spilled where they hold more words than ids."""
        joined = b".".join([t.encode().translate(_PLAIN) for t in texts])
        split = joined.replace(b".", b" . ").split()
        for at in range(0, len(split), STEP):
            if len(self.words.hashes) + STEP + self.length > 1 << ID_BITS:
                yield from self.runs(0)
                self.clear()
            self._count(split[at : at + STEP + self.length - 1])

    def _count(self, split: list[bytes]) -> None:
        ids = np.fromiter(map(self.words.__getitem__, split), np.int64, len(split))
        n = len(ids) - self.length + 1
        if n <= 0:
            return
        whole = ids > 0
        ok = whole[:n].copy()
        for k in range(1, self.length):
            ok &= whole[k : n + k]
        if self.marks[1] is not None:
            at = _mark(_joint(np.frombuffer(self.words.hashes, np.uint64)[ids], self.length - 1))
            held = self.marks[1][at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
            ok &= held[:n] & held[1 : n + 1]
        places = np.flatnonzero(ok)
        if not len(places):
            return
        keys = ids[places]
        for k in range(1, self.length):
            keys = keys << ID_BITS | ids[places + k]
        keys.sort()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.trie.add(keys[first], np.diff(np.append(first, len(keys))))

    def runs(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Spilled subtrees as sorted rows: (key, n) of words all tasks know, (lang, phrase, n) of others."""
        shared, name = self.words.shared, self.words.name
        known = lambda i: name(i) if i >= shared else self.head.words[i - 1]
        for keys, counts in self.trie.spill(keep):
            ids = [keys >> ID_BITS * k & (1 << ID_BITS) - 1 for k in range(self.length - 1, -1, -1)]
            own = np.zeros(len(keys), bool)
            for k in ids:
                own |= k >= shared
            packed = np.flatnonzero(~own)
            for low in range(0, len(packed), 100_000):
                part = packed[low : low + 100_000]
                none = pa.nulls(len(part), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), none, none, pa.array(counts[part])], _RUN_COLUMNS)
            spelt = np.flatnonzero(own)
            for low in range(0, len(spelt), 50_000):
                part = spelt[low : low + 50_000]
                phrases = [b" ".join(map(known, p)).decode() for p in zip(*(k[part].tolist() for k in ids), strict=True)]
                rows = sorted(zip(phrases, counts[part].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(rows), pa.int64()), pa.array([self.lang] * len(rows)), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], _RUN_COLUMNS
                )


_RUN_COLUMNS, _RUNS = ["key", "lang", "phrase", "n"], "key long, lang string, phrase string, n long"


def _counter(length: int, head: str | None, files: list[str], held: int, held_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, marks = _head(head), [np.load(SparkFiles.get(f), mmap_mode="r") for f in files]
        marks = (marks + [None, None])[:2]
        langs: dict[str, _Counting] = {}
        for batch in batches:
            names, texts = (batch.column(c).to_pylist() for c in (0, 1))
            for low, high in blocks(texts):
                dealt: dict[str, list[str]] = {}
                for k in range(low, high):
                    if texts[k]:
                        dealt.setdefault(names[k], []).append(texts[k])
                for lang, own in dealt.items():
                    if lang not in langs:
                        langs[lang] = _Counting(lang, length, shared, marks, held_words)
                    yield from langs[lang].add(own)
                if sum(len(c.words.names) for c in langs.values()) > held_words:
                    for counting in langs.values():
                        yield from counting.runs(0)
                    langs.clear()
                elif sum(c.trie.held for c in langs.values()) > held:
                    largest = max(langs.values(), key=lambda c: c.trie.held)
                    yield from largest.runs(largest.trie.held // 2)
        for counting in langs.values():
            yield from counting.runs(0)

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase) to the phrases' places in the bit array."""
    for batch in batches:
        seeds: dict[str, int] = {}
        joint = []
        for lang, phrase in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
            if lang not in seeds:
                seeds[lang] = _seed(lang)
            total = 0
            for k, word in enumerate(phrase.encode().split(b" ")):
                total = ((total * _BASE if k else 0) + xxhash.xxh64_intdigest(word, seeds[lang])) & (1 << 64) - 1
            joint.append(total)
        yield pa.RecordBatch.from_arrays([pa.array(_mark(np.array(joint, np.uint64)))], ["mark"])


def _send(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    target = Path(tempfile.mkdtemp(prefix="spark-phrases-")) / f"{name}-{uuid.uuid4().hex}"
    write(str(target))
    spark.sparkContext.addFile(str(target))
    return target.name


def _marks(counts: DataFrame) -> str:
    """Sends the bit array of the phrases of ``counts`` out; its size is fixed by MARK_BITS."""
    places = counts.select("lang", "phrase").mapInArrow(_marked, "mark long")
    words = places.groupBy(F.shiftright("mark", 6).alias("place")).agg(F.expr("bit_or(shiftleft(1L, cast(mark & 63 as int)))").alias("bits")).toArrow()
    marks = np.zeros(1 << MARK_BITS - 6, np.int64)
    marks[words.column("place").to_numpy()] = words.column("bits").to_numpy()

    def write(path: str) -> None:
        with open(path, "wb") as out:
            np.save(out, marks.view(np.uint8))

    return _send(counts.sparkSession, "marks", write)


def _frequent(counts: DataFrame, size: int) -> tuple[DataFrame, str]:
    """Ids of about ``size`` of the most frequent words: rows (id, lang, word), and the file sent out."""
    rank = F.shiftleft(F.least("n", F.lit((1 << 38) - 1)), 24).bitwiseOR(F.xxhash64("lang", "phrase").bitwiseAND((1 << 24) - 1))
    ranked = counts.select("lang", F.col("phrase").alias("word"), rank.alias("q"))
    cut = threshold(ranked.select("q"), size)
    found = (ranked if cut is None else ranked.where(F.col("q") >= cut)).select("lang", "word").toArrow()
    found = found.slice(0, (1 << ID_BITS - 1) - 1)
    ids = found.append_column("id", pa.array(np.arange(1, found.num_rows + 1)))
    schema = "lang string, word string, id long"
    rows = counts.sparkSession.createDataFrame(ids.to_pylist() if not found.num_rows else ids, schema)
    return materialise(rows, "head"), _send(counts.sparkSession, "head", lambda path: pq.write_table(found, path))


def _spelt(merged: DataFrame, head: DataFrame, length: int) -> DataFrame:
    """Phrases (lang, phrase, n) of packed ones (key, n)."""
    rows = merged.select("key", "n")
    for k in range(length):
        own = head.select(F.col("id").alias(f"id{k}"), F.col("word").alias(f"w{k}"), *([F.col("lang")] if not k else []))
        rows = rows.withColumn(f"id{k}", F.shiftright("key", ID_BITS * (length - 1 - k)).bitwiseAND((1 << ID_BITS) - 1)).join(own, f"id{k}")
    return rows.select("lang", F.concat_ws(" ", *[f"w{k}" for k in range(length)]).alias("phrase"), "n")


def phrase_counts(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang", longest: int = 3, held: int = HELD, held_words: int = HELD_WORDS, head_words: int = HEAD_WORDS) -> tuple[DataFrame, DataFrame]:
    """Rows (lang, length, phrase, n) of all phrases with at least ``least`` occurrences, and rows (lang, n) of all words.

    Phrases do not cross pieces. A null language is ``und``; null and empty texts hold
    no words. Repeated rows count each time. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(column(lang).cast("string"), F.lit("und")).alias("lang"), column(text).cast("string").alias("text"))
    found, head, head_file, marks, sizes = None, None, None, [], None
    for length in range(1, longest + 1):
        runs = materialise(rows.mapInArrow(_counter(length, head_file, marks, held, held_words), _RUNS), "runs")
        if sizes is None:
            sizes = materialise(runs.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
        enough = F.col("n") >= least
        counts = runs.where("key is null").repartitionByRange("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(enough)
        if head is not None:
            packed = runs.where("key is not null").repartitionByRange("key").groupBy("key").agg(F.sum("n").alias("n")).where(enough)
            counts = counts.unionByName(_spelt(packed, head, length))
        counts = materialise(counts, "counts")
        release(runs)
        if length == 1 < longest:
            head, head_file = _frequent(counts, head_words)
        if length < longest:
            marks.append(_marks(counts))
        own = counts.select("lang", F.lit(length).alias("length"), "phrase", "n")
        found = own if found is None else found.unionByName(own)
    return found, sizes


def _score(a: Column, left: Column, right: Column) -> Column:
    whole = [c.cast("decimal(38,0)") for c in (a, left, right)]
    return F.call_function("div", F.lit(1000000).cast("decimal(38,0)") * whole[0] * whole[0], whole[1] * whole[2])


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP, text: str = "text", lang: str = "lang", **limits: int) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A phrase of two or three words with a >= ``least`` occurrences scores
    floor(10^6 a a / (l r)) by its lowest-scoring cut into two parts with l and r
    occurrences. A pair is left out if a candidate of three words that holds it has
    ``covered`` percent of its occurrences. Ties go by a, then by bytes of the phrase.
    """
    counts, sizes = phrase_counts(docs, least, text, lang, **limits)
    words, pairs, triples = (counts.where(F.col("length") == k).select("lang", "phrase", "n") for k in (1, 2, 3))

    def part(of: DataFrame, key: str, n: str) -> DataFrame:
        return of.select("lang", F.col("phrase").alias(key), F.col("n").alias(n))

    first, last = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    front, back = F.expr("left(phrase, length(phrase) - length(substring_index(phrase, ' ', -1)) - 1)"), F.expr("substr(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
    held = triples.select("lang", F.explode(F.array(front, back)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    two = pairs.withColumnRenamed("n", "a").join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    two = two.withColumn("w1", first).withColumn("w2", last).join(part(words, "w1", "l"), ["lang", "w1"]).join(part(words, "w2", "r"), ["lang", "w2"])
    two = two.select("lang", "phrase", "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    three = triples.withColumnRenamed("n", "a").withColumns({"w1": first, "w23": back, "w12": front, "w3": last})
    for of, key, n in ((words, "w1", "l1"), (pairs, "w23", "r1"), (pairs, "w12", "l2"), (words, "w3", "r2")):
        three = three.join(part(of, key, n), ["lang", key])
    cuts = [F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    three = three.withColumn("cut", F.least(*cuts)).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = two.unionByName(three).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op12_phrases": op12_phrases}


ORACLE_SQL = {
    "op12_phrases": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (
  SELECT lang, k, phrase, count(*) AS n FROM (
    SELECT lang, 1 AS k, w[i] AS phrase FROM g
    UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM g WHERE i + 1 <= len(w)
    UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM g WHERE i + 2 <= len(w)
  ) GROUP BY ALL),
s AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS v FROM f WHERE k > 1 AND n >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, a, x.cut, l.n AS l, r.n AS r, CAST(1000000::HUGEINT * a * a // (l.n::HUGEINT * r.n) AS BIGINT) AS score
  FROM c JOIN (VALUES (2, 1), (3, 1), (3, 2)) x(k, cut) ON c.k = x.k
  JOIN f l ON l.lang = c.lang AND l.k = x.cut AND l.phrase = array_to_string(v[1:x.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.k = c.k - x.cut AND r.phrase = array_to_string(v[x.cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, phrase, max(a) AS m FROM (
  SELECT lang, a, v[1] || ' ' || v[2] AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, v[2] || ' ' || v[3] FROM c WHERE k = 3) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON b.k = 2 AND o.lang = b.lang AND o.phrase = b.phrase WHERE o.m IS NULL OR 100 * o.m < 50 * a),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, s.n AS n, score FROM top JOIN s USING (lang) WHERE rank <= 2000"""
}
