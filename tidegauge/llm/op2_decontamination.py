"""Benchmark decontamination as a prefix-filtered set join, in native columns.

A window (13 consecutive item words, or a whole shorter item) is contained in a
text exactly when its words occur in a row. Order the words of a window by
rarity: at containment 1 the necessary prefix is one token, the rarest. So only
the occurrences of those tokens are joined. Each such occurrence fixes where the
window would start; the length and positional bounds drop starts that do not
fit, and comparing the window-sized slice verifies containment exactly.

Rarity is the number of occurrences in the whole corpus. The words of a text are
thinned out where they are read, by an array of bits that holds each prefix with
its neighbour in the window; what passes is joined exactly. The joined rows are
(row key, place, token and its two neighbours): no text travels with its words,
whatever the size of the benchmark. The texts of documents with candidates come
back once each, for the slices, thinned out in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.bits import bit_array, may_be_in
from tidegauge.llm.columns import column, fresh
from tidegauge.session import materialise, table

WINDOW = 13
#: A text is contaminated if hit words are at least 1 in SHARE.
SHARE = 20

_NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; null and word-free texts have none."""
    lowered = F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    parts = F.split(F.coalesce(lowered, F.lit("")), _NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: words, width, and the sorted ids of the items that hold them."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    cut = items.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), window).alias("win"))
    return cut.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("width", F.size("win"))


def corpus_counts(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows (token, n): how often each word of the windows occurs in all texts; words that never do are left out.

    Counted before the join, so a frequent word is one row per task in the shuffle.
    The outer form spares a second split of every text, which tells empty ones apart.
    """
    counts = texts.select(F.explode_outer("w").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counts.join(windows.select(F.explode("win").alias("token")).distinct(), "token", "left_semi")


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (token, offset, width, win, items): each window by its rarest word; those with a word the corpus lacks go."""
    tokens = windows.select("win", "items", "width", F.posexplode("win").alias("offset", "token"))
    counted = tokens.join(counts, "token").groupBy("win", "items", "width")
    best = counted.agg(F.min(F.struct("n", "token", "offset")).alias("best"), F.count("*").alias("found"))
    return best.where("found = width").select("best.token", "best.offset", "width", "win", "items")


def _marked(kind: str, *parts: str) -> Column:
    return F.xxhash64(F.lit(kind), *parts)


def occurrences(split: DataFrame, probes: DataFrame) -> DataFrame:
    """Rows (key, n, pos, token, before, after): where rarest words may stand beside their neighbours in texts of n words.

    ``probes`` has token, left and right: the neighbours within a window, null at its
    ends. Of the two, one is asked for: the right one, or else the left one. Each text
    also has a row at pos n with an empty token. ``split`` has key and w.
    """
    asked = F.when(F.col("right").isNotNull(), _marked("right", "token", "right")).when(F.col("left").isNotNull(), _marked("left", "left", "token"))
    bits, size = bit_array(probes.select(asked.otherwise(_marked("alone", "token")).alias("h")).distinct())
    w = F.concat("w", F.array(F.lit("")))
    here = split.select("key", F.size("w").alias("n"), w.alias("w")).select("key", "n", "w", F.posexplode_outer("w").alias("pos", "token"))
    here = here.select("key", "n", "pos", "token", F.get("w", F.col("pos") - 1).alias("before"), F.get("w", F.col("pos") + 1).alias("after"))
    ways = (_marked("right", "token", "after"), _marked("left", "before", "token"), _marked("alone", "token"))
    passed = F.col("token") == ""
    for way in ways:
        passed = passed | may_be_in(way, bits, size)
    return here.where(passed)


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Rows (key, n) of all texts, and rows (key, at, width, items) of every occurrence of a benchmark window.

    ``docs`` has columns key and text; equal keys mean equal texts. at is the
    0-based word position, n the number of words.
    """
    windows = materialise(benchmark_windows(benchmark, window=window), "windows")
    split = docs.select("key", words(F.col("text")).alias("w"))
    near = [F.when(F.col("offset") > 0, F.get("win", F.col("offset") - 1)).alias("left"), F.get("win", F.col("offset") + 1).alias("right")]
    probes = materialise(prefixes(windows, corpus_counts(split, windows)).select("*", *near), "probes")
    here = materialise(occurrences(split, probes), "here")
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.col("width") <= F.col("n"))
    fits = (F.col("left").isNull() | (F.col("left") == F.col("before"))) & (F.col("right").isNull() | (F.col("right") == F.col("after")))
    found = here.where("token <> ''").join(probes, "token").where(inside & fits).select("key", start.alias("at"), "width", "win", "items")
    candidates = materialise(found.distinct(), "candidates")
    bits, size = bit_array(candidates.select(F.xxhash64("key").alias("h")).distinct())
    texts = docs.where(may_be_in(F.xxhash64("key"), bits, size)).dropDuplicates(["key"])
    slices = texts.select("key", words(F.col("text")).alias("w")).join(candidates, "key")
    hits = slices.where(F.slice("w", F.col("at") + 1, F.col("width")) == F.col("win")).select("key", "at", "width", "items")
    return here.where("token = ''").select("key", "n"), hits


def _covered(spans: Column) -> Column:
    """Positions covered by sorted structs (at, width)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(state: Column, span: Column) -> Column:
        end = F.greatest(state["end"], span["at"] + span["width"])
        return F.struct(end.alias("end"), (state["n"] + end - F.greatest(state["end"], span["at"])).alias("n"))

    return F.aggregate(spans, start, add, lambda s: s["n"])


def _key(doc_id: str, text: str) -> Column:
    """What names a row: its id, whether it has none, and a hash of its text; never null."""
    own = column(doc_id).cast("long")
    mark = F.xxhash64(F.coalesce(column(text).cast("string"), F.lit("")), F.lit(7))
    return F.struct(F.coalesce(own, F.lit(0).cast("long")).alias("id"), own.isNull().alias("none"), mark.alias("print"))


def _judge(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, window: int, share: int) -> DataFrame:
    """Rows (key, n_words, n_hit, items, contaminated), one per input row."""
    rows = docs.select(_key(doc_id, text).alias("key"), column(text).cast("string").alias("text"))
    sizes, found = find_windows(rows, benchmark, window)
    hits = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("at", "width"))).alias("spans"), F.collect_set("items").alias("lists"))
    hits = hits.select("key", _covered(F.col("spans")).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("lists"))).alias("items"))
    judged = sizes.select("key", F.col("n").cast("long").alias("n_words")).join(hits, "key", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    return judged.withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, share: int = SHARE
) -> DataFrame:
    """One row per document row: what of it stands in benchmark windows.

    Columns: doc_id, n_words, n_hit (words inside an occurrence), n_items,
    items_sha256 (over the sorted item ids, comma-joined), contaminated, items.
    Null and empty texts have no words and no hits. Repeated rows come back
    repeated, each with the same result; equal ids with different texts are
    judged apart. Null item texts hold no window; null item ids count as none.
    Empty tables give no rows, or no hits. Other columns are left out.
    """
    return _judge(docs, benchmark, doc_id, text, window, share).select(
        F.when(~F.col("key.none"), F.col("key.id")).alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "items",
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def decontamination_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns as they came.

    Rows with a null id or text are judged like others (null: no words); repeated
    rows stay or go together. Columns of any name stay as they are.
    """
    (bad,) = fresh(docs, "bad")
    found = _judge(docs, benchmark, "doc_id", "text", WINDOW, SHARE).where("contaminated").select(F.col("key").alias(bad)).distinct()
    found = materialise(found, "contaminated")
    bits, size = bit_array(found.select(F.xxhash64(bad).alias("h")))
    key = _key("doc_id", "text")
    suspect = may_be_in(F.xxhash64(key), bits, size)
    return docs.where(~suspect).unionByName(docs.where(suspect).join(found, key == F.col(bad), "left_anti"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op2_decontamination": op2_decontamination}


_WORDS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLE_SQL = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(w[i:i + 12], ' ') AS win, least(len(w), 13) AS width
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM bw),
dw AS (SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS win
       FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, widths WHERE len(w) >= width)),
hit AS (SELECT doc_id, i, bw.width, item FROM dw JOIN bw ON dw.win = bw.win AND dw.width = bw.width),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""
}
