"""SimHash near-duplicates by tiled exact comparison.

Fingerprints come from one Arrow pass over the texts. Distinct fingerprints are
then compared exactly: a tile is a numpy exclusive-or of two blocks followed by
bit counts. Tiles are formed by the population counts of the four 16-bit
quarters of a fingerprint. Two fingerprints at distance r have quarter counts
whose differences sum to at most r, so a fingerprint meets only its own cell and
the neighbouring cells within the radius; every other tile pair is skipped.

Cells that hold many fingerprints are cut into chunks, and each pair of chunks is
a group of its own, so no task has to hold a cell. A tile gives back a spanning
forest of its links, not the links themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.columns import column, fresh
from tidegauge.llm.components import connected_components
from tidegauge.session import materialise, ship, table

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints in a chunk of a cell.
TILE = 4096
_BLOCK = 1 << 16
#: Decisions of the pipeline stage that are broadcast, some 100 bytes each; more are joined by a shuffle of the texts.
BROADCAST_KEYS = 1_000_000


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text; no words (or null) give 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _BLOCK):
        spans = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints)], ["doc_id", "mark", "print"])

    return run


def _mark(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), text.isNull())


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, mark, print): a hash of the text and the fingerprint as signed bigints, one per input row."""
    ship(docs.sparkSession)
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").alias("text"), _mark(column(text)).alias("mark"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, mark long, print long")


def _quarter(column: Column, k: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(column, 16 * k).bitwiseAND(0xFFFF)).cast("int")


def _cell(quarters: list[Column]) -> Column:
    return sum((q * 17**k for k, q in enumerate(quarters)), F.lit(0))


def _half_space(radius: int) -> list[tuple[int, ...]]:
    """Count differences within the radius, one of each opposite pair, without zero."""
    span = range(-radius, radius + 1)
    return [d for d in product(span, repeat=4) if d > (0, 0, 0, 0) and sum(map(abs, d)) <= radius]


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, for links between n local nodes."""
    low = np.arange(n)
    while True:
        pair = np.minimum(low[u], low[v])
        new = low.copy()
        np.minimum.at(new, u, pair)
        np.minimum.at(new, v, pair)
        np.minimum.at(new, low[u], pair)
        np.minimum.at(new, low[v], pair)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _tile(radius: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left = rows.loc[rows["left"], "print"].to_numpy(np.int64)
        right = rows.loc[~rows["left"], "print"].to_numpy(np.int64)
        inner = rows["i"].iat[0] == rows["j"].iat[0]
        both = np.concatenate([left, right])
        if not len(left):
            return pd.DataFrame({"u": left, "v": left})
        bits, low, step, wide = both.view(np.uint64), np.arange(len(both)), 512, 8192
        for at in range(0, len(left), step):
            rows_at = bits[at : min(at + step, len(left)), None]
            # a left block against the right side and, in a diagonal tile, the left side after it
            for shift in range(at if inner else len(left), len(both), wide):
                a, b = np.nonzero(np.bitwise_count(rows_at ^ bits[None, shift : shift + wide]) <= radius)
                a, b = a + at, b + shift
                keep = a < b
                if keep.any():
                    own = np.arange(len(both))
                    low = np.minimum(low, spanning(np.concatenate([a[keep], own]), np.concatenate([b[keep], low]), len(both)))
        linked = low != np.arange(len(both))
        return pd.DataFrame({"u": both[linked], "v": both[low[linked]]})

    return run


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """A spanning set of the links between distinct fingerprints (columns u, v).

    ``prints`` has one column ``print``, each value once.
    """
    quarters = [_quarter(F.col("print"), k) for k in range(4)]
    placed = prints.select("print", *[q.alias(f"q{k}") for k, q in enumerate(quarters)], _cell(quarters).alias("home"))
    # At most 17^4 cells, whatever the input.
    cells = placed.groupBy("home").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks")).withColumnRenamed("home", "cell")
    reach = F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(d)]) for d in _half_space(radius)])

    home = placed.select("print", F.col("home").alias("cell"), F.lit(True).alias("own"))
    away = placed.select("print", "q0", "q1", "q2", "q3", F.explode(reach).alias("d"))
    at = [F.col(f"q{k}") - F.col(f"d.d{k}") for k in range(4)]
    inside = at[0].between(0, 16) & at[1].between(0, 16) & at[2].between(0, 16) & at[3].between(0, 16)
    away = away.where(inside).select("print", _cell(at).alias("cell"), F.lit(False).alias("own"))

    rows = home.unionByName(away).join(F.broadcast(cells), "cell").withColumn("chunk", F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int"))
    spread = F.sequence(F.lit(0), F.col("chunks") - 1)
    as_left = rows.where("own").select("cell", F.col("chunk").alias("i"), F.explode(spread).alias("j"), F.lit(True).alias("left"), "print")
    as_right = rows.select("cell", F.explode(spread).alias("i"), F.col("chunk").alias("j"), F.lit(False).alias("left"), "print", "own")
    as_right = as_right.where("not own or i < j").drop("own")
    return as_left.unionByName(as_right).groupBy("cell", "i", "j").applyInPandas(_tile(radius), "u long, v long")


def _components(own: DataFrame, radius: int, tile: int) -> DataFrame:
    """Rows (print, best): for each fingerprint the least (no id, doc_id, mark) of all rows its links reach."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("least")
    classes = materialise(own.groupBy("print").agg(best), "classes")
    found = connected_components(links(classes.select("print"), radius, tile))
    grouped = classes.join(found, classes["print"] == found["node"], "left").select("print", "least", F.coalesce("component", "print").alias("component"))
    lowest = grouped.groupBy("component").agg(F.min("least").alias("best"))
    return materialise(grouped.join(lowest, "component").select("print", "best"), "named")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per input row.

    component_id is the smallest doc_id among the texts reachable by links. Null
    and word-free texts have fingerprint zero and link like any other. A row with
    a null doc_id takes part; its component_id is the least id that is known, or
    null. Repeated rows come back repeated. An empty table gives no rows. Other
    columns are left out.

    As dealt the comparison is exact and tiled: tile pairs within reach grow with the
    square of the distinct fingerprints, thinned by the population counts of the
    quarters (a fingerprint goes to at most 41 cells, and to each chunk of a cell).
    A few tens of millions of distinct fingerprints are the sensible limit of that.
    """
    own = materialise(fingerprints(docs, doc_id, text, shingle), "prints")
    named = _components(own, radius, tile)
    return own.join(named, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents."""
    return simhash_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op7_simhash": op7_simhash}


def near_duplicates_stage(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One document of each group: that of the least doc_id, null ids last, then of the least text hash.

    Decisions are made by row (doc_id and text), so two texts under one id are two
    documents. Of repeated rows (equal id and text) one stays. Columns of any name
    stay as they are; an empty table gives no rows.

    Only decisions against the default are joined with the texts: rows that go, and
    rows that repeat. Up to ``broadcast_keys`` of them are broadcast; more shuffle
    the texts once.
    """
    own = materialise(fingerprints(docs), "prints")
    me = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    judged = own.join(_components(own, radius, tile), "print").select("doc_id", "mark", (me == F.col("best")).alias("stays"))
    gone = judged.where("not stays").select("doc_id", "mark").distinct().withColumn("stays", F.lit(False))
    again = judged.where("stays").groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "mark", F.lit(True).alias("stays"))
    names = fresh(docs, "key_id", "key_mark", "key_stays")
    keys = materialise(gone.unionByName(again).toDF(*names), "decisions")
    small = F.broadcast if keys.count() <= broadcast_keys else lambda df: df
    # Null ids count as -1 with a mark of their own, so that the join is a plain one.
    ids, marks = F.struct(F.coalesce(column("doc_id").cast("long"), F.lit(-1)), column("doc_id").isNull()), _mark(column("text"))
    there = (ids == F.struct(F.coalesce(names[0], F.lit(-1)), F.col(names[0]).isNull())) & (marks == F.col(names[1]))
    single = docs.join(small(keys), there, "left_anti")
    repeated = docs.join(small(keys.where(F.col(names[2]))), there, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated)
