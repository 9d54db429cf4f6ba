"""Embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and cut into
cells of fixed width; a bucket of a table is the combination of its cells. Vectors
that share a bucket of any table are compared exactly by cosine. A pair counts in
the first table that holds it, so links are counted without being listed; a group
gives back one row per linked vector (its count, and a spanning link).

With the defaults a pair at cosine 0.9 (distance 0.447) shares a cell with
probability 0.857, a bucket of 16 cells with 0.085 and one of 32 tables with 0.94;
closer pairs are found more surely. Equal vectors are one class from the start.
Large buckets are cut into chunks and compared chunk pair by chunk pair.

Buckets are first shuffled as ids with a 128-bit sign sketch. A vector that has no
one in its bucket within 44 sketch bits (a pair at cosine 0.9 differs in 18.4, with
a deviation of 4.0, so it is missed with less than 1 in 10^9) goes no further; the
vectors themselves are sent only where there is something to compare. More vectors
want more ``cells``, so that buckets stay small, and more ``tables`` to go with them:
the recall of a pair is 1 - (1 - p^cells)^tables for its probability p of a cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.columns import column
from tidegauge.llm.components import connected_components
from tidegauge.llm.op7_simhash import spanning
from tidegauge.session import materialise, ship, table

THRESHOLD = 0.9
TABLES, CELLS, WIDTH, SEED = 32, 16, 2.5, 3
#: Vectors in a chunk of a bucket.
CHUNK = 1024
#: Bits of a sign sketch, and the deviations from its mean up to which a pair is compared.
SIGNS, DEVIATIONS = 128, 6.4


def projections(dim: int, tables: int = TABLES, cells: int = CELLS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, shifts and the odd multipliers that combine a table's cells."""
    rng = np.random.default_rng([seed, dim])
    return rng.normal(size=(dim, tables * cells)), rng.uniform(0, WIDTH, tables * cells), rng.integers(1, 1 << 62, (tables, cells)) | 1


def bucket_keys(unit: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """A 32-bit bucket for each row and table."""
    directions, shifts, mix = parts
    cells = np.floor((unit @ directions + shifts) / WIDTH).astype(np.int64).reshape(len(unit), *mix.shape)
    return ((cells * mix).sum(axis=2) >> 31).astype(np.int32)


def sign_sketch(unit: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Two 64-bit words for each row: the sides of random planes it lies on."""
    planes = np.random.default_rng([seed, unit.shape[1], 1]).normal(size=(unit.shape[1], SIGNS))
    return np.packbits(unit @ planes > 0, axis=1).view(np.int64)


def sketch_radius(threshold: float) -> int:
    """Sketch bits in which a pair at the threshold differs at most, but for DEVIATIONS."""
    p = np.arccos(np.clip(threshold, -1, 1)) / np.pi
    return int(np.ceil(SIGNS * p + DEVIATIONS * np.sqrt(SIGNS * p * (1 - p))))


def normalised(rows: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision from packed components (4 or 8 bytes each)."""
    kinds = [np.float32 if len(r) == 4 * dim else np.float64 for r in rows]
    x = np.stack([np.frombuffer(r, k).astype(np.float64) for r, k in zip(rows, kinds, strict=True)])
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(vector: np.ndarray) -> bytes:
    """As single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        single = vector.astype(np.float32)
    return (single if (single == vector).all() else vector).tobytes()


_KEYED = "id long, alt int, weight long, dim int, raw binary, sketch binary, s0 long, s1 long, keys array<long>"


def _hash_vectors(tables: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, alt, weight, vector) to _KEYED; a key is the table's number and its bucket."""
        parts: dict[int, tuple] = {}
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        names = ["id", "alt", "weight", "dim", "raw", "sketch", "s0", "s1", "keys"]
        for batch in batches:
            ids, alts, weights, vectors = (batch.column(k).to_pylist() for k in range(4))
            by_dim: dict[int, list[int]] = {}
            for k, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(k)
            out: list[tuple] = []
            for dim, rows in by_dim.items():
                raw = [_packed(np.array(vectors[k], np.float64)) for k in rows]
                unit = normalised(raw, dim)
                if dim not in parts:
                    parts[dim] = projections(dim, tables, cells)
                buckets, signs = bucket_keys(unit, parts[dim]), sign_sketch(unit)
                keys = (np.arange(tables, dtype=np.int64) << 32) | (buckets.astype(np.int64) & 0xFFFFFFFF)
                out += [(ids[k], alts[k], weights[k], dim, raw[i], buckets[i].tobytes(), int(signs[i, 0]), int(signs[i, 1]), keys[i]) for i, k in enumerate(rows)]
            for at in range(0, len(out), 2048):
                some = list(zip(*out[at : at + 2048], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, types, strict=True)], names)

    return run


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of each group of equal (key, i, j) that has two rows or more, of sorted rows."""
    held: list[list[np.ndarray]] = []

    def whole() -> Iterator[list[np.ndarray]]:
        if sum(len(h[0]) for h in held) > 1:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()

    for batch in batches:
        columns = []
        for name in names:
            values = batch.column(batch.schema.get_field_index(name))
            columns.append(np.array([*values.to_pylist(), None], object)[:-1] if pa.types.is_binary(values.type) else values.to_numpy(zero_copy_only=False))
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for c in columns[:3]:
            new[1:] |= c[1:] != c[:-1]
        edges = np.concatenate(([0], np.flatnonzero(new), [n]))
        if held and any(held[-1][c][-1] != columns[c][0] for c in range(3)):
            yield from whole()
        last = len(edges) - 2
        for g in range(last + 1):
            a, b = edges[g], edges[g + 1]
            if g == 0 and last > 0 and held:
                held.append([c[a:b] for c in columns])
                yield from whole()
            elif g == last:
                held.append([c[a:b] for c in columns])
            elif b - a > 1:
                yield [c[a:b] for c in columns]
    yield from whole()


def _sides(left: np.ndarray, inner: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a group to compare with each other: within a chunk, or of two chunks."""
    own = np.flatnonzero(left)
    return own, own if inner else np.flatnonzero(~left)


_MEMBER = ["key", "i", "j", "left", "id", "alt"]


def _near(radius: int):
    """Over ids with sketches: those with someone of their group within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for key, i, j, left, ids, alts, s0, s1 in _groups(batches, [*_MEMBER, "s0", "s1"]):
            a, b = _sides(left, inner := i[0] == j[0])
            some = np.zeros(len(ids), bool)
            if len(a) and len(b):
                s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
                close = np.bitwise_count(s0[a, None] ^ s0[None, b]) + np.bitwise_count(s1[a, None] ^ s1[None, b]) <= radius
                if inner:
                    np.fill_diagonal(close, False)
                some[a[close.any(axis=1)]] = True
                some[b[close.any(axis=0)]] = True
            if some.any():
                held.append([c[some] for c in (key, i, j, left, ids, alts)])
            if len(held) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], _MEMBER)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], _MEMBER)

    return run


def _compare(threshold: float):
    """Over members with vectors: (id, n, low) of the vectors that a group links."""

    def judge(t: int, inner: bool, left: np.ndarray, ids: np.ndarray, weight: np.ndarray, unit: np.ndarray, sketch: list[bytes]) -> tuple | None:
        own, other = _sides(left, inner)
        if not len(own) or not len(other):
            return None
        a, b = np.nonzero(unit[own] @ unit[other].T >= threshold)
        a, b = own[a], other[b]
        if inner:
            a, b = a[a < b], b[a < b]
        if len(a) and t:
            earlier = np.stack([np.frombuffer(x, np.int32, t) for x in sketch])
            first = ~(earlier[a] == earlier[b]).any(axis=1)
            a, b = a[first], b[first]
        if not len(a):
            return None
        n = np.bincount(a, weight[b], len(ids)).astype(np.int64) + np.bincount(b, weight[a], len(ids)).astype(np.int64)
        low, some = spanning(a, b, len(ids)), n > 0
        return ids[some], n[some], ids[low[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, i, j, left, ids, _, weight, dims, raw, sketch in _groups(batches, [*_MEMBER, "weight", "dim", "raw", "sketch"]):
            for dim in np.unique(dims).tolist():
                k = np.flatnonzero(dims == dim)
                found = judge(int(key[0]) >> 32, i[0] == j[0], left[k], ids[k], weight[k], normalised(raw[k].tolist(), dim), sketch[k].tolist())
                if found:
                    out.append(found)
            if len(out) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["id", "n", "low"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["id", "n", "low"])

    return run


def embedding_links(classes: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK, tables: int = TABLES, cells: int = CELLS) -> DataFrame:
    """Rows (id, n, low) from classes (id, alt, weight, vector): weights linked, and a spanning link.

    id and alt together name a class.
    """
    ship(classes.sparkSession)
    keyed = materialise(classes.select("id", "alt", "weight", "vector").mapInArrow(_hash_vectors(tables, cells), _KEYED), "keyed")
    # Chunks per bucket that holds more than one.
    large = keyed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(f"n > {chunk}")
    large = materialise(large.select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "large")
    rows = keyed.select("id", "alt", "s0", "s1", F.explode("keys").alias("key")).join(large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    # Chunk c is the left side of pairs (c, j >= c) and the right side of (i < c, c).
    sides = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda o: F.struct(F.least(o, F.col("chunk")).alias("i"), F.greatest(o, F.col("chunk")).alias("j"), (o >= F.col("chunk")).alias("left")),
    )
    group = ["key", "i", "j"]
    dealt = rows.withColumn("side", F.explode(sides)).select("key", "side.*", "id", "alt", "s0", "s1").repartition(*group).sortWithinPartitions(*group)
    members = materialise(dealt.mapInArrow(_near(sketch_radius(threshold)), "key long, i int, j int, left boolean, id long, alt int"), "members")
    full = members.join(keyed.select("id", "alt", "weight", "dim", "raw", "sketch"), ["id", "alt"]).select(*_MEMBER, "weight", "dim", "raw", "sketch")
    return full.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compare(threshold), "id long, n long, low long")


def embedding_groups(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, chunk: int = CHUNK,
    tables: int = TABLES, cells: int = CELLS,
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per input row.

    Vectors that are null, empty or zero, or hold null or non-finite components,
    and rows without an id link with nothing: no links, themselves as component.
    Vectors of different lengths never link. Equal vectors link at once; rows that
    repeat an id and vector are one vector and come back repeated. An empty table
    gives no rows. Other columns are left out.
    """
    own = column(embedding).cast("array<double>")
    rows = vectors.select(column(vec_id).cast("long").alias("vec_id"), own.alias("vector"))
    sound = F.col("vec_id").isNotNull() & F.exists("vector", lambda c: c != 0) & ~F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    name = F.when(F.coalesce(sound, F.lit(False)), F.sha2(F.array_join(F.col("vector").cast("array<string>"), ","), 256))
    rows = materialise(rows.withColumn("class", name), "vectors")
    classes = rows.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("weight"), F.first("vector").alias("vector"))
    # Two classes may share an id (rows of one id with different vectors); their results meet in it.
    classes = materialise(classes.withColumn("alt", F.hash("class")), "classes")
    found = materialise(embedding_links(classes, threshold, chunk, tables, cells), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    components = connected_components(found.select(F.col("id").alias("u"), F.col("low").alias("v")))
    named = classes.select("class", "id", "weight").join(counts, "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left")
    named = materialise(named.select("class", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "named")
    return rows.join(named, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors against all."""
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op6_embeddings": op6_embeddings}


ORACLE_SQL = {
    "op6_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT reach.u, links.w FROM reach JOIN links ON reach.w = links.u),
comp AS (SELECT u, min(w) AS component_id FROM reach GROUP BY 1), n AS (SELECT u, count(DISTINCT w) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp ON comp.u = vec_id LEFT JOIN n ON n.u = vec_id"""
}
