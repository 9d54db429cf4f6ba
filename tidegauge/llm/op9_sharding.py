"""Sharding by jump consistent hashing, in native column expressions.

The published generator (64-bit linear congruence, then a jump of the form
``(b + 1) * 2^31 / (r + 1)``) is evaluated per row inside one ``aggregate``
over a fixed number of steps. Spark's ANSI bigint multiplication refuses to
wrap, so the 64-bit state is kept as limbs of 24, 24 and 16 bits.

Law: ``key``. The id and the number of shards alone decide; adding a shard moves
rows only into the new one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm.columns import column
from tidegauge.session import table

MULTIPLIER = 2862933555777941757
SHARDS = 24
#: Sub-groups of a shard; slots are numbered inside each, then offset.
LANES = 512

_LIMB = (1 << 24) - 1


def _step(state: Column) -> Column:
    """The congruence x -> x * MULTIPLIER + 1 modulo 2^64 on limbs."""
    c = [(MULTIPLIER >> 24 * i) & _LIMB for i in range(3)]
    x0, x1, x2 = state["x0"], state["x1"], state["x2"]
    t0 = x0 * c[0] + 1
    t1 = x0 * c[1] + x1 * c[0] + F.shiftright(t0, 24)
    t2 = x0 * c[2] + x1 * c[1] + x2 * c[0] + F.shiftright(t1, 24)
    return F.struct(
        t0.bitwiseAND(_LIMB).alias("x0"), t1.bitwiseAND(_LIMB).alias("x1"), t2.bitwiseAND(0xFFFF).alias("x2"), state["b"].alias("b"), state["j"].alias("j")
    )


def _limbs(key: Column) -> tuple[Column, Column, Column]:
    key = key.cast("long")
    return (
        key.bitwiseAND(_LIMB),
        F.shiftrightunsigned(key, 24).bitwiseAND(_LIMB),
        F.shiftrightunsigned(key, 48).bitwiseAND(0xFFFF),
    )


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of a bigint key among ``shards`` (1 or more)."""
    x0, x1, x2 = _limbs(key)
    start = F.struct(x0.alias("x0"), x1.alias("x1"), x2.alias("x2"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def advance(state: Column, _: Column) -> Column:
        moved = _step(state)
        top = F.shiftleft(moved["x2"], 15).bitwiseOR(F.shiftright(moved["x1"], 9))  # the state's upper 31 bits
        ahead = F.floor((state["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (top + 1).cast("double"))).cast("long")
        return F.when(
            state["j"] < shards,
            F.struct(moved["x0"].alias("x0"), moved["x1"].alias("x1"), moved["x2"].alias("x2"), state["j"].alias("b"), ahead.alias("j")),
        ).otherwise(state)

    # Each step moves at least one shard ahead, so ``shards`` steps always suffice.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, advance, lambda s: s["b"]).cast("int")


def assign_shards(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", lanes: int = LANES) -> DataFrame:
    """Every row with its shard and a gapless slot inside that shard.

    Columns: ``key``, size, text_crc32, law, shard, slot, grown_shard. Rows are
    not merged: repeated rows each get a slot, side by side. A null key counts
    as -1, a null text as empty. An empty table gives no rows. Other columns,
    also ones named like the results, are left out.

    Slots number the rows of a (shard, lane) by key, size and checksum. A lane is
    one of ``lanes`` hashes of these three, so no task holds a whole shard, nor all
    rows without a key.
    """
    body = F.coalesce(column(text).cast("string"), F.lit(""))
    known = F.coalesce(column(key).cast("long"), F.lit(-1).cast("long"))
    size, checksum = (F.octet_length(body) + 8).cast("long"), F.crc32(body.cast("binary"))
    lane = F.pmod(F.xxhash64(known, size, checksum), F.lit(lanes)).cast("int")
    rows = docs.select(
        column(key).alias("key"), size.alias("size"), checksum.alias("text_crc32"), jump_hash(known, shards).alias("shard"), jump_hash(known, shards + 1).alias("grown_shard"), lane.alias("lane"),
    )
    counts = docs.select(jump_hash(known, shards).alias("shard"), lane.alias("lane")).groupBy("shard", "lane").agg(F.count("*").alias("n"))
    # At most shards * lanes rows, whatever the input.
    before = counts.select("shard", "lane", (F.sum("n").over(Window.partitionBy("shard").orderBy("lane")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("shard", "lane").orderBy(F.col("key").asc_nulls_first(), "size", "text_crc32")
    numbered = rows.withColumn("row", F.row_number().over(inside) - 1).join(F.broadcast(before), ["shard", "lane"])
    return numbered.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("row")).cast("long").alias("slot"), "grown_shard"
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to shards 0 to 23 by the ``key`` law."""
    return assign_shards(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op9_sharding": op9_sharding}
