"""Mixing sources to target weights by capped water-filling.

Every source gets its weight's share of the mix. Sources whose share is above the
maximum number of epochs are clamped to it, and what they leave is dealt to the
others by weight, until no source is above. A round is one aggregate over the table
of sources; the level that it finds only rises, so rounds are few.

A source's target is met by whole repetitions of all its documents, and by one more of
those that come first in a seeded order, the last of them in part. That document is
found by sums over the leading digits of the draws, three and then six, so only the
rows of one in 16 million draws are ever ordered. Documents themselves are neither
sorted nor shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm.columns import column
from tidegauge.session import materialise, table

WEIGHTS, PERCENT, EPOCHS, SEED = (3, 1, 2), 150, 2, 11
#: Equal rows that one task writes out at once.
_RUN = 100_000


def _whole(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("decimal(38,0)")


def weighted(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds weight: ``weights`` repeating over the sources by code point, null last.

    Ranks are counted by ranges of sources, so no task holds them all.
    """
    ranged = materialise(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    # As many rows as there are partitions.
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    rank = F.col("before") + F.row_number().over(inside) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    return ranged.join(F.broadcast(before), "part").select("source", "source_size", weight.alias("weight"))


def water_fill(sources: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """Adds target (double) to rows (source, source_size, weight).

    Targets sum up to ``percent`` of all sizes where ``epochs`` allow it; else every
    source is at its maximum.
    """
    row = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, under = percent * (row[0] or 0), 100 * (row[1] or 0)
    over = total
    while under:
        above = _whole(F.col("weight")) * _whole(over) > _whole(F.col("source_size")) * _whole(epochs * under)
        row = sources.agg(F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        level = total - 100 * epochs * (row[0] or 0), 100 * (row[1] or 0)
        if level == (over, under):
            break
        over, under = level
    limit = (epochs * F.col("source_size")).cast("double")
    if not under:
        return sources.withColumn("target", limit)
    above = _whole(F.col("weight")) * _whole(over) > _whole(F.col("source_size")) * _whole(epochs * under)
    return sources.withColumn("target", F.when(above, limit).otherwise((F.col("weight") * F.lit(over)).cast("double") / F.lit(float(under))))


def _crossing(sums: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with keys, before0, rest and n: the one where the running sum from before0 reaches rest; adds before."""
    window = Window.partitionBy(*keys).orderBy(*order)
    running = sums.withColumn("before", F.col("before0") + F.sum("n").over(window) - F.col("n"))
    return running.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))


def _cuts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """For each source with a part of a repetition to give: the draw at which it is used up, and what equal draws share."""
    open_ = sources.where("rest > 0").select(F.col("source").alias("own"), "rest", F.lit(0).cast("long").alias("before0"), F.lit("").alias("lead"))
    for digits in (3, 6):
        lead = F.substring("draw", 1, digits)
        sums = rows.join(open_, F.col("source").eqNullSafe(F.col("own")) & F.col("draw").startswith(F.col("lead")))
        sums = sums.groupBy("own", "rest", "before0", lead.alias("next")).agg(F.sum("size").alias("n"))
        open_ = materialise(_crossing(sums, ["own"], ["next"]).select("own", "rest", F.col("before").alias("before0"), F.col("next").alias("lead")), "cuts")
    last = rows.join(open_, F.col("source").eqNullSafe(F.col("own")) & F.col("draw").startswith(F.col("lead")))
    # Equal rows are counted, so a row that fills the table is one here.
    last = last.groupBy("own", "rest", "before0", "draw", "key", "size").agg(F.count("*").alias("copies")).withColumn("n", F.col("size") * F.col("copies"))
    found = _crossing(last, ["own"], ["draw", "key", "size"])
    return materialise(found.select("own", F.col("draw").alias("cut"), "key", "size", "copies", (F.col("rest") - F.col("before")).alias("left")), "cuts")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken), one per input row.

    size counts words, taken the words that the mix takes of a row, repeats counted: a
    source's sum up to its target, rounded. Null and empty texts have size 0. Null
    sources are one source, the last. Draws hang on the seed, the id and the text, so
    reruns agree; repeated rows draw alike, and where the cut falls among them the
    first so many count. An empty table gives no rows. Other columns are left out.
    """
    body, key = F.coalesce(column(text).cast("string"), F.lit("")), column(doc_id).cast("long")
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.md5(body)))
    size = F.regexp_count(body, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    rows = materialise(docs.select(key.alias("key"), column(source).cast("string").alias("source"), size.alias("size"), draw.alias("draw")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = water_fill(materialise(weighted(sizes, weights), "weighted"), percent, epochs)
    wanted, own_size = F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size")
    sources = sources.withColumn("times", F.when(own_size > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(0))
    sources = materialise(sources.withColumn("rest", wanted - F.col("times") * own_size), "targets")
    cuts = _cuts(rows, sources)
    plan = sources.join(cuts.select("own", "cut"), F.col("source").eqNullSafe(F.col("own")), "left").select(F.col("source").alias("own"), "source_size", "target", "times", "cut")
    known = rows.join(plan, F.col("source").eqNullSafe(F.col("own")))
    # Rows with the draw of the cut are written from their counts below.
    whole = known.where(F.col("cut").isNull() | (F.col("draw") != F.col("cut")))
    whole = whole.withColumn("taken", F.col("times") * F.col("size") + F.when(F.col("draw") < F.col("cut"), F.col("size")).otherwise(0))
    tied = known.where("draw = cut").groupBy("own", "source_size", "target", "times", "cut", "key", "size").agg(F.count("*").alias("copies"))
    edge = cuts.select(F.col("own").alias("cut_of"), F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), "left")
    tied = tied.join(edge, F.col("own").eqNullSafe(F.col("cut_of")))
    place, cut_place = F.struct(F.col("key").isNotNull(), "key", "size"), F.struct(F.col("cut_key").isNotNull(), "cut_key", "cut_size")
    left = F.when(place < cut_place, F.col("size") * F.col("copies")).when(place > cut_place, F.lit(0)).otherwise(F.col("left"))
    runs = tied.withColumn("left", left).withColumn("run", F.explode(F.expr(f"sequence(0L, (copies - 1) div {_RUN})"))).repartition("own", "run")
    copies = runs.withColumn("copy", F.explode(F.expr(f"sequence(run * {_RUN}, least(copies, (run + 1) * {_RUN}) - 1)")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("copy") * F.col("size")))
    copies = copies.withColumn("taken", F.col("times") * F.col("size") + part)
    out = [F.col("key").alias(doc_id), F.col("own").alias("source"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return whole.select(*out).unionByName(copies.select(*out))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by source."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op11_mixing": op11_mixing}


ORACLE_SQL = {
    "op11_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('11|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY 1),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY size::DOUBLE / weight, source) AS k FROM w),
r AS (SELECT *, 150 * sum(size) OVER () - 200 * coalesce(sum(size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
  100 * sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den FROM o),
level AS (SELECT num, den FROM r WHERE weight * num <= 2 * size * den ORDER BY k LIMIT 1),
t AS (SELECT source, size AS source_size, CASE WHEN weight * num > 2 * size * den THEN CAST(2 * size AS DOUBLE) ELSE CAST(weight * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target
  FROM w CROSS JOIN (SELECT CAST(num AS HUGEINT) AS num, CAST(den AS HUGEINT) AS den FROM level)),
x AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS times FROM t),
c AS (SELECT d.doc_id, d.size, x.source_size, x.target, x.times, CAST(floor(target + 0.5) AS BIGINT) - times * source_size AS rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, CAST(times * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM c"""
}
