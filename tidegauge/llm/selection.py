"""The k-th largest of a column, found by counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def threshold(keys: DataFrame, k: int, bins: int = 4096) -> int | None:
    """The k-th largest of a bigint column ``q`` (None: fewer than k rows, or k is 0)."""
    row = keys.agg(F.min("q"), F.max("q"), F.count("*")).first()
    low, high, n = row[0], row[1], row[2]
    if not k or n <= k:
        return None if n <= k else high + 1
    need = k
    while low < high:
        width = -(-(high - low + 1) // bins)
        part = keys.where(F.col("q").between(low, high)).groupBy(F.expr(f"(q - ({low})) div {width}L").alias("bin")).agg(F.count("*").alias("n"))
        for row in sorted(part.collect(), key=lambda r: -r["bin"]):
            if row["n"] >= need:
                low, high = low + row["bin"] * width, min(high, low + (row["bin"] + 1) * width - 1)
                break
            need -= row["n"]
    return low
