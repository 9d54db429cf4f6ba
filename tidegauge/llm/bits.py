"""An array of bits that tells rows apart from keys they cannot equal, in native columns.

The array has a bound whatever the keys: more keys only let more other rows pass,
so one plan serves every size. Rows that pass are joined exactly afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.session import materialise

#: Bits for a key, and the least and most bits of an array (16 MB).
BITS_A_KEY, LEAST, MOST = 32, 1 << 12, 1 << 27


def _size(n: int) -> int:
    return min(MOST, max(LEAST, 1 << (n * BITS_A_KEY - 1).bit_length()))


def _places(h: Column, size: int) -> list[Column]:
    return [h.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(size - 1))]


def bit_array(hashes: DataFrame) -> tuple[Column, int]:
    """The bits (an array of longs) of a frame with one bigint column, and how many they are.

    Set words are gathered in one row of at most 16 MB.
    """
    h = F.col(hashes.columns[0])
    size = _size(hashes.count())
    places = hashes.select(F.explode(F.array(*_places(h, size))).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits"))
    every = hashes.sparkSession.range(size // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    dense = words.unionByName(every).groupBy("word").agg(F.sum("bits").alias("bits"))
    row = dense.agg(F.array_sort(F.collect_list(F.struct("word", "bits")))["bits"].alias("bits"))
    return materialise(row, "bits").scalar(), size


def may_be_in(h: Column, bits: Column, size: int) -> Column:
    """False only where the hash is none of the array's."""
    first, second = (F.getbit(F.get(bits, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1 for place in _places(h, size))
    return first & second
