"""The rotation bucket of an endpoint: FNV-1a over its bytes.

The one function that native columns cannot express: it needs a 64-bit multiply
that wraps. It runs in Arrow batches, over distinct endpoints only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def fnv1a(texts: list[str]) -> np.ndarray:
    """64-bit FNV-1a of each text's UTF-8 bytes, all texts a byte position at a time."""
    raw = [t.encode() for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes
    out = np.full(len(raw), _OFFSET)
    for k in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > k)
        out[live] = (out[live] ^ data[starts[live] + k].astype(np.uint64)) * _PRIME
    return out


def rotation_bucket(url: Column, every: int) -> Column:
    """hash(url) mod every; null for a null URL."""

    def bucket(urls: pd.Series) -> pd.Series:
        known = urls.notna()
        out = pd.Series(pd.NA, index=urls.index, dtype="Int64")
        out[known] = (fnv1a(urls[known].tolist()) % np.uint64(every)).astype(np.int64)
        return out

    bucket.__annotations__ = {"urls": pd.Series, "return": pd.Series}
    return F.pandas_udf(bucket, "long")(url)


def due_today(url: Column, at: Column, every: int) -> Column:
    """Whether a day's slot is the URL's; every URL if ``every`` is below 2."""
    if every < 2:
        return F.lit(True)
    return rotation_bucket(url, every) == F.pmod(F.unix_date(F.to_date(at)), F.lit(every))
