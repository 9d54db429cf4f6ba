"""Names for working columns that no caller's column has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def same(left: list[Column], right: list[Column]) -> Column:
    """Whether all parts are equal, nulls counting as equal."""
    out = left[0].eqNullSafe(right[0])
    for a, b in zip(left[1:], right[1:], strict=True):
        out = out & a.eqNullSafe(b)
    return out
