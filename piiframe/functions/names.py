"""Names for working columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names that no column of df has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def every(df: DataFrame) -> list[Column]:
    """All columns of df by name, whatever is in the names."""
    return [df[f"`{c.replace('`', '``')}`"] for c in df.columns]


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, where body names it often."""
    return F.transform(F.array(value), body)[0]
