"""Walking structs, arrays and maps: the schema is followed when the plan is built."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import every, unused


def has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StringType):
        return True
    if isinstance(kind, T.StructType):
        return any(has_text(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return has_text(kind.elementType)
    return isinstance(kind, T.MapType) and has_text(kind.valueType)


def walk(c: Column, kind: T.DataType, leaf: Callable[[Column], Column]) -> Column:
    """c with leaf applied to every string in it; keys of maps and other types stay."""
    if isinstance(kind, T.StringType):
        return leaf(c)
    if not has_text(kind):
        return c
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType, leaf).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: walk(x, kind.elementType, leaf))
    return F.transform_values(c, lambda _, v: walk(v, kind.valueType, leaf))


def leaves(c: Column, kind: T.DataType) -> Column:
    """All strings in c, as one array."""
    nothing = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.when(c.isNotNull(), F.array(c)).otherwise(nothing)
    if not has_text(kind):
        return nothing
    if isinstance(kind, T.StructType):
        parts = [leaves(c[f.name], f.dataType) for f in kind.fields if has_text(f.dataType)]
        return F.when(c.isNotNull(), F.concat(*parts)).otherwise(nothing)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(c, lambda x: leaves(x, kind.elementType))), nothing)
    return F.coalesce(F.flatten(F.transform(F.map_values(c), lambda x: leaves(x, kind.valueType))), nothing)


def replace_leaves(df: DataFrame, kinds: dict[str, T.DataType], replaced: Callable[[Column], Column]) -> DataFrame:
    """df with every string of its (nested) columns replaced.  The replacement is worked out once
    for each different string of a row, in one expression however many places the schema has."""
    made = unused(df, "leaves")[0]
    texts = F.concat(*[leaves(F.col(f"`{c}`"), kind) for c, kind in kinds.items()])
    texts = F.array_distinct(F.filter(texts, lambda t: t.isNotNull()))
    pairs = F.transform(texts, lambda t: F.struct(t.alias("key"), replaced(t).alias("value")))
    work = df.withColumn(made, F.map_from_entries(pairs))
    leaf = lambda t: F.when(t.isNotNull(), F.element_at(made, t))
    return work.select(*[walk(c, kinds[n], leaf).alias(n) if n in kinds else c for n, c in zip(df.columns, every(work))])
