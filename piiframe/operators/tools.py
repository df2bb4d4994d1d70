"""Wrapping user functions: they see real values, and what they return is tokenised again."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import unused


class SecureFunction:
    """A pandas function over columns, used as fn(engine, df, inputs, out, as_of)."""

    def __init__(self, fn: Callable, returns: str, name: str | None = None, description: str | None = None):
        functools.update_wrapper(self, fn)
        self.fn, self.returns = fn, returns
        self.name, self.description = name or fn.__name__, description or fn.__doc__

    def __call__(self, engine, df: DataFrame, inputs: list[str], out: str, as_of: float) -> DataFrame:
        """df with the function's result.  Inputs (nested or not) are restored for the call
        only; strings in the result are tokenised."""
        held = unused(df.withColumn(out, F.lit(0)), *[f"in{i}" for i in range(len(inputs))])
        work = df.select("*", *[F.col(f"`{c}`").alias(h) for c, h in zip(inputs, held)])
        work = engine.deep_decode(work, held, as_of)
        call = F.pandas_udf(self.fn, self.returns)
        work = work.withColumn(out, call(*[F.col(h) for h in held])).drop(*held)
        return engine.deep_encode(work, [out])


def secure_udf(fn: Callable | None = None, *, returns: str = "string", name: str | None = None, description: str | None = None):
    """Decorator: @secure_udf or @secure_udf(returns=..., name=..., description=...)."""
    if fn is not None:
        return SecureFunction(fn, returns, name, description)
    return lambda f: SecureFunction(f, returns, name, description)
