"""Plain functions of one text as Arrow-batched column functions."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def rowwise(fn: Callable, schema: str) -> Callable[[Column], Column]:
    """``fn`` of a text (empty for null) over a column; the function is made when it's called, as workers import modules without a session."""

    def call(column: Column) -> Column:
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([fn(t if isinstance(t, str) else "") for t in texts], dtype=object)

        return F.pandas_udf(run, schema)(column)

    return call


def rowwise_struct(fn: Callable, schema: str, names: tuple[str, ...]) -> Callable[[Column], Column]:
    """``fn`` of a text to a tuple, as a struct column."""

    def call(column: Column) -> Column:
        def run(texts: pd.Series) -> pd.DataFrame:
            found = [fn(t if isinstance(t, str) else "") for t in texts]
            return pd.DataFrame({n: pd.Series([r[i] for r in found], dtype=object) for i, n in enumerate(names)})

        return F.pandas_udf(run, schema)(column)

    return call


def rowwise_pair(fn: Callable, schema: str) -> Callable[[Column, Column], Column]:
    """``fn`` of two texts over two columns."""

    def call(left: Column, right: Column) -> Column:
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([fn(x if isinstance(x, str) else "", y if isinstance(y, str) else "") for x, y in zip(a, b, strict=True)], dtype=object)

        return F.pandas_udf(run, schema)(left, right)

    return call
