"""The twelve aggregates and the hook for one's own; all leave nulls out."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..proxy import Getter
from .spec import Spec


def _aggregate(name: str, build: Callable[..., Column], *getters: Getter, empty=None) -> Spec:
    return Spec(name, "aggregate", getters, build, empty)


def count(x: Getter) -> Spec:
    """The number of non-null values; 0 over none."""
    return _aggregate("count", F.count, x, empty=0)


def sum(x: Getter) -> Spec:
    """The sum; null over no values."""
    return _aggregate("sum", F.sum, x)


def total(x: Getter) -> Spec:
    """The sum; 0 over no values."""
    return _aggregate("total", F.sum, x, empty=0)


def mean(x: Getter) -> Spec:
    """The mean; null over no values."""
    return _aggregate("mean", F.avg, x)


def min(x: Getter) -> Spec:
    """The least value; null over none."""
    return _aggregate("min", F.min, x)


def max(x: Getter) -> Spec:
    """The greatest value; null over none."""
    return _aggregate("max", F.max, x)


def cov_samp(x: Getter, y: Getter) -> Spec:
    """Sample covariance of the pairs without a null; null for fewer than two."""
    return _aggregate("cov_samp", F.covar_samp, x, y)


def cov_pop(x: Getter, y: Getter) -> Spec:
    """Population covariance of the pairs without a null; null for none."""
    return _aggregate("cov_pop", F.covar_pop, x, y)


def var_samp(x: Getter) -> Spec:
    """Sample variance; null for fewer than two values."""
    return _aggregate("var_samp", F.var_samp, x)


def var_pop(x: Getter) -> Spec:
    """Population variance; null for no values."""
    return _aggregate("var_pop", F.var_pop, x)


def stdev_samp(x: Getter) -> Spec:
    """Sample standard deviation; null for fewer than two values."""
    return _aggregate("stdev_samp", F.stddev_samp, x)


def stdev_pop(x: Getter) -> Spec:
    """Population standard deviation; null for no values."""
    return _aggregate("stdev_pop", F.stddev_pop, x)


def custom(function: Callable[..., Column], *getters: Getter, empty=None) -> Spec:
    """An aggregate of one's own.

    ``function`` makes an aggregate Column of the getters' columns.  Composed
    of Spark's aggregates it is combined before the shuffle like those; a
    grouped-aggregate ``pandas_udf`` works too, at the price of moving the
    group's values to Python.
    """
    return _aggregate("custom", function, *getters, empty=empty)


def stepwise(kind: type, *getters: Getter, returns: str = "double", empty=None) -> Spec:
    """An aggregate of one's own as a class: ``step`` takes a row's values, ``finalize`` gives the result.

    It sees the rows of a group or frame in no set order, nulls as None.  The
    group's values move to Python, so a group has to fit one worker; ``custom``
    with Spark's own aggregates has no such limit.
    """

    def run(*columns: pd.Series):
        state = kind()
        for values in zip(*columns, strict=True):
            state.step(*[None if pd.isna(v) else v for v in values])
        return state.finalize()

    return _aggregate("custom", F.pandas_udf(run, DataType.fromDDL(returns), F.PandasUDFType.GROUPED_AGG), *getters, empty=empty)
