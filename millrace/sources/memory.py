"""Relations of rows in memory."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..relation import Relation, curried

_TYPES = {
    bool: T.BooleanType(),
    int: T.LongType(),
    float: T.DoubleType(),
    str: T.StringType(),
    bytes: T.BinaryType(),
    decimal.Decimal: T.DecimalType(38, 18),
    datetime.date: T.DateType(),
    datetime.datetime: T.TimestampNTZType(),
}


def _type(values: list[Any]) -> T.DataType | None:
    """The Spark type of a column's values; None: leave it to Spark."""
    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return T.LongType()  # only nulls
    if kinds <= {int, float} and len(kinds) == 2:
        return T.DoubleType()
    if len(kinds) == 1:
        return _TYPES.get(kinds.pop())
    return None


@curried(1)
def table(rows: Iterable[Mapping[str, Any]] | DataFrame) -> Relation:
    """A relation of an iterable of mappings, or of a DataFrame.

    Columns are those of all rows in the order they first appear; a row
    without one has null there.  A column of nulls only is ``bigint``.
    """
    if isinstance(rows, Relation):
        return rows
    if isinstance(rows, DataFrame):
        return Relation(rows)
    rows = [dict(r) for r in rows]
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    names = list(dict.fromkeys(name for r in rows for name in r))
    if not names:
        return Relation(spark.createDataFrame([], T.StructType([])))
    values = [[r.get(name) for name in names] for r in rows]
    kinds = [_type([v[k] for v in values]) for k in range(len(names))]
    if all(kinds):
        whole = [[float(x) if kind == T.DoubleType() and x is not None else x for x, kind in zip(v, kinds, strict=True)] for v in values]
        return Relation(spark.createDataFrame(whole, T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)])))
    return Relation(spark.createDataFrame(values, names))
