"""Windows, and functions over them."""

from __future__ import annotations

import datetime
import enum
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from ..functions.spec import Spec
from ..proxy import Getter, RowProxy, column, const, traced
from ..relation import curried


class Nulls(enum.IntEnum):
    """Where nulls go in an order."""

    FIRST = -1
    LAST = 1


class Descending:
    """An order key from the greatest to the least."""

    def __init__(self, key: Getter):
        self.key = key


def desc(key: Getter) -> Descending:
    return Descending(key)


def ordered(key: Getter | Descending, nulls: Nulls, row: RowProxy) -> Column:
    if isinstance(key, Descending):
        c = column(key.key, row)
        return c.desc_nulls_first() if nulls == Nulls.FIRST else c.desc_nulls_last()
    c = column(key, row)
    return c.asc_nulls_first() if nulls == Nulls.FIRST else c.asc_nulls_last()


@dataclass(frozen=True)
class Window:
    """A window: partitions, an order, and a frame in rows or in values of the order key.

    ``preceding`` and ``following`` are functions of the row (or plain values);
    None is the partition's start, and for ``following`` the current row in an
    ordered window or the partition's end in another.  A bound that is null in
    some row counts as None there.
    """

    mode: str
    order_by: tuple[Getter | Descending, ...] = ()
    partition_by: tuple[Getter, ...] = ()
    preceding: Getter | None = None
    following: Getter | None = None
    nulls: Nulls = Nulls.FIRST

    @staticmethod
    def _made(mode: str, order_by: Sequence, partition_by: Sequence, preceding: Any, following: Any, nulls: Nulls) -> Window:
        bound = lambda x: x if x is None or callable(x) or isinstance(x, Column) else const(x)
        return Window(mode, tuple(order_by), tuple(partition_by), bound(preceding), bound(following), nulls)

    @staticmethod
    def rows(order_by: Sequence = (), partition_by: Sequence = (), preceding: Any = None, following: Any = None, nulls: Nulls = Nulls.FIRST) -> Window:
        """A frame of so many rows before and after the current one."""
        return Window._made("rows", order_by, partition_by, preceding, following, nulls)

    @staticmethod
    def range(order_by: Sequence = (), partition_by: Sequence = (), preceding: Any = None, following: Any = None, nulls: Nulls = Nulls.FIRST) -> Window:
        """A frame of the rows whose order key is within a distance of the current one's."""
        if len(tuple(order_by)) > 1:
            raise ValueError("a range window takes one order key at most")
        return Window._made("range", order_by, partition_by, preceding, following, nulls)


@dataclass(frozen=True)
class Over:
    """A function over a window: a projection of ``select`` and ``mutate``."""

    spec: Spec
    window: Window


@curried(2)
def over(window: Window, spec: Spec) -> Over:
    """``sum(x) >> over(window)``."""
    if not isinstance(window, Window) or not isinstance(spec, Spec):
        raise TypeError("over takes a window and a function such as sum(...)")
    return Over(spec, window)


#: The column by which rows keep their order of arrival, where a window has no order of its own.
ARRIVAL = "__arrival"


def with_arrival(frame: DataFrame) -> DataFrame:
    return frame if ARRIVAL in frame.columns else frame.withColumn(ARRIVAL, F.monotonically_increasing_id())


def needs_arrival(item: Over) -> bool:
    return not item.window.order_by and item.spec.name in ("row_number", "lead", "lag", "first", "last", "nth", "moving")


def _whole(x: Any) -> int | None:
    return None if isinstance(x, bool) or not isinstance(x, int) else x


class Unfoldable(Exception):
    """A bound or an offset that differs from row to row, or that Spark's frames cannot say."""


def order_columns(item: Over, row: RowProxy, arrival: bool = True) -> list[Column]:
    own = [ordered(k, item.window.nulls, row) for k in item.window.order_by]
    return own or ([F.col(ARRIVAL).asc()] if arrival and needs_arrival(item) else [])


def window_spec(item: Over, row: RowProxy, frame: DataFrame) -> WindowSpec:
    """The window with its frame; raises Unfoldable where the frame depends on the row."""
    w = item.window
    spec = W.partitionBy(*[column(p, row) for p in w.partition_by])
    orders = order_columns(item, row)
    before = None if w.preceding is None else traced(w.preceding, row)
    after = None if w.following is None else traced(w.following, row)
    if isinstance(before, Column) or isinstance(after, Column):
        raise Unfoldable
    if w.mode == "rows":
        start = W.unboundedPreceding if before is None else _bound(before, -1)
        stop = (W.currentRow if w.order_by else W.unboundedFollowing) if after is None else _bound(after, 1)
        if orders:
            spec = spec.orderBy(*orders)
        elif before is not None or after is not None:
            spec = spec.orderBy(F.col(ARRIVAL).asc())
        return spec.rowsBetween(start, stop)
    if not w.order_by:
        if orders:
            spec = spec.orderBy(*orders)
        return spec.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    if before is None and after is None:
        return spec.orderBy(*orders).rowsBetween(W.unboundedPreceding, W.currentRow)
    key = w.order_by[0]
    inner = key.key if isinstance(key, Descending) else key
    values, scale = _range_key(column(inner, row), frame, (before, after))
    start = W.unboundedPreceding if before is None else -scale(before)
    stop = W.currentRow if after is None else scale(after)
    if isinstance(key, Descending):
        order = values.desc_nulls_first() if w.nulls == Nulls.FIRST else values.desc_nulls_last()
    else:
        order = values.asc_nulls_first() if w.nulls == Nulls.FIRST else values.asc_nulls_last()
    return spec.orderBy(order).rangeBetween(start, stop)


def _bound(x: Any, sign: int) -> int:
    n = _whole(x)
    if n is None:
        raise TypeError(f"a bound of rows must be a whole number, got {x!r}")
    return sign * n


def _range_key(key: Column, frame: DataFrame, bounds: tuple) -> tuple[Column, Any]:
    """The order key as a number, and how bounds become whole numbers of its unit."""
    if all(b is None or _whole(b) is not None for b in bounds):
        return key, lambda b: b
    if not all(b is None or isinstance(b, datetime.timedelta) for b in bounds):
        raise Unfoldable
    kind = frame.select(key).schema[0].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(key), lambda b: b.days
    return micros(key, kind), lambda b: b // datetime.timedelta(microseconds=1)


def micros(key: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit(datetime.datetime(1970, 1, 1)).cast("timestamp_ntz"), key)
    return F.unix_micros(key)


def compile_over(item: Over, row: RowProxy, frame: DataFrame) -> Column:
    """The function over its window as one expression; raises Unfoldable where it takes a rewrite of the frame."""
    spec = item.spec
    name, args = spec.name, spec.columns(row)
    if name in ("moving", "ranking"):
        raise Unfoldable
    plain = W.partitionBy(*[column(p, row) for p in item.window.partition_by])
    if spec.kind == "rank":
        orders = order_columns(item, row) or [F.lit(0).asc()]
        function = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[name]
        return (function().over(plain.orderBy(*orders)) - 1).cast("long")
    if name in ("lead", "lag"):
        n, default = traced(spec.extra["n"], row), traced(spec.extra["default"], row)
        if isinstance(n, Column) or isinstance(default, Column):
            raise Unfoldable
        if n is None:
            return F.lit(default)
        function = F.lead if name == "lead" else F.lag
        return function(args[0], n, default).over(plain.orderBy(*order_columns(item, row)))
    w = window_spec(item, row, frame)
    if name == "first":
        return F.first(args[0], ignorenulls=True).over(w)
    if name == "last":
        return F.last(args[0], ignorenulls=True).over(w)
    if name == "nth":
        i = traced(spec.extra["i"], row)
        if isinstance(i, Column) or i is None or i < 0:
            raise Unfoldable
        return F.nth_value(args[0], i + 1).over(w)
    value = spec.build(*args).over(w)
    if spec.name == "custom":
        try:
            frame.select(value)
        except AnalysisException:  # a composition of aggregates is no single window function
            raise Unfoldable from None
    return value if spec.empty is None else F.coalesce(value, F.lit(spec.empty))
