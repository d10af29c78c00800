"""Offsets and frame bounds that differ from row to row.

Spark's windows take constant offsets and bounds.  Where they depend on the
row, each row is numbered within its partition, and

- an offset becomes an equi-join on partition and number;
- a frame becomes a pair of numbers.  For bounds in rows that is arithmetic;
  for bounds in values the bounds are sorted in among the rows and counted, so
  no row is ever compared with all of its partition;
- an aggregate over a frame joins rows with the blocks of numbers that their
  frames touch, an equi-join again, whose output is the frames' total width.

Numbering breaks ties by all other columns that have an order, so that both
sides of a join number alike.  A window without an order goes by arrival, which
two passes over a plan need not agree on; there the frame is checkpointed with
its numbers, in the folder that all executors share.

Functions of one's own over frames (``moving``, ``ranking``) get a partition at
once, as Arrow, with the bounds of its frames.
"""

from __future__ import annotations

import datetime
import tempfile
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.spec import Spec
from ..operators.window import (
    ARRIVAL,
    Descending,
    Nulls,
    Over,
    Unfoldable,
    Window,
    compile_over,
    micros,
    order_columns,
    window_spec,
    with_arrival,
)
from ..proxy import RowProxy, column, traced

#: Rows of a block that frames are joined with.
BLOCK = 64


def _sortable(kind: T.DataType) -> bool:
    return not isinstance(kind, T.MapType | T.VariantType) and not (
        isinstance(kind, T.ArrayType) and not _sortable(kind.elementType)
    )


def _numbered(frame: DataFrame, item: Over, row: RowProxy) -> tuple[DataFrame, list[str]]:
    """``frame`` with its partition keys ``__p*``, the number ``__n`` (from 1) and the size ``__size`` of the partition."""
    keys = [f"__p{k}" for k in range(len(item.window.partition_by))]
    orders = [*(order_columns(item, row, arrival=False) or [F.col(ARRIVAL).asc()])]
    ties = [F.col(f"`{f.name}`").asc_nulls_first() for f in frame.schema if _sortable(f.dataType)]
    parts = [column(p, row) for p in item.window.partition_by]
    out = frame.select("*", *[p.alias(k) for p, k in zip(parts, keys, strict=True)])
    by = W.partitionBy(*keys)
    return (
        out.withColumn("__n", F.row_number().over(by.orderBy(*orders, *ties)).cast("long")).withColumn(
            "__size", F.count(F.lit(1)).over(by)
        ),
        keys,
    )


def _join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str) -> DataFrame:
    on = reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])
    return left.join(right, on, how)


def _seen(df: DataFrame, keys: list[str], number: Column, value: dict[str, Column]) -> DataFrame:
    """What a row shows to others: its partition, number and values, under names that clash with nothing."""
    return df.select(*[F.col(k).alias(f"__r{k}") for k in keys], number.alias("__rn"), *[v.alias(n) for n, v in value.items()])


def _bounds(frame: DataFrame, item: Over, row: RowProxy, keys: list[str]) -> DataFrame:
    """``frame`` with the first and last number of each row's frame, ``__lo`` and ``__hi``; empty where lo > hi."""
    w = item.window
    try:
        spec = window_spec(item, row, frame)
        n = F.col("__n")
        if w.mode == "rows" or not w.order_by:
            raise Unfoldable if w.mode == "rows" else KeyError
        return frame.withColumn("__lo", F.min(n).over(spec)).withColumn("__hi", F.max(n).over(spec)).fillna({"__lo": 1, "__hi": 0})
    except KeyError:
        return frame.withColumn("__lo", F.lit(1).cast("long")).withColumn("__hi", F.col("__size"))
    except Unfoldable:
        pass
    before = None if w.preceding is None else column(w.preceding, row)
    after = None if w.following is None else column(w.following, row)
    if w.mode == "rows":
        # A bound that is null in a row is as if it were not given.
        one = F.lit(1).cast("long")
        lo = one if before is None else F.when(before.isNull(), one).otherwise(F.greatest(F.col("__n") - before, one))
        last = F.col("__n") if w.order_by else F.col("__size")
        hi = last if after is None else F.when(after.isNull(), last).otherwise(F.least(F.col("__n") + after, F.col("__size")))
        return frame.withColumn("__lo", lo).withColumn("__hi", hi)
    return _range_bounds(frame, item, row, keys, before, after)


def _range_bounds(
    frame: DataFrame, item: Over, row: RowProxy, keys: list[str], before: Column | None, after: Column | None
) -> DataFrame:
    w = item.window
    key = w.order_by[0]
    sign = -1 if isinstance(key, Descending) else 1
    value = column(key.key if isinstance(key, Descending) else key, row)
    kind = frame.select(value).schema[0].dataType
    static = [None if b is None else traced(b, row) for b in (w.preceding, w.following)]
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        days = isinstance(kind, T.DateType)
        value = F.unix_date(value) if days else micros(value, kind)

        def unit(bound: Column | None, plain) -> Column | None:
            if isinstance(plain, datetime.timedelta):
                return F.lit(plain.days if days else plain // datetime.timedelta(microseconds=1))
            return bound if bound is None or days else bound.cast("interval day to second").cast("long")

        before, after = unit(before, static[0]), unit(after, static[1])
    value = value * F.lit(sign) if sign < 0 else value
    frame = frame.withColumn("__key", value)
    low = frame.select(*keys, (F.col("__key") - before).alias("__at"), F.col("__n"), F.lit(-1).alias("__tag")) if before is not None else None
    high = frame.select(*keys, (F.col("__key") + after).alias("__at"), F.col("__n"), F.lit(1).alias("__tag")) if after is not None else None
    own = frame.select(*keys, F.col("__key").alias("__at"), F.col("__n"), F.lit(0).alias("__tag"))
    # Low bounds sort before the rows of their value and high bounds after, so counts of rows are numbers.
    mixed = reduce(DataFrame.unionByName, [x for x in (low, own, high) if x is not None])
    nulls_first = w.nulls == Nulls.FIRST
    at = F.col("__at").asc_nulls_first() if nulls_first else F.col("__at").asc_nulls_last()
    running = W.partitionBy(*keys).orderBy(at, "__tag").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = mixed.withColumn("__c", F.sum((F.col("__tag") == 0).cast("long")).over(running)).where("__tag <> 0")
    edges = counted.groupBy(*keys, "__n").agg(
        F.max(F.when(F.col("__tag") < 0, F.col("__c") + 1)).alias("__low"), F.max(F.when(F.col("__tag") > 0, F.col("__c"))).alias("__high")
    )
    right = edges.select(*[F.col(k).alias(f"__r{k}") for k in keys], F.col("__n").alias("__rn"), "__low", "__high")
    joined = _join(frame, right, [*[(k, f"__r{k}") for k in keys], ("__n", "__rn")], "left")
    one = F.lit(1).cast("long")
    return (
        joined.withColumn("__lo", one if before is None else F.when(before.isNull(), one).otherwise(F.col("__low")))
        .withColumn("__hi", F.col("__n") if after is None else F.when(after.isNull(), F.col("__n")).otherwise(F.col("__high")))
        .drop("__key", "__rn", "__low", "__high", *[f"__r{k}" for k in keys])
    )


def _add_moved(out: DataFrame, base: DataFrame, keys: list[str], into: str, spec: Spec, row: RowProxy) -> DataFrame:
    """``out`` with the value of another row, found by its number: ``lead``, ``lag`` and ``nth``."""
    args, n = spec.columns(row), F.col("__n")
    if spec.name == "nth":
        i = column(spec.extra["i"], row)
        to = F.when(i >= 0, F.col("__lo") + i).otherwise(F.col("__hi") + 1 + i)
        to = F.when(to.between(F.col("__lo"), F.col("__hi")), to)
        default = F.lit(None)
    else:
        offset = column(spec.extra["n"], row)
        to = n + (offset if spec.name == "lead" else -offset)
        default = column(spec.extra["default"], row)
    out = out.withColumn("__to", to).withColumn("__default", default)
    shown = _seen(base, keys, n, {"__x": args[0], "__matched": F.lit(True)})
    names = [c for c in out.columns if c not in ("__to", "__default")]
    out = _join(out, shown, [*[(k, f"__r{k}") for k in keys], ("__to", "__rn")], "left")
    # A null in a row that is there stays; only a missing row takes the default.
    return out.select(*names, F.when(F.col("__matched"), F.col("__x")).otherwise(F.col("__default")).alias(into))


def _add_framed(out: DataFrame, base: DataFrame, keys: list[str], specs: dict[str, Spec], row: RowProxy) -> DataFrame:
    """``out`` with aggregates over each row's frame, all by one join of frames with blocks of rows."""
    block = lambda c: F.floor(c / BLOCK).cast("long")
    args = {into: spec.columns(row) for into, spec in specs.items()}
    values = {f"__x{i}_{j}": a for i, own in enumerate(args.values()) for j, a in enumerate(own)}
    shown = _seen(base, keys, F.col("__n"), values).withColumn("__rblock", block(F.col("__rn")))
    wide = base.where(F.col("__lo") <= F.col("__hi")).select(
        *keys, "__n", "__lo", "__hi", F.explode(F.sequence(block(F.col("__lo")), block(F.col("__hi")))).alias("__block")
    )
    pairs = _join(wide, shown, [*[(k, f"__r{k}") for k in keys], ("__block", "__rblock")], "inner")
    pairs = pairs.where(F.col("__rn").between(F.col("__lo"), F.col("__hi")))
    made = []
    for i, (into, spec) in enumerate(specs.items()):
        own = [F.col(f"__x{i}_{j}") for j in range(len(args[into]))]
        if spec.name in ("first", "last"):
            pick = F.min_by if spec.name == "first" else F.max_by
            value = pick(own[0], F.when(own[0].isNotNull(), F.col("__rn")))
        else:
            value = spec.build(*own)
        made.append(value.alias(f"__value{i}"))
    found = pairs.groupBy(*keys, "__n").agg(*made)
    found = found.select(*[F.col(k).alias(f"__r{k}") for k in keys], F.col("__n").alias("__rn"), *[f"__value{i}" for i in range(len(made))])
    names = out.columns
    out = _join(out, found, [*[(k, f"__r{k}") for k in keys], ("__n", "__rn")], "left")
    final = []
    for i, (into, spec) in enumerate(specs.items()):
        value = F.col(f"__value{i}")
        final.append((value if spec.empty is None else F.coalesce(value, F.lit(spec.empty))).alias(into))
    return out.select(*names, *final)


def _add_whole(frame: DataFrame, window: Window, specs: dict[str, Spec], row: RowProxy) -> DataFrame:
    """Aggregates over whole partitions: grouped once and joined back."""
    names, parts = frame.columns, [column(p, row) for p in window.partition_by]
    keys = [f"__p{k}" for k in range(len(parts))]
    grouped = frame.groupBy(*[p.alias(f"__r{k}") for p, k in zip(parts, keys, strict=True)])
    made = []
    for into, spec in specs.items():
        value = spec.build(*spec.columns(row))
        made.append((value if spec.empty is None else F.coalesce(value, F.lit(spec.empty))).alias(into))
    found = grouped.agg(*made)
    if not keys:
        return frame.crossJoin(found)  # one row
    left = frame.select("*", *[p.alias(k) for p, k in zip(parts, keys, strict=True)])
    return _join(left, found, [(k, f"__r{k}") for k in keys], "left").select(*names, *specs)


def _settled(frame: DataFrame) -> DataFrame:
    """``frame`` with its numbers of arrival, the same in every pass."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not context.master.startswith("local"):
                raise RuntimeError("a frame that differs by row needs an order, or spark.checkpoint.dir set")
            at = tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(at)
    return with_arrival(frame).checkpoint()


def _add_own(out: DataFrame, window: Window, keys: list[str], into: str, spec: Spec, row: RowProxy) -> DataFrame:
    """``out`` with a function of the user's over each partition, in the order of its numbers."""
    names = out.columns
    if spec.name == "ranking":
        args = [column(k.key if isinstance(k, Descending) else k, row) for k in window.order_by]
    else:
        args = spec.columns(row)
    given = [f"__a{k}" for k in range(len(args))]
    kind = T.DataType.fromDDL(spec.extra["returns"])
    arrow = to_arrow_type(kind)
    framed, function = spec.name == "moving", spec.build

    def run(part: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part["__n"]))
        values = [part[g].to_pandas() for g in given]
        bounds = [part["__lo"].to_numpy() - 1, part["__hi"].to_numpy()] if framed else []
        said = pd.Series(function(*bounds, *values), dtype=object)
        return part.select(names).append_column(into, pa.Array.from_pandas(said, type=arrow))

    sent = out.select("*", *[a.alias(g) for a, g in zip(args, given, strict=True)])
    return sent.groupBy(*keys).applyInArrow(run, T.StructType([*out.schema.fields, T.StructField(into, kind)]))


def add_overs(frame: DataFrame, window: Window, specs: dict[str, Spec], row: RowProxy) -> DataFrame:
    """``frame`` with a column for each of ``specs``, functions over one window that no Spark window can say.

    The frame is numbered once; its plan appears once for the rows themselves,
    twice for all aggregates together and once for every offset.
    """
    unbounded = window.mode == "range" or window.preceding is None and window.following is None
    if not window.order_by and unbounded and all(s.kind == "aggregate" for s in specs.values()):
        return _add_whole(frame, window, specs, row)
    names = frame.columns
    if not window.order_by:
        frame = _settled(frame)
    item = Over(next(iter(specs.values())), window)
    base, keys = _numbered(frame, item, row)
    if any(s.name not in ("lead", "lag") for s in specs.values()):
        base = _bounds(base, item, row, keys)
    out = base
    for into, spec in specs.items():
        if spec.name in ("lead", "lag", "nth"):
            out = _add_moved(out, base, keys, into, spec, row)
        elif spec.name in ("moving", "ranking"):
            out = _add_own(out, window, keys, into, spec, row)
    framed = {into: s for into, s in specs.items() if s.name not in ("lead", "lag", "nth", "moving", "ranking")}
    if framed:
        out = _add_framed(out, base, keys, framed, row)
    return out.select(*names, *specs)


def over_columns(frame: DataFrame, items: dict[str, Over], row: RowProxy) -> tuple[DataFrame, dict[str, Column]]:
    """The frame, rewritten if need be, and an expression of every item in it."""
    out: dict[str, Column] = {}
    rest: dict[Window, dict[str, Spec]] = {}
    hidden = {}
    for k, (name, item) in enumerate(items.items()):
        try:
            out[name] = compile_over(item, row, frame)
        except Unfoldable:
            hidden[name] = f"__over_{k}"
            rest.setdefault(item.window, {})[hidden[name]] = item.spec
    for window, specs in rest.items():
        frame = add_overs(frame, window, specs, row)
    return frame, out | {name: F.col(inner) for name, inner in hidden.items()}
