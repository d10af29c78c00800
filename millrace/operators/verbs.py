"""Projection, selection, order, limits and display."""

from __future__ import annotations

import itertools
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spec import Spec
from ..proxy import Getter, Pair, RowProxy, column, depth, tracing
from ..relation import Relation, Verb, as_relation, curried
from .window import ARRIVAL, Descending, Nulls, Over, needs_arrival, ordered, with_arrival


_sifts = itertools.count()


def _check(items: dict[str, Any]) -> None:
    for name, item in items.items():
        if isinstance(item, Spec) or not (callable(item) or isinstance(item, Column | Over)):
            raise TypeError(f"Invalid projection: {name!r} is neither a function of the row nor a function over a window")


def _compiled(relation: Relation, items: dict[str, Any]) -> tuple[DataFrame, dict[str, Column]]:
    """The frame and an expression for each item; windows of the same kind share a pass."""
    from ..plans.frames import over_columns

    frame, row = relation.frame, relation.row
    overs = {n: x for n, x in items.items() if isinstance(x, Over)}
    if any(needs_arrival(x) or not x.window.order_by and x.window.mode == "rows" for x in overs.values()):
        frame = with_arrival(frame)
    frame, made = over_columns(frame, overs, row)
    return frame, {n: made[n] if n in made else column(x, row) for n, x in items.items()}


def select(**projectors: Getter | Over) -> Verb:
    """Only these columns: plain ones first, then those over windows, each in the order given."""
    _check(projectors)

    def apply(child: Any) -> Relation:
        relation = as_relation(child)
        frame, made = _compiled(relation, projectors)
        names = [n for n, x in projectors.items() if not isinstance(x, Over)] + [
            n for n, x in projectors.items() if isinstance(x, Over)
        ]
        if not names:
            return Relation(frame.select().limit(0))
        return Relation(frame.select(*[made[n].alias(n) for n in names]))

    return Verb(apply)


def mutate(**mutators: Getter | Over) -> Verb:
    """All columns, with these added or put in place of those of the same name."""
    _check(mutators)

    def apply(child: Any) -> Relation:
        relation = as_relation(child)
        if not mutators:
            return relation
        if isinstance(relation.shape, Pair):
            names = relation.row.keys()
            if len(set(names)) < len(names):
                raise ValueError("both sides of the join have columns of the same name; select from them first")
        frame, made = _compiled(relation, mutators)
        shape = {n: relation.row[n] for n in relation.row.keys()}
        return Relation(frame.select(*[c.alias(n) for n, c in (shape | made).items()]))

    return Verb(apply)


def _truth(said: Any, frame: DataFrame) -> Column:
    if not isinstance(said, Column):
        return F.lit(bool(said))
    kind = frame.select(said).schema[0].dataType
    if isinstance(kind, T.BooleanType):
        return said
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.length(said) > 0
    return said != 0 if isinstance(kind, T.NumericType) else said.isNotNull()


@curried(2)
def sift(predicate: Any, child: Any) -> Relation:
    """The rows for which the predicate is true; null, 0 and empty strings are not."""
    relation = as_relation(child)
    name = f"sift{next(_sifts)}"
    frame = relation.frame.alias(name)
    with tracing() as level:
        said = predicate if isinstance(predicate, Column) else predicate(RowProxy(relation.shape, name))
    if level == 1:
        said = _truth(said, frame)
    elif not isinstance(said, Column):
        said = F.lit(bool(said))
    return Relation(frame.where(said), relation.shape)


@curried(1)
def exists(relation: Any) -> bool | Column:
    """Whether there is any row: a job that stops at the first.

    Within a predicate of ``sift`` it is a condition on the row, and Catalyst
    plans it as a semi join, or as an anti join after ``~``:
    ``t >> sift(lambda r: exists(u >> sift(lambda o: o.k == r.k)))``.
    """
    frame = as_relation(relation).frame
    return frame.exists() if depth() else not frame.isEmpty()


def order_by(*keys: Getter | Descending, nulls: Nulls = Nulls.FIRST) -> Verb:
    """All rows in the order of the keys, ascending unless ``desc(key)``."""

    def apply(child: Any) -> Relation:
        relation = as_relation(child)
        if not keys:
            return relation
        return Relation(relation.frame.orderBy(*[ordered(k, nulls, relation.row) for k in keys]), relation.shape)

    return Verb(apply)


def limit(limit: int | None, *relation: Any, offset: int = 0) -> Any:
    """The first ``limit`` rows after ``offset``; None: all.  Without an order which rows they are is open."""
    if limit is not None and limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")

    def apply(child: Any) -> Relation:
        r = as_relation(child)
        frame = r.frame.offset(offset) if offset else r.frame
        return Relation(frame if limit is None else frame.limit(limit), r.shape)

    return apply(*relation) if relation else Verb(apply)


def _cell(value: Any) -> str:
    return "" if value is None else f"{value:g}" if isinstance(value, float) else str(value)


@curried(1)
def pretty(rows: Any, *, n: int | None = 10, tablefmt: str = "simple", headers: str = "keys") -> str:
    """The first ``n`` rows (None: all) as a text table: ``simple``, ``plain``, ``github`` or ``grid``."""
    df = limit(n, as_relation(rows)).df
    names, values = df.columns, [list(r) for r in df.collect()]
    if not values:
        return ""
    numeric = [all(isinstance(r[k], int | float) and not isinstance(r[k], bool) or r[k] is None for r in values) for k in range(len(names))]
    cells = [[_cell(x) for x in r] for r in values]
    head = names if headers == "keys" else [""] * len(names)
    widths = [max(len(head[k]), 0, *[len(r[k]) for r in cells]) for k in range(len(names))]
    if tablefmt in ("simple", "plain") and headers == "keys" and tablefmt == "simple":
        widths = [max(w, len(h) + 2) for w, h in zip(widths, head, strict=True)]

    def line(row: list[str], left: str, between: str, right: str) -> str:
        parts = [x.rjust(w) if num else x.ljust(w) for x, w, num in zip(row, widths, numeric, strict=True)]
        return (left + between.join(parts) + right).rstrip()

    rule = ["-" * w for w in widths]
    if tablefmt == "plain":
        return "\n".join(line(r, "", "  ", "") for r in ([head] if headers == "keys" else []) + cells)
    if tablefmt == "simple":
        return "\n".join(line(r, "", "  ", "") for r in [head, rule, *cells])
    if tablefmt == "github":
        return "\n".join([line(head, "| ", " | ", " |"), "|-" + "-|-".join(rule) + "-|", *[line(r, "| ", " | ", " |") for r in cells]])
    if tablefmt == "grid":
        bar = "+-" + "-+-".join(rule) + "-+"
        double = bar.replace("-", "=")
        body = [x for r in cells for x in (line(r, "| ", " | ", " |"), bar)]
        return "\n".join([bar, line(head, "| ", " | ", " |"), double, *body])
    raise ValueError(f"unknown table format {tablefmt!r}")


@curried(1)
def show(rows: Any, **options: Any) -> None:
    """Print ``pretty``."""
    print(pretty(rows, **options))


__all__ = ["ARRIVAL", "RowProxy", "exists", "limit", "mutate", "order_by", "pretty", "select", "show", "sift"]
