"""Rows as users see them in lambdas: attributes and items that are Spark columns.

A lambda is called once, when a plan is built, with a proxy of the row; what
it returns becomes an expression of the plan.  No Python runs for a row.
"""

from __future__ import annotations

import contextlib
import contextvars
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pair:
    """The shape of a joined row: the shapes of both sides."""

    left: Shape
    right: Shape


#: Public column names with the names they have in the frame, or both sides of a join.
Shape = Mapping[str, str] | Pair


def leaves(shape: Shape) -> list[tuple[str, str]]:
    """All (public name, name in the frame) of a shape, left before right."""
    return [*leaves(shape.left), *leaves(shape.right)] if isinstance(shape, Pair) else list(shape.items())


#: How many predicates are being traced within each other; a row of an outer one is an outer reference in an inner one.
_depth: contextvars.ContextVar[int] = contextvars.ContextVar("depth", default=0)


@contextlib.contextmanager
def tracing() -> Iterator[int]:
    """Within it a predicate is called; the value is its depth."""
    token = _depth.set(_depth.get() + 1)
    try:
        yield _depth.get()
    finally:
        _depth.reset(token)


def depth() -> int:
    return _depth.get()


class RowProxy:
    """``row.name`` and ``row["name"]`` are the column; joined rows also have ``row.left`` and ``row.right``."""

    __slots__ = ("_depth", "_name", "_shape")

    def __init__(self, shape: Shape, name: str | None = None):
        """``name``: the alias of the frame, where columns of several frames meet in one expression."""
        object.__setattr__(self, "_shape", shape)
        object.__setattr__(self, "_name", name)
        object.__setattr__(self, "_depth", depth())

    def __getitem__(self, name: str) -> Column:
        found = [inner for public, inner in leaves(self._shape) if public == name]
        if not found:
            raise KeyError(name)
        if len(found) > 1:
            raise ValueError(f"column {name!r} is on both sides of the join; use row.left or row.right")
        own = F.col(f"{self._name}.`{found[0]}`" if self._name else f"`{found[0]}`")
        return own.outer() if depth() > self._depth else own

    def __getattr__(self, name: str) -> Column | RowProxy:
        shape = object.__getattribute__(self, "_shape")
        if isinstance(shape, Pair) and name in ("left", "right"):
            side = RowProxy(getattr(shape, name), self._name)
            object.__setattr__(side, "_depth", self._depth)
            return side
        if name.startswith("__"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def __contains__(self, name: str) -> bool:
        return any(public == name for public, _ in leaves(self._shape))

    def keys(self) -> list[str]:
        return [public for public, _ in leaves(self._shape)]


Getter = Callable[..., Any] | Column


def traced(getter: Getter, *rows: RowProxy) -> Any:
    """What a getter says of the rows: a Column, or a plain value if it depends on none."""
    if isinstance(getter, Column):
        return getter
    if not callable(getter):
        raise TypeError(f"expected a function of the row or a Column, got {type(getter).__name__}")
    return getter(*rows)


def column(getter: Getter, *rows: RowProxy) -> Column:
    said = traced(getter, *rows)
    return said if isinstance(said, Column) else F.lit(said)


def const(x: Any) -> Callable[..., Any]:
    """A function that returns ``x`` for every row."""
    return lambda *_: x


def get(name: str) -> Callable[[RowProxy], Column]:
    """A function that returns the column ``name`` of a row."""
    return lambda row: row[name]


def same(a: Column, b: Column) -> Column:
    """Equality by which two nulls are equal."""
    return a.eqNullSafe(b)
