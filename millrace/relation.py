"""Relations: a DataFrame with the shape of its rows, and the verbs that ``>>`` applies."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .proxy import Pair, RowProxy, Shape, leaves


class Row(dict):
    """A result row: a mapping whose items are attributes too, and which can be hashed."""

    def __getattribute__(self, name: str) -> Any:
        if not name.startswith("__") and name in self:
            return self[name]
        return super().__getattribute__(name)

    def __hash__(self) -> int:
        return hash(tuple(self.items()))


class Relation:
    """An immutable, lazy relation.

    ``frame`` has unique column names; ``shape`` maps the names that users see
    to them.  ``keys`` are the grouping columns between ``group_by`` and
    ``aggregate``.
    """

    __slots__ = ("frame", "keys", "shape")

    def __init__(self, frame: DataFrame, shape: Shape | None = None, keys: dict[str, Column] | None = None):
        self.frame = frame
        self.shape = {c: c for c in frame.columns} if shape is None else shape
        self.keys = keys

    @property
    def row(self) -> RowProxy:
        return RowProxy(self.shape)

    @property
    def df(self) -> DataFrame:
        """The rows as a DataFrame under their public names; those on both sides of a join get ``_left``, ``_right``."""
        every = leaves(self.shape)
        if not isinstance(self.shape, Pair):
            if all(a == b for a, b in every) and [b for _, b in every] == self.frame.columns:
                return self.frame
            return self.frame.select(*[F.col(f"`{b}`").alias(a) for a, b in every])
        names = [a for a, _ in every]
        twice = {a for a in names if names.count(a) > 1}
        left = len(leaves(self.shape.left))
        shown = [
            F.col(f"`{b}`").alias(a if a not in twice else f"{a}_{'left' if k < left else 'right'}")
            for k, (a, b) in enumerate(every)
        ]
        return self.frame.select(*shown)

    def __iter__(self) -> Iterator[Row]:
        df = self.df
        names = df.columns
        for values in df.toLocalIterator():
            yield Row(zip(names, values, strict=True))

    def __repr__(self) -> str:
        from .operators.verbs import pretty

        return pretty(self)


def as_relation(x: Any, *, grouped: bool = False) -> Relation:
    """A Relation of a Relation, a DataFrame or rows."""
    from .sources.memory import table

    if isinstance(x, DataFrame):
        return Relation(x)
    if isinstance(x, Relation):
        if x.keys is not None and not grouped:
            raise TypeError("group_by must be followed by aggregate")
        return x
    if isinstance(x, Iterable) and not isinstance(x, str | bytes | Mapping):
        return table(x)
    raise TypeError(f"not a relation: {type(x).__name__}")


class Verb:
    """A verb with all its arguments but the last, which ``relation >> verb`` or a call gives."""

    __slots__ = ("_apply",)

    def __init__(self, apply: Callable[[Any], Any]):
        self._apply = apply

    def __rrshift__(self, left: Any) -> Any:
        return self._apply(left)

    def __call__(self, left: Any) -> Any:
        return self._apply(left)


class Curried:
    """A function that may be given its leading arguments in steps; the last one may come by ``>>``."""

    def __init__(self, function: Callable[..., Any], arity: int, given: tuple = (), options: dict | None = None):
        self._function, self._arity, self._given, self._options = function, arity, given, options or {}
        functools.update_wrapper(self, function)

    def __call__(self, *more: Any, **options: Any) -> Any:
        given, named = (*self._given, *more), {**self._options, **options}
        if len(given) > self._arity:
            raise TypeError(f"{self._function.__name__} takes {self._arity} positional arguments, got {len(given)}")
        if len(given) == self._arity:
            return self._function(*given, **named)
        return Curried(self._function, self._arity, given, named)

    def __rrshift__(self, left: Any) -> Any:
        return self(left)


def curried(arity: int) -> Callable[[Callable[..., Any]], Curried]:
    return lambda function: Curried(function, arity)
