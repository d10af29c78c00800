"""Joins by any predicate of the left and the right row.

Catalyst finds equalities in a predicate and plans hash or sort-merge joins;
only a predicate without any is a nested loop.
"""

from __future__ import annotations

import itertools
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..proxy import Pair, RowProxy, Shape
from ..relation import Relation, as_relation, curried

_fresh = itertools.count()


def _renamed(shape: Shape, taken: dict[str, str]) -> Shape:
    if isinstance(shape, Pair):
        return Pair(_renamed(shape.left, taken), _renamed(shape.right, taken))
    return {public: taken.get(inner, inner) for public, inner in shape.items()}


def _sides(left: Any, right: Any) -> tuple[Relation, Relation]:
    """Both relations, the right one's columns renamed where they clash."""
    left, right = as_relation(left), as_relation(right)
    clash = set(left.frame.columns) & set(right.frame.columns)
    if not clash and left.frame is not right.frame:
        return left, right
    taken = {c: f"{c}__{next(_fresh)}" for c in right.frame.columns if c in clash}
    frame = right.frame.select(*[F.col(f"`{c}`").alias(taken.get(c, c)) for c in right.frame.columns])
    return left, Relation(frame, _renamed(right.shape, taken))


def _on(predicate: Any, left: Relation, right: Relation) -> Column:
    said = predicate if isinstance(predicate, Column) else predicate(left.row, right.row)
    return said if isinstance(said, Column) else F.lit(bool(said))


def _join(how: str, right: Any, predicate: Any, left: Any) -> Relation:
    left, right = _sides(left, right)
    frame = left.frame.join(right.frame, _on(predicate, left, right), how)
    if how in ("left_semi", "left_anti"):
        return Relation(frame, left.shape)
    return Relation(frame, Pair(left.shape, right.shape))


@curried(2)
def cross_join(right: Any, left: Any) -> Relation:
    """Every left row with every right row."""
    left, right = _sides(left, right)
    return Relation(left.frame.crossJoin(right.frame), Pair(left.shape, right.shape))


@curried(3)
def inner_join(right: Any, predicate: Any, left: Any) -> Relation:
    """The pairs for which the predicate is true."""
    return _join("inner", right, predicate, left)


@curried(3)
def left_join(right: Any, predicate: Any, left: Any) -> Relation:
    """The pairs, and left rows without one with nulls on the right."""
    return _join("left", right, predicate, left)


@curried(3)
def right_join(right: Any, predicate: Any, left: Any) -> Relation:
    """The pairs, and right rows without one with nulls on the left."""
    return _join("right", right, predicate, left)


@curried(3)
def full_join(right: Any, predicate: Any, left: Any) -> Relation:
    """The pairs, and rows of either side without one."""
    return _join("full", right, predicate, left)


@curried(3)
def semi_join(right: Any, predicate: Any, left: Any) -> Relation:
    """The left rows that have a match."""
    return _join("left_semi", right, predicate, left)


@curried(3)
def anti_join(right: Any, predicate: Any, left: Any) -> Relation:
    """The left rows that have none."""
    return _join("left_anti", right, predicate, left)


__all__ = [
    "RowProxy",
    "anti_join",
    "cross_join",
    "full_join",
    "inner_join",
    "left_join",
    "right_join",
    "semi_join",
]
