"""Set operations; columns meet by name, and nulls are equal."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..relation import Relation, as_relation, curried


def _both(right: Any, left: Any) -> tuple[DataFrame, DataFrame]:
    a, b = as_relation(left).df, as_relation(right).df
    if set(a.columns) != set(b.columns):
        raise ValueError(f"columns differ: {a.columns} and {b.columns}")
    return a, b.select(*[F.col(f"`{c}`") for c in a.columns])


@curried(2)
def union(right: Any, left: Any) -> Relation:
    """The distinct rows of both."""
    return Relation(as_relation(left).df.unionByName(as_relation(right).df, allowMissingColumns=True).distinct())


@curried(2)
def union_all(right: Any, left: Any) -> Relation:
    """The rows of both; a column that one side lacks is null there."""
    return Relation(as_relation(left).df.unionByName(as_relation(right).df, allowMissingColumns=True))


@curried(2)
def intersect(right: Any, left: Any) -> Relation:
    """The distinct rows that both have."""
    a, b = _both(right, left)
    return Relation(a.intersect(b))


@curried(2)
def intersect_all(right: Any, left: Any) -> Relation:
    """The distinct rows that both have, each twice: once for either side."""
    a, b = _both(right, left)
    common = a.intersect(b)
    return Relation(common.withColumn("__twice", F.explode(F.array(F.lit(0), F.lit(1)))).drop("__twice"))


@curried(2)
def difference(right: Any, left: Any) -> Relation:
    """The distinct left rows that the right lacks."""
    a, b = _both(right, left)
    return Relation(a.subtract(b))


@curried(2)
def difference_all(right: Any, left: Any) -> Relation:
    """Every left row, repeats included, whose values the right lacks."""
    a, b = _both(right, left)
    names = a.columns
    if not names:
        return Relation(a)
    b = b.distinct().select(*[F.col(f"`{c}`").alias(f"__r{k}") for k, c in enumerate(names)])
    on = reduce(lambda x, y: x & y, [a[f"`{c}`"].eqNullSafe(b[f"__r{k}"]) for k, c in enumerate(names)])
    return Relation(a.join(b, on, "left_anti"))
