"""Groups and aggregates."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spec import Spec
from ..proxy import Getter, RowProxy, column
from ..relation import Relation, Verb, as_relation


def group_by(**keys: Getter) -> Verb:
    """Group by named keys; ``aggregate`` must follow."""

    def apply(child: Any) -> Relation:
        relation = as_relation(child, grouped=True)  # of two group_bys the last holds
        made = {n: column(k, relation.row) for n, k in keys.items()}
        return Relation(relation.frame, relation.shape, made)

    return Verb(apply)


def _value(spec: Spec, row: RowProxy) -> Column:
    value = spec.build(*spec.columns(row))
    return value if spec.empty is None else F.coalesce(value, F.lit(spec.empty))


def aggregate(**specs: Spec) -> Verb:
    """One row a group: the keys, then the aggregates; without ``group_by`` one row for all.

    Grouped without aggregates gives the distinct keys.
    """
    for name, spec in specs.items():
        if not isinstance(spec, Spec) or spec.kind != "aggregate":
            raise TypeError(f"Invalid aggregation: {name!r}")

    def apply(child: Any) -> Relation:
        relation = as_relation(child, grouped=True)
        made = [_value(s, relation.row).alias(n) for n, s in specs.items()]
        keys = [c.alias(n) for n, c in (relation.keys or {}).items()]
        if not made:
            return Relation(relation.frame.select(*keys).distinct() if keys else relation.frame.select().limit(0))
        return Relation(relation.frame.groupBy(*keys).agg(*made) if keys else relation.frame.agg(*made))

    return Verb(apply)
