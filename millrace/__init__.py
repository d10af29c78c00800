"""Millrace: a pipeable relational verb API that compiles to Spark plans.

    from millrace import aggregate, group_by, read, sift, sum

    read("orders.parquet") >> sift(lambda r: r.price > 10) >> group_by(day=lambda r: r.day) >> aggregate(
        takings=sum(lambda r: r.price)
    )

Lambdas get a proxy of the row and are called once, to build the plan; use
``&``, ``|`` and ``~`` between conditions, and ``pyspark.sql.functions`` for
everything that a column can do.
"""

from .functions import (
    count,
    cov_pop,
    cov_samp,
    custom,
    dense_rank,
    first,
    lag,
    last,
    lead,
    max,
    mean,
    min,
    moving,
    nth,
    rank,
    ranking,
    row_number,
    stdev_pop,
    stdev_samp,
    stepwise,
    sum,
    total,
    var_pop,
    var_samp,
)
from .operators.grouping import aggregate, group_by
from .operators.joins import anti_join, cross_join, full_join, inner_join, left_join, right_join, semi_join
from .operators.setops import difference, difference_all, intersect, intersect_all, union, union_all
from .operators.verbs import exists, limit, mutate, order_by, pretty, select, show, sift
from .operators.window import Nulls, Window, desc, over
from .proxy import const, get, same
from .relation import Relation, Row
from .sources import read, read_table, table, write

__all__ = [
    "Nulls",
    "Relation",
    "Row",
    "Window",
    "aggregate",
    "anti_join",
    "const",
    "count",
    "cov_pop",
    "cov_samp",
    "cross_join",
    "custom",
    "dense_rank",
    "desc",
    "difference",
    "difference_all",
    "exists",
    "first",
    "full_join",
    "get",
    "group_by",
    "inner_join",
    "intersect",
    "intersect_all",
    "lag",
    "last",
    "lead",
    "left_join",
    "limit",
    "max",
    "mean",
    "min",
    "moving",
    "mutate",
    "nth",
    "order_by",
    "over",
    "pretty",
    "rank",
    "ranking",
    "read",
    "read_table",
    "right_join",
    "row_number",
    "same",
    "select",
    "semi_join",
    "show",
    "sift",
    "stdev_pop",
    "stdev_samp",
    "stepwise",
    "sum",
    "table",
    "total",
    "union",
    "union_all",
    "var_pop",
    "var_samp",
    "write",
]
