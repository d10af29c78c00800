"""Aggregates, rankings and navigation: what ``aggregate`` and ``over`` take."""

from .aggregates import (
    count,
    cov_pop,
    cov_samp,
    custom,
    max,
    mean,
    min,
    stdev_pop,
    stdev_samp,
    stepwise,
    sum,
    total,
    var_pop,
    var_samp,
)
from .navigation import first, lag, last, lead, moving, nth
from .ranking import dense_rank, rank, ranking, row_number

__all__ = [
    "count",
    "cov_pop",
    "cov_samp",
    "custom",
    "dense_rank",
    "first",
    "lag",
    "last",
    "lead",
    "max",
    "mean",
    "min",
    "moving",
    "nth",
    "rank",
    "ranking",
    "row_number",
    "stdev_pop",
    "stdev_samp",
    "stepwise",
    "sum",
    "total",
    "var_pop",
    "var_samp",
]
