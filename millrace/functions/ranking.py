"""Rankings, all from 0; only for ``over``."""

from __future__ import annotations

from collections.abc import Callable

from .spec import Spec


def row_number() -> Spec:
    """The row's place in its partition."""
    return Spec("row_number", "rank")


def rank() -> Spec:
    """The number of rows before the first peer."""
    return Spec("rank", "rank")


def dense_rank() -> Spec:
    """The number of distinct order keys before the row's."""
    return Spec("dense_rank", "rank")


def ranking(function: Callable, returns: str = "long") -> Spec:
    """A ranking of one's own.

    ``function(*keys)`` is called once for a partition with the columns of its
    order keys, in order, and gives a rank for each row.  A partition moves to
    Python whole, so it has to fit one worker.
    """
    return Spec("ranking", "rank", (), function, extra={"returns": returns})
