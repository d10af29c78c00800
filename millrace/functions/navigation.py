"""Values of other rows; only for ``over``."""

from __future__ import annotations

from collections.abc import Callable

from ..proxy import Getter, const
from .spec import Spec


def first(x: Getter) -> Spec:
    """The first non-null value in the frame."""
    return Spec("first", "move", (x,))


def last(x: Getter) -> Spec:
    """The last non-null value in the frame."""
    return Spec("last", "move", (x,))


def nth(x: Getter, i: Getter | int) -> Spec:
    """The value of row ``i`` of the frame, from 0; negative from the end; null outside it."""
    return Spec("nth", "move", (x,), extra={"i": i if callable(i) or not isinstance(i, int) else const(i)})


def _shift(name: str, x: Getter, n: Getter | int | None, default: Getter | None) -> Spec:
    n = const(1) if n is None else const(n) if isinstance(n, int) else n
    return Spec(name, "move", (x,), extra={"n": n, "default": const(None) if default is None else default})


def lead(x: Getter, n: Getter | int | None = None, default: Getter | None = None) -> Spec:
    """The value ``n`` rows later in the partition; ``default`` where there is no such row or ``n`` is null."""
    return _shift("lead", x, n, default)


def lag(x: Getter, n: Getter | int | None = None, default: Getter | None = None) -> Spec:
    """The value ``n`` rows earlier in the partition; ``default`` where there is no such row or ``n`` is null."""
    return _shift("lag", x, n, default)


def moving(function: Callable, *getters: Getter, returns: str = "double") -> Spec:
    """A function of the frame of one's own.

    ``function(begin, end, *values)`` is called once for a partition: ``values``
    are its columns in the window's order, ``begin`` and ``end`` (exclusive)
    the places where each row's frame begins and ends; it gives a value for
    each row.  A partition moves to Python whole, so it has to fit one worker.
    """
    return Spec("moving", "move", getters, function, extra={"returns": returns})
