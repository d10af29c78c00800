"""What a function is before it meets a relation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column

from ..proxy import Getter, RowProxy, column


@dataclass(frozen=True)
class Spec:
    """A function of the rows of a group or a frame.

    ``kind``: ``aggregate`` (``build`` makes the aggregate of the getters'
    columns), ``rank`` or ``move`` (by name).  ``empty`` is the value over no
    rows.
    """

    name: str
    kind: str
    getters: tuple[Getter, ...] = ()
    build: Callable[..., Column] | None = None
    empty: Any = None
    extra: dict[str, Any] = field(default_factory=dict)

    def columns(self, row: RowProxy) -> list[Column]:
        return [column(g, row) for g in self.getters]
