"""Where relations come from and go to: rows in memory, files and catalogue tables."""

from .files import read, read_table, write
from .memory import table

__all__ = ["read", "read_table", "table", "write"]
