"""Relations of streams.

``select``, ``sift``, ``mutate`` (without windows) and ``group_by`` with
``aggregate`` are plain DataFrame operations and work on streams as they are.
"""

from .streams import read_stream, tumbling, watermark, write_stream

__all__ = ["read_stream", "tumbling", "watermark", "write_stream"]
