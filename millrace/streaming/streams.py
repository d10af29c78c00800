"""Sources, watermarks, time windows and sinks of streaming relations."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..proxy import RowProxy
from ..relation import Relation, as_relation, curried


def read_stream(path: str, schema: Any, kind: str = "parquet", *, spark: SparkSession | None = None, **options: Any) -> Relation:
    """A relation of files as they arrive in a folder."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return Relation(spark.readStream.schema(schema).format(kind).options(**options).load(path))


@curried(3)
def watermark(name: str, delay: str, relation: Any) -> Relation:
    """``relation >> watermark("ts", "10 minutes")``: rows later than that may be left out, and their state dropped."""
    r = as_relation(relation)
    return Relation(r.frame.withWatermark(name, delay), r.shape)


def tumbling(name: str, width: str, slide: str | None = None) -> Any:
    """A key for ``group_by``: the time window that a row falls in."""

    def key(row: RowProxy) -> Column:
        return F.window(row[name], width, slide) if slide else F.window(row[name], width)

    return key


@curried(1)
def write_stream(relation: Any, *, kind: str = "memory", name: str | None = None, mode: str = "append", checkpoint: str | None = None, path: str | None = None, **options: Any) -> Any:
    """Start the stream; returns Spark's StreamingQuery."""
    writer = as_relation(relation).df.writeStream.format(kind).outputMode(mode).options(**options)
    if name:
        writer = writer.queryName(name)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start(path) if path else writer.start()
