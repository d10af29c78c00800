"""Relations of files and tables, read and written by Spark's own sources."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from ..relation import Relation, as_relation, curried


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def read(path: str, kind: str = "parquet", *, schema: Any = None, spark: SparkSession | None = None, **options: Any) -> Relation:
    """A relation of files; filters and column choices reach the scan where the format allows."""
    reader = _session(spark).read.format(kind).options(**options)
    return Relation((reader.schema(schema) if schema is not None else reader).load(path))


def read_table(name: str, *, spark: SparkSession | None = None) -> Relation:
    """A relation of a catalogue table or view."""
    return Relation(_session(spark).table(name))


@curried(2)
def write(path: str, relation: Any, *, kind: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = (), **options: Any) -> None:
    """``relation >> write(path)``: write the rows as files."""
    writer = as_relation(relation).df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
