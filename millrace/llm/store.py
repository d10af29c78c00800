"""Stored intermediate tables and skew-safe lookups shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A lookup key with more than 1/HOT_PARTS of all rows is answered by
#: broadcast, so at most HOT_PARTS rows are ever broadcast.
HOT_PARTS = 2048


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``.  Only where that
    is unset, and all executors therefore live on this machine (``local``
    masters, as in tests), a temporary folder is made and kept in the session.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    at = spark.conf.get("millrace.shared.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("millrace.shared.dir", at)
    return at


#: Rows of a batch between JVM and Python, unless the session says otherwise than Spark's default.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Have texts cross to Python in batches of BATCH_ROWS rows.

    Spark's default of 10,000 is meant for numbers; as many texts take tens of
    megabytes in every task, several times over.  A session that has set the
    size itself keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, gives every later
    pass the same rows, and keeps column pruning.  The files go when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/millrace/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)


#: The column in which ``numbered`` keeps the number of a row.
ROW = "__row"


def numbered(df: DataFrame, tag: str, row: str = ROW) -> DataFrame:
    """``df`` stored with a number for each row in the column ``row``.

    ``monotonically_increasing_id`` numbers rows by how the files of a scan are
    split and packed, which follows the cores there are when it is planned.
    Where two passes must mean the same rows, the numbers are therefore stored.
    """
    return stored(df.withColumn(row, F.monotonically_increasing_id()), tag)


def place(row: str | None) -> Column:
    """The number of a row: the column ``row`` or, if none is named, its place in this pass."""
    return F.monotonically_increasing_id() if row is None else F.col(row)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Left join ``rows`` to ``table``, which has one row for each key.

    ``weight`` is a column of ``table``: how many of ``rows`` have the key.
    Keys that hold more than ``total / HOT_PARTS`` rows are at most HOT_PARTS,
    so they are broadcast; all others are shuffled, none of them large.
    Null keys match nothing.
    """
    limit = max(total // HOT_PARTS, 1)
    values = [c for c in table.columns if c not in keys]
    # Where each key has a row or two, nothing is hot and nothing is broadcast.
    hot = table.where((F.col(weight) > limit) & (F.col(weight) > 100))
    cold = table.where(~((F.col(weight) > limit) & (F.col(weight) > 100)))
    names = {c: f"__hot_{c}" for c in values}
    marked = rows.join(
        F.broadcast(hot.select(*keys, *[F.col(c).alias(names[c]) for c in values])), keys, "left"
    )
    found = F.col(names[weight]).isNotNull()
    first = marked.where(found).select(*rows.columns, *[F.col(names[c]).alias(c) for c in values])
    rest = marked.where(~found).select(*rows.columns).join(cold, keys, "left")
    return first.unionByName(rest.select(*rows.columns, *values))


def quoted(names: list[str]) -> list[Column]:
    """The columns of these names, whatever characters they hold."""
    return [F.col(name) for name in escaped(names)]


def escaped(names: list[str]) -> list[str]:
    return ["`" + name.replace("`", "``") + "`" for name in names]


def renamed(names: list[str]) -> list[Column]:
    """The columns of these names as ``c0, c1, ...``: ``mapInArrow`` takes no name with a dot, and none of these clashes."""
    return [c.alias(f"c{k}") for k, c in enumerate(quoted(names))]


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores before it until no column of ``taken`` is called so (in any case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def with_fields(df: DataFrame, names: list[str], **added: str) -> T.StructType:
    """The schema of the columns ``names`` of ``df``, then those of ``added`` (name and type)."""
    out = T.StructType(df.select(*quoted(names)).schema.fields)
    for name, kind in added.items():
        out = out.add(name, T.DataType.fromDDL(kind))
    return out


def once_each(rows: DataFrame, ids: DataFrame, drawn: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` (``keys, value``) with one row for each of ``keys``, the least ``value``.

    ``ids`` and ``drawn`` (few rows) hold the column ``__id`` of all rows and of those wanted; values are only
    grouped if some wanted id repeats, which a pass over the ids alone tells.
    """
    counts = ids.join(F.broadcast(drawn.select("__id")), "__id").groupBy("__id").count()
    if counts.where("count > 1").isEmpty():
        return rows
    return rows.groupBy(*keys).agg(F.min(value).alias(value))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
