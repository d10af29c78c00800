"""Exact duplicates: an immutable snapshot screened by static binary-fuse filters.

A snapshot of texts is indexed once: one row for each distinct text (its
SHA-256, the row that stays for it, its count), dealt to buckets by digest,
and one static filter for each bucket.  A new batch is grouped by digest among
itself first.  The distinct digests probe the filter of their bucket; those
that are surely absent never meet the index.  The rest join the exact bucket
rows, and their texts are compared byte for byte before two groups become one.

All shuffles carry digests and ids.  Texts move only for the two
representatives of groups found on both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuse
from .store import lookup, place, stored

#: Distinct digests in a bucket, about: the most that a filter build or probe holds.
BUCKET_KEYS = 200_000
#: Ids that may be broadcast to find the texts to compare; beyond it they are shuffled.
BROADCAST_IDS = 1_000_000


def _text(column: str):
    return F.coalesce(F.col(column), F.lit(""))


def digests(df: DataFrame, text: str, row_id: str, in_snapshot: Column, row: str | None = None) -> DataFrame:
    """``id``, ``digest`` (32 bytes, of the UTF-8 text; null is empty), ``uid`` and ``old`` of each row."""
    return df.select(
        F.col(row_id).alias("id"),
        F.unhex(F.sha2(F.encode(_text(text), "UTF-8"), 256)).alias("digest"),
        place(row).alias("uid"),
        F.coalesce(in_snapshot, F.lit(False)).alias("old"),
    )


def _grouped(rows: DataFrame) -> DataFrame:
    """One row for each digest: the row with the largest id, ties to the larger uid."""
    return (
        rows.groupBy("digest")
        .agg(F.max(F.struct("id", "uid")).alias("top"), F.count(F.lit(1)).alias("n"))
        .select("digest", F.col("top.id").alias("id"), F.col("top.uid").alias("uid"), "n")
    )


def _key64(digest):
    return F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long")


@dataclass
class Snapshot:
    """The index of an immutable set of texts: ``groups`` by digest, a filter for each bucket."""

    groups: DataFrame
    filters: DataFrame
    buckets: int

    @classmethod
    def build(cls, rows: DataFrame) -> Snapshot:
        """``rows`` as from ``digests``."""
        groups = stored(_grouped(rows), "dedup-snapshot")
        buckets = -(-groups.count() // BUCKET_KEYS) or 1

        def filter_of(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"bucket": part["bucket"][:1], "filter": [fuse.build(part["key"].to_numpy(np.uint64))]})

        filters = (
            groups.select(_key64(F.col("digest")).alias("key"))
            .withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
            .groupBy("bucket")
            .applyInPandas(filter_of, "bucket int, filter binary")
        )
        return cls(groups, stored(filters, "dedup-filters"), buckets)

    def save(self, path: str) -> None:
        """Write the snapshot to the new folder ``path``, for later batches."""
        self.groups.write.parquet(f"{path}/groups")
        self.filters.withColumn("buckets", F.lit(self.buckets)).write.parquet(f"{path}/filters")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Snapshot:
        """The snapshot that ``save`` wrote to ``path``."""
        filters = spark.read.parquet(f"{path}/filters")
        some = filters.select("buckets").first()
        return cls(spark.read.parquet(f"{path}/groups"), filters.drop("buckets"), some[0] if some else 1)

    def screen(self, groups: DataFrame) -> DataFrame:
        """``digest`` of those of ``groups`` (distinct digests) that may be in the snapshot."""
        keyed = groups.select("digest", _key64(F.col("digest")).alias("key")).withColumn(
            "bucket", F.pmod("key", F.lit(self.buckets)).cast("int")
        )

        def probe(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(rows):
                return rows[["digest"]][:0]
            return rows.loc[fuse.contains(own["filter"].iloc[0], rows["key"].to_numpy(np.uint64)), ["digest"]]

        return keyed.groupBy("bucket").cogroup(self.filters.groupBy("bucket")).applyInPandas(probe, "digest binary")


def _same_bytes(source: DataFrame, pairs: DataFrame, text: str, row_id: str) -> DataFrame:
    """``digest`` of those pairs (``digest``, ``old_id``, ``new_id``) whose texts are identical."""
    ids = stored(
        pairs.select("digest", F.explode(F.array_distinct(F.array("old_id", "new_id"))).alias("id")), "dedup-compare"
    )
    few = ids.count() <= BROADCAST_IDS
    sent = F.broadcast if few else lambda x: x
    wanted = sent(ids.select(F.coalesce("id", F.lit(-1)).alias("__id")).distinct())
    found = (
        source.select(F.col(row_id).alias("id"), _text(text).alias("text"))
        .join(wanted, F.coalesce(F.col("id"), F.lit(-1)) == F.col("__id"), "left_semi")
        .withColumn("digest", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    )
    held = found.join(sent(ids), (found["digest"] == ids["digest"]) & found["id"].eqNullSafe(ids["id"]), "left_semi")
    return held.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a = b").select("digest")


def dedup(
    df: DataFrame, in_snapshot: Column, *, text: str = "text", row_id: str = "doc_id", row: str | None = None
) -> DataFrame:
    """Groups of equal texts over ``df``, of which rows with ``in_snapshot`` are already indexed.

    Returns a row for each row of ``df``: ``id``, ``uid`` (the
    column ``row``, or its place in ``df``), ``digest``, ``keep_id``, ``group_size`` and ``kept``.  Of equal texts the
    row with the largest id stays; exactly one row of a group is kept.

    Edge cases: a null text counts as empty; null ids are smaller than all
    others, so they stay only where all ids of the group are null; rows that
    repeat an id tie, and the later one stays; empty tables give no rows;
    other columns of ``df`` play no part, whatever their names.
    """
    light = stored(digests(df, text, row_id, in_snapshot, row), "dedup-digests")
    total = light.count()
    snapshot = Snapshot.build(light.where("old"))
    batch = stored(_grouped(light.where("not old")), "dedup-batch")
    maybe = snapshot.screen(batch)
    old = snapshot.groups.select(
        "digest", F.col("id").alias("old_id"), F.col("uid").alias("old_uid"), F.col("n").alias("old_n")
    )
    pairs = stored(
        batch.join(maybe, "digest", "left_semi").withColumnRenamed("id", "new_id").join(old, "digest"), "dedup-pairs"
    )
    same = _same_bytes(df, pairs, text, row_id)
    new_top = F.struct(F.col("new_id").alias("id"), F.col("uid"))
    old_top = F.struct(F.col("old_id").alias("id"), F.col("old_uid").alias("uid"))
    joined = pairs.join(same, "digest", "left_semi").select(
        "digest", F.when(new_top > old_top, new_top).otherwise(old_top).alias("top"), (F.col("n") + F.col("old_n")).alias("both")
    )

    def with_joined(groups: DataFrame, is_old: bool) -> DataFrame:
        return groups.join(joined, "digest", "left").select(
            "digest",
            F.lit(is_old).alias("old"),
            F.coalesce("top.id", "id").alias("keep_id"),
            F.coalesce("top.uid", groups["uid"]).alias("keep_uid"),
            F.coalesce("both", "n").alias("group_size"),
        )

    groups = stored(with_joined(snapshot.groups, True).unionByName(with_joined(batch, False)), "dedup-groups")
    return lookup(light, groups, ["digest", "old"], "group_size", total).select(
        "id", "uid", "digest", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept")
    )


def against(
    df: DataFrame,
    snapshot: Snapshot,
    known: DataFrame,
    *,
    text: str = "text",
    row_id: str = "doc_id",
    row: str | None = None,
) -> DataFrame:
    """A new batch ``df`` screened against an earlier ``snapshot`` of ``known``, which holds the same two columns.

    Returns a row for each row of ``df``: ``id``, ``uid``, ``digest``,
    ``keep_id``, ``group_size`` (rows of both tables), ``known`` (whether the
    snapshot has the text) and ``kept``.  The snapshot is immutable: what it has
    is never kept again, whatever the ids.  Of texts new to it, the row with
    the largest id stays.

    Edge cases: null texts, null ids, repeated ids, empty tables and other
    columns are as in ``dedup``.  A representative that ``known`` lacks is not
    compared; its digest decides.
    """
    light = stored(digests(df, text, row_id, F.lit(False), row).drop("old"), "dedup-digests")
    total = light.count()
    batch = stored(_grouped(light), "dedup-batch")
    old = snapshot.groups.select("digest", F.col("id").alias("old_id"), F.col("n").alias("old_n"))
    pairs = stored(
        batch.join(snapshot.screen(batch), "digest", "left_semi").withColumnRenamed("id", "new_id").join(old, "digest"),
        "dedup-pairs",
    )
    both = [d.select(F.col(row_id).alias("id"), F.col(text).alias("text")) for d in (known, df)]
    same = _same_bytes(both[0].unionByName(both[1]), pairs, "text", "id")
    met = pairs.join(same, "digest", "left_semi").select("digest", "old_id", "old_n")
    is_known = F.col("old_n").isNotNull()
    groups = stored(
        batch.join(met, "digest", "left").select(
            "digest",
            F.when(is_known, F.col("old_id")).otherwise(F.col("id")).alias("keep_id"),
            F.col("uid").alias("top"),
            (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("group_size"),
            is_known.alias("known"),
            "n",
        ),
        "dedup-groups",
    )
    return lookup(light, groups, ["digest"], "n", total).select(
        "id", "uid", "digest", "keep_id", "group_size", "known", (~F.col("known") & (F.col("uid") == F.col("top"))).alias("kept")
    )


def op3(spark, sf_dir: str) -> DataFrame:
    """Exact duplicates over all documents; three quarters of the ids (by hash) form the snapshot."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup(docs, F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0)
    return out.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
