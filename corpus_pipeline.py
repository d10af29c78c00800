"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents that it
keeps with all their columns; the last returns the pieces of the packed
sequences.  ``run`` writes every stage's result to the shared folder and reads
it again, so a lost executor never costs more than its stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from millrace.llm.store import ROW, free_name, numbered, quoted, stored

TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 2048
#: Token weights of the mix: low quality comes down to a tenth, high quality keeps all it has.
WEIGHTS = {"high": 0.9, "low": 0.1}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    score = free_name(docs.columns, "__score")
    return toxicity.score(docs, model, into=score).where(F.col(score) < 0.5).select(*quoted(docs.columns))


#: Dropped rows that are sent to all tasks as numbers; more of them meet their documents in a shuffle.
BROADCAST_ROWS = 1_000_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a stored number for each row, and the name of that column, which no other has."""
    row = free_name(docs.columns, ROW)
    return numbered(docs, "pipeline-documents", row), row


def _keep(docs: DataFrame, row: str, found: DataFrame, tag: str) -> DataFrame:
    """The rows of ``docs`` but those whose number, in ``row``, is not kept in ``found`` (``id, uid, kept``)."""
    gone = stored(found.where("NOT kept").select(F.col("uid").alias(row)), tag)
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, row, "left_anti").drop(row)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    docs, row = _numbered(docs)
    found = exact_dedup.dedup(docs, F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0, row=row)
    return _keep(docs, row, found, "pipeline-exact")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, 80 %) the one with the least doc_id stays."""
    docs, row = _numbered(docs)
    found = near_dedup.near_duplicates(docs, size=5, percent=80, row=row)
    return _keep(docs, row, found, "pipeline-near")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the fitted rates, each once at most; high quality keeps all of its tokens."""
    docs, row = _numbered(docs)
    domain = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    found = mixing.mix(docs, _labels(spark, sf_dir), domain, WEIGHTS, keep_first=True, max_rate=1.0, row=row)
    return _keep(docs, row, found.withColumn("kept", F.col("copies") > 0), "pipeline-mix")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most SEQUENCE ids."""
    packed = packing.pack(docs, public_tokenizers.path(TOKENIZER), SEQUENCE)
    return packed.select(
        F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: The learnt stages and the components of near duplicates are beyond SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
