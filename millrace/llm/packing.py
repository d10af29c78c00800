"""Sequence packing: shortest-pack-first over the histogram of lengths.

Krell et al. 2021 (SPFHP): lengths are placed longest first; each goes to the
pack pattern with the least fill that still has room, many packs at once, by
updating the counts of patterns.  The work depends on the number of distinct
lengths, at most the capacity, not on the documents.  Patterns are then joined
back to the pieces by rank: the k-th piece of a length takes the k-th place
that the plan holds for that length.

Documents longer than a sequence are cut into full sequences and a rest.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sparse import tidied
from .store import stored
from .textkernel import slices

#: Pieces of one length that one task ranks, about; and the parts that any length is dealt to at least.
RANKED_TOGETHER, LEAST_PARTS = 500_000, 64


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns ``(how many packs, lengths in order)`` that use up the histogram of lengths."""
    by_fill: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    fills: list[int] = []

    def put(count: int, lengths: tuple[int, ...], fill: int) -> None:
        if not by_fill[fill]:
            heapq.heappush(fills, fill)
        by_fill[fill].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity or left < 0:
            raise ValueError(f"length {length} x {left} does not fit in {capacity}")
        while left:
            while fills and not by_fill[fills[0]]:
                heapq.heappop(fills)
            if not fills or fills[0] + length > capacity:
                put(left, (length,), length)
                break
            fill = fills[0]
            count, lengths = by_fill[fill].pop()
            used = min(count, left)
            if count > used:
                by_fill[fill].append((count - used, lengths))
            if not by_fill[fill]:
                heapq.heappop(fills)
            put(used, (*lengths, length), fill + length)
            left -= used
    return [p for fill in sorted(by_fill) for p in by_fill[fill]]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows ``length, first rank, sequence of that rank, offset``, by length and rank."""
    rows, taken, base = [], defaultdict(int), 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], base, offset))
            taken[length] += count
            offset += length
        base += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pieces(
    df: DataFrame,
    tokenizer: str,
    capacity: int,
    *,
    text: str = "text",
    row_id: str = "doc_id",
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of every text: ``id, start, length, ids_crc32, doc_tokens`` and, if asked, ``ids``.

    A document is its ids followed by ``end_id``; a null text is empty and so
    has that one id.  ``tokenizer`` is a vocabulary file that executors can read.
    """
    kind = dict(df.dtypes)[row_id]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .wordbpe import WordBpe

        bpe = WordBpe(tokenizer)
        for batch in batches:
            ids_of = batch.column(0)
            for a, b, offsets, data in slices(batch.column(1)):
                flat, bounds = bpe.encode(offsets, data)
                flat = flat.astype("<u4")
                row, start, length, crc, tokens, own = [], [], [], [], [], []
                for r in range(b - a):
                    doc = np.append(flat[bounds[r] : bounds[r + 1]], np.uint32(end_id))
                    for s in range(0, len(doc), capacity):
                        part = doc[s : s + capacity]
                        row.append(a + r)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        tokens.append(len(doc))
                        if with_ids:
                            own.append(part.astype(np.int32))
                columns = [ids_of.take(pa.array(row, pa.int64()))]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc, tokens)]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(own, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return df.select(F.col(row_id), F.col(text).cast("string")).mapInArrow(tidied(cut), schema + ", ids array<int>" * with_ids)


def pack(
    df: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    *,
    text: str = "text",
    row_id: str = "doc_id",
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all texts of ``df``: the columns of ``pieces`` with ``sequence_id`` and ``offset``.

    Each id of each document lies in exactly one piece, and each piece in one
    sequence of at most ``capacity`` ids; offsets in a sequence are gapless
    from 0.  The driver plans over the histogram, at most ``capacity`` rows,
    and what tasks get of the plan is bounded by the capacity as well.

    Edge cases: null or empty texts are the end id alone; rows that repeat
    (ids, texts or both) are packed as often as they come; null ids are kept;
    a very long text is cut into as many pieces as it needs; no rows give no
    rows; other columns play no part, whatever their names.
    """
    made = stored(
        pieces(df, tokenizer, capacity, text=text, row_id=row_id, end_id=end_id, with_ids=with_ids).withColumn(
            "__uid", F.monotonically_increasing_id()
        ),
        "pack-pieces",
    )
    histogram = {r[0]: r[1] for r in made.groupBy("length").count().collect()}
    hottest = max(histogram.values(), default=0)
    buckets = max(-(-hottest // RANKED_TOGETHER), min(LEAST_PARTS, -(-hottest // 100)), 1)
    table = places(plan(histogram, capacity))
    bucketed = made.withColumn("__bucket", F.pmod(F.xxhash64("__uid"), F.lit(buckets)))
    by_length = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        bucketed.groupBy("length", "__bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "__bucket", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("__before"))
    )
    ranked = (
        bucketed.withColumn("__k", F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("__uid")) - 1)
        .join(before, ["length", "__bucket"])
        .withColumn("__rank", F.col("__before") + F.col("__k"))
    )
    shift = np.int64(1) << np.int64(44)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            rank = batch.column(batch.schema.get_field_index("__rank")).to_numpy()
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            kept = [n for n in batch.schema.names if n != "__rank"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(batch.schema.get_field_index(n)) for n in kept],
                    pa.array(table[at, 2] + rank - table[at, 1]),
                    pa.array(table[at, 3]),
                ],
                [*kept, "sequence_id", "offset"],
            )

    names = [c for c in made.columns if c != "__uid"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.select(*names).schema)
    return ranked.select(*names, "__rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack(..., with_ids=True)``: ``sequence_id, ids, document_starts``.

    A sequence has at most ``capacity`` ids, so what meets in a group is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
            F.transform("parts", lambda p: p["offset"]).alias("document_starts"),
        )
    )


def op10(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids; see ``pack``."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
