"""Shards of near-equal bytes by sampled splitters (DataFrame functions only).

1. Draw a sample of sort keys, each with a chance in proportion to its size.
2. Take the sample's quantiles as splitters of contiguous key ranges.
3. Measure every range; split those that came out overfull with a further
   sample of their own rows.
4. Within each range, running sums give every row its exact byte position in
   the whole order; the shard follows from that position.

Rows larger than 1/FINE of a shard (a coarser part for very many shards) are
at most ``max(8192, n_shards)``; they are
dealt to the least filled shards first, and the cuts of the order leave room
for them, so that no cut is off by more than a small row.

The sort key is ``(hash of the group columns, hash of the id, row number)``.
Equal groups are therefore neighbours and share a shard unless a cut falls
among them, and a single key that holds a third of all rows is still divided
over many ranges, since the later parts of the key go on splitting it.

The driver sees only the samples and one row for each range: both are bounded
by ``n_shards`` and the parameters below, never by the rows.
"""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import quoted, stored

#: Ranges for each shard, at the least; more are made where rows are many.
RANGES_PER_SHARD = 4
#: Sampled keys for each range.
SAMPLES_PER_RANGE = 24
#: A range is overfull beyond this many times its fair share of bytes.
OVERFULL = 2.0
#: Rows above this part of a fair shard are dealt one by one.
FINE = 128
#: Splitters that become nested decisions; more are data, searched by halves.
DECISIONS = 255
#: Rounds of subdividing; each divides what is overfull by its own sample.
ROUNDS = 3
_KEY = ("__h1", "__h2", "__uid")


def _key(values: tuple[int, int, int]) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(_KEY, values, strict=True)])


def _range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """The number of splitters that are not above the row's key, by binary decisions."""
    key = F.struct(*_KEY)

    def decide(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < _key(splitters[mid]), decide(lo, mid)).otherwise(decide(mid + 1, hi))

    if len(splitters) <= DECISIONS:
        return decide(0, len(splitters))
    parts = [_values([s[k] for s in splitters]) for k in range(len(_KEY))]

    def halve(found: Column, _: Column) -> Column:
        lo, hi = found["lo"], found["hi"]
        mid = F.shiftright(lo + hi, 1)
        at = F.struct(*[F.get(p, mid).alias(k) for p, k in zip(parts, _KEY, strict=True)])
        pair = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
        return F.when(lo >= hi, found).when(key < at, pair(lo, mid)).otherwise(pair(mid + 1, hi))

    steps = F.sequence(F.lit(1), F.lit(len(splitters).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))
    return F.aggregate(steps, start, halve, lambda found: found["lo"])


def _values(values: list[int]) -> Column:
    """An array of numbers as one literal: it is data of the plan, not an expression for each."""
    return F.split(F.lit(",".join(map(str, values)) or "0"), ",").cast("array<bigint>")


def _sample(rows: DataFrame, chance: Column, seed: int) -> list[tuple[int, int, int]]:
    draw = F.pmod(F.xxhash64(*_KEY, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return sorted(tuple(r) for r in rows.where(draw < chance).select(*_KEY).collect())


def _quantiles(sample: list, parts: int) -> list:
    return [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []


def _deal(sizes: list[int], n_shards: int, rest: int) -> tuple[list[int], list[float]]:
    """Shards of the large rows (sizes descending), and where the cuts of the rest fall."""
    heap = [(0, s) for s in range(n_shards)]
    to = []
    for size in sizes:
        filled, s = heapq.heappop(heap)
        to.append(s)
        heapq.heappush(heap, (filled + size, s))
    filled = [0] * n_shards
    for size, s in zip(sizes, to, strict=True):
        filled[s] += size
    # Water level: what is left fills the emptier shards up to one height.
    level, below, ordered = 0.0, 0, sorted(filled)
    for below in range(1, n_shards + 1):
        level = (rest + sum(ordered[:below])) / below
        if below == n_shards or level <= ordered[below]:
            break
    cuts, at = [], 0.0
    for s in range(n_shards):
        at += max(0.0, level - filled[s])
        cuts.append(at)
    return to, cuts


def assign_shards(
    df: DataFrame,
    n_shards: int,
    *,
    size: str,
    group: list[str],
    row_id: str | None = None,
    rows_per_range: int = 2_000_000,
) -> DataFrame:
    """Add ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard) to every row.

    ``size`` names a column of sizes; ``group`` the columns whose equal values
    are kept next to each other; ``row_id`` orders rows of equal groups.
    A shard's sizes sum to ``total / n_shards`` within 1/FINE of it at either
    end, unless a single row is larger than a fair shard.  ``df`` is stored once in the shared folder, so pass narrow
    rows and join wide columns back by id.

    Edge cases: null ids and groups are ordinary values of the key; a null
    size counts as 0; fully repeated rows are told apart by their place in the
    stored table and may be split; no rows give no rows; rows of equal order
    exchange places freely, as nothing tells them apart.  Columns named
    ``shard`` or ``slot`` in ``df`` are replaced.  Other columns are kept.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    names = [c for c in df.columns if c not in ("shard", "slot")]
    keep = [f"c{k}" for k in range(len(names))]  # no name of the caller's meets one of ours
    back = [F.col(k).alias(name) for k, name in zip(keep, names, strict=True)]
    keyed = stored(
        df.select(
            *[c.alias(k) for c, k in zip(quoted(names), keep, strict=True)],
            F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__size"),
            F.xxhash64(*[F.col(c) for c in group]).alias("__h1"),
            (F.xxhash64(F.col(row_id)) if row_id else F.lit(0).cast("long")).alias("__h2"),
            F.monotonically_increasing_id().alias("__uid"),
        ),
        "shard-keys",
    )
    everything, n_all = keyed.agg(F.coalesce(F.sum("__size"), F.lit(0)), F.count(F.lit(1))).first()
    fine = max(1, min(FINE, 8192 // n_shards))
    large = F.col("__size") * (n_shards * fine) > everything if everything else F.lit(False)
    giants = sorted(
        (tuple(r) for r in keyed.where(large).select("__size", *_KEY).collect()), key=lambda r: (-r[0], *r[1:])
    )
    to, cuts = _deal([r[0] for r in giants], n_shards, everything - sum(r[0] for r in giants))
    rest = keyed.where(~large)
    n, total = n_all - len(giants), everything - sum(r[0] for r in giants)
    parts = max(RANGES_PER_SHARD * n_shards, -(-n // rows_per_range))
    weight = F.col("__size") if total else F.lit(1)
    whole = max(total or n, 1)
    chance = weight * F.lit(parts * SAMPLES_PER_RANGE / whole)
    splitters = sorted(set(_quantiles(_sample(rest, chance, 1), parts)))
    for seed in range(2, 2 + ROUNDS + 1):
        ranged = rest.withColumn("__range", _range_of(splitters))
        measured = {
            r["__range"]: (r["rows"], r["bytes"])
            for r in ranged.groupBy("__range")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum(weight).alias("bytes"))
            .collect()
        }
        fair = whole / parts
        over = {k: b for k, (m, b) in measured.items() if b > OVERFULL * fair and m > 1}
        if not over or seed == 2 + ROUNDS:
            break
        more = F.col("__range").isin(sorted(over))
        found = _sample(ranged.where(more), chance * 4, seed)
        new = set(splitters)
        edges = [None, *splitters, None]
        for k, b in over.items():
            lo, hi = edges[k], edges[k + 1]
            own = [x for x in found if (lo is None or x > lo) and (hi is None or x < hi)]
            new.update(_quantiles(own, int(b // fair) + 1))
        if len(new) == len(splitters):
            break
        splitters = sorted(new)
    rows_before, bytes_before, a, b = [], [], 0, 0
    for k in range(len(splitters) + 1):
        rows_before.append(a)
        bytes_before.append(b)
        m, s = measured.get(k, (0, 0))
        a, b = a + m, b + s
    order = Window.partitionBy("__range").orderBy(*_KEY)
    at = lambda values: F.element_at(_values(values), F.col("__range") + 1)
    start = at(bytes_before) + F.coalesce(
        F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    if not total:  # nothing has a size: equal counts instead
        cuts = [n * (k + 1) / n_shards for k in range(n_shards)]
    middle = (start + weight / 2).cast("double")

    def shard_at(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(middle < F.lit(float(cuts[mid])), shard_at(lo, mid)).otherwise(shard_at(mid + 1, hi))

    placed = stored(
        ranged.select(
            *keep,
            (at(rows_before) + F.row_number().over(order) - 1).alias("__index"),
            shard_at(0, n_shards - 1).alias("shard"),
        ),
        "shard-places",
    )
    first = dict(placed.groupBy("shard").agg(F.min("__index")).collect())
    held, slots = Counter(), {}
    for r, s in zip(giants, to, strict=True):
        slots[r[-1]] = (s, held[s])
        held[s] += 1
    shift = _values([held[k] - first.get(k, 0) for k in range(n_shards)])
    small = placed.select(
        *keep, "shard", (F.col("__index") + F.element_at(shift, F.col("shard") + 1)).alias("slot")
    )
    if not giants:
        return small.select(*back, "shard", "slot")
    rows = ", ".join(f"({u}L, {s}, {k}L)" for u, (s, k) in slots.items())
    given = df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(__uid, shard, slot)")
    return keyed.where(large).join(F.broadcast(given), "__uid").select(*keep, "shard", "slot").unionByName(small).select(*back, "shard", "slot")


def write_shards(df: DataFrame, path: str) -> None:
    """Write assigned rows as one folder a shard.

    Files hold contiguous slots in order; a shard has as many as its rows fill
    partitions, so that no task writes more than its part.
    """
    df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes; see ``assign_shards``."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("__group"),
    )
    out = assign_shards(rows, 40, size="size", group=["__group"], row_id="doc_id")
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
