"""Nearest neighbours by low-dimensional stable projections (SRS; Sun et al. 2014).

Unit vectors are projected to DIMENSIONS Gaussian (2-stable) coordinates and
indexed there by a kd-tree.  The squared projected distance of a pair, over
its squared true distance, follows a chi-square law with DIMENSIONS degrees
of freedom.  A query therefore takes projected neighbours in order of their
distance, verifies them on the full vectors, and stops when that law says
that a nearer one than its k-th best so far would have turned up with
probability CONFIDENCE.

The upper part of the tree is fitted on a bounded sample and deals all
vectors to partitions; a partition that comes out large is dealt on to equal
parts by a hash, so what one task holds is bounded whatever the table's size.
Within a part the lower tree is built in its task.  A query first searches its
own partition, then only those whose bounding box still passes the stopping
test.  Vectors that are equal count once in the index, with the ids that could
be returned, so a common vector is one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import stored, union_all

DIMENSIONS = 8
#: Chance of seeing any one true neighbour; recall is this or more.
CONFIDENCE = 0.98
#: Rows that the upper tree is fitted on, at most about; every row is indexed.
SAMPLE_ROWS = 20_000
#: Vectors in a part that one task searches, about, and the most partitions of the upper tree.
PART_ROWS, MOST_PARTITIONS = 8_192, 4_096
#: Queries that one task searches with.
QUERY_BLOCK = 20_000
LEAF_ROWS = 256
#: Projected neighbours that are verified together before the stopping test is asked again; doubled each time.
VERIFIED = 32


def chi_square_quantile(p: float, k: int) -> float:
    """The p-quantile of the chi-square law with an even number ``k`` of degrees of freedom, by bisection."""
    if k % 2:
        raise ValueError("an even number of dimensions is needed")

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))

    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two by which its greatest component is about 1: exact, and no square overflows."""
    _, e = np.frexp(np.abs(x).max(1, keepdims=True, initial=0))
    return np.ldexp(x, -e)


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _splits(points: np.ndarray, parts: int) -> list[tuple[int, float]]:
    """The upper kd-tree as a heap of (dimension, cut); a leaf of the heap is a partition."""
    depth = max(0, math.ceil(math.log2(max(parts, 1))))
    nodes, groups = [], [points]
    for _ in range(depth):
        below = []
        for own in groups:
            if len(own):
                axis = int(np.argmax(np.ptp(own, axis=0)))
                cut = float(np.median(own[:, axis]))
            else:
                axis, cut = 0, 0.0
            nodes.append((axis, cut))
            left = own[:, axis] < cut if len(own) else np.zeros(0, bool)
            below += [own[left], own[~left]]
        groups = below
    return nodes


def _deal(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    axis, cut = np.array([n[0] for n in nodes], np.int64), np.array([n[1] for n in nodes])
    for _ in range((len(nodes) + 1).bit_length() - 1):
        at = 2 * at + 1 + (points[np.arange(len(points)), axis[at]] >= cut[at])
    return at - len(nodes)


class KdTree:
    """The lower tree: leaves of at most LEAF_ROWS rows (more where rows coincide) with their boxes."""

    def __init__(self, points: np.ndarray):
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))] if len(points) else []
        while todo:
            own = todo.pop()
            spread = np.ptp(points[own], axis=0)
            axis = int(np.argmax(spread))
            if len(own) <= LEAF_ROWS or spread[axis] == 0:
                self.leaves.append(own)
                continue
            half = np.argpartition(points[own, axis], len(own) // 2)
            todo += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
        self.low = np.array([points[x].min(0) for x in self.leaves]).reshape(len(self.leaves), -1)
        self.high = np.array([points[x].max(0) for x in self.leaves]).reshape(len(self.leaves), -1)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Squared projected distance from each query to each leaf's box."""
        out = np.zeros((len(queries), len(self.leaves)))
        for d in range(queries.shape[1]):
            q = queries[:, d, None]
            gap = np.maximum(np.maximum(self.low[None, :, d] - q, q - self.high[None, :, d]), 0)
            out += gap * gap
        return out


def search(
    vectors: np.ndarray, points: np.ndarray, queries: np.ndarray, projected: np.ndarray, k: int, worst: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For each unit query the indexes (-1: none) and cosines of its best ``k`` among ``vectors``.

    ``worst`` holds each query's k-th best cosine known from elsewhere (-inf:
    none); what cannot beat it may be missing.
    """
    limit = chi_square_quantile(CONFIDENCE, points.shape[1])
    tree = KdTree(points)
    best = np.full((len(queries), k), -1, np.int64)
    score = np.full((len(queries), k), -np.inf)
    for a in range(0, len(queries), 512):
        bounds = tree.bounds(projected[a : a + 512])
        order = np.argsort(bounds, axis=1, kind="stable")
        bounds = np.take_along_axis(bounds, order, 1)
        for r in range(len(bounds)):
            q = a + r
            own, cosine = _nearest(queries[q], projected[q], vectors, points, tree, order[r], bounds[r], limit, k, worst[q])
            best[q, : len(own)], score[q, : len(own)] = own, cosine
    return best, score


def _nearest(query, at, vectors, points, tree, order, bounds, limit, k, worst):
    """The best ``k`` of one query: projected neighbours are verified in order of their distance until the test holds."""
    best, cosine = np.zeros(0, np.int64), np.zeros(0)
    pool, far = np.zeros(0, np.int64), np.zeros(0)  # seen in opened leaves, not yet verified, by projected distance
    opened, step, together = 0, 1, VERIFIED
    while True:
        kth = max(worst, cosine[-1] if len(cosine) == k else -np.inf)
        reach = limit * max(2 - 2 * kth, 0.0)
        ahead = bounds[opened] if opened < len(bounds) else np.inf
        # What lies nearer than any leaf still closed is next in the order of all projected distances.
        ready = int(np.searchsorted(far, min(ahead, reach), side="right"))
        if ready:
            own = pool[: min(ready, together)]
            together *= 2
            names, every = np.concatenate([best, own]), np.concatenate([cosine, vectors[own] @ query])
            top = np.argsort(-every, kind="stable")[:k]
            best, cosine = names[top], every[top]
            pool, far = pool[len(own) :], far[len(own) :]
        elif opened < len(bounds) and ahead <= reach:
            own = np.concatenate([tree.leaves[x] for x in order[opened : opened + step]])
            gap = points[own] - at
            distance = np.concatenate([far, (gap * gap).sum(1)])
            pool = np.concatenate([pool, own])
            by = np.argsort(distance, kind="stable")
            by = by[: np.searchsorted(distance[by], reach, side="right")]
            pool, far = pool[by], distance[by]
            opened += step
            step *= 2
        else:
            return best, cosine


def _array(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 1))


_SCHEMA = "query_id long, rank int, id long, score double"


def neighbours(
    df: DataFrame, is_query, *, k: int = 5, vector: str = "embedding", row_id: str = "vec_id", seed: int = 11
) -> DataFrame:
    """``query_id, rank, id, score`` of the ``k`` nearest rows (cosine) of every query row.

    Candidates are all rows but those with the query's own id; ties go to the
    smaller id.  The score is the cosine of the original vectors, in double
    precision.

    Edge cases: vectors that are null, zero, or hold a null, NaN or infinity
    take no part, as queries or candidates; vectors of different lengths are
    no neighbours, each length is searched by itself; components of any finite
    size do not overflow; rows with null ids take no part; a query with
    fewer than ``k`` candidates gets them all; rows that repeat an id and a
    vector count once; no rows give no rows; other columns play no part.
    """
    spark = df.sparkSession
    whole = F.transform(vector, lambda x: x.cast("double"))
    sound = (
        F.col(row_id).isNotNull()
        & F.col(vector).isNotNull()
        & F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
        & F.exists(whole, lambda x: x != 0)
    )
    rows = df.where(sound).select(F.col(row_id).alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = stored(rows, "ann-rows")
    lengths = sorted(r[0] for r in rows.where("q").select(F.size("v")).distinct().collect())
    if not lengths:
        return spark.createDataFrame([], _SCHEMA)
    alone = [_of_length(rows if len(lengths) == 1 else rows.where(F.size("v") == n), n, k, seed) for n in lengths]
    return union_all(alone)


def _of_length(rows: DataFrame, length: int, k: int, seed: int) -> DataFrame:
    """``neighbours`` among rows ``id, v, q`` whose vectors have this length."""
    spark = rows.sparkSession
    rows = rows.where(F.size("v") == length)
    # Equal vectors are one row of the index, with as many of their ids as one query could get.
    alike = Window.partitionBy("v").orderBy("id")
    some = rows.select("v", "id").withColumn("k", F.dense_rank().over(alike)).where(F.col("k") <= k + 1)
    classes = stored(some.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")), "ann-classes")
    count = classes.count()
    share = min(1.0, SAMPLE_ROWS / max(count, 1))
    drawn = classes.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("v").toArrow()
    sample = _array(drawn["v"].to_pylist()).reshape(-1, length)
    plane = np.random.default_rng(seed).normal(size=(length, DIMENSIONS))
    parts = min(MOST_PARTITIONS, -(-count // PART_ROWS))
    nodes = _splits(_unit(sample) @ plane if len(sample) else np.zeros((0, DIMENSIONS)), parts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(0)
            flat = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            p = _unit(flat) @ plane
            points = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, DIMENSIONS), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, points, pa.array(_deal(p, nodes))], [*batch.schema.names, "p", "part"])

    index = stored(classes.select("v", "ids").mapInArrow(place, "v array<double>, ids array<long>, p array<double>, part long"), "ann-index")
    boxes = index.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(*[F.min(F.col("p")[d]) for d in range(DIMENSIONS)]).alias("low"),
        F.array(*[F.max(F.col("p")[d]) for d in range(DIMENSIONS)]).alias("high"),
    )
    boxes = sorted((r["part"], r["low"], r["high"], -(-r["rows"] // (2 * PART_ROWS))) for r in boxes.collect())
    ids = np.array([b[0] for b in boxes])
    low, high = np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes])
    limit = chi_square_quantile(CONFIDENCE, DIMENSIONS)
    # Equal parts of the partitions; the upper tree bounds their number of rows.
    divided = F.broadcast(spark.createDataFrame([(int(b[0]), int(b[3])) for b in boxes], "part long, parts int"))
    sub = F.pmod(F.xxhash64(F.col("ids")[0]), F.col("parts")).cast("int")
    index = index.join(divided, "part").withColumn("sub", sub)
    asked = rows.where("q").select("v", F.array("id").alias("ids")).distinct()
    asked = stored(
        asked.mapInArrow(place, "v array<double>, ids array<long>, p array<double>, part long").withColumn("worst", F.lit(-math.inf)),
        "ann-queries",
    )

    def look(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "id", "score"]
        if not len(queries) or not len(own):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        original, wanted = _scaled(_array(own["v"])), _scaled(_array(queries["v"]))
        unit = _unit(original)
        # A query's own class is found as well, hence one more than k.
        best, _ = search(unit, _array(own["p"]), _unit(wanted), _array(queries["p"]), k + 1, queries["worst"].to_numpy())
        norm, names, out = np.linalg.norm(original, axis=1), own["ids"].to_numpy(), []
        for r, (query, found) in enumerate(zip(queries["ids"], best, strict=True)):
            found = found[found >= 0]
            cosine = (original[found] * wanted[r]).sum(1) / (norm[found] * np.linalg.norm(wanted[r]))
            out += [(query[0], x, c) for f, c in zip(found, cosine, strict=True) for x in names[f] if x != query[0]]
        return pd.DataFrame(out, columns=columns)

    def searched(queries: DataFrame) -> DataFrame:
        blocks = queries.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).cast("int").alias("blocks"))
        left = (
            queries.join(F.broadcast(blocks), "part")
            .join(divided, "part")
            # Of the same type on both sides: keys of other types are dealt to other tasks.
            .withColumn("block", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("blocks")).cast("int"))
            .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        )
        right = index.join(F.broadcast(blocks), "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        found = (
            left.select("part", "sub", "block", "v", "ids", "p", "worst")
            .groupBy("part", "sub", "block")
            .cogroup(right.select("part", "sub", "block", "v", "ids", "p").groupBy("part", "sub", "block"))
            .applyInPandas(look, "query_id long, id long, score double")
        )
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = stored(searched(asked), "ann-near")
    kth = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    kth = kth.select("query_id", F.when(F.col("n") == k, F.col("kth")).alias("kth"))
    again = asked.withColumn("query_id", F.col("ids")[0]).join(kth, "query_id", "left")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _array(batch.column(2).to_pylist()).reshape(-1, DIMENSIONS)
            worst = batch.column(4).to_numpy(zero_copy_only=False)
            gap = np.maximum(np.maximum(low[None] - p[:, None], p[:, None] - high[None]), 0)
            far = (gap * gap).sum(2)
            home = batch.column(3).to_numpy()
            open_ = (far <= limit * np.maximum(2 - 2 * worst, 0)[:, None]) & (ids[None] != home[:, None])
            row, at = np.nonzero(open_)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(take) for i in range(3)], pa.array(ids[at]), batch.column(4).take(take)],
                ["v", "ids", "p", "part", "worst"],
            )

    others = again.select("v", "ids", "p", "part", F.coalesce("kth", F.lit(-math.inf)).alias("worst")).mapInArrow(
        reach, "v array<double>, ids array<long>, p array<double>, part long, worst double"
    )
    far = searched(stored(others, "ann-reach"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    both = near.drop("rank").unionByName(far.drop("rank")).distinct()
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "id", "score")


def op7(spark, sf_dir: str) -> DataFrame:
    """The five nearest rows of every vector whose id is divisible by 50."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = neighbours(df.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
