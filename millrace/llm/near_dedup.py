"""Near duplicates by an LSH forest, confirmed on full shingle sets.

1. Each text becomes its set of hashed word shingles, a 128-bit key of the
   set, and a min-wise signature.  Texts of equal sets are one class from here
   on, so a group of copies, however large, is one row.
2. The signature is cut into trees of DEPTH values, and all classes are sorted
   by each of them.  A walk along an order takes the longest common prefix of
   every two neighbours; a run of neighbours that all share FROM_DEPTH values
   or more is a region, whose members are candidates of each other.  Runs that
   cross the partitions of the sort are joined by their prefix.
3. The depth adapts to the region.  Where more than REGION classes share
   FROM_DEPTH values they form the crowd and go on at full DEPTH.  First each
   is held against the leader of its region, by signature, which unites most
   of a family of copies; then the crowd gets longer signatures and a forest
   of its own, with as many more trees as full depth needs.  In this forest a
   run whose members are united already is closed and costs nothing more; one
   that is crowded even there is one candidate group as it is.
4. Within an open region signatures are compared, and what may reach the
   threshold (with a margin of about five standard errors) is tied together.
   Connected ties are candidate clusters.
5. Clusters are confirmed on full sets.  A small cluster is compared whole, by
   an inverted index in one task together with other small ones.  A large one
   is cut into blocks that share some hub texts; then all that the hubs did
   not bring into its largest component is compared with the whole cluster,
   block by block.  Every pair of a cluster in which some link might still be
   missing is so compared, yet only found links leave a task, a star for each
   component.
6. Links are joined to components over the classes.

The numbers of trees are such that a pair at the threshold is a candidate in
neither forest with a chance of one in a million at most; there is no cap on
partners.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .minhash import MinHash, shingle_sets
from .sparse import tidied
from .store import lookup, place, stored, union_all
from .textkernel import mix64, slices

DEPTH, FROM_DEPTH = 8, 4
#: Chance that the orders of both forests miss a pair at the threshold.
MISSED = 1e-6
#: Classes of a region that are compared with each other at once.
REGION = 512
#: Shingles (8 bytes each) of the sets that one task compares, about.
TASK_SHINGLES = 3_000_000
HUB_SHINGLES = 300_000
#: Ids that may be broadcast to find the texts of clusters; beyond it they are shuffled.
BROADCAST_IDS = 500_000


def trees_for(percent: int, depth: int = FROM_DEPTH, missed: float = MISSED) -> int:
    return max(4, math.ceil(math.log(missed) / math.log(1 - (percent / 100) ** depth)))


def crowd_trees_for(percent: int) -> int:
    """Trees of full depth, by what the first forest leaves of MISSED."""
    return trees_for(percent, DEPTH, MISSED - (1 - (percent / 100) ** FROM_DEPTH) ** trees_for(percent))


def _set_key(own: np.ndarray) -> tuple[int, int]:
    a = int(mix64(own + np.uint64(1)).sum(dtype=np.uint64))
    b = int(mix64(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
    return a - 2**63, b - 2**63


def _signed(df: DataFrame, text: str, row_id: str, size: int, functions: int, sets: bool, row: str | None = None) -> DataFrame:
    """``id, uid, k1, k2, n`` of each text with its signature, or with its whole set of shingles."""
    kind = dict(df.dtypes)[row_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = MinHash(functions)
        for batch in batches:
            for a, b, offsets, data in slices(batch.column(2)):
                rows = []
                for own in shingle_sets(offsets, data, size):
                    blob = own.tobytes() if sets else hashes.signature(own).tobytes() if len(own) else b""
                    rows.append((*_set_key(own), len(own), blob))
                k1, k2, n, blob = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        *[pa.array(x, pa.int64()) for x in (k1, k2, n)],
                        pa.array(blob, pa.binary()),
                    ],
                    ["id", "uid", "k1", "k2", "n", "blob"],
                )

    return df.select(
        F.col(row_id).alias("id"), place(row).alias("uid"), F.col(text).cast("string")
    ).mapInArrow(tidied(run), f"id {kind}, uid long, k1 long, k2 long, n long, blob binary")


def _roots(near: np.ndarray) -> np.ndarray:
    """The least index reachable, from a symmetric matrix of ties."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label, len(near)).min(1)
        least = np.minimum(label, least)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _ties(functions: int, least: float):
    """From rows ``tree, key, node, sig`` in order: ties ``a, b`` of regions, a star for each group."""

    def region(nodes: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.empty((len(nodes), len(nodes)), bool)
        for k in range(len(nodes)):
            near[k] = (sigs == sigs[k]).sum(1) >= least * functions
        root = _roots(near)
        some = root != np.arange(len(nodes))
        return nodes[some], nodes[root[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def finish(table: pa.Table) -> pa.RecordBatch:
            tree, key, node = (table[c].to_numpy() for c in ("tree", "key", "node"))
            sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, functions)
            edge = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (key[1:] != key[:-1])])
            size = np.diff(edge, append=len(tree))
            twos = edge[size == 2]
            near = (sigs[twos] == sigs[twos + 1]).sum(1) >= least * functions
            a, b = [node[twos[near]]], [node[twos[near] + 1]]
            for at, n in zip(edge[size > 2], size[size > 2], strict=True):
                x, y = region(node[at : at + n], sigs[at : at + n])
                a.append(x)
                b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 4 * REGION:
                continue
            tree, key = held["tree"].to_numpy(), held["key"].to_numpy()
            last = int(np.flatnonzero((tree != tree[-1]) | (key != key[-1])).max(initial=-1)) + 1
            if last:
                yield finish(held.slice(0, last))
                held = held.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield finish(held)

    return run


def _walk(depth: int):
    """From rows ``tree, label, node, mark`` in order: the members of regions, as ``_regions`` describes them.

    Rows of the first and last run of a partition are marked ``edge`` and come
    whole, as the run may go on in the next partition.
    """

    def members(rows: pa.Table, begins: bool, ends: bool) -> pa.RecordBatch:
        tree, node, mark = (rows[c].to_numpy() for c in ("tree", "node", "mark"))
        start = np.flatnonzero(np.r_[True, _lcp(tree, _values(rows["label"])) < depth])
        size = np.diff(start, append=len(tree))
        least, most, hub = np.minimum.reduceat(mark, start), np.maximum.reduceat(mark, start), np.minimum.reduceat(node, start)
        edge = np.zeros(len(start), bool)
        edge[:1] |= begins
        edge[-1:] |= ends
        of = np.repeat(np.arange(len(start)), size)
        kept = np.flatnonzero(((least != most) | edge)[of])
        of = of[kept]
        key = pc.binary_slice(rows["label"].take(pa.array(kept)).combine_chunks(), 0, 2 * depth)
        return pa.RecordBatch.from_arrays(
            [pa.array(tree[kept]), key, *[pa.array(x) for x in (node[kept], hub[of], size[of], least[of], most[of], edge[of])]],
            ["tree", "key", "node", "hub", "c", "least", "most", "edge"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one run, so far
        begins = True
        for batch in batches:
            if not batch.num_rows:
                continue
            near = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch] if held else [batch])
            cut = np.flatnonzero(_lcp(near["tree"].to_numpy(), _values(near["label"])) < depth) + (0 if held else 1)
            if len(cut):
                last = int(cut[-1])
                yield members(pa.Table.from_batches([*held, batch.slice(0, last)]), begins, False)
                begins, held = False, [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield members(pa.Table.from_batches(held), begins, True)

    return run


def _values(labels: pa.ChunkedArray) -> np.ndarray:
    """The values of labels of DEPTH each, a row for each label."""
    parts = [np.zeros((0, DEPTH), np.uint16)]
    for chunk in labels.chunks:
        if len(chunk):
            at = int(np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset])
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint16, DEPTH * len(chunk), at).reshape(-1, DEPTH))
    return np.concatenate(parts)


def _lcp(tree: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many first values each row but the first shares with the row before it; 0 at the start of a tree."""
    shared = np.cumprod(values[1:] == values[:-1], axis=1).sum(1)
    return np.where(tree[1:] == tree[:-1], shared, 0)


def _regions(signed: DataFrame, trees: int, depth: int) -> DataFrame:
    """``tree, key, node, hub, c`` of ``signed`` (``node, sig, mark``): who is in a region of ``depth`` values.

    A region is a run of a tree's sort order in which neighbours have a common
    prefix of ``depth`` values or more, here of ``c`` classes, if these do not
    all have the same ``mark``; ``hub`` is one of them, the same for all (of a
    run's part in a partition, where it crosses several).
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    label = F.substring("sig", F.col("tree") * F.lit(2 * DEPTH) + 1, F.lit(2 * DEPTH))
    order = ["tree", "label", "node"]
    found = stored(
        signed.select("node", "sig", "mark", every.alias("tree"))
        .select("tree", label.alias("label"), "node", "mark")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(tidied(_walk(depth)), "tree int, key binary, node long, hub long, c long, least long, most long, edge boolean"),
        "forest-rows",
    )
    inner = found.where("NOT edge")
    edges = found.where("edge")
    # The parts of a run in several partitions are one region.
    whole = edges.groupBy("tree", "key").agg(
        F.count(F.lit(1)).alias("all"), F.min("least").alias("low"), F.max("most").alias("high")
    )
    joined = lookup(edges.select("tree", "key", "node", "hub"), stored(whole, "forest-edges"), ["tree", "key"], "all", edges.count())
    columns = ["tree", "key", "node", "hub"]
    return inner.select(*columns, "c").unionByName(joined.where("low <> high").select(*columns, F.col("all").alias("c")))


def _alike(functions: int, least: float):
    """Of rows ``a, b, left, right`` (two signatures): those pairs ``a, b`` whose signatures agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, functions) for k in (2, 3))
            near = pa.array((left == right).sum(1) >= least * functions)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(near) for k in (0, 1)], ["a", "b"])

    return run


def candidate_ties(classes: DataFrame, functions: int, percent: int, deeper: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Ties ``a, b`` between nodes of ``classes`` (``node, sig``) that may be linked.

    ``deeper`` gives for a table of nodes their signatures for ``crowd_trees_for`` trees, as ``node, blob``.
    """
    error = math.sqrt(percent / 100 * (1 - percent / 100) / functions)
    least = max(0.0, percent / 100 - 4.8 * error)
    trees = functions // DEPTH
    own = classes.select("node", "sig")
    found = _regions(own.withColumn("mark", F.col("node")), trees, FROM_DEPTH)
    members = found.where(F.col("c") <= REGION).select("tree", F.xxhash64("key").alias("key"), "node")
    crowded = found.where(F.col("c") > REGION)
    crowd = stored(crowded.select("node").distinct(), "forest-crowd")
    more = []
    if not crowd.isEmpty():
        # Each against the leader of its region; in most trees a family has the same one.
        pairs = crowded.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
        left, right = (own.select(F.col("node").alias(k), F.col("sig").alias(to)) for k, to in (("a", "left"), ("b", "right")))
        star = stored(
            pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_alike(functions, least), "a long, b long"),
            "forest-stars",
        )
        united = components(star).select("node", F.col("root").alias("mark"))
        # A pair that meets in crowded regions only has both its ends in the crowd.
        signed = deeper(crowd).withColumnRenamed("blob", "sig").join(united, "node", "left").withColumn("mark", F.coalesce("mark", "node"))
        found = _regions(stored(signed, "forest-crowd-signed"), crowd_trees_for(percent), DEPTH)
        members = members.unionByName(found.where(F.col("c") <= REGION).select((F.col("tree") + trees).alias("tree"), F.xxhash64("key").alias("key"), "node"))
        full = found.where((F.col("c") > REGION) & (F.col("node") != F.col("hub")))
        # The parts that a run has in several partitions have hubs of their own, tied to the least of them.
        hubs = found.where(F.col("c") > REGION).select("tree", "key", "hub").distinct()
        first = hubs.groupBy("tree", "key").agg(F.min("hub").alias("b"))
        more = [
            star,
            full.select(F.col("node").alias("a"), F.col("hub").alias("b")),
            hubs.join(first, ["tree", "key"]).where("hub <> b").select(F.col("hub").alias("a"), "b"),
        ]
    ties = (
        members.join(own, "node")
        .select("tree", "key", "node", "sig")
        .repartition("tree", "key")
        .sortWithinPartitions("tree", "key", "node")
        .mapInArrow(tidied(_ties(functions, least)), "a long, b long")
    )
    return union_all([ties, *more]).distinct()


#: Sets of a task that are compared with all others at once, to unite what is alike before anything is searched.
HUBS = 16


def _linked(sets: list[np.ndarray], nodes: np.ndarray, first: np.ndarray, percent: int) -> np.ndarray:
    """Index of the root of each set, by all links that have a set of ``first`` at one end or more.

    A few sets are compared with all.  What they do not bring into the largest
    component is searched for by prefixes: of two linked sets, each holds some
    of the other's rarest terms, among as many as the threshold leaves room
    for.  Links inside one component need no search, as only components count.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    # Terms are named by rarity, and each set has its rarest first.
    often = np.bincount(term)
    name = np.empty(len(often), np.int64)
    name[np.argsort(often, kind="stable")] = np.arange(len(often))
    owner = np.repeat(np.arange(n), sizes)
    term = name[term]
    term = term[np.lexsort((term, owner))]
    order = np.argsort(term, kind="stable")
    label = np.arange(n)
    held = {k: [k] for k in range(n)}  # the sets of a label
    mask = np.zeros(len(often), bool)

    def links(k: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that are linked with set ``k``."""
        own = term[bounds[k] : bounds[k + 1]]
        mask[own] = True
        spans = sizes[others]
        ends = np.cumsum(spans)
        hit = mask[term[np.repeat(bounds[others] - ends + spans, spans) + np.arange(ends[-1] if len(ends) else 0)]]
        mask[own] = False
        common = np.add.reduceat(hit, ends - spans, dtype=np.int64) if len(ends) else np.zeros(0, np.int64)
        return others[100 * common >= percent * (spans + sizes[k] - common)]

    def unite(k: int, linked: np.ndarray) -> None:
        roots = sorted({int(label[k]), *label[linked].tolist()}, key=lambda r: len(held[r]))
        for r in roots[:-1]:
            own = held.pop(r)
            label[own] = roots[-1]
            held[roots[-1]] += own

    everyone, main, open_ = np.arange(n), -1, first.copy()
    for _ in range(HUBS if n > 2 * HUBS else 0):
        rest = np.flatnonzero(open_ & (label != main))
        if not len(rest):
            break
        open_[rest[0]] = False
        unite(rest[0], links(rest[0], everyone))
        main = int(np.bincount(label).argmax())
    # The index of prefixes; a term's owners are those that have it among their rarest.
    within = np.arange(len(term)) - bounds[owner]
    early = within < (sizes - -(-percent * sizes // 100) + 1)[owner]
    order = order[early[order]]
    posting, start = owner[order], np.searchsorted(term[order], np.arange(len(often) + 1))
    for k in np.flatnonzero(label != main):
        own = term[bounds[k] : bounds[k] + sizes[k] - -(-percent * sizes[k] // 100) + 1]
        spans = start[own + 1] - start[own]
        ends = np.cumsum(spans)
        met = np.unique(posting[np.repeat(start[own] - ends + spans, spans) + np.arange(ends[-1])])
        met = met[label[met] != label[k]]
        met = met if first[k] else met[first[met]]
        if len(met):
            unite(k, links(k, met))
    least = np.full(n, -1)
    by = np.argsort(nodes, kind="stable")[::-1]
    least[label[by]] = by  # the last one written is the least node
    return least[label]


def _confirm(percent: int):
    """From the rows of a task (``cluster, node, first, blob``): stars ``cluster, node, root`` of confirmed links."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for cluster, own in part.groupby("cluster", sort=False):
            sets = [np.frombuffer(x, np.uint64) for x in own["blob"]]
            nodes = own["node"].to_numpy()
            out.append(pd.DataFrame({"cluster": cluster, "node": nodes, "root": nodes[_linked(sets, nodes, own["first"].to_numpy(), percent)]}))
        return pd.concat(out)[["cluster", "node", "root"]]

    return run


def _texts_of(df: DataFrame, wanted: DataFrame, text: str, row_id: str, size: int, functions: int = 0) -> DataFrame:
    """``node, blob``: the whole set, or signature of ``functions``, of each class in ``wanted`` (``k1, k2, n, id, node``)."""
    few = wanted.count() <= BROADCAST_IDS
    sent = F.broadcast if few else lambda x: x
    ids = sent(wanted.select(F.struct("id").alias("__wanted")).distinct())
    rows = df.select(F.col(row_id), F.col(text)).join(ids, F.col(row_id).eqNullSafe(F.col("__wanted.id")), "left_semi")
    sets = _signed(rows, text, row_id, size, functions, not functions)
    keys = sent(wanted.select("k1", "k2", "n", "node"))
    found = sets.select("k1", "k2", "n", "blob").join(keys, ["k1", "k2", "n"])
    return found.groupBy("node").agg(F.first("blob").alias("blob"))


def near_duplicates(
    df: DataFrame, *, size: int = 5, percent: int = 80, text: str = "text", row_id: str = "doc_id", row: str | None = None
) -> DataFrame:
    """Components of texts whose sets of ``size``-word shingles have a Jaccard similarity of ``percent`` % or more.

    Returns for each row of ``df``: ``id``, ``uid`` (the column ``row``, or its place in ``df``),
    ``n_shingles``, ``component_id`` (the least id reachable by links, its own
    included) and ``kept``, true for exactly one row of each component: the
    one with the least id.

    Words are runs without ASCII white space with A-Z lower-cased.  A text of
    fewer words has its whole sequence as its only shingle.

    Edge cases: a null, empty or blank text has no shingles, is linked with
    nothing and kept; equal sets are linked (copies, repeated rows); null ids
    count as largest, so ``component_id`` is null only where all ids are; ties
    keep the earlier row; no rows give no rows; other columns play no part.
    """
    functions = trees_for(percent) * DEPTH
    light = stored(_signed(df, text, row_id, size, functions, False, row), "near-signed")
    total = light.count()
    keys = ["k1", "k2", "n"]
    own = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    classes = stored(
        light.where("n > 0")
        .groupBy(*keys)
        .agg(F.min(own).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("blob").alias("sig"))
        .select(*keys, "least", "copies", "sig", F.col("least.uid").alias("node"), F.col("least.id").alias("id")),
        "near-classes",
    )

    def deeper(nodes: DataFrame) -> DataFrame:
        wanted = stored(classes.join(nodes, "node").select("id", "node", *keys), "near-crowd")
        return _texts_of(df, wanted, text, row_id, size, crowd_trees_for(percent) * DEPTH)

    ties = components(candidate_ties(classes, functions, percent, deeper)).select("node", F.col("root").alias("cluster"))
    member = stored(ties.join(classes.select("node", "id", *keys), "node"), "near-members")
    sums = member.groupBy("cluster").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("m"))
    sums = stored(sums, "near-clusters")
    member = lookup(member, sums, ["cluster"], "m", member.count())
    blobs = _texts_of(df, member.select("id", "node", *keys), text, row_id, size)
    member = stored(member.select("cluster", "node", "n", "shingles").join(blobs, "node"), "near-sets")

    whole = member.where(F.col("shingles") <= TASK_SHINGLES)
    amount = whole.agg(F.sum("n")).first()[0] or 0
    task = F.pmod(F.xxhash64("cluster"), F.lit(-(-int(amount) // TASK_SHINGLES * 2) or 1))
    schema = "cluster long, node long, root long"
    stars = stored(
        whole.withColumn("first", F.lit(True))
        .withColumn("task", task)
        .select("task", "cluster", "node", "first", "blob")
        .groupBy("task")
        .applyInPandas(_confirm(percent), schema),
        "near-stars",
    )
    roots = stars.select("node", "root")
    wide = stored(member.where(F.col("shingles") > TASK_SHINGLES), "near-wide")
    if not wide.isEmpty():
        roots = roots.unionByName(_confirm_wide(wide, percent, schema))
    of_class = roots.join(classes.select("node", *keys, "least", "copies"), "node", "right").withColumn(
        "root", F.coalesce("root", "node")
    )
    top = of_class.groupBy("root").agg(F.min("least").alias("top"), F.count(F.lit(1)).alias("w"))
    of_class = lookup(of_class, stored(top, "near-tops"), ["root"], "w", total)
    table = stored(of_class.select(*keys, "copies", F.col("top.id").alias("top_id"), F.col("top.uid").alias("top_uid")), "near-final")
    alone = F.col("n") == 0
    return lookup(light.drop("blob"), table, keys, "copies", total).select(
        "id",
        "uid",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("top_id")).alias("component_id"),
        (alone | (F.col("uid") == F.col("top_uid"))).alias("kept"),
    )


def _confirm_wide(wide: DataFrame, percent: int, schema: str) -> DataFrame:
    """``node, root`` of clusters too large for one task."""
    blocks = F.ceil(F.col("shingles") / F.lit(TASK_SHINGLES)).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks)
    hub = F.pmod(F.xxhash64("node", F.lit(1)), F.col("shingles")) < F.lit(HUB_SHINGLES)
    every = F.sequence(F.lit(0), blocks - 1)
    rows = wide.withColumn("block", F.explode(F.when(hub, every).otherwise(F.array(block))))
    confirm = _confirm(percent)
    first = stored(
        rows.withColumn("first", F.lit(True))
        .select("cluster", "block", "node", "first", "blob")
        .groupBy("cluster", "block")
        .applyInPandas(confirm, schema),
        "near-blocks",
    )
    edges = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
    parts = stored(
        wide.select("cluster", "node", "n").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node")),
        "near-parts",
    )
    sizes = parts.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("w"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("w", "root")).alias("main")).select("cluster", F.col("main.root").alias("main"))
    rest = stored(
        parts.join(main, "cluster").where("root <> main").select("cluster", "node", "n"), "near-rest"
    )
    chunks = rest.groupBy("cluster").agg(F.sum("n").alias("open"))
    chunks = chunks.select("cluster", F.ceil(F.col("open") / F.lit(TASK_SHINGLES // 2)).cast("int").alias("chunks"))
    half = F.ceil(F.col("shingles") / F.lit(TASK_SHINGLES // 2)).cast("int")
    chunked = wide.join(chunks, "cluster")
    all_chunks = F.sequence(F.lit(0), F.col("chunks") - 1)
    blocks_of = F.sequence(F.lit(0), half - 1)
    others = chunked.select(
        "cluster", "node", "blob", F.pmod(F.xxhash64("node"), half).alias("block"), F.explode(all_chunks).alias("chunk")
    ).withColumn("first", F.lit(False))
    opened = chunked.join(rest.select("node"), "node", "left_semi").select(
        "cluster", "node", "blob", F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")).alias("chunk"), F.explode(blocks_of).alias("block")
    ).withColumn("first", F.lit(True))

    def once(part: pd.DataFrame) -> pd.DataFrame:
        # A text of both sides is one set; it counts as open.
        return confirm(part.sort_values("first", ascending=False, kind="stable").drop_duplicates("node"))

    second = (
        others.unionByName(opened)
        .select("cluster", "block", "chunk", "node", "first", "blob")
        .groupBy("cluster", "block", "chunk")
        .applyInPandas(once, schema)
        .select(F.col("node").alias("a"), F.col("root").alias("b"))
    )
    joined = components(edges.unionByName(second))
    return wide.select("node").join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def op2(spark, sf_dir: str) -> DataFrame:
    """Near duplicates over all documents: three-word shingles, 85 % or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs, size=3, percent=85)
    return out.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
