"""Exact and near duplicates against plain versions."""

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, near_dedup
from millrace.llm.minhash import MinHash, shingle_sets
from millrace.llm.textkernel import slices

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id long, text string, digest int, n int, old string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], DOCS).repartition(3)


def test_exact_against_plain(spark):
    rng = random.Random(1)
    texts = ["", None, "a", "A", "a ", "x" * 300_000, *[f"t{k}" for k in range(20)]]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(None, "t1"), (None, None), (None, "only null ids"), (7, "t3"), (7, "t3")]
    got = exact_dedup.dedup(frame(spark, rows), F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(got) == len(rows)
    for r in got:
        own = groups[digest[r.digest.hex()]]
        assert r.group_size == len(own)
        assert r.keep_id == max((i for i in own if i is not None), default=None)
        assert not r.kept or r.id == r.keep_id
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.digest.hex() for r in kept})


@pytest.mark.parametrize("old", [True, False, None])
def test_exact_with_one_side_only(spark, old):
    got = exact_dedup.dedup(frame(spark, [(1, "a"), (2, "a"), (3, "b")]), F.lit(old).cast("boolean")).collect()
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]


def test_exact_batches_against_a_saved_snapshot(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 3)
    rng = random.Random(5)
    first = [(i, rng.choice(["", None, *[f"t{k}" for k in range(12)]])) for i in range(60)] + [(None, "null id")]
    old = frame(spark, first)
    exact_dedup.Snapshot.build(exact_dedup.digests(old, "text", "doc_id", F.lit(True))).save(f"file://{tmp_path}/s")
    for lo, hi in ((0, 18), (12, 30)):
        rows = [(i, rng.choice([None, "null id", *[f"t{k}" for k in range(lo, hi)]])) for i in range(30, 150)] + [(None, "new"), (9, "new")]
        snapshot = exact_dedup.Snapshot.open(spark, f"file://{tmp_path}/s")
        assert snapshot.buckets > 1
        got = exact_dedup.against(frame(spark, rows), snapshot, old).collect()
        before, now = {}, {}
        for table, found in ((first, before), (rows, now)):
            for i, t in table:
                found.setdefault(hashlib.sha256((t or "").encode()).digest(), []).append(i)
        assert len(got) == len(rows)
        for r in got:
            digest = bytes(r.digest)
            group = before.get(digest, now[digest])
            assert r.known == (digest in before)
            assert r.keep_id == max((i for i in group if i is not None), default=None)
            assert r.group_size == len(before.get(digest, [])) + len(now[digest])
        kept = [bytes(r.digest) for r in got if r.kept]
        assert sorted(kept) == sorted(set(now) - set(before))
        assert all(r.id == r.keep_id for r in got if r.kept)


def test_exact_against_an_empty_snapshot(spark, tmp_path):
    none = frame(spark, [(1, "a")]).limit(0)
    exact_dedup.Snapshot.build(exact_dedup.digests(none, "text", "doc_id", F.lit(True))).save(f"file://{tmp_path}/s")
    snapshot = exact_dedup.Snapshot.open(spark, f"file://{tmp_path}/s")
    got = exact_dedup.against(frame(spark, [(1, "a"), (2, "a")]), snapshot, none).collect()
    assert sorted((r.id, r.keep_id, r.group_size, r.known, r.kept) for r in got) == [(1, 2, 2, False, False), (2, 2, 2, False, True)]
    assert exact_dedup.against(none, snapshot, none).count() == 0


def test_exact_empty(spark):
    assert exact_dedup.dedup(frame(spark, [(1, "a")]).limit(0), F.lit(True)).count() == 0


def test_exact_shuffled_comparison(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_IDS", 0)
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 3)
    rows = [(i, f"t{i % 10}") for i in range(40)]
    got = exact_dedup.dedup(frame(spark, rows), F.col("doc_id") < 20).collect()
    assert all(r.keep_id == 30 + r.id % 10 and r.group_size == 4 for r in got)


def sets(rows, size):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append(frozenset(zip(*[w[k:] for k in range(size)])) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


def plain(rows, size, percent):
    s = sets(rows, size)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {k: min((x for x in g if x is not None), default=None) for k, g in groups.items()}
    return [(rows[i][0], len(s[i]), least[root(i)]) for i in range(len(rows))], len(groups)


def corpus(seed, families=12, copies=12, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(own)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, " \n", "two words", "TWO words", "two  WORDS", "w1", "x " * 9000, "x " * 8000])]
    rng.shuffle(rows)
    return rows


def check(spark, rows, size, percent):
    got = near_dedup.near_duplicates(frame(spark, rows), size=size, percent=percent).collect()
    expected, groups = plain(rows, size, percent)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(expected, key=key)
    assert sum(r.kept for r in got) == groups
    assert all(r.id == r.component_id for r in got if r.kept)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_against_plain(spark, size, percent):
    check(spark, corpus(size), size, percent)


def test_near_repeated_rows_and_null_ids(spark):
    check(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (3, "A b c D"), (None, None), (None, "z"), (9, "")], 3, 85)


def test_near_empty(spark):
    assert near_dedup.near_duplicates(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_near_crowded_regions_and_wide_clusters(spark, monkeypatch):
    """A family too large for a region and for a task takes the deeper and the blockwise ways."""
    monkeypatch.setattr(near_dedup, "REGION", 8)
    monkeypatch.setattr(near_dedup, "TASK_SHINGLES", 700)
    monkeypatch.setattr(near_dedup, "HUB_SHINGLES", 150)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    check(spark, corpus(9, families=3, copies=70), 3, 85)


def prefixes(hashes, x, y):
    """How many values of each tree two texts share from its start, one word as a shingle."""
    sig = [hashes.signature(own) for _, _, offsets, data in slices(pa.array([x, y])) for own in shingle_sets(offsets, data, 1)]
    return (sig[0] == sig[1]).reshape(-1, near_dedup.DEPTH).cumprod(1).sum(1)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_crowd_that_is_not_linked(spark, monkeypatch, percent):
    """A pair at the threshold meets in crowded regions only, shares no deep prefix there, and no other row ties it."""
    monkeypatch.setattr(near_dedup, "REGION", 2)
    hashes = MinHash(near_dedup.trees_for(percent) * near_dedup.DEPTH)
    own = {80: 10, 85: 15}[percent]
    both = own * 2 * percent // (100 - percent)
    assert 100 * both == percent * (both + 2 * own)
    names = (f"w{k}" for k in range(10**9))

    def text(common, n):
        return " ".join([*common, *[next(names) for _ in range(n)]])

    while True:
        common = [next(names) for _ in range(both)]
        pair = [text(common, own), text(common, own)]
        deep = prefixes(hashes, *pair)
        if near_dedup.FROM_DEPTH <= deep.max() <= near_dedup.FROM_DEPTH + 1:
            break
    crowd = []
    for tree in np.flatnonzero(deep >= near_dedup.FROM_DEPTH):
        while prefixes(hashes, pair[0], x := text(common, both))[tree] < deep[tree]:
            pass
        crowd.append(x)
    check(spark, list(enumerate([*crowd, *pair])), 1, percent)


@pytest.mark.parametrize("family", [5, 90])
def test_links_by_hubs_and_prefixes_equal_all_links(family):
    """With more sets than hubs, and some whose links count only towards the first ones."""
    rng = np.random.default_rng(family)
    base = [rng.integers(0, 10**6, 60) for _ in range(180 // family)]
    sets = []
    for b in base:
        for _ in range(family):
            own = b.copy()
            own[rng.integers(0, 60, rng.integers(0, 14))] = rng.integers(0, 10**6)
            sets.append(np.unique(own).astype(np.uint64))
    nodes = rng.permutation(len(sets)) * 10
    for first in (np.ones(len(sets), bool), rng.random(len(sets)) < 0.3):
        parent = list(range(len(sets)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                common = len(np.intersect1d(x, y))
                if (first[i] or first[j]) and 100 * common >= 85 * (len(x) + len(y) - common):
                    a, b = sorted((root(i), root(j)), key=lambda k: nodes[k])
                    parent[b] = a
        assert near_dedup._linked(sets, nodes, first, 85).tolist() == [root(k) for k in range(len(sets))]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_regions_are_the_runs_of_common_prefixes(spark, partitions):
    """Whatever the sort's partitions cut apart: every group of equal prefixes with several marks, whole."""
    rng = np.random.default_rng(1)
    depth, trees = near_dedup.FROM_DEPTH, 2
    sig = rng.integers(0, 2, (300, trees * near_dedup.DEPTH)).astype(np.uint16)
    mark = rng.integers(0, 3, 300)
    rows = [(k, bytearray(sig[k].tobytes()), int(mark[k])) for k in range(300)]
    groups = {}
    for k in range(300):
        for t in range(trees):
            at = t * near_dedup.DEPTH
            groups.setdefault((t, sig[k, at : at + depth].tobytes()), []).append(k)
    expected = {(t, k): len(g) for (t, _), g in groups.items() if len({mark[k] for k in g}) > 1 for k in g}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = near_dedup._regions(spark.createDataFrame(rows, "node long, sig binary, mark long"), trees, depth).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.tree, r.node): r.c for r in found} == expected
    assert len(found) == len(expected)
    assert all(r.hub in groups[r.tree, bytes(r.key)] for r in found)
