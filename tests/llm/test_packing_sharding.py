"""Packing and sharding: whole, gapless, and as full and even as they say."""

import bisect
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import packing, sharding

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_plan_uses_every_length_and_fits():
    rng = random.Random(2)
    for _ in range(50):
        histogram = {rng.randrange(1, 65): rng.randrange(1, 200) for _ in range(rng.randrange(1, 40))}
        patterns = packing.plan(histogram, 64)
        used = defaultdict(int)
        for count, lengths in patterns:
            assert count > 0 and sum(lengths) <= 64
            for x in lengths:
                used[x] += count
        assert used == histogram
        rows = packing.places(patterns)
        assert len({(a, b) for a, b, _, _ in rows.tolist()}) == len(rows)
    assert packing.plan({}, 64) == []
    with pytest.raises(ValueError):
        packing.plan({65: 1}, 64)


def test_shortest_pack_first():
    assert packing.plan({5: 2, 4: 1, 1: 3}, 8) == [(1, (5,)), (1, (4, 1, 1)), (1, (5, 1))]


ROWS = [
    (1, "a short one"), (2, None), (3, ""), (4, "word " * 700), (5, "same text"), (6, "same text"), (6, "same text"), (None, "no id"),
    *[(k, "x " * (k % 37)) for k in range(10, 200)],
]


def _docs(spark):
    rows = [(i, t, 5, 0) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, length int, sequence_id int").repartition(4)


def test_pack_round_trip(spark):
    packed = packing.pack(_docs(spark), PATH, 256, with_ids=True)
    library = Tokenizer.from_file(PATH)
    rows = packed.collect()
    expected = defaultdict(int)
    for i, t in ROWS:
        expected[i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    by_sequence = defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length <= 256
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids))
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.1 * total / 256 + 1
    # Every document comes back whole, as often as it was given.
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.id, r.doc_tokens].append(r)
    for (i, ids), n in expected.items():
        own = [r for r in pieces[i, len(ids)] if tuple(r.ids) == ids[r.start : r.start + 256]]
        assert sum(r.length for r in own) >= n * len(ids)
    assert total == sum(len(ids) * n for (_, ids), n in expected.items())
    made = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in made) == total and all(r.document_starts[0] == 0 for r in made)


def test_pack_empty(spark):
    assert packing.pack(_docs(spark).limit(0), PATH, 256).count() == 0


def test_pack_hot_length_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 20)
    df = spark.range(300).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same words here', repeat('y ', cast(id % 50 AS int))) AS text")
    rows = packing.pack(df, PATH, 64).collect()
    seen = defaultdict(set)
    for r in rows:
        own = set(range(r.offset, r.offset + r.length))
        assert not seen[r.sequence_id] & own
        seen[r.sequence_id] |= own
    assert all(s == set(range(len(s))) and len(s) <= 64 for s in seen.values())


def _sizes(got):
    out = defaultdict(list)
    for r in got:
        out[r.shard].append(r)
    for own in out.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return {k: sum(r["size"] or 0 for r in own) for k, own in out.items()}


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_are_even_and_gapless(spark, shards):
    rng = random.Random(shards)
    rows = [(i, 16 + int(rng.paretovariate(1.2) * 100) % 5000, rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, size long, g int").repartition(4)
    got = sharding.assign_shards(df, shards, size="size", group=["g"], row_id="id").collect()
    assert sorted((r.id, r["size"], r.g) for r in got) == sorted(rows)
    sizes = _sizes(got)
    fair = sum(r[1] for r in rows) / shards
    assert len(sizes) == shards and max(sizes.values()) <= 1.02 * fair + 1


def test_a_hot_group_is_divided(spark):
    df = spark.range(4000).selectExpr("id", "100L AS size", "IF(id % 3 = 0, 0, id) AS g")
    sizes = _sizes(sharding.assign_shards(df, 16, size="size", group=["g"], row_id="id").collect())
    assert max(sizes.values()) <= 1.02 * min(sizes.values())
    df = spark.range(1000).selectExpr("1L AS id", "10L AS size", "'same' AS g")  # nothing tells the rows apart
    sizes = _sizes(sharding.assign_shards(df, 8, size="size", group=["g"], row_id="id").collect())
    assert max(sizes.values()) <= 1.03 * min(sizes.values())


def test_shard_edge_cases(spark):
    df = spark.createDataFrame([(None, None, None, 1), (1, 5, "a", 2), (1, 5, "a", 2), (2, 10**9, "b", 3)], "id long, size long, g string, shard int")
    got = sharding.assign_shards(df, 3, size="size", group=["g"], row_id="id")
    assert got.columns == ["id", "size", "g", "shard", "slot"]
    _sizes(got.collect())
    assert got.count() == 4
    assert sharding.assign_shards(df.limit(0), 3, size="size", group=["g"]).count() == 0
    none = sharding.assign_shards(df.withColumn("size", F.lit(0)), 2, size="size", group=["g"], row_id="id").collect()
    assert len(none) == 4
    _sizes(none)
    with pytest.raises(ValueError):
        sharding.assign_shards(df, 0, size="size", group=["g"])


def test_op8_stays_in_the_jvm(spark):
    plan = sharding.op8(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    got = sharding.op8(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    _sizes(got)


def test_many_splitters_are_searched_as_data(spark, monkeypatch):
    """The same ranges, whether splitters are nested decisions or an array searched by halves."""
    rng = random.Random(3)
    rows = [(rng.randrange(-3, 3), rng.randrange(-50, 50), k) for k in range(2000)]
    splitters = sorted({(rng.randrange(-3, 3), rng.randrange(-50, 50), rng.randrange(2000)) for _ in range(300)})
    df = spark.createDataFrame(rows, "__h1 long, __h2 long, __uid long")
    found = df.select("*", sharding._range_of(splitters).alias("r")).collect()
    assert all(r.r == bisect.bisect_right(splitters, tuple(r)[:3]) for r in found)
    monkeypatch.setattr(sharding, "DECISIONS", 10**6)
    assert [r.r for r in df.select(sharding._range_of(splitters).alias("r")).collect()] == [r.r for r in found]
    monkeypatch.setattr(sharding, "DECISIONS", 0)
    assert {r.r for r in df.select(sharding._range_of(splitters[150:151]).alias("r")).collect()} == {0, 1}


def test_shards_are_written_in_parts_and_in_order(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "1L AS size")
    placed = sharding.assign_shards(df, 2, size="size", group=["id"])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sharding.write_shards(placed, f"{tmp_path}/shards")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    for shard in (0, 1):
        files = sorted(tmp_path.glob(f"shards/shard={shard}/*.parquet"))
        assert len(files) > 1
        slots = [pq.read_table(f, columns=["slot"])["slot"].to_pylist() for f in files]
        assert all(own == list(range(own[0], own[0] + len(own))) for own in slots)
        assert sorted(x for own in slots for x in own) == list(range(2500))
