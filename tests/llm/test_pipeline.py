"""The pipeline, stage by stage, against plain versions; the queries over small tables."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import exact_dedup, html_extract, mixing, near_dedup, packing, pii, sharding, toxicity, url_filter
from millrace.llm.queries import ORACLE, QUERIES
from millrace.llm.store import stored

from .test_dedup import plain

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER), "test-stage")
        assert docs.columns == columns
        kept.append(docs.collect())
        assert set(kept[-1]) <= set(kept[-2])
    raw, clean, once, near, mixed = kept
    model = toxicity.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(raw).select("doc_id", "text"), model).collect()}
    assert {r.doc_id for r in clean} == {i for i, s in scores.items() if s < 0.5}
    best = {}
    for r in clean:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in once} == set(best.values())
    expected, _ = plain([(r.doc_id, r.text) for r in once], 5, 80)
    assert {r.doc_id for r in near} == {i for i, _, c in expected if i == c}
    assert len(mixed) >= 0.9 * len(near)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    held = defaultdict(int)
    for r in pieces:
        held[r.doc_id] += r.length
        assert r.length <= corpus_pipeline.SEQUENCE
    assert set(held) == {r.doc_id for r in mixed}
    assert all(held[r.doc_id] == r.doc_tokens for r in pieces)


def test_mixing_keeps_rows_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", 0)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = corpus_pipeline.exact(spark, docs, FOLDER)
    assert got.count() == docs.select("text").distinct().count()


def test_stages_take_tables_that_are_no_plain_reads(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(5).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.exact(spark, docs, FOLDER).count() == docs.select("text").distinct().count()


def test_dropped_rows_do_not_depend_on_how_a_scan_is_split(spark, monkeypatch, tmp_path):
    """The table is packed into other partitions between the pass that finds rows and the one that drops them."""
    key = "spark.sql.files.minPartitionNum"
    rows = [(k, f"text {k % 40}", None, None) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(12)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    dedup = corpus_pipeline.exact_dedup.dedup

    def repacked(*args, **options):
        found = stored(dedup(*args, **options), "test-found")
        spark.conf.set(key, "1")
        return found

    monkeypatch.setattr(corpus_pipeline.exact_dedup, "dedup", repacked)
    try:
        got = corpus_pipeline.exact(spark, docs, FOLDER).collect()
    finally:
        spark.conf.unset(key)
    assert sorted(r.doc_id for r in got) == list(range(80, 120))


def clashing(spark, n=24):
    """Documents and pages in one, with columns named as the operators' own or with a dot."""
    names = ["a.b", "keys", "__uid", "__text", "__html", "__row", "__score", "__size", "__index", "__h1", "__range", "__best", "__hit", "`q`"]
    rows = [(k, f"some words, number {k % 7}", f"http://x.org/{k}", f"<p>text {k}</p>", "en", *[k] * len(names)) for k in range(n)]
    return spark.createDataFrame(rows, ["doc_id", "text", "url", "html", "lang", *names]).repartition(2), names


def test_columns_with_clashing_names_are_kept(spark):
    df, names = clashing(spark)
    model = toxicity.FactorizationMachine.fit([], np.zeros(0))
    posterior = mixing.Posterior.fit([], [], ["x", "y"])
    rules = spark.createDataFrame([("org", "/1", "block")], "host string, path string, verdict string")
    results = {
        "pii": pii.scan(df),
        "html": html_extract.main_text(df, into="main"),
        "toxicity": toxicity.score(df, model),
        "mixing": mixing.posteriors(df, posterior),
        "url": url_filter.judge(df, rules),
        "sharding": sharding.assign_shards(df, 3, size="__size", group=["text"], row_id="doc_id"),
    }
    for _, stage in corpus_pipeline.STAGES[1:3]:
        results[stage.__name__] = stage(spark, df, FOLDER)
    assert corpus_pipeline.mix(spark, df, FOLDER).columns == df.columns
    for name, got in results.items():
        assert got.columns[: len(df.columns)] == df.columns, name
        rows = got.collect()
        assert all(r[n] == r["doc_id"] for r in rows for n in names), name
        assert len(rows) == (24 if name not in ("exact", "near") else 7), name
    for found in (exact_dedup.dedup(df, F.lit(True)), near_dedup.near_duplicates(df), packing.pack(df, public_tokenizers.path("word_bpe_49k.json"))):
        assert found.count() == 24


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    expected = con.sql(ORACLE[name])
    got = QUERIES[name](spark, FOLDER).select(*expected.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expected.fetchall()), key=str)


def test_near_dedup_query_against_plain(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    expected, _ = plain([tuple(r) for r in docs], 3, 85)
    got = QUERIES["op2_near_dedup"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(expected)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_packing_query_against_the_tokenizer(spark):
    """Every document's ids, by the public library, cut as the pieces say; every sequence gapless."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in QUERIES["op10_packing"](spark, FOLDER).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for i, own in by_doc.items():
        ids = np.array([*tokenizer.encode(docs[i], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_query_columns(spark):
    kinds = {
        "op2_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
        "op4_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_disguised bigint",
        "op6_html_extract": "page_id bigint, url string, text string, n_chars bigint",
        "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
        "op10_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
        "op7_ann": "query_id bigint, rank int, vec_id bigint, score double",
    }
    for name, kind in kinds.items():
        got = QUERIES[name](spark, FOLDER)
        assert ", ".join(f"{n} {t}" for n, t in got.dtypes) == kind
    held = QUERIES["op9_toxicity"](spark, FOLDER).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert np.isfinite([r.score for r in held]).all()
