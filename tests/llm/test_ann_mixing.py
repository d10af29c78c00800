"""Nearest neighbours and mixing."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, mixing

SCHEMA = "vec_id long, embedding array<float>, score int"


def plain(rows, queries, k=5):
    out = {}
    for q, v in queries:
        own = []
        for i, u in rows:
            if i != q:
                a, b = np.array(v, np.float32).astype(float), np.array(u, np.float32).astype(float)
                own.append((-(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), i))
        own.sort(key=lambda x: (round(x[0], 9), x[1]))
        out[q] = [i for _, i in own[:k]]
    return out


def search(spark, rows, every=50, k=5):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(3)
    out = {}
    for r in ann.neighbours(df, F.col("vec_id") % every == 0, k=k).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    return {q: sorted(x) for q, x in out.items()}


@pytest.mark.parametrize("clustered", [False, True])
def test_recall(spark, monkeypatch, clustered):
    monkeypatch.setattr(ann, "PART_ROWS", 250)
    monkeypatch.setattr(ann, "MOST_PARTITIONS", 4)  # so partitions are dealt on to parts
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    if clustered:
        x = 0.3 * x + rng.normal(size=(20, 32))[rng.integers(0, 20, 3000)]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x.astype(np.float32))]
    got = search(spark, rows)
    expected = plain(rows, rows[::50])
    assert set(got) == set(expected)
    hits = sum(len({i for _, i, _ in got[q]} & set(expected[q])) for q in expected)
    assert hits >= 0.95 * 5 * len(expected)
    for q, found in got.items():
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        for _, i, s in found:
            a, b = np.array(rows[q][1]), np.array(rows[i][1])
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_common_vectors_ties_and_few_candidates(spark):
    rows = [(k, [1.0, 2.0]) for k in range(300)] + [(1000, [1.0, 0.0])]
    got = search(spark, rows, every=50)
    assert [i for _, i, _ in got[0]] == [1, 2, 3, 4, 5]
    assert [i for _, i, _ in got[50]] == [0, 1, 2, 3, 4]
    assert [i for _, i, _ in got[1000]] == [0, 1, 2, 3, 4]
    got = search(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], every=2)
    assert [(r, i) for r, i, _ in got[0]] == [(1, 1), (2, 2)]


def test_vectors_that_take_no_part(spark):
    good = [(k, [math.cos(k), math.sin(k)]) for k in range(10)]
    bad = [(20, None), (30, [0.0, 0.0]), (40, [float("nan"), 1.0]), (50, [None, 1.0]), (60, [float("inf"), 1.0]), (70, []), (80, [1.0]), (None, [1.0, 1.0])]
    got = search(spark, good + bad + [good[3]], every=10)
    assert set(got) == {0}
    assert [i for _, i, _ in got[0]] == plain(good, good[:1])[0]
    assert search(spark, bad[:2]) == {}
    assert ann.neighbours(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_one_longer_vector_and_enormous_components(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(rng.normal(size=(60, 4)).astype(np.float32))]
    longer = [(100, [1.0] * 7), (101, [1.0, 2.0] + [0.0] * 5)]
    got = search(spark, rows + longer, every=50)
    assert [i for _, i, _ in got[0]] == plain(rows, rows[:1])[0] and [i for _, i, _ in got[50]] == plain(rows, rows[50:51])[50]
    assert [i for _, i, _ in got[100]] == [101]
    huge = spark.createDataFrame([(0, [1e300, 1e300]), (1, [1e200, 0.0]), (2, [1e-300, 1.1e-300])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.id, r.score) for r in ann.neighbours(huge, F.col("vec_id") == 0).collect())
    assert [i for _, i, _ in got] == [2, 1]
    assert got[1][2] == pytest.approx(math.sqrt(0.5)) and got[0][2] == pytest.approx(2.1 / math.sqrt(2 * (1 + 1.21)))


def test_projected_neighbours_come_in_order_until_the_test_holds():
    """Held against a plain loop over all projected distances."""
    rng = np.random.default_rng(8)
    x = ann._unit(rng.normal(size=(700, 16)) + 2 * rng.normal(size=(7, 16))[rng.integers(0, 7, 700)])
    points = x @ rng.normal(size=(16, ann.DIMENSIONS))
    limit = ann.chi_square_quantile(ann.CONFIDENCE, ann.DIMENSIONS)
    best, score = ann.search(x, points, x[:40], points[:40], 5, np.full(40, -np.inf))
    for q in range(40):
        kept = []
        for d, i in sorted((float(((points[i] - points[q]) ** 2).sum()), i) for i in range(len(x))):
            if len(kept) == 5 and d > limit * max(2 - 2 * kept[-1][0], 0):
                break
            kept = sorted([*kept, (float(x[i] @ x[q]), i)], reverse=True)[:5]
        # Neighbours are verified some at a time, so a few more may be seen than the loop takes.
        assert all(s >= c - 1e-12 for s, (c, _) in zip(score[q], kept))
        exact = np.sort(x @ x[q])[::-1][:5]
        assert score[q][0] == pytest.approx(exact[0])


@pytest.fixture
def many_partitions(spark):
    """Both sides of a cogroup dealt over partitions that stay apart, as with large tables."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_recall_of_the_query_on_its_table(spark, many_partitions, monkeypatch):
    from millrace.llm.queries import QUERIES

    monkeypatch.setattr(ann, "PART_ROWS", 1000)

    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding is not None]
    expected = plain(rows, [r for r in rows if r[0] % 50 == 0])
    found = {}
    for r in QUERIES["op7_ann"](spark, folder).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(found) == set(expected) and all(len(x) == 5 for x in found.values())
    recall = sum(len(found[q] & set(own)) for q, own in expected.items()) / sum(map(len, expected.values()))
    print("recall", recall)
    assert recall >= 0.98


def test_chi_square():
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert ann.chi_square_quantile(0.5, 2) == pytest.approx(2 * math.log(2))


def docs_and_labels(spark, n=1500):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        kind = rng.choices(["high", "low"], [0.8, 0.2])[0]
        words = [f"{kind[0] if rng.random() < 0.4 else 'n'}{rng.randrange(100)}" for _ in range(rng.randrange(5, 80))]
        rows.append((k, " ".join(words), 1, 0.5))
        if k % 2:
            labels.append((k, kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens int, rate double").repartition(4)
    return docs, spark.createDataFrame(labels + [(None, "high"), (1, None), (3, "other")], "doc_id long, kind string")


def fit(spark, **options):
    docs, labels = docs_and_labels(spark)
    rows = mixing.mix(docs, labels, F.col("kind"), {"high": 0.5, "low": 0.5}, **options).collect()
    t = np.array([r.tokens for r in rows], float)
    p = np.array([r.posterior for r in rows])
    return rows, t, p, np.array([r.rate for r in rows])


def test_expected_totals_meet_the_target(spark):
    rows, t, p, r = fit(spark)
    assert len(rows) == 1500 and (r >= 0).all()
    total = (t * r) @ p
    assert total == pytest.approx([t.sum() / 2] * 2, rel=0.005)
    copies = np.array([x.copies for x in rows])
    assert (np.abs(copies - r) < 1).all()
    assert (t * copies) @ p == pytest.approx(total, rel=0.1)
    # A document's rate is the least for which the gradient is not negative: the optimum of the stated problem.
    g = p @ ((total - t.sum() / 2) / (t.sum() * 0.5)) + mixing.RIDGE * (r - 1)
    assert np.abs(g[r > 1e-9]).max() < 2e-3 and (g[r <= 1e-9] > -2e-3).all()


def test_query_meets_its_targets(spark):
    """The whole query: rates are recomputed from its posteriors by a plain projected gradient."""
    from millrace.llm.queries import QUERIES

    rows = QUERIES["op5_mixing"](spark, "/root/testdata/sf0.1").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    assert all(r.tokens == len((texts[r.doc_id] or "").encode().split()) for r in rows)
    t = np.array([r.tokens for r in rows], float)
    p = np.array([(r.p_high, r.p_low, r.p_toxic) for r in rows])
    share = np.array([0.90, 0.09, 0.01])
    goal, rate = share * t.sum(), np.ones(len(t))
    for _ in range(2000):
        rate = np.maximum(rate - 0.1 * (p @ (((rate * t) @ p - goal) / (t.sum() * share)) + mixing.RIDGE * (rate - 1)), 0)
    got = np.array([r.rate for r in rows])
    total = (got * t) @ p
    print("reached", total / goal, "plain", ((rate * t) @ p) / goal)
    assert total / goal == pytest.approx([1, 1, 1], abs=0.01)
    cost = lambda r: 0.5 * ((((r * t) @ p - goal) / t.sum()) ** 2 / share).sum() + 0.5 * mixing.RIDGE * (t / t.sum() * (r - 1) ** 2).sum()
    assert cost(got) <= cost(rate) * 1.05 + 1e-6
    assert all(abs(r.copies - r.rate) < 1 for r in rows)


def test_each_document_once_at_most(spark):
    rows, t, p, r = fit(spark, keep_first=True, max_rate=1.0)
    assert r.max() <= 1.0 and {x.copies for x in rows} <= {0, 1}
    sure = p[:, 0] > 0.9
    assert r[sure].min() > 0.95
    assert all(x.copies == 1 for x, y in zip(rows, r) if y == 1.0)


def test_mixing_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b"), (5, "x " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, kind string")
    rows = mixing.mix(df, none, F.col("kind"), {"a": 1, "b": 3}).collect()
    assert len(rows) == 5 and sorted(r.tokens for r in rows) == [0, 0, 0, 2, 50_000]
    assert all(sum(r.posterior) == pytest.approx(1) and r.rate >= 0 for r in rows)
    assert mixing.mix(df.limit(0), none, F.col("kind"), {"a": 1}).count() == 0
    assert {r.rate for r in mixing.mix(df.where("text = ''"), none, F.col("kind"), {"a": 1, "b": 1}).collect()} == {1.0}
