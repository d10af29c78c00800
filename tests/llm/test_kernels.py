"""Text kernels, tokens, filters and components on their own."""

import random
import re
import string

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import fuse
from millrace.llm.components import components
from millrace.llm.minhash import MinHash, shingle_sets
from millrace.llm.store import lookup, shared_dir, stored
from millrace.llm.textkernel import shingles, slices, terms, words
from millrace.llm.wordbpe import WordBpe

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TEXTS = st.lists(st.text("abAB ,.\t\né\x0b\xa0'1", max_size=30) | st.none(), max_size=12)


def _split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_and_shingles_equal_those_of_strings(texts, most):
    seen, reverse = {}, {}
    for a, b, offsets, data in slices(pa.array(texts, pa.string()), most):
        w = words(offsets, data)
        flat, bounds = shingles(w, 3)
        for r in range(b - a):
            own = _split(texts[a + r])
            assert w.bounds[r + 1] - w.bounds[r] == len(own)
            for word, h in zip(own, w.hash[w.bounds[r] : w.bounds[r + 1]].tolist(), strict=True):
                assert seen.setdefault(word, h) == h
                assert reverse.setdefault(h, word) == word
            plain = list(zip(own, own[1:], own[2:])) if len(own) >= 3 else [tuple(own)] if own else []
            got = flat[bounds[r] : bounds[r + 1]].tolist()
            assert len(got) == len(plain)
            for s, h in zip(plain, got, strict=True):
                assert seen.setdefault(s, h) == h
                assert reverse.setdefault(h, s) == s


def test_slices_of_sliced_and_null_arrays():
    column = pa.array(["x", None, "abc", "", "dé"]).slice(1)
    got = [bytes(d[o[r] : o[r + 1]]).decode() for a, b, o, d in slices(column, 3) for r in range(b - a)]
    assert got == ["", "abc", "", "dé"]
    assert list(slices(pa.array([], pa.string()))) == []


def test_very_long_words():
    text = "a" * 200_000 + " b"
    ((_, _, o, d),) = slices(pa.array([text]))
    assert len(words(o, d).hash) == 2
    assert len(terms(o, d, (4,))[0]) == 3


def test_terms_have_prefixes():
    ((_, _, o, d),) = slices(pa.array(["Insulted! insult", "insu"]))
    h, row = terms(o, d, (4, 6))
    assert len(h) == 3 + 2 + 1 and sorted(row) == [0, 0, 0, 0, 0, 1]
    assert h[1] != h[2] and h[3] == h[4]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))
    hashes = MinHash(256)
    a, b = base[:1500], base[300:1800]
    assert (hashes.signature(a) == hashes.signature(b)).mean() == pytest.approx(1200 / 1800, abs=0.12)
    assert [len(s) for s in shingle_sets(np.array([0, 3, 3]), np.frombuffer(b"a b", np.uint8), 3)] == [1, 0]


BPE = WordBpe(public_tokenizers.path("word_bpe_49k.json"))


def _encoded(texts, most=1 << 20):
    out = []
    for a, b, offsets, data in slices(pa.array(texts, pa.string()), most):
        ids, bounds = BPE.encode(offsets, data)
        out += [ids[bounds[r] : bounds[r + 1]].tolist() for r in range(b - a)]
    return out


def _by_library(texts):
    return [x.ids for x in BPE.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_tokens_of_every_character():
    texts = [f"a{c}b {c}{c}'s'{c}" for c in map(chr, [*range(0x2E90), 0x3042, 0xFB01, 0x1F600]) if not 0xD800 <= ord(c) < 0xE000]
    assert _encoded(texts) == _by_library(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcdeABCé 'strevml!,.-12\n\tñ́İ<|>", max_size=50) | st.none(), max_size=8))
def test_tokens_equal_those_of_the_library(texts):
    assert _encoded(texts, 64) == _by_library(texts)


def test_tokens_of_special_strings_long_words_and_none():
    texts = ["<|endoftext|> and <|startoftext|>", "x" * 5000, "!?" * 300, "", None, "it's we'll don''t"]
    assert _encoded(texts) == _by_library(texts)


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr("millrace.llm.wordbpe.REMEMBERED", 10)
    rng = random.Random(1)
    texts = ["".join(rng.choice(string.ascii_letters + " ") for _ in range(60)) for _ in range(30)]
    assert _encoded(texts, 100) == _by_library(texts)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 5000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, n, dtype=np.uint64)
    made = fuse.build(np.concatenate([keys, keys]))
    assert fuse.contains(made, keys).all()
    assert fuse.contains(made, rng.integers(0, 2**64, 50_000, dtype=np.uint64)).mean() < 0.01


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1100)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lookup_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr("millrace.llm.store.HOT_PARTS", 4)
    rows = spark.range(1000).selectExpr("id", "IF(id % 2 = 0, 0, id) AS k")
    table = rows.groupBy("k").count().withColumnRenamed("count", "w").selectExpr("k", "w", "k * 2 AS v")
    got = lookup(rows, table, ["k"], "w", 1000).collect()
    assert len(got) == 1000 and all(r.v == 2 * r.k for r in got)
    plan = lookup(rows, table, ["k"], "w", 1000)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_stored_goes_to_the_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)
    df = stored(spark.range(5), "test")
    assert df.count() == 5 and shared_dir(spark).removeprefix("file://") in df.inputFiles()[0]
