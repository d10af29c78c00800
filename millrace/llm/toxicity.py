"""Toxicity: a factorization machine over hashed terms (Rendle 2010).

A document's features are the presence of terms: its words and the beginnings
of longer words, hashed.  The score is the logistic of

    bias + sum of weights + sum over pairs of terms <v_i, v_j>

so that two terms, such as an insult and the mention of a group, can weigh
more together than their two weights say.  The pairs cost no more than the
terms: ((sum v)^2 - sum v^2) / 2 for each factor.

The model is fitted on the driver from a bounded sample of labelled rows and
is a few hundred kB; scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparse import chosen_terms, examples_of, give_back, tidied
from .store import once_each, renamed, small_batches, with_fields
from .textkernel import slices, terms

#: Labelled rows that the fit draws, about; all of them where there are fewer.
SAMPLE_ROWS = 8_000
#: Bits of the hash that tell terms apart.
BITS = 20
#: Terms that get weights: those whose presence says most about the label.
TERMS = 2_048
#: A term needs this chi-square (one degree of freedom) and this many documents.
LEAST_CHI, LEAST_DOCS = 15.0, 4
#: Bytes of word beginnings that are terms too.
PREFIXES = (4, 5, 6)
FACTORS = 8
EPOCHS = 40


def _distinct(offsets: np.ndarray, data: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hashed term) of a slice, by row; with ``known`` flags of hashes, of those terms only."""
    hashes, rows = terms(offsets, data, PREFIXES)
    if known is not None:
        some = known[hashes >> np.uint64(64 - BITS)]
        hashes, rows = hashes[some], rows[some]
    code = (rows.astype(np.uint64) << np.uint64(BITS)) | (hashes >> np.uint64(64 - BITS))
    code = np.unique(code)
    return (code >> np.uint64(BITS)).astype(np.int64), (code & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class FactorizationMachine:
    """``slot[hash]`` is a term's place in ``weight`` and ``factor``, or -1."""

    bias: float
    terms: np.ndarray
    weight: np.ndarray
    factor: np.ndarray

    @classmethod
    def fit(cls, examples: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> FactorizationMachine:
        """``examples``: distinct hashed terms of each document; ``labels``: 0 or 1.

        No examples, or examples of one label only, give the constant score
        that the labels suggest.
        """
        labels = np.asarray(labels, np.float32)
        n, ones = len(labels), float(labels.sum())
        bias = float(np.log((ones + 0.5) / (n - ones + 0.5)))
        empty = cls(bias, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
        if not 0 < ones < n:
            return empty
        chosen, x = chosen_terms(examples, labels, 2, 1 << BITS, TERMS, LEAST_CHI, LEAST_DOCS)
        if not len(chosen):
            return empty
        rng = np.random.default_rng(seed)
        w, v = np.zeros(len(chosen), np.float32), rng.normal(0, 0.02, (len(chosen), FACTORS)).astype(np.float32)
        b = np.float32(bias)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v, np.zeros(1, np.float32))]
        step = 0

        def adam(p: np.ndarray, g: np.ndarray, m: list[np.ndarray], rate: float) -> np.ndarray:
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            return p - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)

        for epoch in range(EPOCHS):
            rate = 0.02 * (1 - epoch / EPOCHS) + 0.001
            order = rng.permutation(n)
            for a in range(0, n, 256):
                own = order[a : a + 256]
                xb, step = x[own].astype(np.float32), step + 1
                xv = xb @ v
                z = b + xb @ w + 0.5 * (xv * xv - xb @ (v * v)).sum(1)
                e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]) / len(own)
                gw = xb.T @ e + 2e-5 * w
                gv = xb.T @ (e[:, None] * xv) - (xb.T @ e)[:, None] * v + 1e-4 * v
                w, v = adam(w, gw, state[0], rate), adam(v, gv, state[1], rate)
                b = adam(np.array([b]), np.array([e.sum()]), state[2], rate)[0]
        return cls(float(b), chosen, w.astype(np.float64), v.astype(np.float64))

    def flags(self) -> np.ndarray:
        """Whether a hash is that of a term with weights."""
        out = np.zeros(1 << BITS, bool)
        out[self.terms] = True
        return out

    def predict(self, rows: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Scores of ``rows`` documents from their distinct (row, hashed term)."""
        spot = np.searchsorted(self.terms, term)
        known = spot < len(self.terms)
        known[known] = self.terms[spot[known]] == term[known]
        row, spot = row[known], spot[known]
        z = np.full(rows, self.bias) + np.bincount(row, self.weight[spot], minlength=rows)
        for k in range(self.factor.shape[1]):
            own = self.factor[spot, k]
            s = np.bincount(row, own, minlength=rows)
            z += (s * s - np.bincount(row, own * own, minlength=rows)) / 2
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def to_json(self) -> str:
        return json.dumps(
            {
                "bias": self.bias,
                "terms": self.terms.tolist(),
                "weight": self.weight.tolist(),
                "factor": self.factor.tolist(),
            }
        )

    @classmethod
    def from_json(cls, text: str) -> FactorizationMachine:
        x = json.loads(text)
        factor = np.array(x["factor"], float).reshape(len(x["terms"]), -1 if x["terms"] else FACTORS)
        return cls(x["bias"], np.array(x["terms"], np.int64), np.array(x["weight"], float), factor)


def in_training(row_id: str = "doc_id"):
    """Rows whose labels may be learnt from: all but a fifth by the CRC of the id."""
    return F.crc32(F.encode(F.col(row_id).cast("string"), "UTF-8")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, *, text="text", row_id="doc_id", label="toxic", sample_rows=SAMPLE_ROWS):
    """Fit on at most about ``sample_rows`` labelled documents, drawn by a hash of the id.

    Null labels and ids are left out; of several labels for an id the largest
    holds; labels without a document count for nothing; of documents that
    repeat an id one counts, so what is collected is bounded by the ids.
    """
    small_batches(docs.sparkSession)
    known = (
        labels.select(F.col(row_id).alias("__id"), F.col(label).cast("int").alias("__label"))
        .where(F.col("__id").isNotNull() & F.col("__label").isin(0, 1) & in_training("__id"))
        .groupBy("__id")
        .agg(F.max("__label").alias("__label"))
    )
    share = sample_rows / max(known.count(), sample_rows)
    drawn = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in slices(batch.column(2)):
                row, term = _distinct(offsets, data)
                bounds = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                own = pa.ListArray.from_arrays(pa.array(bounds), pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), own], ["id", "label", "terms"]
                )

    kind = dict(docs.dtypes)[row_id]
    ids = docs.select(F.col(row_id).alias("__id"))
    rows = (
        docs.select(F.col(row_id).alias("__id"), F.col(text).cast("string").alias("__text"))
        .join(F.broadcast(drawn), "__id")
        .select("__id", "__label", "__text")
        .mapInArrow(tidied(features), f"id {kind}, label int, terms array<int>")
    )
    rows = once_each(rows, ids, drawn, ["id", "label"], "terms").toArrow()
    examples, order = examples_of(rows, "id", "terms")
    model = FactorizationMachine.fit(examples, rows["label"].to_numpy()[order])
    del rows, examples
    give_back()
    return model


def score(df: DataFrame, model: FactorizationMachine, *, text: str = "text", into: str = "score") -> DataFrame:
    """Add ``into`` (double, 0 to 1) to every row of ``df``, from its whole text.

    A null text is scored as an empty one, which has no terms; repeated rows
    get equal scores; a column ``into`` of ``df`` is replaced; no rows give no
    rows.  No column but the text is an input.
    """
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != into]
    schema = with_fields(df, keep, **{into: "double"})
    # The text goes to Python once, if it is among what is kept.
    at = keep.index(text) if text in keep and dict(df.dtypes)[text] == "string" else len(keep)
    sent = df.select(*renamed(keep), *[F.col(text).cast("string").alias("text")] * (at == len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.flags()
        for batch in batches:
            parts = [np.zeros(0)]
            for a, b, offsets, data in slices(batch.column(at)):
                parts.append(model.predict(b - a, *_distinct(offsets, data, known)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(np.concatenate(parts))], [*keep, into]
            )

    return sent.mapInArrow(tidied(run), schema)


def op9(spark, sf_dir: str) -> DataFrame:
    """A score for every document, learnt from the labels outside the held-out fifth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(~in_training(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
