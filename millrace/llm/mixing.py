"""Mixing to target weights with soft domain membership.

A classifier learnt from a labelled table gives every document a posterior
over domains.  A document of ``t`` tokens that is drawn at rate ``r`` adds
``r * t * posterior`` to the expected tokens of the domains.  Rates are fitted
by distributed projected-gradient least squares:

    min  1/2 sum_k ((S_k - T_k) / N)^2 / w_k  +  ridge/2 sum_i (t_i / N) (r_i - 1)^2,
    0 <= r_i (<= max_rate),   S_k = sum_i r_i t_i posterior_ik

with T the target tokens, N all tokens and w the target weights, so that a
small domain meets its target as closely as a large one.  In the metric of the
tokens the gradient at a document is ``posterior . (S - T) / (N w) + ridge (r -
1)``: it needs only the K totals.  So a step is one aggregation of K sums over a narrow table;
rates are not stored but computed anew from the few K-vectors of the steps so
far (with Nesterov's acceleration, begun anew where it overshoots), and the driver holds K numbers a step.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sparse import chosen_terms, examples_of, give_back, tidied
from .store import once_each, place, renamed, stored, with_fields
from .textkernel import mix64, slices, terms

#: Labelled rows that the classifier is fitted on, at most about.
SAMPLE_ROWS = 8_000
BITS, TERMS, EPOCHS = 20, 2_048, 30
LEAST_CHI, LEAST_DOCS = 10.0, 4
PREFIXES = (4, 5)
RIDGE = 1e-3
#: Steps of the fit at most, and the change of any domain's total, in parts of its target, at which it ends.
STEPS, SETTLED = 60, 2e-4

_UPPER, _PUNCT, _DIGITS, _BREAKS = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_DIGITS[48:58] = True
_BREAKS[10] = True


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _features(
    offsets: np.ndarray, data: np.ndarray, known: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) by row, and tokens (white-space words) of each row; with ``known`` flags, of those terms only.

    Terms are words, beginnings of words, and shapes: shares of capitals,
    punctuation, digits and line breaks, length, and repetition, in steps.
    """
    rows = len(offsets) - 1
    hashes, row = terms(offsets, data, PREFIXES)
    sizes = np.maximum(np.diff(offsets), 1)
    counted = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])[offsets])
    term = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    # Repetition: marks of the terms that a row has, in a table of a few bits a term, against all of its terms.
    many = np.bincount(row, minlength=rows)
    width = 4 * np.maximum(many, 1)
    start = np.cumsum(width) - width
    marks = np.zeros(int(width.sum()), bool)
    marks[start[row] + term * 2654435761 % width[row]] = True
    distinct = np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[np.append(start, len(marks))])
    if known is not None:
        some = known[term]
        term, row = term[some], row[some]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    tokens = counted(begins).astype(np.int64)
    shapes = [np.minimum(counted(t[data]) * 40 // sizes, 39) for t in (_UPPER, _PUNCT, _DIGITS, _BREAKS)]
    shapes += [np.log2(sizes).astype(np.int64), np.minimum(distinct * 20 // np.maximum(many, 1), 79)]
    code = [(row << BITS) | term]
    for k, s in enumerate(shapes):
        own = (mix64(np.uint64(k * 1000 + 7) + s.astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)
        some = slice(None) if known is None else known[own]
        code.append((np.arange(rows)[some] << BITS) | own[some])
    code = np.unique(np.concatenate(code))
    return code >> BITS, code & ((1 << BITS) - 1), tokens


@dataclass
class Posterior:
    """Multinomial logistic regression on the presence of hashed terms."""

    domains: list[str]
    bias: np.ndarray
    terms: np.ndarray
    weight: np.ndarray

    @classmethod
    def fit(cls, examples: list[np.ndarray], labels: list[str], domains: list[str], seed: int = 5) -> Posterior:
        """Without examples every domain is as likely; one without any example is never quite excluded."""
        y = np.array([domains.index(x) for x in labels], np.int64)
        n, k = len(y), len(domains)
        counts = np.bincount(y, minlength=k) + 0.5
        bias = np.log(counts / counts.sum())
        if not n:
            return cls(domains, bias, np.zeros(0, np.int64), np.zeros((0, k)))
        chosen, x = chosen_terms(examples, y, k, 1 << BITS, TERMS, LEAST_CHI, LEAST_DOCS)
        w, b = np.zeros((len(chosen), k), np.float32), bias.astype(np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        rng, step = np.random.default_rng(seed), 0
        target = np.eye(k, dtype=np.float32)[y]
        for epoch in range(EPOCHS):
            rate = 0.02 * (1 - epoch / EPOCHS) + 0.001
            order = rng.permutation(n)
            for a in range(0, n, 256):
                own, step = order[a : a + 256], step + 1
                xb = x[own].astype(np.float32)
                e = (_softmax(xb @ w + b) - target[own]) / len(own)
                g = xb.T @ e + 1e-4 * w
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                b = b - 0.05 * e.sum(0)
        return cls(domains, b.astype(float), chosen, w.astype(float))

    def flags(self) -> np.ndarray:
        """Whether a hash is that of a term with weights."""
        out = np.zeros(1 << BITS, bool)
        out[self.terms] = True
        return out

    def predict(self, rows: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        spot = np.searchsorted(self.terms, term)
        known = spot < len(self.terms)
        known[known] = self.terms[spot[known]] == term[known]
        row, spot = row[known], spot[known]
        z = np.stack([np.bincount(row, self.weight[spot, d], minlength=rows) for d in range(len(self.domains))], 1)
        return _softmax(z + self.bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_posterior(
    docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], *, text="text", row_id="doc_id"
) -> Posterior:
    """Fit on at most about SAMPLE_ROWS rows of ``labels`` (``row_id`` and what ``domain`` reads), drawn by a hash of the id.

    Rows with a null id or a domain not in ``domains`` are left out; of several
    labels for an id the least domain holds; of documents that repeat an id one
    counts, so what is collected is bounded by the ids.
    """
    known = labels.select(F.col(row_id).alias("__id"), domain.alias("__domain"))
    known = known.where(F.col("__id").isNotNull() & F.col("__domain").isin(domains)).groupBy("__id").agg(F.min("__domain").alias("__domain"))
    share = SAMPLE_ROWS / max(known.count(), SAMPLE_ROWS)
    drawn = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    kind = dict(docs.dtypes)[row_id]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in slices(batch.column(2)):
                row, term, _ = _features(offsets, data)
                bounds = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                own = pa.ListArray.from_arrays(pa.array(bounds), pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), own], ["id", "domain", "terms"]
                )

    ids = docs.select(F.col(row_id).alias("__id"))
    rows = (
        docs.select(F.col(row_id).alias("__id"), F.col(text).cast("string").alias("__text"))
        .join(F.broadcast(drawn), "__id")
        .select("__id", "__domain", "__text")
        .mapInArrow(tidied(features), f"id {kind}, domain string, terms array<int>")
    )
    rows = once_each(rows, ids, drawn, ["id", "domain"], "terms").toArrow()
    examples, order = examples_of(rows, "id", "terms")
    model = Posterior.fit(examples, rows["domain"].take(pa.array(order)).to_pylist(), domains)
    del rows, examples
    give_back()
    return model


def posteriors(df: DataFrame, model: Posterior, *, text: str = "text") -> DataFrame:
    """Add ``tokens`` (long) and ``posterior`` (array of doubles in the order of ``model.domains``) to every row."""
    keep = [c for c in df.columns if c not in ("tokens", "posterior")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, known = len(model.domains), model.flags()
        for batch in batches:
            counts, said = [np.zeros(0, np.int64)], [np.zeros((0, k))]
            for a, b, offsets, data in slices(batch.column(batch.num_columns - 1)):
                row, term, tokens = _features(offsets, data, known)
                counts.append(tokens)
                said.append(model.predict(b - a, row, term))
            p = np.concatenate(said)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.concatenate(counts)), lists], [*keep, "tokens", "posterior"]
            )

    schema = with_fields(df, keep, tokens="long", posterior="array<double>")
    return df.select(*renamed(keep), F.col(text).cast("string").alias("text")).mapInArrow(tidied(run), schema)


@dataclass
class Rates:
    """The fitted rates as a function of the posterior: the steps' K-vectors with their momentum, and the step size."""

    steps: list[tuple[np.ndarray, float]]
    size: float
    ridge: float
    max_rate: float | None
    #: Expected tokens of the domains at the fitted rates, and the targets; whether the steps settled before they ran out.
    totals: np.ndarray | None = None
    goal: np.ndarray | None = None
    settled: bool = False

    def of(self, p: np.ndarray) -> np.ndarray:
        """Rates for posteriors ``p``."""
        return self.path(p)[0]

    def path(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rates, the point ahead where the next step takes its gradient, and by how much momentum went astray.

        The last is positive where a step turned against the one before it.
        """
        rate = point = np.ones(len(p))
        astray = np.zeros(len(p))
        for g, momentum in self.steps:
            new = np.maximum(point - self.size * (p @ g + self.ridge * (point - 1)), 0)
            if self.max_rate is not None:
                new = np.minimum(new, self.max_rate)
            astray = (point - new) * (new - rate)
            point, rate = new + momentum * (new - rate), new
        return rate, point, astray


def _sums(table: DataFrame, rates: Rates, k: int, ahead: bool, square: bool = False) -> np.ndarray:
    """Expected tokens of the domains at the rates or ahead of them, and then how far momentum went astray.

    ``square``: the second moments of posteriors by tokens.
    """
    size = k * k if square else k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            t = batch.column(0).to_numpy().astype(float)
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            if square:
                out += ((p * t[:, None]).T @ p).ravel()
                continue
            rate, point, astray = rates.path(p)
            out += np.append(((point if ahead else rate) * t) @ p, astray @ t)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array(out)], ["k", "s"])

    parts = table.select("tokens", "posterior").mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s")).collect()
    out = np.zeros(size)
    for d, s in parts:
        out[d] = s
    return out


def fit_rates(
    table: DataFrame, weights: list[float], *, tokens: float | None = None, keep_first: bool = False, max_rate: float | None = None, ridge: float = RIDGE
) -> Rates:
    """Rates for ``table`` (``tokens, posterior``; stored) by which domain totals come to ``weights`` of ``tokens``.

    ``tokens`` defaults to all tokens there are.  ``keep_first``: instead, the
    total at which the first domain keeps just what it has.  No tokens give
    rates of 1.
    """
    k = len(weights)
    share = np.array(weights, float) / sum(weights)
    if not (share > 0).all():
        raise ValueError("every domain needs a positive weight")
    start = Rates([], 0.0, ridge, max_rate)
    now = _sums(table, start, k, False)[:k]
    everything = now.sum()
    if not everything:
        return start
    goal = share * (now[0] / share[0] if keep_first else tokens or everything)
    moment = _sums(table, start, k, False, square=True).reshape(k, k) / everything
    moment /= np.sqrt(share[:, None] * share)
    rates = Rates([], 1 / (np.linalg.eigvalsh(moment).max() + ridge), ridge, max_rate, goal=goal)
    before, since = now, 0  # steps since momentum began anew
    for _ in range(STEPS):
        rates.steps.append(((now - goal) / (everything * share), since / (since + 3)))
        *now, astray = _sums(table, rates, k, True)
        now, since = np.array(now), 0 if astray > 0 else since + 1
        rates.settled = bool((np.abs(now - before) < SETTLED * goal).all())
        if rates.settled:
            break
        before = now
    rates.totals = _sums(table, rates, k, False)[:k]
    if not rates.settled:
        logging.getLogger(__name__).warning("rates not settled in %d steps: totals %s, targets %s", STEPS, rates.totals, goal)
    return rates


def mix(
    docs: DataFrame,
    labels: DataFrame,
    domain: Column,
    weights: dict[str, float],
    *,
    tokens: float | None = None,
    keep_first: bool = False,
    max_rate: float | None = None,
    text: str = "text",
    row_id: str = "doc_id",
    row: str | None = None,
    seed: int = 3,
) -> DataFrame:
    """``id, uid, tokens, posterior, rate, copies`` of every row of ``docs`` (``uid``: the column ``row``, or its place in ``docs``).

    ``copies`` rounds the rate up or down by a hash of id and place, so that
    its expectation is the rate.

    Edge cases: a null text is empty, has no tokens and weighs nothing, and its
    rate is that of its posterior; null ids are kept; rows that repeat are
    separate; an empty labelled table gives equal posteriors; no rows give no
    rows; other columns play no part, whatever their names.
    """
    domains = list(weights)
    model = fit_posterior(docs, labels, domain, domains, text=text, row_id=row_id)
    rows = docs.select(F.col(row_id).alias("id"), place(row).alias("uid"), F.col(text).alias("__source"))
    table = stored(posteriors(rows, model, text="__source").drop("__source"), "mix-posteriors")
    rates = fit_rates(table, list(weights.values()), tokens=tokens, keep_first=keep_first, max_rate=max_rate)
    k = len(domains)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates.of(p))], [*batch.schema.names, "rate"])

    kind = dict(docs.dtypes)[row_id]
    fitted = table.select("id", "uid", "tokens", "posterior").mapInArrow(
        rate, f"id {kind}, uid long, tokens long, posterior array<double>, rate double"
    )
    draw = F.pmod(F.xxhash64("id", "uid", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return fitted.withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))


def label_domain() -> Column:
    """``toxic``, else ``high`` or ``low`` by the quality label."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


def op5(spark, sf_dir: str) -> DataFrame:
    """Rates for all documents: 90 % of tokens of high quality, 9 % low, 1 % toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = mix(docs, labels, label_domain(), {"high": 0.90, "low": 0.09, "toxic": 0.01})
    return out.select(
        F.col("id").alias("doc_id"),
        "tokens",
        F.col("posterior")[0].alias("p_high"),
        F.col("posterior")[1].alias("p_low"),
        F.col("posterior")[2].alias("p_toxic"),
        "rate",
        "copies",
    )
