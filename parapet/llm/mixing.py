"""Mixing documents to target weights of domains with soft membership.

A classifier fitted on the labelled table gives every document a posterior over the domains. Its rate (how
often it should be seen) is nonnegative, and the rates are fitted so that the expected tokens of each
domain match the targets:

    minimise  sum_k (sum_d r_d n_d p_dk / N - t_k)^2,   r >= 0,   from r_d = 1

by projected gradient: a step takes p_d . g from every rate and cuts it at 0, where g is the residual of the
domains, preconditioned by their Gram matrix over the rates above 0. Without a cut one step meets the
targets. A step needs one aggregate of a few numbers (totals and Gram matrix); the rate of a row follows from
its posterior and the list of steps, so no table of rates is kept between them.
"""

from __future__ import annotations

import math
import warnings
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.llm.common import HELD_OUT_FOLD, fold, map_batches, written
from parapet.llm.sample import labelled_sample
from parapet.llm.words import ALNUM, constants, mix64, word_slices

#: domains are the combinations of the two labels
DOMAINS = ("plain", "toxic plain", "quality", "toxic quality")
#: share of expected tokens wanted of each domain
TARGETS = (0.12, 0.03, 0.80, 0.05)
PER_DOMAIN = 800
MOST_CHARS = 20_000
BITS = 15
#: weight of the overall rate of a word, in documents
PRIOR_DOCS = 20.0
#: added to the Gram matrix, so that a domain without tokens can be solved for
FLOOR = 1e-12
#: shortest part of a step that is tried
LEAST_STEP = 1e-3
#: most aggregates, and the residual at which the fit ends
STEPS = 100
TOLERANCE = 1e-7
#: a total further than this from its target is reported
REACHED = 1e-4

_C = constants(1, 61)[0]


class Bayes(NamedTuple):
    prior: np.ndarray  # log prior by domain
    weights: np.ndarray  # 2**BITS x domains, log likelihood of a word's slot


def _slots(h: np.ndarray) -> np.ndarray:
    return (mix64(h * _C) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, per_domain: int = PER_DOMAIN) -> Bayes | None:
    """Naive Bayes over words, from at most ``per_domain`` labelled documents of each domain outside the
    held-out fold; the priors count all labels. None without labels."""
    known = labels.filter(F.col("doc_id").isNotNull() & (fold() != HELD_OUT_FOLD)).groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    known = known.select("doc_id", (2 * F.coalesce((F.col("q") == 1).cast("int"), F.lit(0)) + F.coalesce((F.col("t") == 1).cast("int"), F.lit(0))).alias("class"))
    counts = {r["class"]: r["count"] for r in known.groupBy("class").count().collect()}
    rows = labelled_sample(known, docs.select("doc_id", "text"), per_domain, MOST_CHARS)
    if not rows:
        return None
    k = len(DOMAINS)
    seen, n = np.zeros((1 << BITS, k)), np.array([counts.get(d, 0) for d in range(k)], float)
    for s in word_slices(pa.array([t for _, t in rows], pa.string()), ALNUM):
        for d in range(s.last - s.first):
            seen[np.unique(_slots(s.hashes[s.doc_off[d] : s.doc_off[d + 1]])), rows[s.first + d][0]] += 1
    drawn = np.bincount([c for c, _ in rows], minlength=k)
    # a domain of few documents leans on the rate of the word in all of them
    overall = (seen.sum(axis=1, keepdims=True) + 0.5) / (len(rows) + 1.0)
    rate = (seen + PRIOR_DOCS * overall) / (drawn + PRIOR_DOCS)
    return Bayes(np.log((n + 0.5) / (n + 0.5).sum()), np.log(rate / rate.mean(axis=1, keepdims=True)))


def posteriors(docs: DataFrame, model: Bayes | None) -> DataFrame:
    """The rows of ``docs`` with n_tokens and the posterior of each domain (array p). Evidence is the
    mean over the distinct words, times the square root of their number: words repeat each other."""
    k = len(DOMAINS)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        tokens, post = [], []
        for s in word_slices(b.column("text"), ALNUM):
            for d in range(s.last - s.first):
                h = s.hashes[s.doc_off[d] : s.doc_off[d + 1]]
                tokens.append(len(h))
                x = np.zeros(k) if model is None else model.prior.copy()
                if model is not None and len(h):
                    u = np.unique(_slots(h))
                    x += model.weights[u].sum(axis=0) / math.sqrt(len(u))
                x = np.exp(x - x.max())
                post.append((x / x.sum()).tolist())
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens, pa.int64()), pa.array(post, pa.list_(pa.float64()))], names=[*b.schema.names, "_n", "_p"])

    plain = docs.select([F.col(c) for c in docs.columns])
    return map_batches(plain, fn, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["_n bigint", "_p array<double>"]))


def _rate(steps: list[tuple[float, ...]]) -> Column:
    """Rate after the given steps: each is taken from it along the posterior, and it is cut at 0."""
    if not steps:
        return F.lit(1.0)
    past = F.array(*[F.array(*[F.lit(float(g)) for g in s]) for s in steps])
    dot = lambda g: F.aggregate(F.zip_with("_p", g, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(past, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - dot(g)))


def _moments(table: DataFrame, steps: list[tuple[float, ...]], k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Expected token shares of the domains after the steps, and their Gram matrix over the rows with a
    rate. None without tokens."""
    rows = table.select(F.col("_n").cast("double").alias("n"), _rate(steps).alias("r"), *[F.col("_p")[j].alias(f"p{j}") for j in range(k)])
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(F.sum("n"), *[F.sum(F.expr(f"n * r * p{j}")) for j in range(k)], *[F.sum(F.expr(f"if(r > 0, n * p{i} * p{j}, 0D)")) for i, j in upper]).first()
    if not got[0]:
        return None
    x = np.array(got[1:], float) / got[0]
    gram = np.zeros((k, k))
    for (i, j), v in zip(upper, x[k:], strict=True):
        gram[i, j] = gram[j, i] = v
    return x[:k], gram


def fit_rates(table: DataFrame, targets: tuple[float, ...] = TARGETS, steps: int = STEPS) -> list[tuple[float, ...]]:
    """Steps of the projected gradient for a table of (_n, _p), to a residual of TOLERANCE or ``steps``
    aggregates. A step that does not lessen the residual is halved."""
    want, past, part = np.array(targets, float), [], 1.0
    now = _moments(table, past, len(want))
    if now is None:
        return []
    for _ in range(steps - 1):
        off = now[0] - want
        if np.abs(off).max() <= TOLERANCE or part < LEAST_STEP:
            break
        g = part * np.linalg.solve(now[1] + FLOOR * np.eye(len(want)), off)
        new = _moments(table, [*past, tuple(g.tolist())], len(want))
        if np.abs(new[0] - want).sum() < np.abs(off).sum():
            past, now, part = [*past, tuple(g.tolist())], new, min(1.0, 2 * part)
        else:
            part /= 2
    return past


def totals(table: DataFrame, past: list[tuple[float, ...]], k: int = len(DOMAINS)) -> tuple[float, ...]:
    """Share of expected tokens of each domain under the fitted rates; nothing without tokens."""
    now = _moments(table, past, k)
    return () if now is None else tuple(now[0].tolist())


def mixed(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """The rows of ``docs`` with n_tokens, domain (the likeliest), rate and copies.

    ``copies`` is the rate rounded up or down by a hash of the id, so that its expectation is the rate;
    rows of no copy stay, with 0. A null or empty text has the prior's posterior and no tokens; without
    labels all domains are equally likely. A target that no rates reach (the domain has no tokens, or none
    without those of others) is approached as closely as can be and reported as a warning. Columns of ``docs`` with these names give way to the result;
    repeated rows give repeated results; no rows give no rows.
    """
    made = ["n_tokens", "domain", "rate", "copies"]
    base = docs.drop(*made)
    # columns that are named like the two worked with are put aside and come back at the end
    aside = {c: f"_own_{i}_{c}" for i, c in enumerate(base.columns) if c.lower() in ("_n", "_p")}
    table = written(posteriors(base.withColumnsRenamed(aside), fit(docs, labels)))
    past = fit_rates(table.select("_n", "_p"), targets)
    for d, got, want in zip(DOMAINS, totals(table.select("_n", "_p"), past), targets, strict=False):
        if abs(got - want) > REACHED:
            warnings.warn(f"domain {d}: share {got:.4f} of the expected tokens, target {want} cannot be reached", stacklevel=2)
    best = F.array_position("_p", F.array_max("_p")).cast("int") - 1
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    out = table.withColumns({"n_tokens": F.col("_n"), "domain": F.array(*[F.lit(d) for d in DOMAINS])[best], "rate": _rate(past)})
    return out.withColumn("copies", F.floor(F.col("rate") + unit).cast("bigint")).select(*[F.col(aside.get(c, c)).alias(c) for c in base.columns], *made)
