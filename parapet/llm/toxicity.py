"""Toxic spans and document scores by a linear-chain conditional random field.

Labels are given per document; ``fit`` turns them into labelled tokens (words and word beginnings that
stand in toxic documents far more often than chance allows mark the toxic tokens), fits the field on
them, relabels the toxic documents by its marginals, adds the places of other documents where it errs,
and fits again. The marginals of a text become its score and the offsets of its toxic spans.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm import crf
from parapet.llm.common import HELD_OUT_FOLD, fold, map_batches
from parapet.llm.sample import labelled_sample
from parapet.llm.words import ALNUM, Words, constants, mix64, shingle_hashes, text_buffers, word_slices

#: bound of the sample: so many toxic and so many other documents
PER_CLASS = (1200, 3000)
MOST_CHARS = 20_000
#: a word or beginning seeds the toxic label if it is so many times as frequent in toxic documents as in
#: the others, by a log likelihood ratio that no word would reach by chance
LEAST_RATIO = 12.0
CHANCE = 0.05
BEGINNINGS = (4, 5, 6, 7)
#: words on each side of a seed that are used as its context
CONTEXT = 12
CLEAN_RUN = 40
#: marginal from which a word of a document that is not toxic is learned from as a mistake
MISTAKE_AT = 0.02
ROUNDS = 4
#: share of a document's shingles that earlier documents of the sample may hold
MOST_KNOWN = 0.3
SPAN_AT = 0.5
#: smaller marginals of a long text must not add up to a toxic word
LEAST_MARGINAL = 0.3
THRESHOLD = 0.3

_STEP = constants(1, 47)[0]


class Fitted(NamedTuple):
    model: crf.Model
    a: float  # score = logistic(a + b * logit(1 - prod(1 - marginal)))
    b: float


def _beginnings(raw: np.ndarray, s: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each distinct word of a slice and of its beginnings (0 where there is none), and the
    distinct word of each word."""
    _, at, inverse = np.unique(s.hashes, return_index=True, return_inverse=True)
    c = crf.word_chars(raw, s.starts[at], s.ends[at])
    lens = np.diff(c.off) - 2
    keys, h = [s.hashes[at]], np.zeros(len(at), np.uint64)
    for k in range(1, BEGINNINGS[-1] + 1):
        ok = lens > k
        h[ok] = h[ok] * _STEP + c.b[c.off[:-1][ok] + k]
        if k in BEGINNINGS:
            keys.append(np.where(ok, mix64(h + np.array([k], np.uint64)), np.uint64(0)))
    return np.stack(keys, axis=1), inverse


def _unlike(col: pa.Array) -> list[int]:
    """Documents of the sample of whose shingles most are not in an earlier one: the rare words of a
    toxic text with many copies would pass for toxic words."""
    known: set[int] = set()
    keep = []
    for s in word_slices(col, ALNUM):
        for d in range(s.last - s.first):
            h = np.unique(shingle_hashes(s.hashes[s.doc_off[d] : s.doc_off[d + 1]], 3))
            own = h[h % np.uint64(4) == 0].tolist()
            if sum(x in known for x in own) <= MOST_KNOWN * len(own):
                keep.append(s.first + d)
                known.update(own)
    return keep


def _seed_tokens(raw: np.ndarray, slices: list[Words], y: np.ndarray) -> np.ndarray:
    """1 for the words of toxic documents that are, or begin like, a seed."""
    seen: list[list[np.ndarray]] = [[], []]
    parts = []
    for s in slices:
        keys, inverse = _beginnings(raw, s)
        parts.append((keys, inverse))
        docs_of = np.repeat(np.arange(s.first, s.last), np.diff(s.doc_off))
        for kind in (0, 1):
            of = y[docs_of] == kind
            words = np.unique(np.stack([docs_of[of].astype(np.int64), inverse[of].astype(np.int64)], axis=1), axis=0)
            for d in np.unique(words[:, 0]):
                k = np.unique(keys[words[words[:, 0] == d, 1]])
                seen[kind].append(k[k != 0])
    (clean, n_clean), (toxic, n_toxic) = (np.unique(np.concatenate(x) if x else np.zeros(0, np.uint64), return_counts=True) for x in seen)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    other = np.zeros(len(toxic))
    if len(clean):
        at = np.minimum(np.searchsorted(clean, toxic), len(clean) - 1)
        other = np.where(clean[at] == toxic, n_clean[at], 0).astype(float)
    q, n = n1 / (n1 + n0), n_toxic + other
    surprise = n_toxic * np.log(n_toxic / (n * q)) + np.where(other > 0, other * np.log(np.maximum(other, 1) / (n * (1 - q))), 0)
    seeds = toxic[(n_toxic / n1 >= LEAST_RATIO * other / n0) & (surprise >= np.log(max(1, len(toxic)) / CHANCE))]
    token = np.concatenate([np.isin(keys, seeds).any(axis=1)[inverse] for keys, inverse in parts]).astype(np.int64)
    token[np.repeat(y, np.concatenate([np.diff(s.doc_off) for s in slices])) == 0] = 0
    return token


def _evidence(marginals: np.ndarray, doc_off: np.ndarray) -> np.ndarray:
    """Log odds that a document has a toxic word: -log prod(1 - p) turned to odds."""
    out = np.zeros(len(doc_off) - 1)
    full = np.flatnonzero(np.diff(doc_off))
    if len(full):
        p = np.where(marginals[:, 1] >= LEAST_MARGINAL, np.minimum(marginals[:, 1], 1 - 1e-6), 0).astype(np.float64)
        out[full] = np.add.reduceat(-np.log1p(-p), doc_off[:-1][full])
    return np.log(np.expm1(np.clip(out, 1e-6, 12.0)))


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS) -> Fitted | None:
    """Field and calibration from labelled documents outside the held-out fold; None if there are not
    both toxic and other documents. A document labelled more than once is toxic if any label says so."""
    known = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold() != HELD_OUT_FOLD))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("class"))
    counts = {r["class"]: r["count"] for r in known.groupBy("class").count().collect()}
    rows = []
    for kind, most in ((1, per_class[0]), (0, per_class[1])):
        rows += labelled_sample(known.filter(F.col("class") == kind), docs.select("doc_id", "text"), most, MOST_CHARS)
    rows = [rows[i] for i in _unlike(pa.array([t for _, t in rows], pa.string()))]
    y = np.array([c for c, _ in rows])
    if not rows or y.min() == y.max():
        return None
    col = pa.array([t for _, t in rows], pa.string())
    raw, _ = text_buffers(col)
    slices = list(word_slices(col, ALNUM))
    starts, ends = (np.concatenate([getattr(s, n) for s in slices]) for n in ("starts", "ends"))
    off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(s.doc_off) for s in slices]))])
    token = _seed_tokens(raw, slices, y)
    toxic_word = np.repeat(y, np.diff(off)) == 1
    mistakes = np.zeros(len(token), bool)
    for _ in range(ROUNDS):
        idx, bounds, lab = _sequences(y, off, token, mistakes)
        model = crf.train(crf.word_chars(raw, starts[idx], ends[idx]), bounds, lab, 2, epochs=4)
        p = np.concatenate([t.marginals for t in crf.tag(col, model)])
        token = ((p[:, 1] >= SPAN_AT) & toxic_word).astype(np.int64)
        mistakes |= (p[:, 1] >= MISTAKE_AT) & ~toxic_word
    a, b = _calibrate(_evidence(p, off), y, np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum()))
    return Fitted(model, a, b)


def _sequences(y: np.ndarray, off: np.ndarray, token: np.ndarray, mistakes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of words around toxic tokens; of every other document a run, and those around mistakes."""
    rng = np.random.default_rng(9)
    idx, bounds = [], [0]
    for d in range(len(y)):
        lo, hi = int(off[d]), int(off[d + 1])
        ranges: list[list[int]] = []
        for i in lo + np.flatnonzero(token[lo:hi] if y[d] else mistakes[lo:hi]):
            s, e = max(lo, i - CONTEXT), min(hi, i + CONTEXT + 1)
            if ranges and s <= ranges[-1][1]:
                ranges[-1][1] = e
            else:
                ranges.append([s, e])
        if not y[d] and hi > lo:
            s = lo + int(rng.integers(0, max(1, hi - lo - CLEAN_RUN + 1)))
            ranges.append([s, min(hi, s + CLEAN_RUN)])
        for s, e in ranges:
            idx.append(np.arange(s, e))
            bounds.append(bounds[-1] + e - s)
    every = np.concatenate(idx) if idx else np.zeros(0, np.int64)
    return every, np.array(bounds), token[every]


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of the label on one number, with a small ridge."""
    x1, beta = np.stack([np.ones_like(x), x / 10], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        h = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + 0.1 * np.eye(2)
        beta -= np.linalg.solve(h, x1.T @ (weight * (p - y)) + 0.1 * beta)
    return float(beta[0]), float(beta[1] / 10)


def score(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans), one row for each row of ``docs`` (doc_id, text).

    ``spans`` lists the toxic word runs as structs (start, end, p) in code points of the text, end
    exclusive. A null or empty text is scored like any text without a toxic word. Without labels of
    both kinds every score is 0. A null doc_id counts as held out; repeated rows give repeated
    results; other columns are ignored; no rows give no rows.
    """
    fitted = fit(docs, labels, per_class)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        col = b.column("text")
        scores, spans = np.zeros(len(col)), [[] for _ in range(len(col))]
        if fitted:
            _, offs = text_buffers(col)
            for t in crf.tag(col, fitted.model):
                x = _evidence(t.marginals, t.doc_off)
                scores[t.first : t.last] = 1 / (1 + np.exp(-np.clip(fitted.a + fitted.b * x, -30, 30)))
                hit = np.flatnonzero(t.marginals[:, 1] >= SPAN_AT)
                docs_of = np.searchsorted(t.doc_off, hit, side="right") - 1
                last = (-1, -2)
                for w, d in zip(hit.tolist(), docs_of.tolist(), strict=True):
                    own, base = spans[t.first + d], int(offs[t.first + d])
                    s, e, p = int(t.starts[w]) - base, int(t.ends[w]) - base, float(t.marginals[w, 1])
                    if last == (d, w - 1):
                        own[-1] = {"start": own[-1]["start"], "end": e, "p": max(p, own[-1]["p"])}
                    else:
                        own.append({"start": s, "end": e, "p": p})
                    last = (d, w)
            raw, _ = text_buffers(col)
            for own, lo, hi in zip(spans, offs[:-1], offs[1:], strict=True):
                if own:
                    # places in bytes become places in code points
                    chars = np.concatenate([[0], np.cumsum((raw[lo:hi] & 0xC0) != 0x80)])
                    own[:] = [{"start": int(chars[x["start"]]), "end": int(chars[x["end"]]), "p": x["p"]} for x in own]
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32), pa.int32()), pa.array(spans, span_type)],
            names=["doc_id", "held_out", "score", "predicted", "spans"],
        )

    rows = docs.select("doc_id", F.coalesce(fold() == HELD_OUT_FOLD, F.lit(True)).alias("held_out"), "text")
    return map_batches(rows, fn, "doc_id bigint, held_out boolean, score double, predicted int, spans array<struct<start: bigint, end: bigint, p: double>>")
