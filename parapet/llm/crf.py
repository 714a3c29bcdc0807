"""Linear-chain conditional random field over words, vectorised with numpy.

A word's emission is the sum of the weights of its hashed features (the word, its affixes, its byte
n-grams); transitions are learned. Training maximises the likelihood of labelled word sequences with
AdaGrad; forward-backward gives the marginals, for many sequences at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from parapet.llm.words import ALNUM, constants, mix64, text_buffers, word_slices

BITS = 17
AFFIXES = 6
GRAMS = (2, 3)
#: words whose emissions are held at once before forward-backward runs over them
HELD_WORDS = 600_000

_C = constants(8, 23)


class Model(NamedTuple):
    weights: np.ndarray  # 2**BITS x labels
    transitions: np.ndarray  # labels x labels
    start: np.ndarray


class Chars(NamedTuple):
    """Bytes of words, each word between two boundary marks, and the offsets of the words."""

    b: np.ndarray
    off: np.ndarray


def word_chars(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Chars:
    """Lower-cased bytes of words (ASCII and Latin-1 letters) with a boundary on each side."""
    lens = ends - starts
    off = np.concatenate([[0], np.cumsum(lens + 2)])
    b = np.zeros(int(off[-1]), np.uint64)
    inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    src = raw[inner + np.repeat(starts, lens)].astype(np.uint64)
    src += (np.uint64(32)) * ((src >= 65) & (src <= 90))
    if len(src):
        wide = np.zeros(len(src), bool)
        wide[1:] = src[:-1] == 0xC3
        src += np.uint64(32) * (wide & (src >= 0x80) & (src <= 0x9E) & (src != 0x97))
    b[inner + np.repeat(off[:-1] + 1, lens)] = src
    return Chars(b + np.uint64(1), off)


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix64(h + np.array([kind], np.uint64) * _C[7]) >> np.uint64(64 - BITS)).astype(np.int64)


def features(c: Chars) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, word of each slot) by kind of feature; the words of one kind are in order."""
    b, off = c.b, c.off
    lens = np.diff(off)
    words = np.arange(len(lens))
    owner = np.repeat(words, lens)
    weight = constants(int(lens.max(initial=1)), 29)[np.arange(len(b)) - np.repeat(off[:-1], lens)]
    yield _slot(np.add.reduceat(b * weight, off[:-1]), 1), words
    pre, suf = np.zeros(len(lens), np.uint64), np.zeros(len(lens), np.uint64)
    for k in range(1, AFFIXES + 1):
        ok = lens - 2 >= k
        if not ok.any():
            break
        at, end = off[:-1][ok] + k, off[1:][ok] - 1 - k
        pre[ok], suf[ok] = pre[ok] * _C[0] + b[at], suf[ok] * _C[0] + b[end]
        if k > 1:
            yield _slot(pre[ok], 2 * k), words[ok]
            yield _slot(suf[ok], 2 * k + 1), words[ok]
    for k in GRAMS:
        if len(b) < k:
            continue
        h = sum((b[j : len(b) - k + 1 + j] * _C[j] for j in range(k)), np.zeros(len(b) - k + 1, np.uint64))
        ok = owner[: len(b) - k + 1] == owner[k - 1 :]
        yield _slot(h[ok], 20 + k), owner[: len(b) - k + 1][ok]


def emissions(c: Chars, weights: np.ndarray) -> np.ndarray:
    n = len(c.off) - 1
    out = np.zeros((n, weights.shape[1]), np.float32)
    for slots, words in features(c):
        if not len(words):
            continue
        first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        out[words[first]] += weights[slots] if len(first) == len(words) else np.add.reduceat(weights[slots], first)
    return out


def forward_backward(e: np.ndarray, off: np.ndarray, m: Model) -> np.ndarray:
    """Marginals of every word; sequences are e[off[i]:off[i+1]]. Long and short sequences run side by
    side: step t works on those with more than t words."""
    lens = np.diff(off)
    order = np.argsort(-lens, kind="stable")
    begin, lens = off[:-1][order], lens[order]
    longest = int(lens[0]) if len(lens) else 0
    active = np.searchsorted(-lens, -np.arange(longest), side="left")  # sequences longer than t
    e -= e.max(axis=1, keepdims=True)
    psi = np.exp(e, out=e)
    t = np.exp(m.transitions - m.transitions.max()).astype(np.float32)
    alpha = np.empty_like(psi)
    for step in range(longest):
        at = begin[: active[step]] + step
        a = psi[at]
        a *= np.exp(m.start - m.start.max()).astype(np.float32) if step == 0 else alpha[at - 1] @ t
        a += np.float32(1e-30)
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    beta = np.ones((len(lens), e.shape[1]), np.float32)
    tt = np.ascontiguousarray(t.T)
    for step in range(longest - 2, -1, -1):
        k = active[step + 1]
        at = begin[:k] + step
        b = (psi[at + 1] * beta[:k]) @ tt
        b += np.float32(1e-30)
        b /= b.sum(axis=1, keepdims=True)
        beta[:k] = b
        alpha[at] *= b
    alpha /= alpha.sum(axis=1, keepdims=True)
    return alpha


def train(texts: Chars, off: np.ndarray, labels: np.ndarray, n_labels: int, epochs: int = 6, batch: int = 64, rate: float = 0.3, l2: float = 1e-6, seed: int = 5) -> Model:
    """Fit on sequences of words: words off[i]:off[i+1] of ``texts`` with their labels."""
    kinds = list(features(texts))
    words, slots = np.concatenate([w for _, w in kinds]), np.concatenate([s for s, _ in kinds])
    order = np.argsort(words, kind="stable")
    slots = slots[order]
    f_off = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=len(texts.off) - 1))])
    rng = np.random.default_rng(seed)
    w = np.zeros((1 << BITS, n_labels), np.float32)
    tr, st = np.zeros((n_labels, n_labels), np.float32), np.zeros(n_labels, np.float32)
    gw, gt, gs = np.full_like(w, 1e-6), np.full_like(tr, 1e-6), np.full_like(st, 1e-6)
    eye = np.eye(n_labels, dtype=np.float32)
    for _ in range(epochs):
        turn = rng.permutation(len(off) - 1)
        for b in range(0, len(turn), batch):
            seqs = turn[b : b + batch]
            seqs = seqs[off[seqs + 1] > off[seqs]]
            if not len(seqs):
                continue
            idx = np.concatenate([np.arange(off[s], off[s + 1]) for s in seqs])
            sub = np.concatenate([[0], np.cumsum(off[seqs + 1] - off[seqs])])
            n_f = f_off[idx + 1] - f_off[idx]
            fs = slots[np.repeat(f_off[idx] - (np.cumsum(n_f) - n_f), n_f) + np.arange(n_f.sum())]
            owner = np.repeat(np.arange(len(idx)), n_f)
            e = np.add.reduceat(w[fs], np.cumsum(n_f) - n_f)
            y = eye[labels[idx]]
            gamma, pair = _expected(e, sub, Model(w, tr, st))
            d = gamma - y
            g = np.stack([np.bincount(fs, d[owner, k], 1 << BITS) for k in range(n_labels)], axis=1).astype(np.float32)
            g += l2 * w
            inner = np.ones(len(idx), bool)
            inner[sub[1:] - 1] = False
            inner = np.flatnonzero(inner)
            seen = np.zeros_like(tr)
            np.add.at(seen, (labels[idx][inner], labels[idx][inner + 1]), 1)
            for p, grad, acc in ((w, g, gw), (tr, pair - seen + 1e-3 * tr, gt), (st, d[sub[:-1]].sum(axis=0) + 1e-3 * st, gs)):
                acc += grad * grad
                p -= rate * grad / np.sqrt(acc)
    return Model(w, tr, st)


def _expected(e: np.ndarray, off: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and the expected number of each transition."""
    lens = np.diff(off)
    n, k, longest = len(lens), e.shape[1], int(lens.max())
    psi = np.ones((longest, n, k), np.float64)
    live = np.arange(longest)[:, None] < lens[None, :]
    rows = off[:-1][None, :] + np.arange(longest)[:, None]
    x = e - e.max(axis=1, keepdims=True)
    psi[live] = np.exp(x[rows[live]])
    t = np.exp(m.transitions.astype(np.float64))
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    alpha[0] = psi[0] * np.exp(m.start)
    alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
    for i in range(1, longest):
        a = psi[i] * (alpha[i - 1] @ t)
        a /= a.sum(axis=1, keepdims=True)
        alpha[i] = np.where(live[i][:, None], a, alpha[i - 1])
    for i in range(longest - 2, -1, -1):
        b = (psi[i + 1] * beta[i + 1]) @ t.T
        b /= b.sum(axis=1, keepdims=True)
        beta[i] = np.where(live[i + 1][:, None], b, 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    pair = np.zeros((k, k))
    for i in range(longest - 1):
        if (ok := live[i + 1]).any():
            j = alpha[i][ok][:, :, None] * t[None] * (psi[i + 1] * beta[i + 1])[ok][:, None, :]
            pair += (j / j.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    out = np.empty((len(e), k), np.float32)
    out[rows[live]] = gamma[live]
    return out, pair.astype(np.float32)


class Tagged(NamedTuple):
    """Marginals of the words of documents first..last-1 of a batch."""

    first: int
    last: int
    marginals: np.ndarray
    doc_off: np.ndarray
    starts: np.ndarray  # byte offset inside the column's data
    ends: np.ndarray


def tag(col: pa.Array, m: Model) -> Iterator[Tagged]:
    """Forward-backward over the whole text of every document of a column."""
    raw, _ = text_buffers(col)
    held: list[tuple] = []
    count = 0

    def out() -> Tagged:
        e = np.concatenate([h[1] for h in held])
        sizes = np.concatenate([np.diff(h[0].doc_off) for h in held])
        off = np.concatenate([[0], np.cumsum(sizes)])
        starts, ends = (np.concatenate([getattr(h[0], n) for h in held]) for n in ("starts", "ends"))
        first, last = held[0][0].first, held[-1][0].last
        held.clear()
        return Tagged(first, last, forward_backward(e, off, m), off, starts, ends)

    for s in word_slices(col, ALNUM):
        if len(s.hashes):
            _, at, inverse = np.unique(s.hashes, return_index=True, return_inverse=True)
            e = emissions(word_chars(raw, s.starts[at], s.ends[at]), m.weights)[inverse]
        else:
            e = np.zeros((0, m.weights.shape[1]), np.float32)
        held.append((s, e))
        count += len(e)
        if count >= HELD_WORDS:
            count = 0
            yield out()
    if held:
        yield out()
