"""Vectorised tokenising of Arrow text columns.

Texts stay UTF-8 bytes: all delimiters used here are ASCII, so a word is a run of bytes outside the
delimiter set, and every byte from 0x80 on belongs to a word. Work is done in slices of a few MB so
that a batch of long documents never needs more than a few times a slice in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_SPACE = np.ones(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: bytes that form words when only white space (0x20, 0x09-0x0D) separates
NOT_SPACE = _SPACE

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[0x30:0x3A] = True
_ALNUM[0x61:0x7B] = True
_ALNUM[0x41:0x5B] = True
_ALNUM[0x80:] = True
#: bytes that form words when everything ASCII but letters and digits separates
ALNUM = _ALNUM


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers; the first k do not depend on n."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 2654435761)
    return mix64(x) | np.uint64(1)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null counts as empty."""
    if pa.types.is_large_string(col.type):
        width = np.int64
    else:
        col, width = col.cast(pa.string()), np.int32
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if col.null_count:
        # the range of a null may hold bytes: rebuild without it
        return text_buffers(col.fill_null(""))
    return raw, offs


class Words(NamedTuple):
    """Words of documents first..last-1 of a batch: byte ranges, 64-bit hashes and word offsets."""

    first: int
    last: int
    hashes: np.ndarray  # uint64 per word
    starts: np.ndarray  # byte offset in the column's data
    ends: np.ndarray
    doc_off: np.ndarray  # last - first + 1 word offsets


def word_slices(col: pa.Array, is_word: np.ndarray, lower: bool = True, slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of a string column, slice by slice; a document is never split between slices."""
    raw, offs = text_buffers(col)
    n, i = len(col), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + slice_bytes, side="right")) - 1)
        yield _words(raw, offs[i : j + 1], i, j, is_word, lower)
        i = j


def _words(raw: np.ndarray, offs: np.ndarray, first: int, last: int, is_word: np.ndarray, lower: bool) -> Words:
    base = int(offs[0])
    b = raw[base : int(offs[-1])]
    w = is_word[b]
    before = np.empty_like(w)
    after = np.empty_like(w)
    if len(w):
        before[0], before[1:] = False, w[:-1]
        after[-1], after[:-1] = False, w[1:]
        rel = offs - base
        s = rel[:-1]
        before[s[s < len(w)]] = False
        e = rel[1:] - 1
        after[e[e >= 0]] = False
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    lens = ends - starts
    h = np.zeros(0, np.uint64)
    if len(starts):
        at = np.concatenate([[0], np.cumsum(lens)])
        chars = (_LOWER[b] if lower else b)[w]
        pos = np.arange(at[-1]) - np.repeat(at[:-1], lens)
        table = constants(int(lens.max()), 7)
        vals = table[pos]
        vals *= chars.astype(np.uint64) + np.uint64(1)
        h = mix64(np.add.reduceat(vals, at[:-1]))
    return Words(first, last, h, starts + base, ends + base, np.searchsorted(starts, offs - base))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of k consecutive word hashes; fewer words give one hash of the whole run."""
    if len(h) == 0:
        return h
    k = min(k, len(h))
    c = constants(k + 1, 11)
    out = np.full(len(h) - k + 1, c[k], dtype=np.uint64)
    for j in range(k):
        out += h[j : len(h) - k + 1 + j] * c[j]
    return mix64(out)
