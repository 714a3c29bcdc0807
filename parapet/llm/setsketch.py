"""SetSketch registers: exponentially spaced, truncated minima of a set's hashes.

Register i of a set is floor(1 - log_b(x_i)), where x_i is the least exponential value that hash i gives
an element, truncated to 0..LIMIT. The register of a union is the maximum of the registers, so sketches
merge; equal registers are the likelier the more two sets share.
"""

from __future__ import annotations

import numpy as np

from parapet.llm.words import constants

REGISTERS = 128
BASE = 1.001
RATE = 20.0
LIMIT = (1 << 16) - 1
#: registers of a band fill one 64-bit value
ROWS = 4
BANDS = REGISTERS // ROWS

_MUL = (constants(REGISTERS, 31) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = constants(REGISTERS, 37).astype(np.uint32)
_BAND = constants(BANDS, 41)
_CHUNK = 4096


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a set of 64-bit hashes; an empty set has all registers 0."""
    if len(hashes) == 0:
        return np.zeros(REGISTERS, np.uint16)
    x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), _CHUNK):
        v = np.multiply.outer(_MUL, x[at : at + _CHUNK])
        v += _ADD[:, None]
        np.minimum(least, v.min(axis=1), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    k = np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE))
    return np.clip(k, 0, LIMIT).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per row of ``registers`` and band."""
    packed = np.ascontiguousarray(registers).view(np.uint64).reshape(len(registers), BANDS)
    x = (packed ^ (packed >> np.uint64(29))) * _BAND
    return x ^ (x >> np.uint64(32))


def jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches of sets of known sizes.

    With u and v the shares of the sizes, register a exceeds b with probability p(u - v J), falls below
    it with p(v - u J) and equals it otherwise, where p(x) = -log_b(1 - x (b - 1) / b).
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u

    def value(j: np.ndarray) -> np.ndarray:
        p, q = (-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE) for x in (u - v * j, v - u * j))
        e = 1e-12
        return more * np.log(p + e) + less * np.log(q + e) + same * np.log(np.maximum(1 - p - q, 0) + e)

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = value(x) < value(y)
        lo, hi = np.where(left, x, lo), np.where(left, hi, y)
    return (lo + hi) / 2
