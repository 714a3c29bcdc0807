"""Benchmark decontamination by word pairs: window filter, pair keys, exact edit distance.

A benchmark item of n words leaks into a document if some passage is within ``floor(n * (1 - similarity))``
word edits of it. The documents are read once. A window the size of an item is only looked at if it holds
as many of the items' word pairs as any passage so close must hold (the q-gram bound; the pairs are kept
in a filter of fixed size, which can let windows through but never lose one). All windows that pass are
kept, those that overlap as one piece of text. An edit breaks at most two pairs of an item, so of any
``2 * edits + 1`` of its pairs one stands in the piece: the item's rarest ones are its keys. Equal keys
are joined, and each candidate is confirmed by its exact edit distance, so no leak is missed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm.common import map_batches, without, written
from parapet.llm.words import ALNUM, constants, mix64, word_slices

SIMILARITY = 0.8
#: items of fewer words are ordinary phrases and are not looked for
LEAST_WORDS = 5
#: slots of the pair filter: 2**23 bits, one megabyte, whatever the size of the benchmark
FILTER_BITS = 23
#: counters of how many items hold a pair; they only choose among keys
COUNT_BITS = 20

_PAIR = constants(3, 53)


def size_class(n: int) -> int:
    """Window size for items of n words: n itself, in steps of 3 percent beyond 64."""
    return n if n <= 64 else int(round(64 * 1.03 ** round(math.log(n / 64) / math.log(1.03))))


def edits(n: int, similarity: float) -> int:
    """Most edits of an item of n words."""
    return int(math.floor(n * (1 - similarity) + 1e-9))


def sizes_of(w: int) -> list[int]:
    """Item sizes of class w."""
    return [n for n in range(max(1, int(w / 1.04)), int(w * 1.04) + 2) if size_class(n) == w]


def least_pairs(w: int, similarity: float) -> int:
    """Pairs that a window of w words must share with an item of its class within the edits allowed."""
    return max(1, min(max(n, w) - 1 - 2 * (edits(n, similarity) + abs(n - w)) for n in sizes_of(w)))


def pair_hashes(h: np.ndarray) -> np.ndarray:
    return mix64(h[:-1] * _PAIR[0] + h[1:] * _PAIR[1])


def pair_slots(h: np.ndarray) -> np.ndarray:
    """Filter slots of the word pairs of a run of word hashes."""
    return (pair_hashes(h) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def class_slots(slots: np.ndarray, w: int) -> np.ndarray:
    """Slots of the same pairs in the filter of the items of class w."""
    return (mix64(slots.astype(np.uint64) * _PAIR[2] + np.uint64(w)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def item_keys(pairs: np.ndarray, w: int, most: int, counts: np.ndarray) -> np.ndarray:
    """Keys of an item of class w with these pairs: those of the 2 * most + 1 places whose pairs the
    fewest items hold. ``most`` edits cannot break all of them."""
    rare = np.argsort(counts[(pairs >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], kind="stable")
    return window_keys(pairs[rare[: 2 * most + 1]], w)


def window_keys(pairs: np.ndarray, w: int) -> np.ndarray:
    return mix64(np.unique(pairs) * _PAIR[2] + np.uint64(w))


def alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Least word edits between the item and any stretch of the passage, and the first start of such."""
    # a cell holds edits * unit + start, so that the least cell is the least pair
    unit = 1 << 32
    ramp = np.arange(len(passage) + 1) * unit
    row = np.arange(len(passage) + 1)
    for word in item:
        new = row + unit
        new[1:] = np.minimum(new[1:], row[:-1] + (passage != word) * unit)
        row = np.minimum.accumulate(new - ramp) + ramp
    return divmod(int(row.min()), unit)


def edit_distance(item: np.ndarray, passage: np.ndarray) -> int:
    """Least word edits between the item and any stretch of the passage."""
    return alignment(item, passage)[0]


def _item_words(items: DataFrame) -> DataFrame:
    """(item_id, n, words binary) of the items that are long enough."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        n, words = [], []
        for s in word_slices(b.column("text"), ALNUM):
            for d in range(s.last - s.first):
                h = s.hashes[s.doc_off[d] : s.doc_off[d + 1]]
                n.append(len(h))
                words.append(h.tobytes())
        return pa.RecordBatch.from_arrays([b.column("item_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(words, pa.binary())], names=["item_id", "n", "words"])

    return map_batches(items.select("item_id", "text").filter("text is not null"), fn, "item_id bigint, n bigint, words binary").filter(f"n >= {LEAST_WORDS}")


def _filters(items: DataFrame) -> np.ndarray:
    """Bit filter of the items' pairs, alone and by class; its size does not depend on the items."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        slots = [np.zeros(0, np.int64)]
        for n, words in zip(b.column("n").to_pylist(), b.column("words"), strict=True):
            own = pair_slots(np.frombuffer(words.as_buffer(), np.uint64))
            slots += [own, class_slots(own, size_class(n))]
        s = np.unique(np.concatenate(slots))
        return pa.RecordBatch.from_arrays([pa.array(s >> 6), pa.array(np.int64(1) << (s & 63))], names=["word", "bits"])

    rows = map_batches(items, fn, "word bigint, bits bigint").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _counts(items: DataFrame) -> np.ndarray:
    """How many items hold a pair, by the first COUNT_BITS of its hash, up to 255."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.zeros(0, np.int64)]
        own += [np.unique(pair_hashes(np.frombuffer(x.as_buffer(), np.uint64)) >> np.uint64(64 - COUNT_BITS)).astype(np.int64) for x in b.column("words")]
        slots, n = np.unique(np.concatenate(own), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(n)], names=["slot", "n"])

    rows = map_batches(items, fn, "slot bigint, n bigint").groupBy("slot").agg(F.least(F.sum("n"), F.lit(255)).alias("n")).toArrow()
    out = np.zeros(1 << COUNT_BITS, np.uint8)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def _windows(docs: DataFrame, bits: np.ndarray, classes: list[int], similarity: float) -> DataFrame:
    """(doc_id, size, start, words): pieces of text that hold the windows that pass the pair bound, with
    as many words more on each side as an alignment may need; start is the place of the first word."""
    limits = [(w, least_pairs(w, similarity), max(edits(n, similarity) + abs(n - w) for n in sizes_of(w)) + 1) for w in classes]
    packed = np.packbits(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(packed).astype(bool)
        fewest = min((need for _, need, _ in limits), default=0)
        for b in batches:
            ids, size, start, words = [], [], [], []
            for s in word_slices(b.column("text"), ALNUM):
                if len(s.hashes) < 2:
                    continue
                slots = pair_slots(s.hashes)
                hit = seen[slots]
                total = np.concatenate([[0], np.cumsum(hit)])
                lo, hi = s.doc_off[:-1], s.doc_off[1:]
                # pairs of a document are those from its first word to its last but one
                ends = np.minimum(np.maximum(hi - 1, lo), len(hit))
                for d in np.flatnonzero(total[ends] - total[np.minimum(lo, len(hit))] >= fewest):
                    a, e = int(lo[d]), int(hi[d])
                    doc_hit, doc_slots = hit[a : e - 1], slots[a : e - 1]
                    run_all = np.concatenate([[0], np.cumsum(doc_hit)])
                    for w, need, slack in limits:
                        v = min(w, e - a)
                        if v < 2 or (run_all[v - 1 :] - run_all[: len(run_all) - v + 1]).max() < need:
                            continue
                        own = doc_hit & seen[class_slots(doc_slots, w)]
                        c = np.concatenate([[0], np.cumsum(own)])
                        count = c[v - 1 :] - c[: len(c) - v + 1]
                        for first, last in _runs(np.flatnonzero(count >= need), w):
                            ids.append(b.column("doc_id")[s.first + int(d)].as_py())
                            size.append(w)
                            start.append(max(0, first - slack))
                            words.append(s.hashes[max(a, a + first - slack) : min(e, a + last + v + slack)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, size, start, words), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "size", "start", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, size bigint, start bigint, words binary")


def _runs(at: np.ndarray, w: int) -> list[tuple[int, int]]:
    """First and last of each run of the starts ``at``: no gap over w // 4, no more than w starts, and
    every start in one of them."""
    if not len(at):
        return []
    gap = np.r_[True, np.diff(at) > max(1, w // 4)]
    part = (at - at[np.flatnonzero(gap)][np.cumsum(gap) - 1]) // w
    new = np.flatnonzero(gap | np.r_[True, np.diff(part) != 0])
    return list(zip(at[new].tolist(), at[np.r_[new[1:], len(at)] - 1].tolist(), strict=True))


def _keys(table: DataFrame, names: list[str], keys_of: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """One row for each key of each item or piece, given its pairs and its size."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        own = [keys_of(pair_hashes(np.frombuffer(x.as_buffer(), np.uint64)), n) for x, n in zip(b.column("words"), b.column("size").to_pylist(), strict=True)]
        rows = pa.array(np.repeat(np.arange(len(own)), [len(k) for k in own]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), *[b.column(n).take(rows) for n in names]], names=["key", *names])

    kinds = ", ".join(f"{n} bigint" for n in names)
    return map_batches(table, fn, f"key bigint, {kinds}")


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start_word, edits, similarity): for each document and benchmark item that leaks
    into it, the closest passage, the first of several.

    Words are runs of letters and digits, ASCII in lower case. Null or empty texts and texts of fewer
    than LEAST_WORDS words leak nothing; a null doc_id or item_id is reported as it is; rows that repeat
    an id are one document or item. Other columns are ignored; no rows on either side give no rows.
    """
    words = written(_item_words(items))
    classes = sorted({size_class(r["n"]) for r in words.select("n").distinct().collect()})
    spark = docs.sparkSession
    if not classes:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, start_word bigint, edits bigint, similarity double")
    windows = written(_windows(docs, _filters(words), classes, similarity).distinct())
    counts = _counts(words)
    of_windows = _keys(windows, ["doc_id", "size", "start"], window_keys)
    of_items = written(_keys(words.withColumnRenamed("n", "size"), ["item_id"], lambda pairs, n: item_keys(pairs, size_class(n), edits(n, similarity), counts)))
    found = written(of_windows.join(of_items, "key").select("doc_id", "size", "start", "item_id").distinct())

    same = [windows[c].eqNullSafe(found[c]) if c == "doc_id" else windows[c] == found[c] for c in ("size", "start", "doc_id")]
    pairs = found.join(windows, same).select(found["doc_id"], found["item_id"], found["start"], windows["words"].alias("passage"))
    pairs = pairs.join(words.withColumnRenamed("item_id", "_i"), F.col("item_id").eqNullSafe(F.col("_i"))).select("doc_id", "item_id", "start", "passage", "words")

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        far, at, n = [], [], []
        for p, i, first in zip(b.column("passage"), b.column("words"), b.column("start").to_pylist(), strict=True):
            item = np.frombuffer(i.as_buffer(), np.uint64)
            least, start = alignment(item, np.frombuffer(p.as_buffer(), np.uint64))
            far.append(least)
            at.append(first + start)
            n.append(len(item))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("item_id"), *[pa.array(x, pa.int64()) for x in (at, far, n)]], names=["doc_id", "item_id", "start", "edits", "n"])

    near = map_batches(pairs, fn, "doc_id bigint, item_id bigint, start bigint, edits bigint, n bigint").filter(F.col("edits") <= F.floor(F.col("n") * (1 - similarity) + 1e-9))
    best = near.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start", "n")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.start").alias("start_word"), F.col("m.edits").alias("edits"), (1 - F.col("m.edits") / F.col("m.n")).alias("similarity"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that an item leaks into; the columns stay as they are."""
    gone = written(leaks(docs, items).select("doc_id").distinct())
    return without(docs, gone)
