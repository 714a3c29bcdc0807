"""Phrase collocations from a weighted de Bruijn graph of word runs.

Nodes are runs of four words, edges the five-word runs between overlapping nodes, weighted by how often
they occur. Only edges are counted, and the tail (up to four words) of each run of words; all shorter
counts follow from the flow: a phrase occurs as often as it is continued by one more word, plus as often as
it ends a run. A phrase whose whole flow passes through one longer phrase is inside a unary path and is
represented by that one.

Runs are pieces of text, cut where no phrase with the least count can lie: at words, and between pairs of
words, that are too rare. That is decided by bit tables of a fixed size over hashes, which let some rare
pairs pass and never stop a frequent one, so the counts stay exact. With a very large vocabulary the
tables let all through; then more edges are counted and nothing is lost.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parapet.llm.common import ID_BITS, id_filter, map_batches, written
from parapet.llm.words import mix64, text_buffers, word_slices

#: words of an edge; nodes have one less
LONGEST = 5
LEAST = 100
FIRST = 2000
UNKNOWN = "und"

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_SEPARATOR
_WORD[[0x20, 0x09]] = False
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PAIR = np.uint64(0x9FB21C651E98DF25)


class Run(NamedTuple):
    """Words of some documents: hashes that include the language, byte ranges, and True where the next word
    is in the same piece."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    joined: np.ndarray
    lang: np.ndarray
    raw: np.ndarray


def _runs(b: pa.RecordBatch) -> Iterator[tuple[Run, list[str]]]:
    langs = b.column("lang").dictionary_encode()
    names = langs.dictionary.to_pylist()
    code = langs.indices.to_numpy()
    seed = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)
    col = b.column("text")
    raw, _ = text_buffers(col)
    for w in word_slices(col, _WORD):
        n = len(w.starts)
        if not n:
            continue
        lang = np.repeat(code[w.first : w.last], np.diff(w.doc_off))
        lo, hi = int(w.starts[0]), int(w.ends[-1])
        piece = np.cumsum(_SEPARATOR[raw[lo:hi]])[w.starts - lo]
        joined = np.zeros(n, bool)
        joined[:-1] = piece[1:] == piece[:-1]
        last = w.doc_off[1:] - 1
        joined[last[last >= 0]] = False
        yield Run(mix64(w.hashes + seed[lang]), w.starts, w.ends, joined, lang, raw), names


def _pairs(r: Run) -> np.ndarray:
    """Hash of each word with the next one, also where they are not joined."""
    return mix64(r.hashes * _PAIR + np.append(r.hashes[1:], np.uint64(0)))


def _keys(hashes: np.ndarray) -> np.ndarray:
    """The upper half of hashes, as counted: two rare ones that share it may pass together."""
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    s = (mix64(_keys(hashes).astype(np.int64).view(np.uint64)) >> np.uint64(64 - ID_BITS)).astype(np.int64)
    return ((bits[s >> 3] >> (s & 7)) & 1).astype(bool)


def _counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(_keys(hashes), return_counts=True)


def _count_words(b: pa.RecordBatch) -> pa.RecordBatch:
    """Counts by hash, and by language where there is no hash."""
    keys, counts, langs = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], Counter()
    for r, names in _runs(b):
        k, n = _counted(r.hashes)
        keys.append(k)
        counts.append(n)
        for i, m in enumerate(np.bincount(r.lang, minlength=len(names)).tolist()):
            langs[names[i]] += m
    key, n = np.concatenate(keys), np.concatenate(counts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None] * len(key) + list(langs), pa.string()),
            pa.concat_arrays([pa.array(key), pa.nulls(len(langs), pa.int32())]),
            pa.array(np.concatenate([n, np.fromiter(langs.values(), np.int64, len(langs))])),
        ],
        names=["lang", "key", "n"],
    )


#: ranges of keys in which pairs are counted: what one range holds of them fits a task many times over
RANGES = 1024


def _pair_blocks(words: np.ndarray) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Counts of the pairs of some documents, as one block for each range of keys: the steps between the
    sorted keys, then the counts. Most pairs are rare, and a row for each costs four times as much to shuffle."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = [np.zeros(0, np.uint32)]
        for r, _ in _runs(b):
            ok = _holds(words, r.hashes)
            both = ok & np.append(ok[1:], False) & r.joined
            keys.append((_pairs(r)[both] >> np.uint64(32)).astype(np.uint32))
        k, n = np.unique(np.concatenate(keys), return_counts=True)
        part = (k >> np.uint32(22)).astype(np.int32)
        found, at = np.unique(part, return_index=True)
        blocks = [_block(x, m) for x, m in zip(np.split(k, at[1:]), np.split(n, at[1:]), strict=True)] if len(k) else []
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blocks, pa.binary())], names=["part", "block"])

    return fn


def _block(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys of one range with their counts; the bytes of equal weight stand together."""
    steps = np.diff(keys, prepend=keys[:1] & np.uint32(0xFFC00000)).astype("<u4")
    return b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes() for x in (steps, n.astype("<u4")))


def _unblock(block: bytes, part: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(block, np.uint8).reshape(2, 4, -1)
    steps, n = (np.ascontiguousarray(x.T).view("<u4").ravel() for x in planes)
    return np.cumsum(steps, dtype=np.uint32) + np.uint32(part << 22), n


def _frequent_pairs(blocks: DataFrame, least: int) -> DataFrame:
    """(key) of the pairs with the least count."""

    def fn(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        rows = [_unblock(x.as_py(), part) for x in t.column("block")]
        k, at = np.unique(np.concatenate([x for x, _ in rows]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([m for _, m in rows]), minlength=len(k))
        return pa.table({"key": pa.array(k[n >= least].view(np.int32).astype(np.int64))})

    return blocks.groupBy("part").applyInArrow(fn, "key bigint")


def _count_edges(words: np.ndarray, pairs: np.ndarray) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Edges (runs of LONGEST words) and tails of runs (fewer words), as text."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter = Counter()
        for r, names in _runs(b):
            ok = _holds(words, r.hashes)
            joined = ok & np.append(ok[1:], False) & r.joined
            joined &= _holds(pairs, _pairs(r))
            at = np.arange(len(ok))
            begins = ok & ~np.append(False, joined[:-1])
            length = at - np.maximum.accumulate(np.where(begins, at, 0)) + 1
            edge = np.flatnonzero(ok & (length >= LONGEST))
            tail = np.flatnonzero(ok & ~joined)
            size = np.concatenate([np.full(len(edge), LONGEST), np.minimum(length[tail], LONGEST - 1)])
            last = np.concatenate([edge, tail])
            lo = int(r.starts[0])
            text = r.raw[lo : int(r.ends[-1])].tobytes().translate(_LOWER)
            need = np.zeros(len(ok) + 1, np.int64)
            np.add.at(need, last - size + 1, 1)
            np.add.at(need, last + 1, -1)
            used = np.cumsum(need[:-1]) > 0
            word: list[bytes | None] = [None] * len(ok)
            for i, s, e in zip(np.flatnonzero(used).tolist(), (r.starts[used] - lo).tolist(), (r.ends[used] - lo).tolist()):
                word[i] = text[s:e]
            for lang, i, k in zip(r.lang[last].tolist(), last.tolist(), size.tolist()):
                found[names[lang], k, b" ".join(word[i - k + 1 : i + 1])] += 1
        lang, k, gram = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(k, pa.int32()), pa.array(gram, pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())],
            names=["lang", "k", "gram", "f"],
        )

    return fn


def prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text.alias("text"))


def edges(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, n): all words of a language; (lang, k, gram, f): edges (k = LONGEST) and tails of runs."""
    docs = prepared(docs)
    counts = map_batches(docs, _count_words, "lang string, key int, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counts = written(counts.filter((F.col("n") >= least) | F.col("key").isNull()))
    words = id_filter(counts.filter("key is not null").select(F.col("key").cast("bigint")))
    pairs = id_filter(_frequent_pairs(map_batches(docs, _pair_blocks(words), "part int, block binary"), least))
    found = map_batches(docs, _count_edges(words, pairs), "lang string, k int, gram string, f bigint")
    return counts.filter("key is null").select("lang", "n"), written(found.groupBy("lang", "k", "gram").agg(F.sum("f").alias("f")))


def flows(graph: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, k, gram, f) of all phrases of 1 to LONGEST words with the least count, from edges and tails."""
    level = graph.filter(F.col("k") == LONGEST).select("lang", "gram", "f")
    levels = [level.withColumn("k", F.lit(LONGEST))]
    tails = graph.filter(F.col("k") < LONGEST)
    for k in range(LONGEST - 1, 0, -1):
        onward = level.select("lang", F.substring_index("gram", " ", k).alias("gram"), "f")
        ending = tails.filter(F.col("k") >= k).select("lang", F.substring_index("gram", " ", -k).alias("gram"), "f")
        level = onward.unionByName(ending).groupBy("lang", "gram").agg(F.sum("f").alias("f"))
        levels.append(level.withColumn("k", F.lit(k)))
    return reduce(DataFrame.unionByName, [x.filter(F.col("f") >= least) for x in levels]).select("lang", "k", "gram", "f")


def compacted(phrases: DataFrame, percent: int = 100) -> DataFrame:
    """Phrases of ``phrases`` (lang, k, gram, f) that lie in no longer one with ``percent`` of their count:
    at 100, phrases inside a unary path go, whose whole flow passes through a longer phrase."""
    spans = ", ".join(f"struct({i} as i, {m} as m)" for m in range(2, LONGEST) for i in range(LONGEST - m + 1))
    inner = phrases.filter("k > 2").select("lang", "k", F.split("gram", " ").alias("w"), F.col("f").alias("longer"), F.explode(F.expr(f"array({spans})")).alias("s"))
    inner = inner.filter("s.m < k and s.i + s.m <= k").select("lang", F.expr("array_join(slice(w, s.i + 1, s.m), ' ')").alias("gram"), "longer")
    most = inner.groupBy("lang", "gram").agg(F.max("longer").alias("longer"))
    return phrases.filter("k > 1").join(most, ["lang", "gram"], "left").filter(f"longer is null or 100 * longer < {percent} * f").drop("longer")


def scored(phrases: DataFrame, frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """``phrases`` with the counts l and r of the two parts of their lowest-scoring cut, and its score
    floor(1000 * f * n / (l * r)); ties go to the first cut."""
    cuts = phrases.select("lang", "gram", "f", F.col("k").alias("words"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", F.expr("substring_index(gram, ' ', cut)").alias("first"), F.expr("substring_index(gram, ' ', cut - words)").alias("rest"))
    part = frequent.select("lang", "gram", "f")
    left = part.select("lang", F.col("gram").alias("first"), F.col("f").alias("l"))
    right = part.select("lang", F.col("gram").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    whole = "cast({} as decimal(19, 0))".format
    score = F.expr(f"({whole('1000 * f')} * {whole('n')}) div ({whole('l')} * {whole('r')})")
    low = both.groupBy("lang", "gram").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r", "f", "n")).alias("c"))
    return low.select("lang", F.col("gram").alias("phrase"), F.col("c.f").alias("a"), "c.l", "c.r", "c.n", "c.score")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, percent: int = 100) -> DataFrame:
    """Each language's ``first`` phrases of 2 to LONGEST words by score: (lang, rank, phrase, a, l, r, n,
    score).

    Null texts count as empty and a null lang as "und"; rows of one text count each; other columns play no
    part. A table without such phrases gives no rows.
    """
    totals, graph = edges(docs, least)
    frequent = written(flows(graph, least))
    found = scored(compacted(frequent, percent), frequent, totals)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # first within shares of a language, so that no task sorts all of one
    share = Window.partitionBy("lang", F.expr(f"pmod(xxhash64(phrase), {shares})")).orderBy(*order)
    some = found.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def paths(frequent: DataFrame) -> DataFrame:
    """(lang, words, phrase, f): edges of ``flows`` joined along unary paths into their longest phrases.

    An edge goes on to the next where the node between has the count of both: then no other edge and no
    run begins or ends there. Each round doubles the stretches joined; a path that is a circle cannot be,
    because every run has an end.
    """
    node = frequent.filter(F.col("k") == LONGEST - 1).select("lang", F.col("gram").alias("node"), "f")
    cut = LONGEST - 1
    edge = frequent.filter(F.col("k") == LONGEST).select(
        "lang", "f", "gram", F.substring_index("gram", " ", cut).alias("src"), F.substring_index("gram", " ", -cut).alias("node")
    )
    ahead = edge.select("lang", "f", F.col("gram").alias("to"), F.col("src").alias("node"))
    steps = edge.join(node, ["lang", "node", "f"]).join(ahead, ["lang", "node", "f"]).select("lang", "gram", "to")
    inner = steps.select("lang", F.col("to").alias("gram"))
    at = written(edge.join(steps, ["lang", "gram"], "left").select("lang", "gram", "f", F.col("gram").alias("phrase"), "to"))
    while not at.filter("to is not null").isEmpty():
        onward = at.select("lang", F.col("gram").alias("to"), F.col("phrase").alias("more"), F.col("to").alias("then"))
        moved = at.join(onward, ["lang", "to"], "left")
        more = F.expr("substring(more, char_length(to) + 1)")
        last = F.substring_index("to", " ", -1)
        phrase = F.when(F.col("to").isNull(), F.col("phrase")).otherwise(F.concat("phrase", F.lit(" "), last, more))
        at = written(moved.select("lang", "gram", "f", phrase.alias("phrase"), F.col("then").alias("to")))
    heads = at.join(inner, ["lang", "gram"], "left_anti")
    return heads.select("lang", F.size(F.split("phrase", " ")).alias("words"), "phrase", "f")
