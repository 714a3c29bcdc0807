"""Byte-level BPE with forced boundaries: encode and decode whole texts with a given vocabulary file.

A pair of bytes that stands inside no token of the vocabulary can never be merged over, so every place of
such a pair is a certain cut; so is every place where the pre-tokeniser separates. The fragments between
cuts are encoded independently, each distinct one once as long as it stays in the bounded cache of a task,
and their ids are concatenated. Merges inside a fragment go by rank, leftmost first, with a heap once a
fragment is long, so a stretch without any cut costs n log n.

The vocabulary (its size is that of the file) goes to the tasks with the function. Documents are
independent: no shuffle, and a hot source or a group of copies needs no care. A long text is worked on in
pieces that end before white space, where no token crosses.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm.common import map_batches

#: characters of text that are cut and encoded at once
PIECE = 1 << 19
#: fragments that a task remembers
CACHED = 1 << 18
#: fragments longer than this are merged with a heap
SHORT = 64
#: rank of a pair that is no merge
UNMERGED = np.int64(1) << 40

SPACE, LETTER, NUMBER, OTHER, NONE = range(5)
#: fixed values: endings that are tokens of their own behind an apostrophe
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


@cache
def _byte_of_char() -> dict[str, int]:
    """The characters by which the file writes bytes: printable ones stand for themselves, the others for
    the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _bytes(token: str) -> bytes:
    table = _byte_of_char()
    return bytes(table[c] for c in token)


@cache
def char_classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other.

    Code points that one Unicode version lists as unassigned and another as letters or numbers are asked of
    the library's pre-tokeniser, because its version is its own.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    whole = "".join(map(chr, range(0xD800))) + "" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, whole):
            out[m.start() : m.end()] = kind
    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for kind, mate in ((LETTER, "a"), (NUMBER, "1")):
        for i in np.flatnonzero(out == kind).tolist():
            c = chr(i)
            if unicodedata.category(c) == "Cn" and len(split(mate + c)) > 1:
                out[i] = OTHER
    return out


class Codec:
    """Vocabulary, merges and cuts of a tokenizer file (byte-level BPE, model type BPE)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k.encode(): v for k, v in special.items()}
        ids = {t: i for t, i in vocab.items() if t not in special}
        self.tokens: list[bytes] = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, i in ids.items():
            self.tokens[i] = _bytes(t)
        for t, i in special.items():
            self.tokens[i] = t.encode()
        self.first = [0] * 256
        for c, b in _byte_of_char().items():
            self.first[b] = vocab[c]
        #: (left id, right id): (rank, id of both)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.first_of = np.array(self.first, np.int64)
        keys = np.array([a * len(self.tokens) + b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        #: id made by the merge of a rank
        self.made = np.zeros(len(merges), np.int64)
        for rank, new in self.merge.values():
            self.made[rank] = new
        inside = np.zeros((256, 256), bool)
        for t in ids:
            b = np.frombuffer(_bytes(t), np.uint8)
            inside[b[:-1], b[1:]] = True
        #: True where a pair of bytes, as 256 * left + right, stands inside no token
        self.cut = ~inside.ravel()
        self.classes = char_classes()
        self.known: dict[bytes, tuple[int, ...]] = {}

    # --- fragments ---

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids; UNMERGED where there is none."""
        key = left.astype(np.int64) * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], UNMERGED)

    def fragments(self, texts: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each fragment: merges by rank, leftmost first.

        All fragments go in step: in each round every one of them has its best pair merged, and those
        without a pair leave. Long ones are merged one by one with a heap.
        """
        out: list[tuple[int, ...]] = [()] * len(texts)
        short = []
        for i, t in enumerate(texts):
            if len(t) > SHORT:
                out[i] = tuple(self._long([self.first[x] for x in t]))
            else:
                short.append(i)
        owner = np.array(short, np.int64)
        sizes = np.array([len(texts[i]) for i in short], np.int64)
        ids = self.first_of[np.frombuffer(b"".join(texts[i] for i in short), np.uint8)]
        ranks = np.full(len(ids), UNMERGED)
        ranks[:-1] = self._pairs(ids[:-1], ids[1:])
        if len(sizes):
            ranks[np.cumsum(sizes) - 1] = UNMERGED
        while len(owner):
            least = np.minimum.reduceat(ranks, np.cumsum(sizes) - sizes)
            going = least < UNMERGED
            if not going.all():
                stay = np.repeat(going, sizes)
                left, done = ids[~stay].tolist(), 0
                for k, m in zip(owner[~going].tolist(), sizes[~going].tolist()):
                    out[k] = tuple(left[done : done + m])
                    done += m
                ids, ranks, owner, sizes, least = ids[stay], ranks[stay], owner[going], sizes[going], least[going]
                if not len(owner):
                    break
            best = np.flatnonzero(ranks == np.repeat(least, sizes))
            of = np.repeat(np.arange(len(owner)), sizes)
            lead = np.ones(len(best), bool)
            lead[1:] = of[best[1:]] != of[best[:-1]]
            at = best[lead]
            ids[at] = self.made[ranks[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, ranks, at = ids[keep], ranks[keep], at - np.arange(len(at))
            sizes = sizes - 1
            ends = np.cumsum(sizes) - 1
            ranks[at] = UNMERGED
            right = at[at < ends]
            ranks[right] = self._pairs(ids[right], ids[right + 1])
            before = at[at > ends - sizes + 1] - 1
            ranks[before] = self._pairs(ids[before], ids[before + 1])
        return out

    def _long(self, ids: list[int]) -> list[int]:
        merge, n = self.merge, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*f, i) for i in range(n - 1) if (f := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, new, i = heapq.heappop(heap)
            j = after[i]
            # a pair whose parts have changed since is not merged any more
            if ids[i] < 0 or j >= n or merge.get((ids[i], ids[j])) != (rank, new):
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if f := merge.get((new, ids[k])):
                    heapq.heappush(heap, (*f, i))
            if (h := before[i]) >= 0 and (f := merge.get((ids[h], new))):
                heapq.heappush(heap, (*f, h))
        return [i for i in ids if i >= 0]

    # --- cuts ---

    def _starts(self, chars: np.ndarray, part_of: np.ndarray) -> np.ndarray:
        """True at characters where the pre-tokeniser starts a token; parts are texts of their own."""
        n = len(chars)
        kind = self.classes[chars]
        first = np.ones(n, bool)
        first[1:] = part_of[1:] != part_of[:-1]
        before, behind = np.full(n, NONE, np.uint8), np.full(n, SPACE, np.uint8)
        before[1:][~first[1:]] = kind[:-1][~first[1:]]
        behind[:-1][~first[1:]] = kind[1:][~first[1:]]
        blank = np.zeros(n, bool)
        blank[1:] = (chars[:-1] == 0x20) & ~first[1:]
        space = kind == SPACE
        # a blank goes with the run behind it; the last of several spaces before a run stands apart
        start = first | (~space & (before != kind) & ~blank) | (space & ((before != SPACE) | (behind != SPACE)))
        at = np.flatnonzero((chars == 0x27) & start)
        for end in ENDINGS:
            k = len(end)
            ok = at[at + k < n]
            ok = ok[part_of[ok + k] == part_of[ok]]
            for j, c in enumerate(end, 1):
                ok = ok[chars[ok + j] == ord(c)]
            start[ok + 1] = False
            ok = ok[ok + k + 1 < n]
            start[ok + k + 1] = True
        return start

    def encode_parts(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of each part, as unsigned 32-bit integers; a part that is a special token has its id."""
        data = "".join(parts).encode()
        if not data:
            return [np.zeros(0, np.uint32) for _ in parts]
        chars = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(p) for p in parts])
        part_of = np.repeat(np.arange(len(parts)), sizes)
        raw = np.frombuffer(data, np.uint8)
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = self.cut[(raw[:-1].astype(np.uint16) << 8) | raw[1:]]
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        cut[lead[self._starts(chars, part_of)]] = True
        bounds = np.append(lead, len(raw))[np.concatenate([[0], np.cumsum(sizes)])]
        for i, p in enumerate(parts):
            if p.encode() in self.special:
                cut[bounds[i] + 1 : bounds[i + 1]] = False
        cut[bounds] = True
        at = np.flatnonzero(cut)
        ends = at.tolist()
        known = self.known
        pieces = [data[a:b] for a, b in zip(ends, ends[1:])]
        if len(known) > CACHED or not known:
            known.clear()
            known.update((k, (v,)) for k, v in self.special.items())
        new = list(set(pieces).difference(known))
        known.update(zip(new, self.fragments(new)))
        found = [known[p] for p in pieces]
        flat = np.fromiter(chain.from_iterable(found), np.uint32)
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        where = upto[np.searchsorted(at, bounds)]
        return [flat[a:b] for a, b in zip(where[:-1], where[1:])]

    # --- whole texts ---

    def parts(self, text: str) -> Iterator[str]:
        """A text in parts of about PIECE characters: at special tokens, and before white space."""
        names = [k.decode() for k in self.special]
        cutter = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        for part in cutter.split(text) if cutter else [text]:
            done = 0
            while len(part) - done > PIECE:
                m = _GAP.search(part, done + PIECE)
                if m is None:
                    break
                yield part[done : m.start() + 1]
                done = m.start() + 1
            yield part[done:]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []

        def flush() -> None:
            for (i, _), ids in zip(held, self.encode_parts([p for _, p in held])):
                out[i].append(ids)
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            for p in self.parts(text):
                held.append((i, p))
                size += len(p)
                if size >= PIECE:
                    flush()
                    size = 0
        flush()
        return [np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


#: a character that is not white space, with white space behind it
_GAP = regex.compile(r"\S(?=[ \t\n\r])")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row: ``ids`` are the packed token ids, 32-bit unsigned little-endian.

    A null text counts as empty and gives no ids; a null doc_id stays null; repeated rows stay.
    """
    codec = Codec(path)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec.encode([t or "" for t in b.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], names=["doc_id", "ids"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, fn, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of rows of packed ids; null ids give an empty text."""
    codec = Codec(path)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        text = [codec.decode(np.frombuffer(x or b"", "<u4")) for x in b.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(text, pa.string())], names=["doc_id", "ids", "text"])

    return map_batches(encoded.select("doc_id", "ids"), fn, "doc_id bigint, ids binary, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, from its ids and the text they give."""
    return decode(encode(docs, path), path).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
