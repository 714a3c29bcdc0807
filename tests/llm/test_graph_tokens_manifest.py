"""Phrase graph, BPE and manifest, each against a brute-force version."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parapet.llm import bpe, merkle, phrases

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars int"


# --- phrases ---------------------------------------------------------------------------------------------


def all_collocations(rows, least, first):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\v\f\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    cand = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= least}
    inside = {}
    for (lang, w), n in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                key = (lang, w[i : i + m])
                inside[key] = max(inside.get(key, 0), n)
    out = []
    for (lang, w), a in cand.items():
        if inside.get((lang, w), 0) >= a:
            continue
        n = total[lang]
        cuts = [(1000 * a * n // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), left, right, n))
    found = []
    for lang in {x[0] for x in out}:
        for rank, (_, s, a, p, left, right, n) in enumerate(sorted(x for x in out if x[0] == lang)[:first], 1):
            found.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(found)


def some_texts(seed, n):
    rng = random.Random(seed)
    words = ["The", "cat", "sat", "on", "É", "mat", "x\x00y", "ha", "中文", "dog's"]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " !", "\x0b"]
    texts = [("".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None])) for _ in range(n)]
    return texts + [("New York City hall opens today in New York City", "en")] * 5 + [(None, "en"), ("", None), ("...", "fr"), ("ha " * 30, "de"), ("ha " * 30, "de")]


@pytest.mark.parametrize(("seed", "least", "first"), [(1, 4, 2000), (2, 2, 7)])
def test_collocations_equal_brute_force(spark, seed, least, first):
    rows = some_texts(seed, 60)
    df = spark.createDataFrame([(i, t, lang, "s", 0, "z") for i, (t, lang) in enumerate(rows)], DOCS + ", k string")
    got = sorted(tuple(r) for r in phrases.collocations(df, least=least, first=first).collect())
    assert got == all_collocations(rows, least, first)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "a b c", "en", "s", 1)], DOCS)).count() == 0


def test_paths_join_edges_into_the_longest_phrases(spark):
    long = " ".join(f"w{i}" for i in range(23))
    rows = [(long, "en")] * 3 + [("w4 w5 w6 w7 w8 other", "en")] * 2 + [("a b c d e f g", "de")] * 2
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], DOCS)
    _, graph = phrases.edges(df, 2)
    got = {(r.lang, r.phrase, r.f) for r in phrases.paths(phrases.flows(graph, 2)).collect()}
    # the shared part has another count and another follower, so the long path is cut around it
    assert ("de", "a b c d e f g", 2) in got
    assert ("en", "w4 w5 w6 w7 w8", 5) in got
    assert ("en", " ".join(f"w{i}" for i in range(5, 23)), 3) in got
    assert sum(len(p.split()) - 4 for lang, p, _ in got if lang == "en") == 20


# --- BPE -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(codec, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert codec.encode([text])[0].tolist() == ids, repr(text)
    assert codec.decode(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False) == text


PARTS = [*"aAbcdst rvelm''  \n\t\r19.,!¿é½²①中😀 ́\x1c\x85​", "<|endoftext|>", "<|endof", "'s", "'re", "'ll", " '", "\n\n", "   "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_bpe_equals_library(codec, library, text):
    same(codec, library, text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_bpe_equals_library_on_any_text(codec, library, text):
    same(codec, library, text)


def test_bpe_of_long_texts(codec, library):
    rng = random.Random(3)
    words = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 90))) for _ in range(3000))
    same(codec, library, words)
    same(codec, library, "ab" * 3000 + " " * 500 + "x\n" * 300)
    # cut into pieces: longer than a piece, with and without white space
    piece = "One two  three\n\n four's 12 " * (bpe.PIECE // 20)
    assert codec.encode([piece])[0].tolist() == library.encode(piece, add_special_tokens=False).ids


def test_bpe_parts_of_batches_are_texts_of_their_own(codec, library):
    texts = ["a ", " b", "", "'", "s", " ", "\n", "x", "<|endoftext|>", "don", "'t"]
    assert [x.tolist() for x in codec.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_forced_cuts_stand_inside_no_token(codec):
    pairs = {t[i : i + 2] for k, t in enumerate(codec.tokens) if t not in codec.special for i in range(len(t) - 1)}
    assert int(codec.cut.sum()) == 65536 - len(pairs)
    assert not any(codec.cut[p[0] * 256 + p[1]] for p in pairs)


def test_bpe_digests(spark, library):
    rows = [(1, "Hello  world's 12\n"), (2, None), (3, ""), (None, "Hello"), (1, "Hello  world's 12\n"), (4, "x" * 5000), (5, "a<|endoftext|>b")]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "q") for i, t in rows], DOCS + ", ids string")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, PATH).collect())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((str(i), len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(df.limit(0), PATH).count() == 0


# --- manifest --------------------------------------------------------------------------------------------


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def way(tree, i):
    steps = []
    for level in tree[:-1]:
        run = i - i % 16
        steps.append((level[run:i], level[i + 1 : run + 16]))
        i //= 16
    return steps


def all_proofs(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for k in keys:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {k: levels([leaf(r) for r in by[k]]) for k in keys}
    top = levels([trees[k][-1][0] for k in keys])
    out = []
    for s, k in enumerate(keys):
        for i, r in enumerate(by[k]):
            steps = way(trees[k], i) + way(top, s)
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r, altered)
            for a, b in steps:
                node = sha("".join(a) + node + "".join(b))
            proof = [d for a, b in steps for d in a + b]
            root = top[-1][0]
            out.append((str(r[0]), leaf(r), trees[k][-1][0], root, sha("".join(proof)), node, node == root, proof))
    return sorted(out)


def proved(spark, rows):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], DOCS + ", tree string, idx int")
    return sorted((str(r[0]), *r[1:]) for r in (tuple(x) for x in merkle.proofs(df, with_siblings=True).collect()))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4096, 4097, 70000])
def test_positions_are_postorder(n):
    tree = levels(["x"] * n) if n < 5000 else None
    assert merkle.height(n) == (len(tree) - 1 if tree else 5)
    if tree is None:
        assert merkle.position(n, 5, 0) == sum(merkle.width(n, m) for m in range(6)) - 1
        return
    order = []

    def visit(level, i):
        if level:
            for j in range(16 * i, min(16 * i + 16, len(tree[level - 1]))):
                visit(level - 1, j)
        order.append((level, i))

    visit(len(tree) - 1, 0)
    assert [merkle.position(n, level, i) for level, i in order] == list(range(len(order)))


def test_proofs_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["Abc", "abc", "É X" * 5, "", None]), "en", "big", i) for i in range(4400)]
    rows += [(i, f"T{i}", rng.choice(["en", None]), f"s{i % 18}", None) for i in range(400)]
    rows += [(None, "n", "en", "s1", 1), (None, "n", "en", "s1", 1), (7, "A", None, None, 3), (7, "A", None, None, 3), (9, "B", "", "", 0), (8, "Ü", "de", "é", 2)]
    got = proved(spark, rows)
    assert got == all_proofs(rows)
    assert sum(not r[6] for r in got) > 0


def test_proofs_of_small_tables(spark):
    lone = [(1, "A", "en", "s", 1)]
    assert proved(spark, lone) == all_proofs(lone)
    assert proved(spark, lone)[0][4] == sha("")
    assert proved(spark, []) == []
