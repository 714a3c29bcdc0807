"""Near-duplicates, passages, leaks, top-k and mixing against brute force on small cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parapet.llm import decontaminate, mixing, neardup, passages, setsketch, topk
from parapet.llm.common import table

SF = "/root/testdata/sf0.001"


def shingles(text, k):
    low = {c: c + 32 for c in range(65, 91)}
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(low)) if x]
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute_components(sets, percent):
    par = {i: i for i in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def varied(rng, words, edits):
    out = list(words)
    for at in rng.choice(len(out), edits, replace=False):
        out[at] = f"n{rng.integers(1 << 30)}"
    return " ".join(out)


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 400, 120)]
    texts = [varied(rng, base, int(rng.integers(0, 7))) for _ in range(120)] + [" ".join(base)] * 5
    texts += [None, "", "  ", "one two", "ONE  two", "x"] + [" ".join(f"u{x}" for x in rng.integers(0, 10**6, 80)) for _ in range(10)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in rows] + [(0, texts[0], 7, 8), (None, texts[0], 7, 8)], "doc_id bigint, text string, n bigint, comp bigint")
    sets = {i: shingles(t, 4) for i, t in rows}
    comp = brute_components(sets, 80)
    got = neardup.near_duplicates(docs, 4, 80).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)
    kept = neardup.deduplicated(docs, 4, 80)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 1
    assert neardup.near_duplicates(docs.limit(0), 4, 80).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    a, b = x[:1000], x[500:]
    sa, sb = setsketch.sketch(a), setsketch.sketch(b)
    assert (setsketch.merge(sa, sb) == setsketch.sketch(x)).all()
    j = setsketch.jaccard(sa[None], sb[None], np.array([1000.0]), np.array([1000.0]))[0]
    assert abs(j - 1 / 3) < 0.15


def test_leaks_match_planted_edits(spark):
    rng = np.random.default_rng(3)
    items = [[f"b{x}" for x in rng.integers(0, 3000, n)] for n in (12, 20, 33, 70)]
    docs, want = [], set()
    for d in range(80):
        body = [f"d{x}" for x in rng.integers(0, 3000, 100)]
        if d % 2:
            item = items[(d // 2) % 4]
            body[50:50] = varied(rng, item, int(rng.integers(0, int(0.2 * len(item)) + 1))).split()
            want.add((d, (d // 2) % 4))
        docs.append((d, " ".join(body)))
    docs = spark.createDataFrame([*docs, (900, None), (901, ""), (None, "b1 b2")], "doc_id bigint, text string")
    bench = spark.createDataFrame([*[(i, " ".join(w)) for i, w in enumerate(items)], (10, None), (11, "b1 b2")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    assert decontaminate.decontaminated(docs, bench).filter("doc_id % 2 = 0 or doc_id is null or doc_id = 901").count() == 43
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 == decontaminate.leaks(docs.limit(0), bench).count()


def test_leaks_cut_or_replaced_at_either_end(spark):
    rng = np.random.default_rng(7)
    items = [[f"b{x}" for x in rng.integers(0, 10**6, n)] for n in (20, 50, 100, 203)]
    fill = lambda n: [f"d{x}" for x in rng.integers(0, 10**6, n)]
    docs, want = [], set()
    for k, item in enumerate(items):
        t = len(item) // 5
        for body in (item[t:], item[:-t], fill(t) + item[t:], item[:-t] + fill(t), varied(rng, item, t).split()):
            for before, after in ((0, 90), (90, 0), (7, 90), (43, 43), (0, 0)):
                want.add((len(docs), k, before, len(item) // 5))
                docs.append((len(docs), " ".join(fill(before) + body + fill(after))))
        docs.append((len(docs), " ".join(item[t + 1 :])))
    docs, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {w[:2] for w in want}
    assert all(got[d, i].edits == e and abs(got[d, i].start_word - before) <= e for d, i, before, e in want)


def test_edit_distance():
    h = np.arange(1, 9, dtype=np.uint64)
    assert decontaminate.edit_distance(h, np.concatenate([h + np.uint64(50), h, h])) == 0
    assert decontaminate.edit_distance(h, np.delete(h, 3)) == 1
    assert decontaminate.edit_distance(h, h[:0]) == 8


def test_compact_windows_cover_every_stretch():
    rng = np.random.default_rng(4)
    for n, span in ((40, 1000), (40, 6), (5, 3)):
        h = rng.integers(0, span, n).astype(np.uint64)
        w = passages.compact_windows(h, 8)
        for i in range(n):
            for j in range(i + 7, n):
                assert [h[c] for a, c, b in w if a <= i and j <= b and h[c] == h[i : j + 1].min()]


def test_passages_of_finds_every_copy():
    rng = np.random.default_rng(8)
    fresh = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    p, b = fresh(70), lambda *parts: np.concatenate([fresh(30), *parts, fresh(30)])
    teaser = b(p[:42], fresh(60), p)
    assert passages.passages_of(teaser, b(p)) == [(132, 202, 30, 100)]
    # a longer excerpt is a passage of its own, and so is a second copy on either side
    assert {x[:2] for x in passages.passages_of(b(p[:50], fresh(60), p), b(p))} == {(30, 80), (140, 210)}
    got = passages.passages_of(b(p, fresh(60), p), b(p, fresh(60), p, fresh(60), p))
    assert {x[:2] for x in got} == {(30, 100), (160, 230)} and {x[2:] for x in got} == {(30, 100), (160, 230), (290, 360)}
    # 20 shingles more inside one copy, and text of one shingle only
    q = fresh(70)
    assert passages.passages_of(b(p, fresh(20), q), b(p, q)) == [(30, 190, 30, 170)]
    one = np.repeat(p[:1], 2000)
    assert passages.passages_of(one, one) == [(0, 2000, 0, 2000)]
    assert passages.passages_of(fresh(200), b(p)) == [] == passages.passages_of(fresh(0), b(p))


def test_repeated_passages(spark):
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"f{x}" for x in rng.integers(0, 10**6, n)]
    shared, near = fresh(70), fresh(90)
    rows = [(i, " ".join(fresh(60) + shared + fresh(40))) for i in range(30)]
    rows += [(100 + i, " ".join(fresh(30) + varied(rng, near, 1).split() + fresh(50))) for i in range(4)]
    rows += [(200 + i, " ".join(fresh(200))) for i in range(20)] + [(300, "short"), (301, None), (302, "")]
    rows += [(400, rows[40][1]), (400, rows[40][1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, c bigint")
    got = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    twin = rows[40][0]
    assert set(got) ^ {*range(30), *range(100, 104), twin, 400} == set()
    assert {got[i].component_id for i in range(30)} == {0} and {got[i].component_id for i in range(100, 104)} == {100}
    p = got[7].passages[0]
    assert abs(p.first_word - 60) <= 12 and abs(p.n_words - 70) <= 24
    assert passages.repeated_passages(docs.limit(0)).count() == 0


def test_passages_against_every_pair(spark):
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    shared, line = [fresh(int(n)) for n in (60, 90, 140)], fresh(25)
    docs = []
    for i in range(45):
        parts = [fresh(int(rng.integers(0, 120))), line if i % 2 else []]
        for p in shared:
            if rng.random() < 0.35:
                q = list(p)
                if rng.random() < 0.5:
                    q[int(rng.integers(0, len(q)))] = "edited"
                parts += [q, fresh(int(rng.integers(0, 60)))]
        docs.append((i, " ".join(x for p in parts for x in p)))
    own = list(passages._shingles(pa.array([t for _, t in docs])))
    pairs = {(i, j) for i in range(45) for j in range(i + 1, 45) if passages.passages_of(own[i], own[j])}
    comp = list(range(45))
    for _ in comp:
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: comp[i] for p in pairs for i in p}


def test_pairs_of_windows_share_a_stretch_with_both_tokens():
    rng = np.random.default_rng(12)
    text = " ".join(map(str, rng.integers(0, 60, 400)))
    for x, _, _ in passages._slices(pa.array([text, None, "", text])):
        _, _, w = passages._windows(x)
        got = {(min(i, j), max(i, j)) for a, b in passages._overlaps(w) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        low, high = np.maximum(w[:, None, 0], w[None, :, 0]), np.minimum(w[:, None, 2], w[None, :, 2])
        tokens = np.minimum(w[:, None, 1], w[None, :, 1]), np.maximum(w[:, None, 1], w[None, :, 1])
        ok = (high - low + 1 >= passages.LEAST) & (tokens[0] >= low) & (tokens[1] <= high)
        assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(ok, 1)), strict=True)}


def test_passages_within_a_component(spark):
    # a boilerplate passage joins all; an older version of a second passage is in document 0, too unlike
    rng = np.random.default_rng(9)
    fresh = lambda n: [f"f{x}" for x in rng.integers(0, 10**6, n)]
    docs, want = [], {}
    for group in range(6):
        line, own = fresh(80), fresh(60)
        old = own[:25] + fresh(1) + own[26:32] + fresh(1) + own[33:]
        for k in range(4):
            i = 10 * group + k
            docs.append((i, " ".join(fresh(60) + line + fresh(60) + (old if k == 0 else own) + fresh(60))))
            want[i] = 1 if k == 0 else 2
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert {i: r.n_passages for i, r in got.items()} == want
    assert {i: r.component_id for i, r in got.items()} == {i: i - i % 10 for i in want}


def test_top_k(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 8)).round(3)
    v[100:200] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(500, None), (550, [1.0, None]), (600, [float("nan")] * 8), (650, []), (700, [1.0] * 3)]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id bigint, embedding array<double>, score int"), 50, 5).collect()}
    m = np.floor(256 * v).astype(np.int64)
    for q in range(0, 300, 50):
        s = m @ m[q]
        best = [j for j in np.lexsort((np.arange(300), -s)) if j != q][:5]
        assert [got[q, k + 1] for k in range(5)] == [(j, s[j]) for j in best]
    assert len(got) == 30


def test_mixing_meets_targets(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    out = mixing.mixed(docs, labels)
    assert out.count() == docs.count() and out.columns == [*docs.columns, "n_tokens", "domain", "rate", "copies"]
    assert out.filter("rate < 0 or rate is null or abs(copies - rate) > 1").count() == 0
    model = mixing.fit(docs, labels)
    t = mixing.posteriors(docs.select("doc_id", "text"), model).cache()
    past = mixing.fit_rates(t)
    p, w = (np.array(x) for x in zip(*[(r._p, r._n) for r in t.collect()], strict=True))
    r = np.ones(len(w))
    for g in past:
        r = np.maximum(0, r - p @ np.array(g))
    end = (p * (w * r)[:, None]).sum(axis=0) / w.sum() - np.array(mixing.TARGETS)
    assert np.abs(end).max() < 1e-6
    assert np.allclose(sorted(x.rate for x in out.select("rate").collect()), sorted(r))
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    edge = spark.createDataFrame([(1, None, 2.0, "a", 3), (None, "", 1.0, "b", 4)], "doc_id bigint, text string, rate double, _n string, _P int")
    assert [(x._n, x._P) for x in mixing.mixed(edge, none).orderBy("_n").collect()] == [("a", 3), ("b", 4)]
    assert [x.n_tokens for x in mixing.mixed(edge, none).collect()] == [0, 0]
    assert mixing.mixed(edge.limit(0), none).count() == 0


def test_mixing_totals_are_the_targets(spark):
    rng = np.random.default_rng(10)
    for shares in ((0.0144, 0.6, 0.3, 0.0856), (0.9, 0.001, 0.069, 0.03)):
        p = 0.97 * np.eye(4)[rng.choice(4, 4000, p=shares)] + 0.03 * rng.dirichlet(np.ones(4), 4000)
        t = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(rng.integers(1, 900, 4000), p, strict=True)], "_n bigint, _p array<double>").cache()
        past = mixing.fit_rates(t)
        assert np.abs(np.array(mixing.totals(t, past)) - mixing.TARGETS).max() < 1e-6
    sf = "/root/testdata/sf0.1"
    t = mixing.posteriors(table(spark, sf, "documents").select("text"), mixing.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))).cache()
    assert np.abs(np.array(mixing.totals(t, mixing.fit_rates(t))) - mixing.TARGETS).max() < 1e-6
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    with pytest.warns(UserWarning, match="cannot be reached"):
        mixing.mixed(spark.createDataFrame([(1, "one two")], "doc_id bigint, text string"), none)


def test_pipeline(spark):
    corpus = pytest.importorskip("corpus_pipeline")
    out = corpus.run(spark, SF)
    docs = table(spark, SF, "documents")
    assert set(docs.columns) <= set(out.columns)
    assert 0.5 * docs.count() < out.count() <= docs.count()
    assert out.filter("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0


def test_passages_that_the_hashes_miss(spark):
    rng = random.Random(11)
    docs, n = [], 0
    while len(docs) < 8:
        a = [f"w{n}x{i}" for i in range(50)]
        b = [*a[: (k := rng.randint(10, 40))], f"other{n}", *a[k + 1 :]]
        n += 1
        keys = []
        for x, _, _ in passages._slices(pa.array([" ".join(a), " ".join(b)])):
            k, key, w = passages._windows(x)
            keys = [{key[i] for i in range(len(key)) if (w[i, 1] > 46) == second} for second in (False, True)]
        # fewer than two hashes agree: one pair in 150
        if len(keys[0] & keys[1]) < 2:
            docs += [(len(docs), " ".join(a)), (len(docs) + 1, " ".join(b))]
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert sorted(got) == list(range(8))
    assert all(got[i].component_id == i - i % 2 and got[i].passages[0].n_words == 50 for i in got)


def test_only_repeating_documents_go_further(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    shared, short = fresh(50), fresh(40)
    texts = [fresh(300), [*fresh(80), *shared, *fresh(9)], [*shared[:20], "new", *shared[21:], *fresh(200)], [*short, *fresh(30)], [*fresh(30), *short], fresh(3), []]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(9, None)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in passages.repeating(df).collect()) == [1, 2]


def test_passages_of_many_pairs_in_portions(spark, monkeypatch):
    # zeros stand for places that no passage can hold; portions of pairs give the links of all pairs at once
    rng = np.random.default_rng(21)
    fresh = lambda n: rng.integers(1, 2**63, n).astype(np.uint64)
    line, none = fresh(60), np.zeros(90, np.uint64)
    own = [np.concatenate([none[: 50 + i], line, none[:70], fresh(50), none[: i % 3 * 40]]) for i in range(12)] + [np.concatenate([none, fresh(50)])]
    docs = passages.written(spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(own)], passages.SEGMENTS))
    pairs = passages.written(spark.createDataFrame([(i, j) for i in range(13) for j in range(i + 1, 13)], "a bigint, b bigint"))
    want = {(i, j, *p) for i in range(13) for j in range(i + 1, 13) for p in passages.passages_of(own[i], own[j])}
    assert len(want) == 66 and (0, 11, 50, 110, 61, 121) in want
    for portion in (1, 100):
        monkeypatch.setattr(passages, "PAIRS_A_DOC", portion)
        assert sorted(map(tuple, passages._confirmed(pairs, docs).collect())) == sorted(want)


def test_tables_leave_no_shuffle_files(spark):
    from parapet.llm.common import FREE, written

    statuses = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before, kept = statuses(), spark.conf.get(FREE, None)
    for i in range(3):
        assert written(spark.range(1000).groupBy((F.col("id") % (7 + i)).alias("k")).count(), free=True).count() == 7 + i
    assert statuses() <= before + 3 and spark.conf.get(FREE, None) == kept


def _segments(spark, texts):
    own = {i: x for i, x in enumerate(passages._shingles(pa.array(texts)))}
    return passages.written(spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in own.items()], passages.SEGMENTS))


def test_covered_passages_of_two_components_are_left(spark):
    rng = np.random.default_rng(21)
    fresh = lambda n: [f"f{x}" for x in rng.integers(0, 10**6, n)]
    shared = fresh(80)
    texts = [" ".join(fresh(60) + shared + fresh(60)) for _ in range(2)]
    bits = passages.shared_filter(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    docs = _segments(spark, texts)
    keys = passages.id_filter(passages.shared_keys(docs).select("key"))
    wanted = passages.id_filter(passages._shared(passages.shared_pairs(docs, keys)).select("key"))
    # both copies lie in passages with others; in one component nothing is left, in two the link is
    whole = docs.withColumn("spans", F.expr("array(named_struct('s', 0L, 'e', length(x) div 8L))"))
    assert passages.rows_left(whole.withColumn("comp", F.lit(0).cast("bigint")), keys, wanted, bits).isEmpty()
    assert {r.doc_id for r in passages.rows_left(whole.withColumn("comp", F.col("doc_id")), keys, wanted, bits).collect()} == {0, 1}


def test_passages_that_reach_past_confirmed_ones_are_left(spark):
    rng = np.random.default_rng(22)
    fresh = lambda n: [f"f{x}" for x in rng.integers(0, 10**6, n)]
    shared = fresh(120)
    texts = [" ".join(fresh(60) + shared + fresh(60)) for _ in range(2)]
    bits = passages.shared_filter(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    docs = _segments(spark, texts)
    keys = passages.id_filter(passages.shared_keys(docs).select("key"))
    wanted = passages.id_filter(passages._shared(passages.shared_pairs(docs, keys)).select("key"))
    # 116 shingles from 60 on are shared; confirmed passages hold the first 90 of them
    part = docs.withColumn("spans", F.expr("array(named_struct('s', 60L, 'e', 150L))")).withColumn("comp", F.lit(0).cast("bigint"))
    left = passages.rows_left(part, keys, wanted, bits).filter("open").collect()
    assert any(r.c < 150 and r.d < 150 and r.r >= 150 for r in left)
