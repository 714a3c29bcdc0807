"""Near-duplicate documents by SetSketch registers.

1. One pass makes, for each document, the size, a 128-bit sum and the sketch of its set of shingles.
   Documents of equal sets form a class; the smallest id stands for it from here on.
2. Bands of registers put representatives into buckets. A bucket is never turned into all its pairs:
   its smallest member is a hub, and every other member is paired with the hub.
3. A pair whose likelihood estimate is far below the threshold is dropped, any other is confirmed on
   the full sets, taken from the texts. Confirmed links are joined to components.
4. Members of buckets that still hold more than one component are dealt anew, exactly: ordered by how
   many of these members have it, a set's rarest shingles form a prefix that meets the prefix of every
   set similar enough. A common core of a large group of copies is in no such prefix, so its members
   are not paired with each other. Shingle buckets of one component need no pair; the others take hubs
   outside their largest component, and a hub that has met all others leaves. The rounds end when no
   bucket holds two components: every pair is tested, ruled out by its prefix, or known to be connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parapet.llm import setsketch
from parapet.llm.common import id_filter, map_batches, maybe_in, without, written
from parapet.llm.graph import components
from parapet.llm.words import NOT_SPACE, mix64, shingle_hashes, word_slices

#: an estimate may lie so many standard errors below the threshold before a pair is given up
SIGMAS = 5.0
#: hubs of a bucket in each round after the first
HUBS = 512

MARKS = "doc_id bigint, n bigint, k1 bigint, k2 bigint, regs binary"


def shingle_sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted set of k-word shingle hashes of each text."""
    for s in word_slices(col, NOT_SPACE):
        for d in range(s.last - s.first):
            yield np.unique(shingle_hashes(s.hashes[s.doc_off[d] : s.doc_off[d + 1]], k))


def marks(docs: DataFrame, k: int) -> DataFrame:
    """Size, sum and sketch of each document's set of shingles."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        sums = np.zeros((3, b.num_rows), np.int64)
        regs = []
        for i, u in enumerate(shingle_sets(b.column("text"), k)):
            sums[0, i] = len(u)
            sums[1, i] = u.sum(dtype=np.uint64).astype(np.int64)
            sums[2, i] = np.bitwise_xor.reduce(mix64(u + np.uint64(0x9E3779B97F4A7C15))).astype(np.int64) if len(u) else 0
            regs.append(setsketch.sketch(u).tobytes())
        return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(s, pa.int64()) for s in sums], pa.array(regs, pa.binary())], names=["doc_id", "n", "k1", "k2", "regs"])

    return map_batches(docs.select("doc_id", "text"), fn, MARKS)


def _bands(reps: DataFrame) -> DataFrame:
    """(bucket, rep) for every band of every representative."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        regs = np.frombuffer(b"".join(b.column("regs").to_pylist()), np.uint16).reshape(b.num_rows, setsketch.REGISTERS)
        keys = setsketch.band_keys(regs).reshape(-1).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(b.column("rep").to_numpy(), setsketch.BANDS))], names=["bucket", "rep"])

    return map_batches(reps.select("rep", "regs"), fn, "bucket bigint, rep bigint")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose estimate does not rule it out."""
    threshold = percent / 100
    least = threshold - SIGMAS * np.sqrt(threshold * (1 - threshold) / setsketch.REGISTERS)
    a, b = (reps.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"r_{c}")) for c in "ab")
    sized = pairs.join(a, "a").join(b, "b").filter(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))

    def fn(t: pa.RecordBatch) -> pa.RecordBatch:
        ra, rb = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint16).reshape(t.num_rows, -1) for c in ("r_a", "r_b"))
        j = setsketch.jaccard(ra, rb, t.column("n_a").to_numpy(), t.column("n_b").to_numpy())
        return t.select(["a", "b"]).filter(pa.array(j >= least))

    return map_batches(sized.select("a", "b", "n_a", "n_b", "r_a", "r_b"), fn, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * |intersection| >= percent * |union| of their full shingle sets."""
    a, b = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t_{c}")) for c in "ab")
    # the side with the hub's text is shuffled once more: join it last
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "t_a", "t_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep, hub, own = np.zeros(t.num_rows, bool), None, None
            for i, (h, s) in enumerate(zip(t.column("a").to_pylist(), shingle_sets(t.column("t_b"), k), strict=True)):
                if h != hub:
                    hub, own = h, next(shingle_sets(t.column("t_a").slice(i, 1), k))
                both = len(np.intersect1d(own, s, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(own) + len(s) - both)
            yield t.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a bigint, b bigint")


def _one_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents named by ``ids`` (doc_id), one row each."""
    some = maybe_in(docs.select("doc_id", "text"), id_filter(ids))
    return some.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def link(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Marks with the representative ``rep`` of each document, the confirmed links (a, b) between
    representatives, and (node, comp) of the representatives that have a link."""
    all_marks = written(marks(docs, k))
    key = ["n", "k1", "k2"]
    named = all_marks.filter("doc_id is not null")
    classes = written(named.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep")))
    reps = written(named.join(classes.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "n", "regs").dropDuplicates(["rep"]))

    band = _bands(reps)
    shared = band.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub <> last").select("bucket", "hub")
    members = written(band.join(shared, "bucket"))
    pairs = written(members.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    rest = members.filter("rep <> hub").select("bucket", "rep")
    tested, links, comp, exact = pairs, None, None, False
    while True:
        likely = written(_likely(pairs, reps, percent))
        ids = written(likely.select(F.col("a").alias("doc_id")).union(likely.select(F.col("b").alias("doc_id"))).distinct())
        found = written(_confirmed(likely, _one_text(docs, ids), k, percent))
        links = found if links is None else links.union(found)
        comp = components(links)
        live = _live(rest, comp)
        if not exact and not live.isEmpty():
            exact = True
            live = _live(_prefix_buckets(docs, live, reps, k, percent), comp)
        if live.isEmpty():
            break
        rest, pairs = _next_round(live, tested, percent)
        tested = tested.union(pairs)
    full = all_marks.drop("regs").join(classes, key, "left")
    return full, links, comp


def _live(rest: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of ``rest`` in buckets that hold several components, with comp and main, the largest."""
    seen = rest.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(*rest.columns, F.coalesce("comp", "rep").alias("comp"))
    parts = seen.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("size", "comp")).alias("m"), F.count("*").alias("parts")).filter("parts > 1").select("bucket", F.col("m.comp").alias("main"))
    return written(seen.join(main, "bucket"))


def _prefix_buckets(docs: DataFrame, live: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """(bucket, rep, n, at): the shared shingles of each live member's prefix, and their places in it.

    A set of n shingles, whose smallest possible partner has l, must share o = percent / (100 + percent)
    * (n + l) of them; so its n - o + 1 rarest meet those of every partner. Shingles of one member only
    are the rarest of all and meet nothing: they use up places of the prefix without making a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for i, u in enumerate(shingle_sets(b.column("text"), k)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), ids[i])), pa.array(u.view(np.int64))], names=["rep", "shingle"])

    sized = live.select("bucket", "rep").join(reps.select("rep", "n"), "rep")
    least = sized.groupBy("bucket").agg(F.min("n").alias("l"))
    need = F.ceil(F.lit(percent) * (F.col("n") + F.greatest("l", F.ceil(F.col("n") * percent / 100))) / (100 + percent))
    members = written(sized.join(least, "bucket").groupBy("rep", "n").agg(F.min("l").alias("l")).select("rep", "n", (F.col("n") - need + 1).alias("places")))
    texts = _one_text(docs, members.select(F.col("rep").alias("doc_id")))
    each = written(texts.mapInArrow(run, "rep bigint, shingle bigint"))
    common = each.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = each.join(common, "shingle").join(members, "rep").select("*", F.row_number().over(Window.partitionBy("rep").orderBy("df", "shingle")).alias("row"), F.count("*").over(Window.partitionBy("rep")).alias("shared"))
    return written(ranked.withColumn("at", F.expr("row + n - shared")).filter("at <= places").select(F.col("shingle").alias("bucket"), "rep", "n", "at"))


def _next_round(live: DataFrame, tested: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members left in their buckets, and the pairs of the next hubs.

    A pair is met in the bucket of the first shingle, in rarity, that both have: what they share lies
    from there on in both sets, which rules out the pairs for which that is too little.
    """
    slot = F.pmod(F.xxhash64("rep"), F.lit(HUBS))
    hubs = live.filter("comp <> main").groupBy("bucket", slot.alias("slot")).agg(F.min(F.struct("rep", "comp", "n", "at")).alias("h"))
    hubs = written(hubs.select("bucket", F.col("h.rep").alias("hub"), F.col("h.comp").alias("h_comp"), F.col("h.n").alias("h_n"), F.col("h.at").alias("h_at")))
    possible = f"live.bucket = hubs.bucket and comp <> h_comp and {100 + percent} * (1 + least(n - at, h_n - h_at)) >= {percent} * (n + h_n)"
    met = live.alias("live").join(hubs.alias("hubs"), F.expr(possible)).select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    pairs = written(met.join(tested, ["a", "b"], "left_anti"))
    rest = written(live.join(hubs.select("bucket", F.col("hub").alias("rep")), ["bucket", "rep"], "left_anti").drop("comp", "main"))
    return rest, pairs


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs`` (doc_id, text).

    Documents are linked when their sets of k-word shingles have a similarity of percent / 100 or
    more; ``component_id`` is the smallest doc_id that links reach, and only that document is kept. A
    null, empty or blank text has no shingles and is linked with nothing; fewer than k words make one
    shingle. A null doc_id has a null component and is kept; rows that repeat a doc_id are one document
    and get the same answer. Other columns are ignored; no rows give no rows.
    """
    full, _, comp = link(docs, k, percent)
    out = full.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates; the columns stay as they are."""
    gone = written(near_duplicates(docs, k, percent).filter(~F.col("kept")).select("doc_id").distinct())
    return without(docs, gone)
