"""Merkle manifest of a table: a postorder append log of 16-ary trees, and proofs read from it.

One tree per source over its documents by doc_id, and one tree over the subroots of all sources. Aligned
builders of 4,096 nodes (three levels) write their nodes as they are completed, so each builder's part of
the log is one stretch of postorder positions. The position of any node follows from the sizes of the
subtrees before it, hence from level, index and number of leaves alone (``position``): siblings of a proof
are looked up by position, inside the builder's own stretch for the lowest three levels and by a join on
(tree, position) above.

Nothing is gathered: ranks come from a range partitioning, so a source with a third of all rows is spread;
builders and proofs work on groups of at most 4,096 rows; upper levels have a 4,096th of the rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parapet.llm.common import written

#: children of a node are 2 ** BITS consecutive ones
BITS = 4
ARITY = 1 << BITS
#: levels that one builder completes
SPAN = 3
#: 16 ** 15 leaves are beyond any count of rows
MAX_HEIGHT = 15

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: tree of the subroots; trees of sources have the keys "-" (null) and "=" + source
TOP = ""
LOG = "tree string, chunk bigint, at bigint, level int, idx bigint, n bigint, digest string, doc_id bigint, tampered string"
PROOF = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, siblings array<string>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- closed forms: in Python and as Spark SQL ------------------------------------------------------------


def width(n: int, level: int) -> int:
    """Nodes of a level of a tree with n leaves."""
    return ((n - 1) >> BITS * level) + 1


def height(n: int) -> int:
    """Levels above the leaves: 0 for one leaf."""
    h = 0
    while width(n, h) > 1:
        h += 1
    return h


def position(n: int, level: int, i: int) -> int:
    """Postorder position, from 0, of node i of a level: all nodes below it, and the earlier ones above."""
    below = sum(min((i + 1) << BITS * (level - m), width(n, m)) for m in range(level + 1))
    return below + sum(i >> BITS * (m - level) for m in range(level + 1, height(n) + 1)) - 1


HEIGHT_SQL = f"cast(size(filter(sequence(0, {MAX_HEIGHT}), m -> shiftleft(1L, {BITS} * m) < n)) as int)"


def position_sql(level: str, i: str) -> str:
    return (
        f"aggregate(sequence(0, {MAX_HEIGHT}), -1L, (acc, m) -> acc + case"
        f" when m <= {level} then least(shiftleft({i} + 1L, {BITS} * ({level} - m)), shiftright(n - 1, {BITS} * m) + 1)"
        f" when m <= h then shiftright({i}, {BITS} * (m - {level})) else 0L end)"
    )


# --- leaves ----------------------------------------------------------------------------------------------


def _field(col):
    s = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, tampered) of every row; ``tampered`` is the leaf of the altered row, where
    5 divides crc32 of the decimal doc_id (a null doc_id is never altered)."""
    head = [_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", UPPER, UPPER.lower())
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.sha2(F.concat(*head, _field(F.col("text"))), 256).alias("digest"),
        F.when(altered, F.sha2(F.concat(*head, _field(lowered)), 256)).alias("tampered"),
    )


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their place ``idx`` in their tree by the columns ``by`` and the tree's number of rows ``n``.

    The rows are range partitioned and sorted; places are offsets of the partitions plus places inside
    them. Rows that agree in all of ``by`` keep the order in which they were first written.
    """
    order = ["tree", *by, "uid"]
    first = written(rows.withColumn("uid", F.monotonically_increasing_id()))
    dealt = written(first.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33).alias("part")
    sizes = dealt.groupBy("tree", part).agg(F.min("row").alias("least"), F.count("*").alias("m"))
    # the windows are over one row per tree and partition
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("m").over(before), F.lit(0)) - F.col("least")
    sizes = sizes.select("tree", "part", shift.alias("shift"), F.sum("m").over(tree).alias("n"))
    placed = dealt.withColumn("part", part).join(sizes, ["tree", "part"])
    return placed.select(*rows.columns, "n", (F.col("row") + F.col("shift")).alias("idx"))


# --- the log ---------------------------------------------------------------------------------------------


def _builder(base: int):
    """Appends the nodes over one aligned stretch of nodes of level ``base``, in completion order."""

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        tree, chunk, n = t["tree"][0].as_py(), t["chunk"][0].as_py(), t["n"][0].as_py()
        top = min(base + SPAN, height(n))
        last = [width(n, level) - 1 for level in range(top + 1)]
        out: list[tuple] = []
        open_runs: list[list[str]] = [[] for _ in range(top + 1)]
        for i, d, doc, tampered in zip(t["idx"].to_pylist(), t["digest"].to_pylist(), t["doc_id"].to_pylist(), t["tampered"].to_pylist()):
            if base == 0:
                out.append((0, i, d, doc, tampered))
            level = base
            open_runs[level].append(d)
            while level < top and (i % ARITY == ARITY - 1 or i == last[level]):
                d, i = digest("".join(open_runs[level])), i >> BITS
                open_runs[level] = []
                level += 1
                open_runs[level].append(d)
                out.append((level, i, d, None, None))
        level, idx, digests, docs, tampered = (list(c) for c in zip(*out)) if out else ([], [], [], [], [])
        m = len(out)
        return pa.table(
            {
                "tree": pa.array([tree] * m, pa.string()),
                "chunk": pa.array([chunk] * m, pa.int64()),
                "at": pa.array([position(n, a, b) for a, b in zip(level, idx)], pa.int64()),
                "level": pa.array(level, pa.int32()),
                "idx": pa.array(idx, pa.int64()),
                "n": pa.array([n] * m, pa.int64()),
                "digest": pa.array(digests, pa.string()),
                "doc_id": pa.array(docs, pa.int64()),
                "tampered": pa.array(tampered, pa.string()),
            }
        )

    return build


def append_log(rows: DataFrame) -> DataFrame:
    """The log (``LOG``) over ranked rows (tree, n, idx, digest, doc_id, tampered); ``part`` 0 has the
    lowest three levels and the leaves, part 1 the next three, and so on. ``n`` counts the leaves."""
    parts: list[DataFrame] = []
    most = rows.agg(F.max("n")).first()[0] or 1
    for base in range(0, max(height(most), 1), SPAN):
        chunked = rows.withColumn("chunk", F.shiftright("idx", BITS * SPAN))
        parts.append(written(chunked.groupBy("tree", "chunk").applyInArrow(_builder(base), LOG)))
        rows = parts[-1].filter((F.col("level") == base + SPAN) & (F.expr(HEIGHT_SQL) > base + SPAN)).drop("chunk", "at", "level")
    return reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])


def roots(log: DataFrame) -> DataFrame:
    """(tree, n, digest) of every tree's root."""
    return log.filter(F.col("level") == F.expr(HEIGHT_SQL)).select("tree", "n", "digest")


def paths(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, idx, path) of ``nodes`` (tree, n, level, idx): siblings up to the root, each as
    (level, index, digest), looked up in ``log`` by position. A root has a null path."""
    n = nodes.withColumn("h", F.expr(HEIGHT_SQL))
    up = n.select("*", F.explode(F.expr("case when level < h then sequence(level, h - 1) else array() end")).alias("lv"))
    up = up.withColumn("own", F.expr(f"shiftright(idx, {BITS} * (lv - level))"))
    run = f"sequence(own - own % {ARITY}, least(own - own % {ARITY} + {ARITY - 1}, shiftright(n - 1, {BITS} * lv)))"
    each = up.select("*", F.explode(F.expr(f"array_remove({run}, own)")).alias("j")).withColumn("at", F.expr(position_sql("lv", "j")))
    met = each.select("tree", "idx", "lv", "j", "at").join(log.select("tree", "at", "digest"), ["tree", "at"])
    found = met.groupBy("tree", "idx").agg(F.sort_array(F.collect_list(F.struct("lv", "j", "digest"))).alias("path"))
    return nodes.join(found, ["tree", "idx"], "left").select("tree", "n", "idx", "path")


# --- proofs ----------------------------------------------------------------------------------------------


def _steps(path: list[dict] | None, idx: int, first: int, n: int) -> list[tuple[str, str]]:
    """Siblings left and right of the way from node ``idx`` of level ``first`` to the root, per level."""
    by_level: dict[int, list[dict]] = {}
    for p in path or ():
        by_level.setdefault(p["lv"], []).append(p)
    out = []
    for level in range(first, height(n)):
        own = idx >> BITS * (level - first)
        run = by_level.get(level, [])
        out.append(("".join(p["digest"] for p in run if p["j"] < own), "".join(p["digest"] for p in run if p["j"] > own)))
    return out


def _prover(with_siblings: bool):
    """Proofs of the leaves of one aligned stretch, from its part of the log and the way above it."""

    def prove(log: pa.Table, way: pa.Table) -> pa.Table:
        w = {k.removeprefix("w_"): v for k, v in way.to_pylist()[0].items()}
        n, chunk = w["n"], w["chunk"]
        log = log.sort_by("at")
        digests, start = log["digest"].to_pylist(), log["at"][0].as_py()
        upper = _steps(w["path"], chunk, SPAN, n) + _steps(w["top_path"], w["top_idx"], 0, w["top_n"])
        inner = min(SPAN, height(n))
        runs: dict[tuple[int, int], list[str]] = {}
        for level in range(inner):
            first = chunk << BITS * (SPAN - level)
            for i in range(first, min(first + (1 << BITS * (SPAN - level)), width(n, level))):
                runs.setdefault((level, i >> BITS), []).append(digests[position(n, level, i) - start])
        rest = "".join(a + b for a, b in upper)
        rows: list[tuple] = []
        for level, i, leaf, doc, tampered in zip(*(log[c].to_pylist() for c in ("level", "idx", "digest", "doc_id", "tampered"))):
            if level:
                continue
            steps = []
            for lv in range(inner):
                run, place = runs[lv, i >> BITS * (lv + 1)], (i >> BITS * lv) % ARITY
                steps.append(("".join(run[:place]), "".join(run[place + 1 :])))
            proof = "".join(a + b for a, b in steps) + rest
            node = leaf if tampered is None else tampered
            for a, b in steps + upper:
                node = digest(a + node + b)
            cut = [proof[k : k + 64] for k in range(0, len(proof), 64)] if with_siblings else None
            rows.append((doc, leaf, w["subroot"], w["root"], digest(proof), node, node == w["root"], cut))
        cols = list(zip(*rows))
        types = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.list_(pa.string())]
        names = [f.split()[0] for f in PROOF.split(", ")]
        return pa.table({k: pa.array(list(c), t) for k, c, t in zip(names, cols, types)})

    return prove


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Log of the trees of all sources, log of the tree over their subroots, and (of, idx, n): the place
    of each source's tree in it."""
    below = append_log(ranked(leaves(docs), ["doc_id", "digest"]))
    none = F.lit(None)
    tops = roots(below).select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "digest", none.cast("bigint").alias("doc_id"), none.cast("string").alias("tampered"))
    # keys of trees sort as the sources do, null first
    places = written(ranked(tops, ["of"]))
    return below, append_log(places.drop("of")), places.select("of", "idx", "n", "digest")


def proofs(docs: DataFrame, with_siblings: bool = False) -> DataFrame:
    """Every row of ``docs`` with its leaf, its source's subroot, the root, the digest of its proof, the
    root recomputed from the (where chosen, altered) row, and whether both roots agree.

    ``siblings`` holds the proof itself where asked for. Nulls count as "-" in a leaf, an empty text as
    "0:"; repeated rows are leaves of their own; a table without rows gives none. Columns other than
    doc_id, source, lang, n_chars and text play no part.
    """
    below, above, places = manifest(docs)
    top_paths = paths(above, places.select(F.lit(TOP).alias("tree"), "n", F.lit(0).alias("level"), "idx"))
    root = roots(above).select(F.col("digest").alias("root"))
    tops = places.select("of", "idx", F.col("digest").alias("subroot")).join(top_paths.select("idx", F.col("n").alias("top_n"), F.col("path").alias("top_path")), "idx")
    # one row: the root
    tops = written(tops.crossJoin(F.broadcast(root)).select(F.col("of").alias("tree"), F.col("idx").alias("top_idx"), "top_n", "top_path", "subroot", "root"))
    tall = below.filter((F.col("level") == SPAN) & (F.expr(HEIGHT_SQL) >= SPAN)).select("tree", "n", "level", "idx")
    low = below.filter((F.col("level") == F.expr(HEIGHT_SQL)) & (F.col("level") < SPAN)).select("tree", "n", F.col("idx"), F.lit(None).cast("array<struct<lv:int,j:bigint,digest:string>>").alias("path"))
    ways = paths(below.filter(F.col("level") >= SPAN), tall).unionByName(low)
    ways = ways.select("tree", "n", F.col("idx").alias("chunk"), "path").join(tops, "tree")
    ways = ways.toDF(*[f"w_{c}" for c in ways.columns])
    stretch = below.filter("part = 0")
    return stretch.groupBy("tree", "chunk").cogroup(ways.groupBy("w_tree", "w_chunk")).applyInArrow(_prover(with_siblings), PROOF)
