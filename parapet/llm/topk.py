"""Exact top-k inner-product search by tiled matrix products.

Query vectors are packed into blocks of bounded size, candidate vectors into shards of bounded size.
Every (block, shard) pair is one tile: a matrix product, a partial selection of k columns per query,
and at most k rows per query leave the tile. The lists are merged by a tree over the shards. Nothing
is broadcast; a tile holds one block and one shard, whatever the size of the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
SHARD = 4096
FAN_IN = 16
#: shards are dealt to so many keys; raise it with the number of cores
SLOTS = 64
#: sums up to here are exact in a float64 matrix product
EXACT = 1 << 53

PACKED = "block bigint, dim int, ids binary, vecs binary"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) with each component floor(scale * x); rows whose id or vector is null, or whose
    vector is empty or holds a null or non-finite component, are left out."""
    x = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    ok = F.expr("vec_id is not null and size(e) > 0 and forall(e, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    return x.filter(ok).select("vec_id", F.transform("e", lambda c: F.floor(c * F.lit(scale))).alias("v"))


def packed(q: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors of one length; a block never leaves its input partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, held = TaskContext.get().partitionId() << 32, {}

        def out(dim: int, ids: np.ndarray, vecs: np.ndarray) -> pa.RecordBatch:
            nonlocal n
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vecs.tobytes()], pa.binary())], names=["block", "dim", "ids", "vecs"])

        for b in batches:
            ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            flat, dims = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims):
                rows_of = np.flatnonzero(dims == dim)
                vecs = flat[at[rows_of][:, None] + np.arange(dim)]
                old = held.pop(int(dim), None)
                i, v = (ids[rows_of], vecs) if old is None else (np.concatenate([old[0], ids[rows_of]]), np.concatenate([old[1], vecs]))
                while len(i) >= rows:
                    yield out(int(dim), i[:rows], v[:rows])
                    i, v = i[rows:], v[rows:]
                if len(i):
                    held[int(dim)] = (i, v)
        for dim, (i, v) in held.items():
            yield out(dim, i, v)

    return q.mapInArrow(run, PACKED)


def tile(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top k (query_id, vec_id, score) of one tile, ties to the smaller id, a query's own row left out."""
    order = np.argsort(ci, kind="stable")
    ci, c = ci[order], c[order]
    worst = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * q.shape[1]
    if worst < EXACT:
        s = (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    else:
        s = q @ c.T  # 64-bit integers
    least = -np.iinfo(np.int64).max
    s[qi[:, None] == ci[None, :]] = least
    n = len(ci)
    # columns are in id order: a stable partial selection takes the first of equal scores
    if n > k:
        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1] if worst < EXACT else np.sort(s, axis=1)[:, -k]
        above, equal = s > kth[:, None], s == kth[:, None]
        room = k - above.sum(axis=1)
        keep = above | (equal & (np.cumsum(equal, axis=1) <= room[:, None]))
    else:
        keep = np.ones_like(s, dtype=bool)
    keep &= s != least
    r, col = np.nonzero(keep)
    return qi[r], ci[col], s[r, col]


def top_k(vectors: DataFrame, every: int, k: int, scale: int = 256, slots: int = SLOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, the k
    other rows of highest integer inner product, ties to the smaller vec_id; fewer rows give all.

    Rows with a null id or a null, empty or non-finite vector take no part; vectors of different
    length are never compared. A repeated vec_id is one candidate for each distinct score, and its
    rows are never candidates of their own query. No queries or no candidates give no rows. Other
    columns are ignored.
    """
    q = quantised(vectors, scale)
    shards = packed(q, SHARD).withColumnsRenamed({"block": "shard", "ids": "c_ids", "vecs": "c_vecs"})
    blocks = packed(q.filter(F.col("vec_id") % every == 0).coalesce(4), QUERY_BLOCK).withColumnRenamed("block", "qblock")
    # every block meets every shard: the few blocks are copied to each of the slots that shards are dealt to
    shards = shards.withColumn("slot", F.pmod(F.xxhash64("shard"), F.lit(slots)))
    blocks = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint"))))
    tiles = shards.hint("merge").join(blocks, ["dim", "slot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dim = b.column("dim")[r].as_py()
                qi, ci = (np.frombuffer(b.column(n)[r].as_buffer(), np.int64) for n in ("ids", "c_ids"))
                qv, cv = (np.frombuffer(b.column(n)[r].as_buffer(), np.int64).reshape(-1, dim) for n in ("vecs", "c_vecs"))
                ids, near, score = tile(qi, qv, ci, cv, k)
                shard = np.full(len(ids), b.column("shard")[r].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, shard, near, score)], names=["query_id", "node", "vec_id", "score"])

    return merged(tiles.select("dim", "ids", "vecs", "shard", "c_ids", "c_vecs").mapInArrow(run, "query_id bigint, node bigint, vec_id bigint, score bigint"), k)


def merged(lists: DataFrame, k: int) -> DataFrame:
    """Tree merge of the tiles' lists: each level joins up to FAN_IN lists of a query."""
    best = "slice(array_sort(array_distinct(flatten(collect_list(top))), (a, b) -> case when a.score <> b.score then if(a.score > b.score, -1, 1) when a.vec_id <> b.vec_id then if(a.vec_id < b.vec_id, -1, 1) else 0 end), 1, {k})"
    x = lists.select("query_id", "node", F.array(F.struct("score", "vec_id")).alias("top"))
    # rows of one tile first, then FAN_IN nodes of the tree, then all: at most k rows a node each time
    x = x.groupBy("query_id", "node").agg(F.expr(best.format(k=k)).alias("top"))
    for width in (FAN_IN**2, FAN_IN):
        x = x.groupBy("query_id", F.pmod(F.xxhash64("node"), F.lit(width)).alias("node")).agg(F.expr(best.format(k=k)).alias("top"))
    x = x.groupBy("query_id").agg(F.expr(best.format(k=k)).alias("top"))
    return x.select("query_id", F.posexplode("top").alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "t.vec_id", "t.score")
