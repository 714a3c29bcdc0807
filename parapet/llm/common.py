"""Table access, folds and output helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm.words import mix64
from parapet.session import shared_folder

HELD_OUT_FOLD = 2
#: rows of an Arrow batch: with texts of a few KB, some MB on either side of the pipe
BATCH_ROWS = 1500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str = "doc_id"):
    """crc32 of the id written as text, mod 4; rows whose fold is 2 are never learned from."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 4


def give_back() -> None:
    """Return freed memory of this Python process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df``. Batches are kept to BATCH_ROWS rows of text, and a
    worker gives its memory back after each task, because it waits for others of the same executor."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield fn(b)
        give_back()

    return df.mapInArrow(run, schema)


#: whether Spark deletes the shuffle files of a query when the query ends, not when the driver collects garbage
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` as a table in the folder of ``spark.checkpoint.dir`` and read it back.

    Unlike a checkpoint, the table's size is known to later joins: Spark broadcasts it only where it is
    under spark.sql.autoBroadcastJoinThreshold, and sorts and merges beyond that. With ``free``, the shuffle
    files that the write has made are deleted once the table is there.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE, None)
    try:
        if free:
            spark.conf.set(FREE, "true")
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later plan reads; results that came from them are
    written tables themselves, so a lost executor never asks for them again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("table-"):
                path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: bits of an id filter: two megabytes whatever the number of ids. With very many ids it lets more rows
#: through, up to all; it never loses one.
ID_BITS = 24


def _id_slots(ids: pa.Array) -> np.ndarray:
    return (mix64(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - ID_BITS)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bits of the slots of the ids in the one column of ``ids``."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        s = np.unique(_id_slots(b.column(0)))
        return pa.RecordBatch.from_arrays([pa.array(s >> 6), pa.array(np.int64(1) << (s & 63))], names=["word", "bits"])

    rows = map_batches(ids, fn, "word bigint, bits bigint").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(1 << (ID_BITS - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def in_filter(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the unsigned ids may be in the filter."""
    s = (mix64(ids) >> np.uint64(64 - ID_BITS)).astype(np.int64)
    return ((bits[s >> 3] >> (s & 7)) & 1).astype(bool)


def maybe_in(df: DataFrame, bits: np.ndarray, wanted: bool = True) -> DataFrame:
    """Rows of ``df`` whose doc_id is in the filter (or, if not ``wanted``, is surely not one of its ids).
    Spares the shuffle of the other rows' texts before a join on few ids."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        s = _id_slots(b.column("doc_id").cast(pa.int64()))
        return b.filter(pa.array(((bits[s >> 3] >> (s & 7)) & 1).astype(bool) == wanted))

    return map_batches(df, fn, df.schema)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``gone`` (doc_id); rows with a null doc_id stay."""
    bits = id_filter(gone)
    some = maybe_in(docs, bits).join(gone, "doc_id", "left_anti").select(docs.columns)
    return maybe_in(docs, bits, wanted=False).unionByName(some)
