"""Structured Streaming jobs (O1-O3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parapet import schemas as S
from parapet.operators.normalise import normalise, validate
from parapet.plans.evaluate import evaluate


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Stream of model documents as JSON lines with ``submission_id`` and event time ``ts``."""
    return spark.readStream.schema("submission_id string, ts timestamp, " + S.MODEL_JSON.strip()).json(path)


def stream_checks(submissions: DataFrame, rules: DataFrame, sink: Callable[[DataFrame, int], None], rejects: Callable[[DataFrame, int], None], checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """O1: findings of each new submission; invalid ones go to ``rejects``. Repeated submissions inside the watermark are dropped;
    both sinks must be idempotent per batch id."""
    once = submissions.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["submission_id"])

    def batch(df: DataFrame, batch_id: int) -> None:
        ok, bad = validate(df)
        sink(evaluate(normalise(ok), rules), batch_id)
        rejects(bad, batch_id)

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def latest_corrections(corrections: DataFrame) -> DataFrame:
    """O2: latest use and confidence of each (model, level, room); runs on a stream (update mode) or a
    batch. The state is one struct per room: a partial aggregate, not a list of corrections."""
    return corrections.groupBy("model_id", "floor_level", "room_index").agg(
        F.max("seq").alias("seq"),
        F.max_by("use", F.when(F.col("use").isNotNull(), F.col("seq"))).alias("use"),
        F.max_by(F.coalesce("confidence", F.lit("high")), "seq").alias("confidence"),
    )


def stream_corrections(corrections: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return latest_corrections(corrections).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).start()


def issue_counts_per_hour(findings: DataFrame, delay: str = "2 hours") -> DataFrame:
    """O3: issues per authority and hour; rows later than the watermark are dropped on a stream.
    ``findings(ts, authority, status)``."""
    return (
        findings.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 hour").alias("w"), "authority")
        .agg(F.count_if(F.col("status") != "pass").alias("n_issues"), F.count("*").alias("n_findings"))
        .select(F.col("w.start").alias("hour"), "authority", "n_issues", "n_findings")
    )
