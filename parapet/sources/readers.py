"""File sources and sinks (A1, A6-A13, A15). Every read has a fixed schema: no inference pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet import schemas as S
from parapet.functions import geometry as g


def read_models(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A1: building documents -> (models, rejected). A body that does not parse is rejected with its
    text, never repaired; the contract itself is checked by ``normalise.validate``."""
    return parse_models(_bodies(spark, path))


def _bodies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))


def parse_models(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A1: the parse step over ``raw`` (file, body). A null or empty body is rejected."""
    p = raw.withColumn("m", F.from_json("body", S.MODEL_JSON + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("m").isNull() | F.col("m._corrupt_record").isNotNull()
    models = p.filter(~bad).select("file", "m.*").drop("_corrupt_record").withColumn("model_id", F.coalesce("model_id", F.xxhash64("file")))
    return models, p.filter(bad).select("file", "body")


def read_clauses(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines."""
    return parse_clauses(spark.read.text(path))


def parse_clauses(raw: DataFrame) -> DataFrame:
    """One clause for each JSON line of ``raw`` (value); blank lines give none."""
    return raw.filter("trim(value) <> ''").select(F.from_json("value", S.CLAUSE).alias("c")).select("c.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, the id standing in for a missing title."""
    return parse_manifest(_bodies(spark, path))


def parse_manifest(raw: DataFrame) -> DataFrame:
    """The parse step over ``raw`` (body)."""
    m = raw.select(F.from_json("body", S.MANIFEST_JSON).alias("m")).select(F.explode("m.documents").alias("d"))
    return m.select("d.*").withColumn("title", F.coalesce("title", "doc_id"))


def verify_manifest(manifest: DataFrame, files_path: str) -> DataFrame:
    """Documents whose recorded digest differs from the file, or whose file is absent."""
    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(files_path)
    return mismatches(manifest, files)


def mismatches(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The comparison, with ``files`` (path, content)."""
    digest = files.select(F.element_at(F.split("path", "/"), -1).alias("_name"), F.sha2("content", 256).alias("actual_sha256"))
    j = manifest.withColumn("_name", F.element_at(F.split("raw_path", "/"), -1)).join(digest, "_name", "left")
    return j.filter("actual_sha256 is null or actual_sha256 <> sha256").select("doc_id", "sha256", "actual_sha256")


def require_intact(manifest: DataFrame, files_path: str) -> None:
    """Stop the run on the first mismatch."""
    bad = verify_manifest(manifest, files_path).limit(5).collect()
    if bad:
        raise ValueError("digest mismatch: " + ", ".join(r.doc_id for r in bad))


def read_pass(spark: SparkSession, path: str, kind: str = "verdicts") -> DataFrame:
    """A recorded transcription (``proposed``) or verification (``verdicts``) pass."""
    return parse_pass(_bodies(spark, path), kind)


def parse_pass(raw: DataFrame, kind: str = "verdicts") -> DataFrame:
    """The records of ``raw`` (body), each body a JSON array or a single record."""
    schema = S.PROPOSED if kind == "proposed" else S.VERDICT
    records = ", ".join(f"{n}:{t}" for n, t in (x.split() for x in schema.split(", ")))
    return raw.select(F.explode(F.from_json("body", f"array<struct<{records}>>")).alias("r")).select("r.*")


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """A10: GeoJSON polygons as ``layer, pos, props, ring`` (outer ring)."""
    return parse_layer(_bodies(spark, path))


def parse_layer(raw: DataFrame) -> DataFrame:
    """A10: the parse step over ``raw`` (file, body)."""
    features = F.from_json("body", S.LAYER_JSON)["features"]
    x = raw.select(F.regexp_extract("file", r"([^/]+)\.\w+$", 1).alias("layer"), F.posexplode(features).alias("pos", "f"))
    return x.select("layer", "pos", F.col("f.properties").alias("props"), F.expr(g.from_pairs("f.geometry.coordinates[0]")).alias("ring"))


def read_primitives(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Decoder output tables, partitioned by case."""
    return spark.read.schema(S.PRIMITIVES[table]).parquet(f"{path}/{table}")


def write_findings(findings: DataFrame, path: str) -> None:
    """A12."""
    findings.write.mode("append").partitionBy("rule_pack", "status").parquet(path)


def write_clauses(clauses: DataFrame, health: DataFrame, path: str) -> None:
    """A13."""
    clauses.write.mode("overwrite").json(f"{path}/clauses")
    health.write.mode("overwrite").json(f"{path}/health")


def write_features(features: DataFrame, path: str) -> None:
    """GeoJSON text sequences, ordered inside each task."""
    features.repartition("model_id").sortWithinPartitions("model_id", "feature_seq").select("feature").write.mode("overwrite").text(path)


def write_truth(truth: DataFrame, path: str) -> None:
    """A15."""
    truth.write.mode("overwrite").json(path)
