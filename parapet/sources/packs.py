"""Rule packs (A4): documents with one row per rule."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.schemas import PACK_JSON

PACK_DIR = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "packs")


def _pack_rows(pack: DataFrame, name) -> DataFrame:
    """Flatten pack documents to rules; ``rule_pos`` keeps the order inside the pack."""
    return (
        pack.select(
            name.alias("rule_pack"),
            "pack_id",
            F.col("title").alias("pack_title"),
            "jurisdiction",
            F.coalesce("doc_id", "pack_id").alias("pack_doc_id"),
            F.posexplode("rules").alias("rule_pos", "r"),
        )
        .select(
            "rule_pack",
            "pack_id",
            "pack_title",
            "jurisdiction",
            "pack_doc_id",
            "rule_pos",
            F.col("r.id").alias("rule_id"),
            F.col("r.kind").alias("kind"),
            F.col("r.applies_when.authority").alias("authority"),
            F.col("r.applies_when.plot_area_sqm.min").alias("area_lo"),
            F.col("r.applies_when.plot_area_sqm.max").alias("area_hi"),
            F.coalesce("r.enforced", F.lit(True)).alias("enforced"),
            F.col("r.status").alias("rule_status"),
            "r",
        )
    )


def read_packs(spark: SparkSession, path: str = PACK_DIR) -> DataFrame:
    """All ``*.json`` packs of a folder; the file stem is the pack name models refer to.

    The packs shipped with the package are driver-side files, so they are read on the driver and
    turned into rows; any other location goes through Spark's reader.
    """
    if path == PACK_DIR:
        return packs_from_text(
            spark,
            {
                name[:-5]: open(os.path.join(path, name), encoding="utf-8").read()
                for name in sorted(os.listdir(path))
                if name.endswith(".json")
            },
        )
    raw = spark.read.schema(PACK_JSON).option("multiLine", True).json(path)
    return _pack_rows(raw, F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def packs_from_text(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Packs given as JSON text, keyed by pack name."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(b).alias("body")) for n, b in texts.items()])
    pack = spark.range(1).select(F.inline(rows)).select("name", F.from_json("body", PACK_JSON).alias("p"))
    return _pack_rows(pack.select("name", "p.*"), F.col("name"))


def packs_from_yaml(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Packs kept as YAML files (needs PyYAML on the driver)."""
    import json

    import yaml

    texts = {}
    for p in paths:
        with open(p, encoding="utf-8") as f:
            texts[os.path.splitext(os.path.basename(p))[0]] = json.dumps(yaml.safe_load(f), default=str)
    return packs_from_text(spark, texts)
