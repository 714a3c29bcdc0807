"""Session helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster job brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("parapet")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
    )
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; tests and the benchmark set one of their own."""
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        # one process: driver and tasks share this folder
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def in_place(df: DataFrame) -> DataFrame:
    """``df``, whose joins by model and more need no shuffle where both sides are dealt by model already."""
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df


def spread(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join by a key that grows with the data: shuffled, never sent whole through the driver.

    Spark guesses the size of a table from its compressed files, before rings are built and rows exploded.
    That guess may lie under the broadcast limit where the table itself has gigabytes.
    """
    return df.hint("merge")
