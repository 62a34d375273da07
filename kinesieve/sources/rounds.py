"""Tables written between the rounds of an iteration, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A temporary one only in a local session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        folder = "file://" + tempfile.mkdtemp(prefix="kinesieve-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows, written and read back: lineage ends there, and a lost executor costs only what ran on it."""
    path = f"{shared_folder(df.sparkSession)}/kinesieve/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
