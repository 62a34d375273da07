"""Tables written between the steps of an operator, in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in a local session without it (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        folder = "file://" + tempfile.mkdtemp(prefix="kinesieve-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let Spark hand texts to Python in small batches: a batch of its usual 10,000 long texts takes
    more of a worker's memory than what the operators hold."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def unique() -> str:
    return uuid.uuid4().hex


@contextlib.contextmanager
def made() -> Iterator[list[str]]:
    """Inside the block, gathers the tables that are made and not yet deleted at its end."""
    before, paths = set(_made), []
    yield paths
    paths += [x for x in _made if x not in before]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/kinesieve/{name}-{unique()}"
    _made.append(path)
    return path


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside the block, a query's shuffle files go when it ends, not when the driver next happens to
    collect its garbage: operators of many steps would hold those of all steps at once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def keep(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends there, and a lost
    executor costs only what was running on it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with shuffles_dropped(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that no later step reads."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in _made:
            _made.remove(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table made by keep()."""
    folders = {x.rpartition("/")[0] for x in df.inputFiles()}
    drop(df.sparkSession, *[x for x in _made if any(f"/{x.rpartition('/')[2]}" in f for f in folders)])


def drop_part(df: DataFrame, part: str) -> None:
    """Delete one partition folder of a table made by keep(..., partition_by=...)."""
    for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if path.endswith("/" + part):
            drop(df.sparkSession, path)
