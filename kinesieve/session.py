"""Session helpers: a local session for tests and benchmarks, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cores: int | str = "*", **options: str) -> SparkSession:
    """A session on this machine, with the settings that the queries rely on (UTC above all)."""
    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    builder = SparkSession.builder.master(f"local[{cores}]").appName("kinesieve")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in options.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless PYTHONPATH leads them to it already."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(context, "_kinesieve", False):
        return
    path = Path(tempfile.mkdtemp(prefix="kinesieve-")) / "kinesieve.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted((ROOT / "kinesieve").rglob("*.py")):
            out.write(p, p.relative_to(ROOT))
    context.addPyFile(str(path))
    context._kinesieve = True
