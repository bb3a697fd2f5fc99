"""Sends this package to Python workers and bounds what they, and other tasks, get at once."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it.

    Arrow batches are bounded by bytes too, unless the session has a bound of its own: ten thousand long texts at once
    would take hundreds of MB of an executor, in the JVM and in each worker.
    """
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    sc = spark.sparkContext
    if getattr(sc, "_loomscan_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="loomscan-zip-")) / "loomscan_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._loomscan_shipped = True


def tasks_for(spark: SparkSession, rows: int, most: int) -> int:
    """Tasks for so many rows, none with more than `most` of them on average; few rows still go to all cores, an eighth of `most` each.

    For repartition(): a small file is one task however much is made of its rows, and Spark joins partitions by their bytes,
    which say little about the rows of narrow tables.
    """
    return max(1, -(-rows // most), min(spark.sparkContext.defaultParallelism, 8 * rows // most))
