"""Helpers shared by the corpus operators: scratch storage, materialisation and code shipping."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ship as ship

#: Words everywhere in this subpackage: maximal runs of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of tables that open workspaces hold, innermost last.
_workspaces: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """URI of a new folder in the shared folder that the cluster names in spark.checkpoint.dir.

    Where that setting is missing, a local session gets a temporary folder of its own; a cluster is refused. A folder's
    name has the application's id, and it is removed when the driver's Python ends, or by clean_up().
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_loomscan_scratch", None)
    if not base:
        if not re.match(r"local($|\[)", sc.master or ""):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = sc._loomscan_scratch = "file://" + tempfile.mkdtemp(prefix="loomscan-")
    folder = f"{base.rstrip('/')}/loomscan/{name}-{getattr(sc, 'applicationId', 'application')}-{uuid.uuid4().hex}"
    if not hasattr(sc, "_loomscan_folders"):
        sc._loomscan_folders = set()
        atexit.register(clean_up, spark)
    sc._loomscan_folders.add(folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    sc._loomscan_folders.discard(folder)


def clean_up(spark: SparkSession) -> None:
    """Remove all tables that operators of this application wrote; results that weren't read yet are lost."""
    try:
        for folder in list(getattr(spark.sparkContext, "_loomscan_folders", ())):
            _remove(spark, folder)
    except Exception:  # the session or its JVM has ended, its folder stays
        return


class workspace:
    """Tables that materialize() writes inside are removed at the end, but for those it is told to keep."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> workspace:
        _workspaces.append([])
        return self

    def __exit__(self, *_) -> None:
        for folder in _workspaces.pop():
            _remove(self.spark, folder)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written as Parquet to shared storage and read again: lineage ends there and survives lost executors.

    With keep, the table outlives the workspace it is written in, for the one around it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if held := _workspaces[: -1 if keep else None]:
        held[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: What tasks cached in this worker, by operator, as functions that drop it.
_cached: dict[str, Callable[[], None]] = {}


def begin(operator: str, forget: Callable[[], None] | None = None) -> None:
    """Called in a worker where a task's Python code starts: what tasks of other operators cached there is dropped.

    Spark gives a worker to one stage after the other; the caches of all of them together would be memory that no
    single operator accounts for. `forget` drops this operator's own, for the next one.
    """
    for other in [name for name in _cached if name != operator]:
        _cached.pop(other)()
    if forget:
        _cached[operator] = forget


def freed(batches: Iterable) -> Iterator:
    """The batches of a task; before each next one, and at the end, the worker's free memory goes back to the system.

    Arrow's allocator keeps what it freed, as malloc does: a worker would hold the memory of the largest batches it had,
    while it is idle too, beside the JVM of its executor.
    """
    import pyarrow as pa

    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_fs(uri: str):
    """(file system, path) of a URI or an absolute path; any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """An output file that appears under its name only when it is whole.

    Each attempt of a task writes under a name of its own, so retried or speculative attempts never mix.
    """

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.temp = f"{os.path.dirname(self.path)}/_temp-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp, compression=None)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)


def small_enough(df: DataFrame, most: int = 8 << 20) -> bool:
    """Whether the columns in use of a materialised table have at most so many bytes in its files; decides about a broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def file_count(df: DataFrame, file_bytes: int = 32 << 20) -> int:
    """Files for df's rows: one for so many bytes of the tables it reads, at least one a core unless they are very small.

    As many as shuffle partitions where it reads no table of known size.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.length()))
    if size >= 1 << 60:
        return partitions(df.sparkSession)
    return max(1, -(-size // file_bytes), min(df.sparkSession.sparkContext.defaultParallelism, size >> 18))


def bounded(df: DataFrame) -> DataFrame:
    """A materialised table, marked for broadcast if its size allows that."""
    return F.broadcast(df) if small_enough(df) else df


HOT = 8  # a key is hot that has more than 1/HOT of a task's fair share of rows


def dealt_join(big: DataFrame, small: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """big joined with small, which has one row for each key and, in column weight, how often big has it.

    A key with more than total / (HOT * tasks) of big's rows is dealt over as many salts as it holds such shares, and its
    row of small is repeated for each; there can be HOT * tasks of such keys at most, so the list of them is broadcast.
    """
    parts = HOT * partitions(big.sparkSession)
    share = max(256.0, total / parts)
    hot = small.filter(F.col(weight) > share).select(F.col(key).alias("_hot"), F.ceil(F.col(weight) / share).cast("int").alias("_salts"))

    def salted(df: DataFrame, salt: Column) -> DataFrame:
        return df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_salts")

    salts = F.coalesce("_salts", F.lit(1))
    a = salted(big, F.pmod(F.xxhash64(*[c for c in big.columns if c != key]), salts).cast("int"))
    b = salted(small, F.explode(F.sequence(F.lit(0), salts - 1)))
    return a.join(b, [key, "_salt"], how).drop("_salt")
