"""Snapshots as folders of Parquet tables, and incremental collection."""

from __future__ import annotations

import hashlib
import json

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Field, Snapshot
from .match import file_classes
from .metrics import REGISTRY, MetricSpec, builtin, fields_of, measure
from .spans import tokenize
from .suppress import MARK, suppressions


def config_key(specs: list[MetricSpec]) -> str:
    """Changes whenever results may: a snapshot of another configuration isn't reused."""
    said = sorted(f"{s.field}|{sorted(s.patterns.items(), key=str)}|{s.kinds}|{s.types}|{s.merge}|{s.counter.__qualname__}" for s in specs)
    return hashlib.sha256("\n".join(said).encode()).hexdigest()


def reuse(files: DataFrame, prev_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to compute again, paths whose rows of the previous snapshot still hold), by path and checksum."""
    status = file_classes(files, prev_files)
    return files.join(status.filter("status in ('new', 'modified')").select("path"), "path", "left_semi"), status.filter("status = 'unchanged'").select("path")


def collect(files: DataFrame, specs: list[MetricSpec] | None = None, prev: Snapshot | None = None, properties: dict[str, str] | None = None, mark: str = MARK) -> Snapshot:
    """A snapshot of files (path, lang, text, checksum): regions, metrics and suppressions.

    With a previous snapshot of the same configuration, only new and modified files are tokenized; rows of unchanged
    ones are taken over and vanished files are dropped. Files are tokenized once: the rows are kept on the executors'
    disks, and made again where an executor is lost, until write() has stored what is derived from them.
    """
    specs = specs if specs is not None else [*builtin(), *REGISTRY.values()]
    fields = fields_of(specs)
    key = hashlib.sha256(f"{config_key(specs)} {mark}".encode()).hexdigest()
    old = prev if prev is not None and prev.properties.get("config") == key else None
    todo, same = reuse(files, old.files) if old else (files, None)
    tokens = tokenize(todo).persist(StorageLevel.DISK_ONLY)
    regions, facts = measure(tokens, specs)
    muted, _ = suppressions(tokens, fields, mark)
    if old:
        regions = regions.unionByName(old.regions.join(same, "path", "left_semi"))
        facts = facts.unionByName(old.files.join(same, "path", "left_semi"))
        muted = muted.unionByName(old.suppress.join(same, "path", "left_semi"))
    return Snapshot(facts, regions, fields, muted, {**(properties or {}), "config": key}, tokens)


def write(snapshot: Snapshot, path: str) -> None:
    """A folder of Parquet tables; the tokenizer's rows that collect() keeps are dropped afterwards."""
    spark = snapshot.files.sparkSession
    for name in ("files", "regions", "suppress"):
        getattr(snapshot, name).write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame(list(snapshot.properties.items()) or [("", "")], "property string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/properties")
    if snapshot.tokens is not None:
        snapshot.tokens.unpersist()
    said = json.dumps([f.__dict__ for f in snapshot.fields])
    spark.createDataFrame([(said,)], "fields string").coalesce(1).write.mode("overwrite").parquet(f"{path}/fields")


def read(spark: SparkSession, path: str) -> Snapshot:
    fields = [Field(**f) for f in json.loads(spark.read.parquet(f"{path}/fields").first()[0])]
    properties = dict(tuple(r) for r in spark.read.parquet(f"{path}/properties").collect())
    return Snapshot(*(spark.read.parquet(f"{path}/{n}") for n in ("files", "regions")), fields, spark.read.parquet(f"{path}/suppress"), properties)


def below(snapshot: Snapshot, prefix: str) -> Snapshot:
    """The part of a snapshot at or below a path."""
    from .aggregate import under

    def cut(df: DataFrame | None) -> DataFrame | None:
        return df.filter(under(F.col("path"), prefix)) if df is not None else None

    return Snapshot(cut(snapshot.files), cut(snapshot.regions), snapshot.fields, cut(snapshot.suppress), snapshot.properties)


def has_path(snapshot: Snapshot, prefix: str) -> bool:
    return not below(snapshot, prefix).files.isEmpty()
