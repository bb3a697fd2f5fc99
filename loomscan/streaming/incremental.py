"""Collection as files arrive: each micro-batch makes the next snapshot from the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store
from ..operators.metrics import MetricSpec
from ..sources.files import with_facts


def merge_batch(files: DataFrame, prev: store.Snapshot | None, specs: list[MetricSpec] | None = None) -> store.Snapshot:
    """The previous snapshot with the files of a batch (path, lang, text) new or replaced; of equal paths the last text."""
    w = Window.partitionBy("path").orderBy(F.xxhash64("text"))
    files = with_facts(files.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank"))
    new = store.collect(files, specs)
    if prev is None:
        return new
    keep = files.select("path")
    return store.Snapshot(new.files.unionByName(prev.files.join(keep, "path", "left_anti")), new.regions.unionByName(prev.regions.join(keep, "path", "left_anti")), new.fields, new.suppress.unionByName(prev.suppress.join(keep, "path", "left_anti")), new.properties)


def collect_stream(files: DataFrame, folder: str, checkpoint: str, specs: list[MetricSpec] | None = None) -> StreamingQuery:
    """Starts a query that keeps snapshots folder/0, folder/1, ... of a stream of files; a batch run again overwrites its own."""

    def run(batch: DataFrame, n: int) -> None:
        prev = store.read(batch.sparkSession, f"{folder}/{n - 1}") if n else None
        store.write(merge_batch(batch, prev, specs), f"{folder}/{n}")

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
