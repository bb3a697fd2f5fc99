"""The tokenizer stage, and relations over spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokenizer import region_rows
from ..schema import ANY, REGIONS
from ..workers import ship

#: Stands between texts that don't touch; private-use characters that no metric pattern names.
EDGE = "\ue000\ue001"
BATCH = 2_000_000


_SPAN = pa.struct([("kind", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("text", pa.string())])
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of schema.REGIONS as Arrow columns; spans, the last of them, as flat arrays with offsets."""
    *plain, spans = zip(*rows)
    kinds = [x.split() for x in REGIONS.split(", spans")[0].split(", ")]
    flat = list(zip(*(s.values() for x in spans for s in x))) or [[]] * 4
    offsets = np.cumsum([0, *map(len, spans)], dtype=np.int32)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, _SPAN)], fields=list(_SPAN))
    arrays = [pa.array(c, _TYPES[t]) for c, (_, t) in zip(plain, kinds)]
    return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(offsets, values)], names=[*(n for n, _ in kinds), "spans"])


def tokenize(files: DataFrame) -> DataFrame:
    """Rows of schema.REGIONS of files (path, lang, text); the only stage with Python workers. Null texts are empty.

    Files go through in Arrow batches, and their rows come back in batches of about BATCH characters of text.
    """
    ship(files.sparkSession)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                path, lang, text = (batch.column(c)[k].as_py() for c in range(3))
                held += region_rows(path, lang, text or "")
                size += len(text or "") + 256
                if size >= BATCH:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)

    return files.select("path", "lang", "text").mapInArrow(run, REGIONS)


def texts(spans: Column, kinds: int = ANY, merge: bool = False) -> Column:
    """Texts of the spans of some kinds; merge joins those that touch."""
    some = F.filter(spans, lambda s: s["kind"].bitwiseAND(kinds) != 0)
    if not merge:
        return F.transform(some, lambda s: s["text"])
    ends = F.concat(F.array(F.lit(None).cast("int")), F.transform(some, lambda s: s["end"]))
    parts = F.transform(some, lambda s, i: F.concat(F.when((i > 0) & (F.get(ends, i) != s["begin"]), EDGE).otherwise(""), s["text"]))
    return F.when(F.size(some) > 0, F.split(F.array_join(parts, ""), EDGE)).otherwise(F.array().cast("array<string>"))


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, kind, begin, end) with those that touch joined and their kinds united: gaps and islands."""
    w = Window.partitionBy(*keys).orderBy("begin", "end")
    fresh = F.when(F.lag("end").over(w).eqNullSafe(F.col("begin")), 0).otherwise(1)
    x = spans.withColumn("_island", fresh).withColumn("_island", F.sum("_island").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "_island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.bit_or("kind").alias("kind")).drop("_island")


def innermost(spans: DataFrame, regions: DataFrame, keys: list[str], region_id: str = "region_id") -> DataFrame:
    """Spans (keys, begin, ...) with the id of the innermost region (keys, id, begin, end) in which they begin.

    An equi-join on the keys with a range condition; the latest region to begin wins, and of those the one with the
    larger id. Spans in no region are left out; equal spans are one. Regions of a key are those of a file or so.
    """
    r = regions.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col(region_id).alias("_r_id"), F.col("begin").alias("_r_begin"), F.col("end").alias("_r_end"))
    on = [F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col("_r_begin") <= F.col("begin"), F.col("begin") < F.col("_r_end")]
    return spans.join(r, on).groupBy(*spans.columns).agg(F.max_by("_r_id", F.struct("_r_begin", "_r_id")).alias(region_id))
