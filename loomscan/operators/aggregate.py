"""Aggregates and distributions of metrics, of one snapshot or as differences of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Field


def under(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix or lies below it; case counts and no character is a wildcard."""
    root = prefix.rstrip("/")
    return F.lit(True) if root in ("", ".") else (path == root) | path.startswith(root + "/")


def long_form(wide: DataFrame, fields: list[Field], keys: list[str] | None = None) -> DataFrame:
    """keys, metric, value (double) for the metrics that aren't null: one pass over the wide table for all fields."""
    keys = keys or [c for c in ("path", "region_id") if c in wide.columns]
    wide = wide.select(*keys, *[F.col(f"`{f.column}`").cast("double").alias(f"_{k}") for k, f in enumerate(fields)])
    pairs = F.array(*[F.struct(F.lit(f.column).alias("metric"), F.col(f"_{k}").alias("value")) for k, f in enumerate(fields)])
    return wide.select(*keys, F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("_p")).select(*keys, "_p.metric", "_p.value")


def distribution(values: DataFrame) -> DataFrame:
    """metric, value, count, ratio, cumulative ratio: how often each value occurs."""
    counts = values.groupBy("metric", "value").agg(F.count("*").alias("count"))
    whole = Window.partitionBy("metric")
    ratio = F.col("count") / F.sum("count").over(whole)
    out = counts.withColumn("ratio", ratio)
    return out.withColumn("cumulative", F.sum("count").over(whole.orderBy("value")) / F.sum("count").over(whole))


def aggregate(values: DataFrame, fields: list[Field]) -> DataFrame:
    """metric, min, max, avg, total, count, nonzero for every field; a field without values has nulls, total 0 and count 0."""
    sums = values.groupBy("metric").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"), F.sum("value").alias("total"), F.count("value").alias("count"))
    spark = values.sparkSession
    names = spark.createDataFrame([(f.column, f.non_zero) for f in fields], "metric string, nonzero boolean")
    return names.join(sums, "metric", "left").withColumns({"total": F.coalesce("total", F.lit(0.0)), "count": F.coalesce("count", F.lit(0))}).select("metric", "min", "max", "avg", "total", "count", "nonzero")


def suppressed(suppress: DataFrame) -> DataFrame:
    """metric, sup: in how many regions each metric is suppressed (suppressions of files don't count)."""
    return suppress.filter("region_id is not null").select(F.explode(F.array_distinct("metrics")).alias("metric")).groupBy("metric").agg(F.count("*").alias("sup"))


def diff(new: Column, old: Column) -> Column:
    """new - old; no old value is 0, no new value is none."""
    return F.when(new.isNotNull(), new - F.coalesce(old, F.lit(0)))


def aggregate_diff(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """Aggregates of the current side with diff_ columns, nulls as 0 on both sides; metrics on both sides only."""
    values = ("min", "max", "avg", "total", "count")
    old = prev.select("metric", *[F.col(c).alias(f"_{c}") for c in values])
    return cur.join(old, "metric").withColumns({f"diff_{c}": F.coalesce(c, F.lit(0)) - F.coalesce(f"_{c}", F.lit(0)) for c in values}).drop(*[f"_{c}" for c in values])


def distribution_diff(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """metric, value, count, ratio, diff: values of either side; those of the old side only have count and ratio 0."""
    a, b = cur.select("metric", "value", "count", "ratio"), prev.select("metric", "value", F.col("count").alias("_old"))
    out = a.join(b, ["metric", "value"], "full_outer")
    count, old = F.coalesce("count", F.lit(0)), F.coalesce("_old", F.lit(0))
    return out.select("metric", "value", count.alias("count"), F.coalesce("ratio", F.lit(0.0)).alias("ratio"), (count - old).alias("diff"))


def scoped(values: DataFrame, scope: DataFrame, mode: str) -> DataFrame:
    """Region values of the scope new, or touched (new ones too); all: as they are."""
    if mode == "all":
        return values
    wanted = ["new"] if mode == "new" else ["new", "touched"]
    return values.join(scope.filter(F.col("scope").isin(wanted)).select("path", "region_id"), ["path", "region_id"], "left_semi")


def scoped_files(values: DataFrame, files: DataFrame, mode: str, side: str) -> DataFrame:
    """File values of a scope; side is cur or prev. new has no old side; unchanged files count in neither."""
    if mode == "all":
        return values
    wanted = {("new", "cur"): ["new"], ("new", "prev"): [], ("touched", "cur"): ["new", "modified"], ("touched", "prev"): ["modified", "deleted"]}[mode, side]
    return values.join(files.filter(F.col("status").isin(wanted)).select("path"), "path", "left_semi")
