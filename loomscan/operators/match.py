"""Pairing two snapshots: files by path, regions by checksum and then by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def file_classes(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """path, status: new, modified, unchanged or deleted, by path and checksum; one shuffle of narrow rows."""
    a = cur.select("path", F.col("checksum").alias("_cur"), F.lit(True).alias("_in_cur"))
    b = prev.select("path", F.col("checksum").alias("_prev"), F.lit(True).alias("_in_prev"))
    status = F.when(F.col("_in_prev").isNull(), "new").when(F.col("_in_cur").isNull(), "deleted").when(F.col("_cur").eqNullSafe(F.col("_prev")), "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def _ranked(regions: DataFrame, key: str, id_name: str) -> DataFrame:
    w = Window.partitionBy("path", key).orderBy("region_id")
    return regions.select("path", key, F.col("region_id").alias(id_name), F.row_number().over(w).alias("_rank"))


def match_regions(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """path, region_id, prev_region_id, modified of regions that have a partner in the same file.

    Regions with equal checksums are paired in order of appearance (not modified), those that are left by equal names
    likewise (modified). The n-th of one side meets the n-th of the other, so ranks and equi-joins do it.
    """
    cur, prev = cur.select("path", "region_id", "name", "checksum"), prev.select("path", "region_id", "name", "checksum")
    same = _ranked(cur, "checksum", "region_id").join(_ranked(prev, "checksum", "prev_region_id"), ["path", "checksum", "_rank"]).select("path", "region_id", "prev_region_id")
    left = cur.join(same, ["path", "region_id"], "left_anti")
    right = prev.join(same.select("path", F.col("prev_region_id").alias("region_id")), ["path", "region_id"], "left_anti")
    named = _ranked(left, "name", "region_id").join(_ranked(right, "name", "prev_region_id"), ["path", "name", "_rank"]).select("path", "region_id", "prev_region_id")
    return same.withColumn("modified", F.lit(False)).unionByName(named.withColumn("modified", F.lit(True)))


def change_classes(cur: DataFrame, prev: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scope of regions of both sides: (path, region_id, prev_region_id, scope), (path, region_id, scope).

    scope is new, touched or same; regions of unchanged files are same, of deleted ones touched. Only modified files
    are matched.
    """
    modified = files.filter("status = 'modified'").select("path")
    pairs = match_regions(cur.join(modified, "path", "left_semi"), prev.join(modified, "path", "left_semi"))
    now = cur.select("path", "region_id").join(files, "path").join(pairs, ["path", "region_id"], "left")
    scope = F.when(F.col("status") == "new", "new").when(F.col("status") == "unchanged", "same").when(F.col("prev_region_id").isNull(), "new").when(F.col("modified"), "touched").otherwise("same")
    now = now.select("path", "region_id", "prev_region_id", scope.alias("scope"))
    back = pairs.select("path", F.col("prev_region_id").alias("region_id"), "modified")
    then = prev.select("path", "region_id").join(files, "path").join(back, ["path", "region_id"], "left")
    scope = F.when(F.col("status") == "unchanged", "same").when(F.col("modified").eqNullSafe(False), "same").otherwise("touched")
    return now, then.select("path", "region_id", scope.alias("scope"))
