"""Export, overview and information tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Snapshot, type_names
from .match import file_classes, match_regions


def export(cur: Snapshot, prev: Snapshot | None = None) -> DataFrame:
    """One row a region and then one a file: file, region, type, modified, line start, line end and all metrics by name.

    Sorted by file and region. modified is null for what is new, and without a previous snapshot.
    """
    names = sorted({f.column for f in cur.fields})
    own = {f.column: f.regions for f in cur.fields}

    def metrics(regions: bool) -> list:
        return [(F.col(f"`{n}`") if own[n] == regions else F.lit(None)).alias(n) for n in names]

    regions, files = cur.regions, cur.files
    whole = regions.filter("region_id = 1").select("path", F.col("line_begin").alias("_first"), F.col("line_end").alias("_last"))
    if prev is None:
        regions, files = regions.withColumn("_modified", F.lit(None).cast("boolean")), files.withColumn("_modified", F.lit(None).cast("boolean"))
    else:
        pairs = match_regions(regions, prev.regions).select("path", "region_id", F.col("modified").alias("_modified"))
        regions = regions.join(pairs, ["path", "region_id"], "left")
        status = file_classes(cur.files, prev.files)
        files = files.join(status, "path").withColumn("_modified", F.when(F.col("status") != "new", F.col("status") == "modified"))
    a = regions.select(F.col("path").alias("file"), F.col("region_id").alias("_order"), F.col("name").alias("region"), type_names(F.col("group_id")).alias("type"), F.col("_modified").alias("modified"), F.col("line_begin").alias("line start"), F.col("line_end").alias("line end"), *metrics(True))
    b = files.join(whole, "path", "left").select(F.col("path").alias("file"), F.lit(None).cast("int").alias("_order"), F.lit(None).cast("string").alias("region"), F.lit("file").alias("type"), F.col("_modified").alias("modified"), F.col("_first").alias("line start"), F.col("_last").alias("line end"), *metrics(False))
    return a.unionByName(b).orderBy("file", F.col("_order").asc_nulls_last()).drop("_order")


def warnings_by_region(regions: DataFrame, warnings: DataFrame) -> DataFrame:
    """path, region, n_warnings: regions of one name count together, those without warnings have 0."""
    counts = warnings.filter("region is not null").groupBy("path", "region").agg(F.count("*").alias("n_warnings"))
    names = regions.select("path", F.col("name").alias("region")).distinct()
    return names.join(counts, ["path", "region"], "left").withColumn("n_warnings", F.coalesce("n_warnings", F.lit(0)))


def overview(cur: Snapshot, warnings: DataFrame) -> DataFrame:
    """A row a file: path, n_warnings, and each file metric as text, - where it is missing."""
    counts = warnings.groupBy("path").agg(F.count("*").alias("n_warnings"))
    shown = [F.coalesce(F.col(f"`{f.column}`").cast("string"), F.lit("-")).alias(f.column) for f in sorted(cur.fields, key=lambda f: f.column) if not f.regions]
    return cur.files.join(counts, "path", "left").select("path", F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"), *shown)


def file_info(cur: Snapshot, prev: Snapshot | None = None) -> DataFrame:
    """path, checksum, change: '', [new] or [modified]."""
    if prev is None:
        return cur.files.select("path", "checksum", F.lit("").alias("change"))
    change = F.when(F.col("status") == "new", "[new]").when(F.col("status") == "modified", "[modified]").otherwise("")
    return cur.files.join(file_classes(cur.files, prev.files), "path").select("path", "checksum", change.alias("change"))


def property_info(cur: DataFrame, prev: DataFrame | None = None) -> DataFrame:
    """property, value, change of property tables: '', [new], or [modified (was: ...)]."""
    if prev is None:
        return cur.select("property", "value", F.lit("").alias("change"))
    old = prev.select("property", F.col("value").alias("_was"), F.lit(True).alias("_there"))
    change = F.when(F.col("_there").isNull(), "[new]").when(F.col("value").eqNullSafe(F.col("_was")), "").otherwise(F.concat(F.lit("[modified (was: "), F.coalesce("_was", F.lit("None")), F.lit(")]")))
    return cur.join(old, "property", "left").select("property", "value", change.alias("change"))


def directory_content(files: DataFrame, folder: str) -> DataFrame:
    """kind (dir or file) and name of what lies directly in a folder; ./ or an empty string is the top."""
    root = folder.strip("/") if folder.strip("/") not in ("", ".") else "."
    depth = root.count("/") + 1
    inside = files.filter(F.col("path").startswith(root + "/")).select(F.split("path", "/").alias("p"))
    kind = F.when(F.size("p") > depth + 1, "dir").otherwise("file")
    return inside.select(kind.alias("kind"), F.element_at("p", depth + 1).alias("name")).distinct()


def region_tree(regions: DataFrame) -> DataFrame:
    """path, region_id, parent_id, depth, trail: names from the file's root, level by level within files.

    Trees are as deep as code nests; levels are found by following parents, all files at once.
    """
    level = regions.filter("parent_id is null").select("path", "region_id", "parent_id", F.lit(0).alias("depth"), F.col("name").alias("trail"))
    rest = regions.filter("parent_id is not null").select("path", "region_id", "parent_id", "name")
    out = level
    while True:
        up = level.select("path", F.col("region_id").alias("parent_id"), F.col("depth").alias("_depth"), F.col("trail").alias("_trail"))
        level = rest.join(up, ["path", "parent_id"]).select("path", "region_id", "parent_id", (F.col("_depth") + 1).alias("depth"), F.concat_ws("/", "_trail", "name").alias("trail"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
