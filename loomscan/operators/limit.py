"""Thresholds: regions and files whose metric exceeds a limit, with suppressions, change modes and hotspots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ANY, Snapshot, mask_of, type_names
from .aggregate import diff, under
from .match import file_classes, match_regions

MODES = ("all", "new", "touched", "trend")


@dataclass(frozen=True)
class Limit:
    metric: str
    value: float
    kind: str = "max"
    types: int = ANY

    @classmethod
    def parse(cls, spec: str, kind: str = "max") -> Limit:
        """From namespace:field:number[:type[,type]]."""
        parts = spec.split(":")
        if len(parts) not in (3, 4):
            raise ValueError(f"a limit is namespace:field:number[:types]: {spec}")
        return cls(":".join(parts[:2]), float(parts[2]), kind, mask_of(parts[3]) if len(parts) == 4 else ANY)

    def exceeded(self, value: Column) -> Column:
        return value > self.value if self.kind == "max" else value < self.value


def warned(mode: str, limit: Limit, modified: Column, change: Column) -> Column:
    """Whether a mode warns: what is new (modified is null) always, else by the change of what was there."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "all":
        return F.lit(True)
    worse = change > 0 if limit.kind == "max" else change < 0
    old = {"new": F.lit(False), "touched": modified, "trend": modified & worse}[mode]
    return modified.isNull() | F.coalesce(old, F.lit(False))


def warnings(cur: Snapshot, limit: Limit, prev: Snapshot | None = None, mode: str = "all", hotspots: int | None = None, suppressions: bool = True, prefix: str = "") -> DataFrame:
    """path, region_id, region, type, cursor, metric, value, modified, trend, limit of each warning.

    modified is null for what is new, trend the change since the previous snapshot. With hotspots only the worst are
    returned: in mode all the worst rows are taken before suppressions and types are looked at (so it may be fewer),
    in other modes after; ties are broken by path and region. The matcher runs once, and only over modified files.
    """
    f = cur.field_of(limit.metric)
    if mode != "all" and prev is None:
        raise ValueError("this mode needs a previous snapshot")
    value = F.col(f"`{limit.metric}`")
    rows = cur.regions if f.regions else cur.files
    rows = rows.filter(limit.exceeded(value) & under(F.col("path"), prefix))
    about = [F.col(c) for c in ("region_id", "name", "group_id", "cursor")] if f.regions else [F.lit(None).cast(t).alias(n) for n, t in (("region_id", "int"), ("name", "string"), ("group_id", "int"), ("cursor", "int"))]
    rows = rows.select("path", *about, value.cast("double").alias("value"))
    order = [F.col("value").desc() if limit.kind == "max" else F.col("value").asc(), "path", F.col("region_id").asc_nulls_first()]
    if hotspots and mode == "all":
        rows = rows.orderBy(*order).limit(hotspots)
    if prev is None:
        rows = rows.withColumns({"modified": F.lit(None).cast("boolean"), "trend": F.lit(None).cast("double")})
    else:
        rows = _with_change(rows, cur, prev, limit.metric, f.regions)
    rows = rows.filter(warned(mode, limit, F.col("modified"), F.col("trend")))
    if f.regions and limit.types != ANY:
        rows = rows.filter(F.col("group_id").bitwiseAND(limit.types) != 0)
    if suppressions and cur.suppress is not None:
        own = F.col("region_id").isNotNull() if f.regions else F.col("region_id").isNull()
        muted = cur.suppress.filter(own & F.array_contains("metrics", limit.metric)).select("path", "region_id")
        rows = rows.join(muted.hint("merge"), ["path", "region_id"] if f.regions else ["path"], "left_anti")  # no broadcast: there is no bound to them
    if hotspots and mode != "all":
        rows = rows.orderBy(*order).limit(hotspots)
    kind = type_names(F.col("group_id")) if f.regions else F.lit(None).cast("string")
    return rows.select("path", "region_id", F.col("name").alias("region"), kind.alias("type"), "cursor", F.lit(limit.metric).alias("metric"), "value", "modified", "trend", F.lit(limit.value).alias("limit"))


def _with_change(rows: DataFrame, cur: Snapshot, prev: Snapshot, metric: str, regions: bool) -> DataFrame:
    status = file_classes(cur.files, prev.files)
    rows = rows.join(status, "path")
    known = metric in prev.files.columns or metric in prev.regions.columns
    old_value = (F.col(f"`{metric}`") if known else F.lit(None)).cast("double").alias("_old")
    if regions:
        paths = status.filter("status = 'modified'").select("path")
        pairs = match_regions(cur.regions.join(paths, "path", "left_semi"), prev.regions.join(paths, "path", "left_semi")).withColumnRenamed("modified", "_modified")
        old = prev.regions.select("path", F.col("region_id").alias("prev_region_id"), old_value)
        rows = rows.join(pairs, ["path", "region_id"], "left").join(old, ["path", "prev_region_id"], "left")
        modified = F.when(F.col("status") == "new", F.lit(None)).when(F.col("status") == "unchanged", F.lit(False)).otherwise(F.col("_modified"))
    else:
        rows = rows.join(prev.files.select("path", old_value), "path", "left")
        modified = F.when(F.col("status") != "new", F.col("status") == "modified")
    rows = rows.withColumn("modified", modified)
    return rows.withColumn("trend", F.when(F.col("status") == "unchanged", F.lit(0.0)).when(F.col("modified").isNotNull(), diff(F.col("value"), F.col("_old"))))


def all_warnings(cur: Snapshot, limits: list[Limit], **options) -> DataFrame:
    """Warnings of several limits, one scan each."""
    out = warnings(cur, limits[0], **options)
    for x in limits[1:]:
        out = out.unionByName(warnings(cur, x, **options))
    return out
