"""The actions over snapshots: view, limit, report, export and info, as nested results of plain values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators.histogram import compress_distribution
from ..operators.match import change_classes, file_classes
from ..operators.report import directory_content
from ..operators.store import below
from ..schema import Snapshot, type_names


def values_of(s: Snapshot) -> tuple[DataFrame, DataFrame]:
    """(region values, file values), long."""
    return A.long_form(s.regions, s.numeric(True), ["path", "region_id"]), A.long_form(s.files, s.numeric(False), ["path"])


def sides(cur: Snapshot, prev: Snapshot | None, mode: str = "all") -> tuple[DataFrame, DataFrame | None]:
    """Values (metric, value) of both snapshots within a scope: all, new or touched."""
    regions, files = values_of(cur)
    if mode == "all" or prev is None:
        if mode != "all":
            raise ValueError("this scope needs a previous snapshot")
        now = regions.select("metric", "value").unionByName(files.select("metric", "value"))
        return now, None if prev is None else sides(prev, None)[0]
    status = file_classes(cur.files, prev.files)
    scope, old_scope = change_classes(cur.regions, prev.regions, status)
    old_regions, old_files = values_of(prev)
    now = A.scoped(regions, scope, mode).select("metric", "value").unionByName(A.scoped_files(files, status, mode, "cur").select("metric", "value"))
    if mode == "new":
        return now, now.limit(0)
    then = A.scoped(old_regions, old_scope, mode).select("metric", "value").unionByName(A.scoped_files(old_files, status, mode, "prev").select("metric", "value"))
    return now, then


def summary(cur: Snapshot, prev: Snapshot | None = None, mode: str = "all", bars: int = 20) -> tuple[DataFrame, DataFrame]:
    """(aggregates, bars) with differences to prev where it is given."""
    now, then = sides(cur, prev, mode)
    fields = [f for f in cur.fields if f.kind != "string"]
    real = tuple(f.column for f in fields if f.kind == "double")
    totals, dist = A.aggregate(now, fields), A.distribution(now)
    if then is not None:
        old = [f for f in prev.fields if f.kind != "string"]
        totals = A.aggregate_diff(totals, A.aggregate(then, old))
        dist = A.distribution_diff(dist, A.distribution(then))
    if cur.suppress is not None:
        totals = totals.join(A.suppressed(cur.suppress), "metric", "left").withColumn("sup", F.coalesce("sup", F.lit(0)))
    return totals, compress_distribution(dist, real, bars)


def view(cur: Snapshot, prev: Snapshot | None = None, path: str = "./", mode: str = "all", bars: int = 20, nest: bool = False) -> dict:
    """The tree of a path: info, aggregated-data by namespace and field, file-data with regions, subdirs, subfiles."""
    c, p = below(cur, path), below(prev, path) if prev else None
    totals, hist = summary(c, p, mode, bars)
    by_metric: dict[str, list] = {}
    for r in hist.orderBy("metric", "bar").collect():
        by_metric.setdefault(r["metric"], []).append({"metric": r["label"], "count": r["count"], "ratio": r["ratio"]} | ({"__diff__": r["diff"]} if prev else {}))
    data: dict = {}
    for r in totals.orderBy("metric").collect():
        ns, name = r["metric"].rsplit(":", 1)
        own = {k: r[k] for k in ("max", "min", "avg", "total", "count", "nonzero")} | {"sup": r["sup"] if "sup" in totals.columns else 0}
        own["distribution-bars"] = by_metric.get(r["metric"], [])
        if prev:
            own["__diff__"] = {k: r[f"diff_{k}"] for k in ("max", "min", "avg", "total", "count")}
        data.setdefault(ns, {})[name] = own
    here = directory_content(cur.files, path).orderBy("kind", "name").collect()
    out = {"info": {"path": path, "id": 1}, "aggregated-data": data, "file-data": {}, "subdirs": [r["name"] for r in here if r["kind"] == "dir"], "subfiles": [r["name"] for r in here if r["kind"] == "file"]}
    if not here and (own_file := c.files.filter(F.col("path") == path).first()):
        out["file-data"] = _file_data(c, own_file.asDict(), nest)
    return out


def _file_data(c: Snapshot, own: dict, nest: bool) -> dict:
    def metrics(row: dict, regions: bool) -> dict:
        found: dict = {}
        for f in c.fields:
            if f.regions == regions and row.get(f.column) is not None:
                found.setdefault(f.namespace, {})[f.name] = row[f.column]
        return found

    rows = c.regions.withColumn("type", type_names(F.col("group_id"))).orderBy("region_id").collect()
    flat = {r["region_id"]: {"info": {"name": r["name"], "type": r["type"], "cursor": r["cursor"], "line_begin": r["line_begin"], "line_end": r["line_end"]}, "data": metrics(r.asDict(), True), "subregions": []} for r in rows}
    top = list(flat.values())
    if nest:
        top = []
        for r in rows:
            (flat[r["parent_id"]]["subregions"] if r["parent_id"] in flat else top).append(flat[r["region_id"]])
    return metrics(own, False) | {"regions": top}
