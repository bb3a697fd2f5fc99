"""Suppressions of limits, written in comments at the head of a region."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SPAN_KINDS, Field

MARK = "loomscan:"


def suppressions(tokens: DataFrame, fields: list[Field], mark: str = MARK) -> tuple[DataFrame, DataFrame]:
    """(suppressed, rejected) of the tokenizer's rows.

    mark is the text before "suppress"; sources that were annotated for another tool name that tool's here. Only the first block of comments of a region counts: comments with nothing but white space between. suppressed has
    path, region_id (null: the file's), count, metrics in order of appearance. Metrics of files may be suppressed in
    the outermost region only. rejected has path, region_id, metric, reason: unknown, misplaced or duplicate.
    A region's row has all that is said in it, so nothing is shuffled or joined.
    """
    comments = F.filter("spans", lambda s: s["kind"] == SPAN_KINDS["comment"])
    # texts of the spans between comments: a comment block ends where one isn't blank
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("state"))  # 0 before the block, 1 inside, 2 behind

    def step(a, s):
        comment = s["kind"] == SPAN_KINDS["comment"]
        blank = ~s["text"].rlike(r"(?U)\S")
        state = F.when(a["state"] == 2, 2).when(comment, 1).when((a["state"] == 1) & ~blank, 2).otherwise(a["state"])
        text = F.when(comment & (a["state"] < 2), F.concat(a["text"], F.lit("\n"), s["text"])).otherwise(a["text"])
        return F.struct(text.alias("text"), state.cast("int").alias("state"))

    head = F.when(F.size(comments) > 0, F.aggregate("spans", zero, step)["text"]).otherwise("")
    found = F.regexp_extract_all(head, F.lit(re.escape(mark) + r"[ \t]+suppress[ \t]+([^ \t\r\n*]+)"), F.lit(1))
    rows = tokens.filter("region_id is not null").select("path", "region_id", found.alias("found"))
    of_regions, of_files = ([f.column for f in fields if f.regions == r] for r in (True, False))
    first = F.col("region_id") == 1

    def named(metrics: list[str]) -> Column:
        return F.filter(F.array_distinct("found"), lambda m: m.isin(metrics))

    own = F.struct("region_id", named(of_regions).alias("metrics"))
    whole = F.struct(F.lit(None).cast("int").alias("region_id"), F.when(first, named(of_files)).otherwise(F.array().cast("array<string>")).alias("metrics"))
    good = rows.select("path", F.explode(F.filter(F.array(own, whole), lambda x: F.size(x["metrics"]) > 0)).alias("x"))
    good = good.select("path", "x.region_id", F.size("x.metrics").cast("long").alias("count"), "x.metrics")
    bad = rows.select("path", "region_id", "found", F.posexplode("found").alias("at", "metric"))
    known = F.col("metric").isin(of_regions)
    reason = F.when(~known & ~F.col("metric").isin(of_files), "unknown").when(~known & ~first, "misplaced").when(F.array_position("found", F.col("metric")) != F.col("at") + 1, "duplicate")
    return good, bad.withColumn("reason", reason).filter("reason is not null").select("path", "region_id", "metric", "reason")
