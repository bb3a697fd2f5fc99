"""Mixing sources to target weights (operator 7): weighted fair queueing, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, bounded, file_count, materialize, table, workspace

KEY_BITS, BUCKET_BITS = 60, 12
BINS = 65_536  # of one unit of virtual time
FILE_BYTES = 16 << 20  # of the input for each file of the mix: a task sorts the texts of one in memory, copies included


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(id_col: Column, seed: str) -> Column:
    """60 bits of an md5 of the id: a fixed random order."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources: source, source_size in; rank and target added.

    Sources in code-point order, null last, take the weights in turn and share `share` times the whole size; a target
    stops at `most` times its source's size and what is over is shared again. With sources by rising cap/weight the
    capped ones come first, so the level is the largest of (what is left)/(weights left) over all such prefixes.
    One row a source, so the windows over all of them are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ws = F.array(*[F.lit(float(w)) for w in weights])
    x = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(ws, F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
    x = x.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(whole).cast("double") * F.lit(share) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))
    x = x.withColumn("level", left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))))
    x = x.withColumn("target", F.least(F.col("cap"), F.max("level").over(whole) * F.col("weight")))
    return x.select("source", "source_size", "rank", "target")


def _finish_times(rows: DataFrame, sources: DataFrame, copies: int) -> DataFrame:
    """Adds source_size, target, rank and finish (the virtual finish time of each copy) to row_id, id, source, size, key.

    A source's running sum is taken in two levels, by buckets of the random key, so a hot source meets in no one task.
    """
    rows = rows.withColumn("bucket", F.shiftright("key", KEY_BITS - BUCKET_BITS))
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(in_source), F.lit(0)))
    offsets = offsets.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "n")
    offsets = offsets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "source_size", "target", "rank")
    joined = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    through = F.col("before") + F.sum("size").over(in_bucket)
    finish = [F.when(F.col("target") > 0, (through + F.col("source_size") * c).cast("double") / F.col("target")) for c in range(copies)]
    return joined.withColumn("finish", F.array(*finish)).select("row_id", "id", "source", "size", "key", "source_size", "target", "rank", "finish")


def _numbered(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *more: Column) -> DataFrame:
    """A table of row_id, id, source, size and key, and of more columns; numbers are fixed by writing it."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), shuffle_key(F.col(id_col), seed).alias("key"), *more)
    return materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "mix-rows", keep=True)


def _mixed(rows: DataFrame, weights: tuple[int, ...], share: float, most: int, keep: bool) -> DataFrame:
    """A table of _finish_times with copies, the number of each row's copies that the mix takes."""
    rows = rows.select("row_id", "id", "source", "size", "key")
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, float(most))
    timed = materialize(_finish_times(rows, sources, most), "mix-times", keep)
    copies = timed.select("id", "size", "key", "rank", F.posexplode("finish").alias("copy", "at")).filter("at is not null and size > 0")
    copies = copies.withColumn("bin", F.least(F.floor(F.col("at") * BINS), F.lit(2 * BINS)))
    budget = F.floor(F.lit(share) * F.lit(rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = copies.groupBy("bin").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(upto))
    over = bins.filter(F.col("upto") > budget).agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("before")), "bin").alias("x")).first()["x"]
    order = ("at", "rank", "key", "id", "size")
    if over is None:
        taken = F.size(F.filter("finish", lambda f: f.isNotNull()))
    else:
        inside = copies.filter(F.col("bin") == over["bin"]).withColumn("upto", F.lit(over["before"]) + F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        last = inside.filter(F.col("upto") <= budget).agg(F.max(F.struct(*order)).alias("x")).first()["x"]
        if last is None:
            within = lambda f: F.floor(f * BINS) < over["bin"]
        else:
            edge = F.struct(*[F.lit(last[c]).cast(copies.schema[c].dataType).alias(c) for c in order])
            within = lambda f: F.struct(f.alias("at"), *[F.col(c) for c in order[1:]]) <= edge
        taken = F.size(F.filter("finish", lambda f: f.isNotNull() & within(f)))
    return timed.withColumn("copies", F.when(F.col("size") > 0, taken).otherwise(0))


def fair_queue_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """Mix of all documents: id, size, source_size, target, taken, copies, finish (times of its copies), source_name.

    Each source is shuffled by a hash of the id and repeats up to `most` times. The virtual finish time of a copy is
    the words of its source up to and with it, divided by the source's target; all copies are taken in the order of
    finish time (ties: source, hash, id) while the words taken stay within `share` times all words. The cut is found
    from the sums of fine bins of finish time and then exactly in the bin where the budget ends, so nothing is sorted
    in one task and reruns agree. repeat_mixed gives the mix itself, in that order.

    Null or blank texts have size 0 and are taken 0 words; null sources are one source, the last; rows that repeat an
    id each count; an empty table gives no rows. Other columns are ignored.
    """
    with workspace(docs.sparkSession):
        out = _mixed(_numbered(docs, id_col, text_col, source_col, seed), weights, share, most, True)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "finish", F.col("source").alias("source_name"))


def repeat_mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """The mix: rows of docs, each as often as it is taken, range-sorted by the finish times of the copies.

    Each row has copies of its own, whatever its id; the columns are those of docs. Written as files, part numbers and
    places in them keep the order (see tokens.stored_order). Rows are told apart by 128 bits of a hash of id, source and
    text, so their texts aren't stored; where rows repeat all three, they are, with a number.
    """
    spark = docs.sparkSession
    names = ("_loomscan_1", "_loomscan_2")
    hashes = [F.xxhash64(F.lit(n), F.col(id_col).cast("long"), F.col(source_col), F.col(id_col).isNull(), F.col(source_col).isNull(), F.col(text_col)).alias(n) for n in names]
    with workspace(spark):
        rows = _numbered(docs, id_col, text_col, source_col, seed, *hashes)
        mixed = _mixed(rows, weights, share, most, False).filter("copies > 0").select("row_id", F.slice("finish", F.lit(1), F.col("copies")).alias("_loomscan_at"))
        if rows.groupBy(*names).count().filter("count > 1").isEmpty():
            mixed = mixed.join(rows.select("row_id", *names), "row_id").drop("row_id")
            mixed = materialize(mixed, "mix-copies", keep=True)
            found = docs.select(F.struct("*").alias("row"), *hashes).join(bounded(mixed), list(names))
        else:
            rows = _numbered(docs, id_col, text_col, source_col, seed, F.struct("*").alias("row"))
            mixed = _mixed(rows, weights, share, most, False).filter("copies > 0").select("row_id", F.slice("finish", F.lit(1), F.col("copies")).alias("_loomscan_at"))
            mixed = materialize(mixed, "mix-copies", keep=True)
            found = rows.select("row", "row_id", F.col("row_id").alias(names[0])).join(bounded(mixed), "row_id")
    order = ("at", names[0], "copy")
    mix = found.select("row", names[0], F.posexplode("_loomscan_at").alias("copy", "at"))
    return mix.repartitionByRange(file_count(docs, FILE_BYTES), *order).sortWithinPartitions(*order).select("row.*")


def op7_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_queue_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op7_fair_queue_mix": op7_fair_queue_mix}
ORACLES = {
    "op7_fair_queue_mix": """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             source_size::DOUBLE * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w),
t AS (SELECT source, source_size, rank, least(cap, max(level) OVER () * weight) AS target FROM l),
f AS (SELECT d.doc_id, d.size, d.key, t.source_size, t.target, t.rank,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT f.*, k, (upto + k * source_size)::DOUBLE / target AS fin
      FROM f, (VALUES (0), (1)) v(k) WHERE target > 0 AND size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY fin, rank, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS taken_upto FROM c),
n AS (SELECT doc_id, key, rank, size, count(*) AS copies FROM o
      WHERE taken_upto <= floor(1.5 * (SELECT sum(size) FROM d)) GROUP BY ALL)
SELECT f.doc_id, f.size, f.source_size, f.target, (f.size * coalesce(n.copies, 0))::BIGINT AS taken
FROM f LEFT JOIN n ON f.doc_id IS NOT DISTINCT FROM n.doc_id AND f.rank = n.rank AND f.size = n.size AND f.key = n.key
"""
}
