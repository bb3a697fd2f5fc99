"""Line dedup (operator 10): recurring templates of a fixed-depth log-template tree, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, dealt_join, materialize, small_enough, table, workspace

SPACE = r"[\x20\x09-\x0D]"
ANY = "<*>"


def masked(line: Column) -> Column:
    """Tokens of a line with one space between them; a token that has a digit is a variable field, <*>.

    Most lines need neither replacement, and finding that out costs little.
    """
    plain = F.when(line.rlike(r"[\t\x0B\f\r]|  |^ | $"), F.trim(F.regexp_replace(line, f"{SPACE}+", " "))).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(plain, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", ANY)).otherwise(plain)


def _looked_up(big: DataFrame, small: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """big joined with a table that has a row for each key and big's rows with it in column w."""
    if small_enough(small):
        return big.join(F.broadcast(small.drop("w")), key, how)
    return dealt_join(big, small, key, "w", total, how).drop("w")


def template_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 4, min_tokens: int = 5, min_docs: int = 3, short_docs: int = 20, long_tokens: int = 50, long_docs: int = 2, similarity: float = 0.6, min_fixed: int = 4, shares: tuple[float, ...] = (0.0, 0.1, 0.5)
) -> DataFrame:
    """Lines whose template recurs: id, text_hash, line (from 0), template, n_docs.

    A line's tokens that have a digit are variable fields, <*>. Lines that are the same then recur if min_docs documents
    have them: long_docs, if they have long_tokens tokens, short_docs, if they have fewer than min_tokens.

    The others, of min_tokens or more, go down a tree of fixed depth: by number of tokens and the first `depth` tokens.
    A branch is its own if min_docs documents reach it, else one of its tokens becomes <*>, the first with which they
    do. A leaf can hold several templates: a line keeps its tokens that min_docs documents' lines have at that place of
    the leaf, and a share of all of them (the least of `shares` first); the rest are variable fields. The line takes the
    first of these templates that recurs and in which `similarity` of the places, and min_fixed, aren't variable.

    Leaves, lines and templates are told apart by 64-bit hashes. Equal lines are counted before their tokens are, and
    keys that very many lines have are dealt over tasks.
    """
    text = F.col(text_col)
    everywhere = F.when(F.col("n") < min_tokens, short_docs).when(F.col("n") >= long_tokens, long_docs).otherwise(min_docs)
    with workspace(docs.sparkSession):
        # masked inside the array, before the rows are made: conditions on m can't move below and compute it again
        rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.transform(F.split(text, "\n"), masked)).alias("line", "m")).filter(F.col("m") != "")
        rows = rows.withColumn("n", F.length("m") - F.length(F.replace(F.col("m"), F.lit(" "), F.lit(""))) + 1)
        rows = materialize(rows.withColumn("who", F.xxhash64("id")).withColumn("k", F.xxhash64("m")), "lines", keep=True)
        total = rows.count()
        exact = rows.groupBy("k").agg(F.count_distinct("who").alias("n_docs"), F.min("n").alias("n"), F.count("*").alias("w")).filter(F.col("n_docs") >= everywhere)
        exact = materialize(exact.select("k", "n_docs", "w"), "line-exact", keep=True)
        known = _looked_up(rows, exact, "k", total, "left")
        rest = known.filter(F.col("n_docs").isNull() & (F.col("n") >= min_tokens)).drop("n_docs")

        words = F.slice(F.split("m", " ", depth + 1), 1, depth)
        branches = [F.xxhash64("n", words), *[F.xxhash64("n", F.concat(F.slice(words, 1, j), F.array(F.lit(ANY)), F.slice(words, j + 2, depth))) for j in range(depth)]]
        reached = rest.select("k", "who", F.posexplode(F.array(*branches)).alias("wild", "leaf"))
        leaves = reached.groupBy("leaf").agg(F.count_distinct("who").alias("docs"), F.count("*").alias("w")).filter(F.col("docs") >= min_docs)
        leaves = materialize(leaves.select("leaf", "w"), "line-leaves")
        chosen = _looked_up(reached.select("k", "wild", "leaf"), leaves, "leaf", total * (depth + 1)).groupBy("k").agg(F.min(F.struct("wild", "leaf")).alias("x"))
        chosen = bounded(materialize(chosen.select("k", "x.leaf"), "line-chosen"))
        near = materialize(rest.join(chosen, "k").select("id", "text_hash", "line", "who", "k", "leaf", "m", "n"), "line-near", keep=True)

        lines = materialize(near.groupBy("k", "leaf").agg(F.count_distinct("who").alias("docs"), F.min("m").alias("m")), "line-masked")
        tokens = lines.select("k", "leaf", "docs", F.posexplode(F.split("m", " ")).alias("place", "token")).withColumn("at", F.xxhash64("leaf", "place", "token"))
        support = tokens.groupBy("at").agg(F.sum("docs").alias("s"), F.count("*").alias("w")).filter(F.col("s") >= min_docs)
        support = materialize(support, "line-support")
        sizes = materialize(lines.groupBy("leaf").agg(F.sum("docs").alias("all"), F.count("*").alias("w")), "line-sizes")
        tokens = _looked_up(tokens.select("k", "leaf", "place", "token", "at"), support, "at", near.count(), "left")
        lists = tokens.groupBy("k", "leaf").agg(F.sort_array(F.collect_list(F.struct("place", "token", F.coalesce("s", F.lit(0)).alias("s")))).alias("x"))  # bounded by a line
        lists = _looked_up(lists, sizes, "leaf", near.count())

        def shape(share: float):
            return F.transform("x", lambda x: F.when((x["s"] >= min_docs) & (x["s"] >= share * F.col("all")), x["token"]).otherwise(ANY))

        named = lists.select("k", "leaf", F.posexplode(F.array(*[shape(x) for x in shares])).alias("level", "shape"))
        fixed = F.size(F.filter("shape", lambda t: t != ANY))
        named = named.filter((fixed >= min_fixed) & (fixed >= similarity * F.size("shape"))).select("k", "level", F.array_join("shape", " ").alias("template"), F.size("shape").alias("n"), F.xxhash64("leaf", "shape").alias("t"))
        named = materialize(named, "line-named")
        found = named.select("k", "t", "n").distinct().join(near.select("k", "who").distinct(), "k")
        often = found.groupBy("t").agg(F.count_distinct("who").alias("n_docs"), F.min("n").alias("n")).filter(F.col("n_docs") >= everywhere).select("t", "n_docs")
        often = materialize(often.join(named.groupBy("t").agg(F.count("*").alias("w")), "t"), "line-often")
        first = _looked_up(named.select("k", "level", "template", "t"), often, "t", near.count()).groupBy("k").agg(F.min(F.struct("level", "template", "n_docs")).alias("x"))
        first = materialize(first.select("k", "x.template", "x.n_docs"), "line-templates", keep=True)
    same = known.filter(F.col("n_docs").isNotNull()).select("id", "text_hash", "line", F.col("m").alias("template"), "n_docs")
    return same.union(near.select("id", "text_hash", "line", "k").join(bounded(first), "k").select("id", "text_hash", "line", "template", "n_docs"))


def drop_template_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the recurring lines dropped from their text, and n_lines and n_dropped before it.

    Result: id, n_lines, n_dropped, text. Lines are split at line feeds; an empty text is one empty line. Null texts
    have 0 lines and stay null. Rows that are equal in id and text are treated alike; other columns are left out.
    """
    dropped = template_lines(docs, id_col, text_col, **options)
    dropped = dropped.groupBy("id", "text_hash").agg(F.array_distinct(F.collect_list("line")).alias("drop"))  # bounded by a text's lines
    dropped = bounded(materialize(dropped.toDF("d_id", "d_hash", "drop"), "line-drops"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = rows.join(dropped, F.col("id").eqNullSafe(F.col("d_id")) & (F.xxhash64("text") == F.col("d_hash")), "left")
    lines = F.split("text", "\n")
    marks = F.map_from_arrays("drop", F.transform("drop", lambda _: F.lit(True)))
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.coalesce(F.try_element_at(marks, i), F.lit(False))), "\n"))
    n_lines, n_dropped = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop"))
    return joined.select(F.col("id").alias(id_col), n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), kept.alias(text_col))


def op10_log_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    out = drop_template_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("kept_chars"), F.md5(F.encode(text, "utf-8")).alias("kept_md5"))


QUERIES = {"op10_log_template_lines": op10_log_template_lines}
ORACLES = {
    "op10_log_template_lines": """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
s AS (SELECT doc_id, text, unnest(ls) AS raw, generate_subscripts(ls, 1) AS line FROM d),
m AS (SELECT doc_id, text, line,
             list_transform(list_filter(regexp_split_to_array(raw, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''),
                            lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS ws FROM s),
r AS (SELECT *, coalesce(doc_id::VARCHAR, 'null') AS who, len(ws) AS n, array_to_string(ws, ' ') AS m FROM m WHERE len(ws) > 0),
ex AS (SELECT m FROM r GROUP BY m HAVING count(DISTINCT who) >= CASE WHEN any_value(n) < 5 THEN 20 WHEN any_value(n) >= 50 THEN 2 ELSE 3 END),
rest AS (SELECT * FROM r WHERE n >= 5 AND m NOT IN (SELECT m FROM ex)),
rd AS (SELECT m, who, wild, n::VARCHAR || ' ' || array_to_string(list_transform(ws[1:4], lambda x, j: CASE WHEN j = wild THEN '<*>' ELSE x END), ' ') AS leaf
       FROM rest, (VALUES (0), (1), (2), (3), (4)) v(wild)),
lf AS (SELECT leaf FROM rd GROUP BY leaf HAVING count(DISTINCT who) >= 3),
ch AS (SELECT m, arg_min(leaf, wild) AS leaf FROM rd WHERE leaf IN (SELECT leaf FROM lf) GROUP BY m),
near AS (SELECT rest.*, leaf FROM rest JOIN ch ON rest.m = ch.m),
lines AS (SELECT leaf, m, any_value(ws) AS ws, count(DISTINCT who) AS docs FROM near GROUP BY leaf, m),
tk AS (SELECT leaf, m, docs, unnest(ws) AS token, generate_subscripts(ws, 1) AS place FROM lines),
sp AS (SELECT leaf, place, token, sum(docs) AS s FROM tk GROUP BY ALL),
sz AS (SELECT leaf, sum(docs) AS n FROM lines GROUP BY leaf),
nm AS (SELECT tk.leaf, tk.m, level, list(CASE WHEN s >= 3 AND s >= share * n THEN token ELSE '<*>' END ORDER BY place) AS shape
       FROM tk JOIN sp USING (leaf, place, token) JOIN sz USING (leaf), (VALUES (0, 0.0::DOUBLE), (1, 0.1::DOUBLE), (2, 0.5::DOUBLE)) v(level, share) GROUP BY tk.leaf, tk.m, level),
ok AS (SELECT leaf, m, array_to_string(shape, ' ') AS template, len(shape) AS n FROM nm
       WHERE len(list_filter(shape, lambda t: t <> '<*>')) >= 4 AND len(list_filter(shape, lambda t: t <> '<*>')) >= 0.6::DOUBLE * len(shape)),
often AS (SELECT leaf, template FROM ok JOIN near USING (leaf, m) GROUP BY leaf, template HAVING count(DISTINCT who) >= CASE WHEN any_value(ok.n) >= 50 THEN 2 ELSE 3 END),
gone AS (SELECT m FROM ex UNION SELECT m FROM ok JOIN often USING (leaf, template)),
dr AS (SELECT DISTINCT doc_id, text, line FROM r WHERE m IN (SELECT m FROM gone)),
k AS (SELECT s.doc_id, s.text, count(dr.line) AS n_dropped, coalesce(string_agg(s.raw, chr(10) ORDER BY s.line) FILTER (WHERE dr.line IS NULL), '') AS kept
      FROM s LEFT JOIN dr ON s.doc_id IS NOT DISTINCT FROM dr.doc_id AND s.text = dr.text AND s.line = dr.line GROUP BY s.doc_id, s.text)
SELECT d.doc_id, coalesce(len(d.ls), 0)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped,
       length(coalesce(k.kept, ''))::BIGINT AS kept_chars, md5(coalesce(k.kept, '')) AS kept_md5
FROM d LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.text = k.text
"""
}
