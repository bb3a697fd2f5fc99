"""Queries that go the whole way: generated source files, tokenizer, spans, metrics, suppressions, aggregates.

Each row of part becomes a file in one of the languages, put together from pieces that are repeated as often as the row's
numbers say. The SQL knows these numbers only, not the text: it says what each metric must be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import metrics as M
from ..operators.histogram import compress_distribution
from ..operators.limit import Limit, warnings
from ..operators.store import collect
from ..schema import Snapshot
from ..workers import tasks_for
from .queries import ORACLES, QUERIES, query

#: Files of a task at most: some 10 MB of text and 3 seconds of the tokenizer.
FILES = 20_000
#: How often pieces are repeated, from the columns of part: branches, comments, fields, globals, long lines, strings.
COUNTS = {"b": "p_size % 4", "c": "p_partkey % 3", "f": "p_size % 5 % 3", "g": "p_partkey % 2", "l": "p_size % 6 % 2", "s": "p_partkey % 5 % 2", "m": "(p_partkey + p_size) % 3 % 2"}
BRANCH = "        if (a > 17 && a) { a += 23; }\n"
COMMENT = "        // step TODO\n"
FIELD = "    int ab;\n"
GLOBAL = "int gx;\n"
LONG = "        a = a + " + "aaaaaaaaaa + " * 7 + "a;\n"
STRING = '        s = "FIXME {";\n'
MUTE = "        // loomscan: suppress std.code.complexity:cyclomatic\n"
#: Lines around the pieces: before the class (with its name), before the function, its head and its end, the ends of class and file.
FRAMES = {
    "cpp": ("#include <x.h>\n\nnamespace n {\n", "class C {\n", "    int f(int a) {\n", "        return a;\n    }\n", "};\n", "}\n"),
    "cs": ("namespace n {\n", "interface C {\n", "    int f(int a) {\n", "        return a;\n    }\n", "}\n", "}\n"),
    "java": ("import x;\n", "class C {\n", "    int f(int a) {\n", "        return a;\n    }\n", "}\n", ""),
}


def generated(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    """path, lang, text, checksum of a file a part; the counts are dealt over tasks before any text is made of them."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    tasks = tasks_for(spark, part.count(), FILES)
    part = part.select(F.concat(F.lit("./p/"), "p_partkey").alias("path"), *[F.expr(e).cast("int").alias(n) for n, e in COUNTS.items()]).repartition(tasks)
    head, opened, function, closed, end, bottom = FRAMES[lang]
    pieces = [head, (GLOBAL, "g"), opened, (FIELD, "f"), function, (MUTE, "m"), (COMMENT, "c"), (BRANCH, "b"), (LONG, "l"), (STRING, "s"), closed, end, bottom]
    text = F.concat(*[F.lit(p) if isinstance(p, str) else F.repeat(F.lit(p[0]), F.col(p[1])) for p in pieces])
    return part.select("path", F.lit(lang).alias("lang"), text.alias("text")).withColumn("checksum", F.crc32("text"))


def collected(spark: SparkSession, sf_dir: str, lang: str = "cpp") -> Snapshot:
    return collect(generated(spark, sf_dir, lang), M.builtin())


def _n(text: str) -> int:
    return len(text)


def _lines(lang: str) -> str:
    """Common tables of the SQL: p, a row a file with the counts; r, a row a region with offsets and line numbers."""
    head, opened, function, closed, end, bottom = FRAMES[lang]
    counts = ", ".join(f"({e})::BIGINT AS {n}" for n, e in COUNTS.items())
    inside = f"(m * {_n(MUTE)} + c * {_n(COMMENT)} + b * {_n(BRANCH)} + l * {_n(LONG)} + s * {_n(STRING)})"
    rows, grows = "(m + c + b + l + s)", head.count("\n")
    kind = 32 if lang == "cs" else 2
    space = lang != "java"
    top = head.rindex("namespace") if space else None
    lead = len(function) - len(function.lstrip())
    x = f"""WITH p AS (SELECT './p/' || p_partkey AS path, {counts} FROM part),
q AS (SELECT *, {_n(head)} + g * {_n(GLOBAL)} AS c0, {_n(head)} + g * {_n(GLOBAL)} + {_n(opened)} + f * {_n(FIELD)} AS f0, {inside} AS body, {rows} AS body_lines FROM p),
o AS (SELECT *, f0 + {_n(function)} + body + {_n(closed)} AS f1, f0 + {_n(function)} + body + {_n(closed)} + {_n(end.rstrip(";" + chr(10)))} AS c1,
        f0 + {_n(function)} + body + {_n(closed)} + {_n(end)} + {_n(bottom)} AS size, 1 + {grows} + g AS class_line, 1 + {grows} + g + {opened.count(chr(10))} + f AS function_line FROM q),
r AS ("""
    parts = [f"SELECT o.*, 1 AS region_id, NULL::INT AS parent_id, '__global__' AS name, 1 AS group_id, 0 AS a, size AS z FROM o"]
    if space:
        parts.append(f"SELECT o.*, 2, 1, 'n', 8, {top}, size - 1 FROM o")
    k = len(parts)
    parts.append(f"SELECT o.*, {k + 1}, {k}, 'C', {kind}, c0, c1 FROM o")
    parts.append(f"SELECT o.*, {k + 2}, {k + 1}, 'f', 16, f0 + {lead}, f1 - 1 FROM o")
    return x + " UNION ALL ".join(parts) + ") "


def _regions(lang: str) -> str:
    return _lines(lang) + "SELECT path, region_id, parent_id, name, group_id, a::INT AS offset_begin, z::INT AS offset_end FROM r"


def _region_query(lang: str):
    def run(spark, sf_dir):
        return collected(spark, sf_dir, lang).regions.select("path", "region_id", "parent_id", "name", "group_id", "offset_begin", "offset_end")

    run.__name__ = f"code_regions_{lang}"
    return run


for _lang in FRAMES:
    query(_regions(_lang), base=False)(_region_query(_lang))

IN_F = "group_id = 16"
#: What metrics of the regions of C++ files must be, as SQL over a region's counts.
EXPECTED = {
    "complexity": {
        "std.code.complexity:cyclomatic": f"CASE WHEN {IN_F} THEN 2 * b END", "std.code.complexity:cyclomatic_switch_case_once": f"CASE WHEN {IN_F} THEN 2 * b END",
        "std.code.complexity:maxindent": f"CASE WHEN {IN_F} THEN CASE WHEN b > 0 THEN 2 ELSE 1 END END",
    },
    "lines": {
        "std.code.lines:code": "CASE group_id WHEN 16 THEN 3 + b + l + s WHEN 2 THEN 2 + f WHEN 8 THEN 3 + g ELSE 0 END",
        "std.code.lines:preprocessor": "CASE WHEN group_id = 1 THEN 1 ELSE 0 END",
        "std.code.lines:comments": f"CASE WHEN {IN_F} THEN c + m ELSE 0 END",
        "std.code.lines:total": "CASE group_id WHEN 16 THEN 3 + b + l + s + c + m WHEN 2 THEN 2 + f WHEN 8 THEN 3 + g ELSE 1 END",
    },
    "longlines": {"std.code.longlines:numbers": f"CASE WHEN {IN_F} THEN nullif(l, 0) END"},
    "magic": {"std.code.magic:numbers": f"CASE WHEN {IN_F} THEN nullif(2 * b, 0) END"},
    "fields": {"std.code.member:fields": "CASE WHEN group_id = 2 THEN nullif(f, 0) END", "std.code.member:globals": "CASE WHEN group_id = 8 THEN nullif(g, 0) END"},
    "children": {
        "std.code.member:classes": "CASE WHEN group_id = 8 THEN 1 END", "std.code.member:structs": "NULL::BIGINT", "std.code.member:interfaces": "NULL::BIGINT",
        "std.code.member:types": "CASE WHEN group_id = 8 THEN 1 END", "std.code.member:methods": "CASE WHEN group_id = 2 THEN 1 END", "std.code.member:namespaces": "CASE WHEN group_id = 1 THEN 1 END",
    },
    "todo": {"std.code.todo:comments": f"CASE WHEN {IN_F} THEN nullif(c, 0) END", "std.code.todo:strings": f"CASE WHEN {IN_F} THEN nullif(s, 0) END"},
    "length": {"std.code.length:total": "z - a - CASE group_id WHEN 1 THEN size - 1 - TOP WHEN 8 THEN c1 - c0 WHEN 2 THEN f1 - 1 - (f0 + 4) ELSE 0 END"},
}
EXPECTED["length"]["std.code.length:total"] = EXPECTED["length"]["std.code.length:total"].replace("TOP", str(FRAMES["cpp"][0].rindex("namespace")))
_CODE, _COMMENTS = EXPECTED["lines"]["std.code.lines:code"], EXPECTED["lines"]["std.code.lines:comments"]
EXPECTED["derived"] = {
    "std.code.mi:simple": "1", "std.code.ratio:comments": f"CASE WHEN ({_CODE}) + ({_COMMENTS}) = 0 THEN 0.0 ELSE (1000 * ({_COMMENTS}) // (({_CODE}) + ({_COMMENTS}))) / 1000.0 END::DOUBLE",
}


def _metric_query(name: str):
    def run(spark, sf_dir):
        return collected(spark, sf_dir).regions.select("path", "region_id", *[F.col(f"`{c}`") for c in EXPECTED[name]])

    run.__name__ = f"code_{name}"
    return run


for _name, _columns in EXPECTED.items():
    _as = ", ".join(f'({e}){"" if "DOUBLE" in e else "::BIGINT"} AS "{c}"' for c, e in _columns.items())
    query(_lines("cpp") + f"SELECT path, region_id, {_as} FROM r", base=False)(_metric_query(_name))

_FILE_LINES = {
    "std.code.filelines:code": "7 + g + f + b + l + s", "std.code.filelines:preprocessor": "1", "std.code.filelines:comments": "c + m",
    "std.code.filelines:total": "8 + g + f + b + l + s + c + m", "std.general:size": "size", "std.general:procerrors": "NULL::BIGINT",
}


@query(_lines("cpp") + "SELECT path, " + ", ".join(f'({e})::BIGINT AS "{c}"' for c, e in _FILE_LINES.items()) + " FROM o", base=False)
def code_files(spark, sf_dir):
    return collected(spark, sf_dir).files.select("path", *[F.col(f"`{c}`") for c in _FILE_LINES])


@query(_lines("cpp") + "SELECT path, region_id, function_line::INT AS cursor, class_line::INT AS class_line, function_line::INT AS line_begin, (function_line + body_lines + 2)::INT AS line_end FROM r WHERE group_id = 16", base=False)
def code_line_numbers(spark, sf_dir):
    r = collected(spark, sf_dir).regions
    c = r.filter("group_id = 2").select("path", F.col("line_begin").alias("class_line")).hint("merge")  # a row a file: Spark takes it for as small as the table of parts
    return r.filter("group_id = 16").join(c, "path").select("path", "region_id", "cursor", "class_line", "line_begin", "line_end")


@query(_lines("cpp") + "SELECT path, 4 AS region_id, 1::BIGINT AS count, ['std.code.complexity:cyclomatic'] AS metrics FROM o WHERE m > 0", base=False)
def code_suppressions(spark, sf_dir):
    return collected(spark, sf_dir).suppress


@query(_lines("cpp") + "SELECT 'std.code.complexity:cyclomatic' AS metric, count(*) AS sup FROM o WHERE m > 0 HAVING count(*) > 0", base=False)
def code_view_suppressed(spark, sf_dir):
    return A.suppressed(collected(spark, sf_dir).suppress)


@query(_lines("cpp") + """SELECT path, region_id, name AS region, 'function' AS type, function_line::INT AS cursor, 'std.code.complexity:cyclomatic' AS metric, (2 * b)::DOUBLE AS value,
NULL::BOOLEAN AS modified, NULL::DOUBLE AS trend, 3::DOUBLE AS "limit" FROM r WHERE group_id = 16 AND 2 * b > 3 AND m = 0""", base=False)
def code_limit(spark, sf_dir):
    return warnings(collected(spark, sf_dir), Limit("std.code.complexity:cyclomatic", 3.0))


def _values(s: Snapshot) -> DataFrame:
    return A.long_form(s.regions, s.numeric(True))


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS metric, ({e})::DOUBLE AS value FROM r WHERE ({e}) IS NOT NULL" for x in EXPECTED.values() for c, e in x.items())
_ZEROS = {f.column: f.non_zero for f in M.fields_of(M.builtin()) if f.regions}


@query(_lines("cpp") + f""", v AS ({_LONG}), names(metric, nonzero) AS (VALUES {', '.join(f"('{c}', {str(z).lower()})" for c, z in _ZEROS.items())})
SELECT metric, min(value) AS min, max(value) AS max, avg(value) AS avg, coalesce(sum(value), 0)::DOUBLE AS total, count(value) AS count, any_value(nonzero) AS nonzero FROM names LEFT JOIN v USING (metric) GROUP BY metric""", base=False)
def code_view(spark, sf_dir):
    s = collected(spark, sf_dir)
    return A.aggregate(_values(s), s.numeric(True))


#: Bars one after another: a state has what is counted already and the first value of the next bar.
BARS = """, d AS (SELECT metric, list(value ORDER BY value) AS vs, list(n ORDER BY value) AS ns, list(u ORDER BY value) AS us, max(u) AS n FROM
  (SELECT metric, value, n, sum(n) OVER (PARTITION BY metric ORDER BY value)::BIGINT AS u FROM (SELECT metric, value, count(*) AS n FROM v GROUP BY ALL)) GROUP BY metric),
bar AS (SELECT metric, -1 AS k, 0 AS s, 0 AS e, 0::BIGINT AS done FROM d
  UNION ALL SELECT metric, k + 1, e + 1, x, us[x] FROM (SELECT bar.*, us, greatest(e + 1, 1 + len(list_filter(us, lambda u: u < done + (n - done) // (20 - (k + 1)))))::INT AS x FROM bar JOIN d USING (metric) WHERE done < n)),
t AS (SELECT bar.*, d.vs, d.n, (us[e] - CASE WHEN s > 1 THEN us[s - 1] ELSE 0 END)::BIGINT AS c FROM bar JOIN d USING (metric) WHERE k >= 0),
ev AS (SELECT metric, n > 20 AND count(*) > 1 AND (max(c) - min(c)) / n::DOUBLE < 0.05 AS even FROM t GROUP BY metric, n),
w AS (SELECT metric, vs, us, n, len(vs) AS last, round_even((vs[len(vs)] - vs[1]) / 20, 0) AS step FROM d JOIN ev USING (metric) WHERE even),
wide AS (SELECT metric, -1 AS k, 0 AS s, 0 AS e FROM w
  UNION ALL SELECT metric, k + 1, e + 1, least(last, greatest(e + 1, 1 + len(list_filter(vs, lambda x: x < vs[1] + step * (k + 2)))))::INT FROM wide JOIN w USING (metric) WHERE e < last)
SELECT metric, k::INT AS bar, CASE WHEN s = e THEN vs[s]::BIGINT::VARCHAR ELSE vs[s]::BIGINT || '-' || vs[e]::BIGINT END AS label, c AS count, c / n AS ratio, 0::BIGINT AS diff FROM t JOIN ev USING (metric) WHERE NOT even
UNION ALL SELECT metric, k::INT, (vs[1] + step * k)::BIGINT || '-' || (CASE WHEN e = last THEN vs[last] ELSE vs[1] + step * (k + 1) END)::BIGINT, (us[e] - CASE WHEN s > 1 THEN us[s - 1] ELSE 0 END)::BIGINT,
  (us[e] - CASE WHEN s > 1 THEN us[s - 1] ELSE 0 END) / n, 0 FROM wide JOIN w USING (metric) WHERE k >= 0"""


@query((_lines("cpp") + f", v AS (SELECT * FROM ({_LONG}) WHERE metric <> 'std.code.ratio:comments')").replace("WITH p", "WITH RECURSIVE p", 1) + BARS, base=False)
def code_view_bars(spark, sf_dir):
    return compress_distribution(A.distribution(_values(collected(spark, sf_dir)).filter("metric <> 'std.code.ratio:comments'")))
