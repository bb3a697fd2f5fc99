"""Queries over the driver's tables, each with SQL that must give the same rows.

A code base is made of the documents: a document is a file and each of its lines a region. In the previous snapshot the
files of one source lie in another folder and some words of English texts differ, so every change class occurs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import metrics as M
from ..operators import report as R
from ..operators.histogram import compress_distribution
from ..operators.limit import Limit, warnings
from ..operators.match import file_classes, match_regions
from ..operators.spans import innermost, merge_spans, tokenize
from ..operators.store import reuse
from ..schema import Field, Snapshot
from ..workers import tasks_for
from .views import sides

LENGTH, LINES, BRANCHES, NUMBERS = Field("std.code.length", "total"), Field("std.code.lines", "code"), Field("std.code.complexity", "cyclomatic"), Field("std.code.magic", "numbers", non_zero=True)
SIZE = Field("std.general", "size", regions=False)
FIELDS = [LENGTH, LINES, BRANCHES, NUMBERS, SIZE]
_LINE, _BRANCH, _ONCE = M._LINE, M._branches()["cpp"], M._branches(once=True)["cpp"]
_NUMBER, _MEMBER = r"\b[0-9]+\b", M._MEMBERS["cpp"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (BASE if base else "") + sql
        return f

    return add


def _count(text, pattern: str):
    return F.regexp_count(text, F.lit(M.java(pattern))).cast("long")


def files_of(spark: SparkSession, sf_dir: str, prev: bool = False) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    top = F.when(F.col("source") == "src1", "./old/").otherwise("./") if prev else F.lit("./")
    text = F.when(F.col("lang") == "en", F.replace(F.col("text"), F.lit("whor"), F.lit("whoar"))).otherwise(F.col("text")) if prev else F.col("text")
    return d.select(F.concat(top, "lang", F.lit("/"), "source", F.lit("/"), "doc_id").alias("path"), "lang", text.alias("text")).withColumn("checksum", F.md5("text"))


def snapshot(spark: SparkSession, sf_dir: str, prev: bool = False) -> Snapshot:
    files = files_of(spark, sf_dir, prev)
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    n = F.length("line").cast("long")
    kind = F.when(F.col("at") == 0, 1).when(n % 2 == 0, 16).otherwise(2)
    number = (F.col("at") + 1).cast("int")
    regions = lines.select(
        "path", number.alias("region_id"), F.when(F.col("at") > 0, 1).cast("int").alias("parent_id"), F.substring_index("line", " ", 1).alias("name"), kind.cast("int").alias("group_id"),
        number.alias("line_begin"), number.alias("line_end"), number.alias("cursor"), F.md5("line").alias("checksum"),
        n.alias(LENGTH.column), _count(F.col("line"), _LINE).alias(LINES.column), _count(F.col("line"), _BRANCH).alias(BRANCHES.column), F.nullif(_count(F.col("line"), "[0-9]+"), F.lit(0)).alias(NUMBERS.column),
    )
    muted = lines.filter(F.col("line").contains("the")).select("path", number.alias("region_id"), F.array(F.lit(LENGTH.column)).alias("metrics"))
    return Snapshot(files.select("path", "checksum", F.length("text").cast("long").alias(SIZE.column)), regions, FIELDS, muted)


def both(spark: SparkSession, sf_dir: str) -> tuple[Snapshot, Snapshot]:
    return snapshot(spark, sf_dir), snapshot(spark, sf_dir, True)


def _sql_regions(files: str) -> str:
    return f"""SELECT path, i::INT AS region_id, split_part(line, ' ', 1) AS name, CASE WHEN i = 1 THEN 1 WHEN length(line) % 2 = 0 THEN 16 ELSE 2 END AS group_id,
  md5(line) AS checksum, length(line)::BIGINT AS len, len(regexp_extract_all(line, '{_LINE}'))::BIGINT AS lines, len(regexp_extract_all(line, '{_BRANCH}'))::BIGINT AS branches,
  nullif(len(regexp_extract_all(line, '[0-9]+')), 0)::BIGINT AS numbers, contains(line, 'the') AS muted
  FROM (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT path, string_split(text, chr(10)) AS ls FROM {files}))"""


def _sql_values(regions: str, files: str) -> str:
    cols = ((LENGTH, "len"), (LINES, "lines"), (BRANCHES, "branches"), (NUMBERS, "numbers"))
    parts = [f"SELECT path, region_id, '{f.column}' AS metric, {c}::DOUBLE AS value FROM {regions} WHERE {c} IS NOT NULL" for f, c in cols]
    return " UNION ALL ".join([*parts, f"SELECT path, NULL, '{SIZE.column}', length(text)::DOUBLE FROM {files}"])


_NAMES = ", ".join(f"('{f.column}', {str(f.non_zero).lower()})" for f in FIELDS)
BASE = f"""WITH cf AS (SELECT './' || lang || '/' || source || '/' || doc_id AS path, lang, coalesce(text, '') AS text, md5(coalesce(text, '')) AS checksum FROM documents),
pf AS (SELECT CASE WHEN source = 'src1' THEN './old/' ELSE './' END || lang || '/' || source || '/' || doc_id AS path,
  CASE WHEN lang = 'en' THEN replace(coalesce(text, ''), 'whor', 'whoar') ELSE coalesce(text, '') END AS text, md5(CASE WHEN lang = 'en' THEN replace(coalesce(text, ''), 'whor', 'whoar') ELSE coalesce(text, '') END) AS checksum FROM documents),
cr AS ({_sql_regions('cf')}), pr AS ({_sql_regions('pf')}),
st AS (SELECT path, CASE WHEN pf.checksum IS NULL THEN 'new' WHEN cf.checksum IS NULL THEN 'deleted' WHEN cf.checksum = pf.checksum THEN 'unchanged' ELSE 'modified' END AS status FROM cf FULL JOIN pf USING (path)),
m1 AS (SELECT a.path, a.region_id, b.region_id AS prev_region_id FROM (SELECT *, row_number() OVER (PARTITION BY path, checksum ORDER BY region_id) AS n FROM cr) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY path, checksum ORDER BY region_id) AS n FROM pr) b ON a.path = b.path AND a.checksum = b.checksum AND a.n = b.n),
m2 AS (SELECT a.path, a.region_id, b.region_id AS prev_region_id FROM (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY region_id) AS n FROM cr ANTI JOIN m1 USING (path, region_id)) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY region_id) AS n FROM pr ANTI JOIN (SELECT path, prev_region_id AS region_id FROM m1) USING (path, region_id)) b ON a.path = b.path AND a.name = b.name AND a.n = b.n),
mm AS (SELECT *, false AS modified FROM m1 UNION ALL SELECT *, true FROM m2),
cs AS (SELECT cr.path, cr.region_id, CASE WHEN status = 'new' THEN 'new' WHEN status = 'unchanged' THEN 'same' WHEN prev_region_id IS NULL THEN 'new' WHEN modified THEN 'touched' ELSE 'same' END AS scope
  FROM cr JOIN st USING (path) LEFT JOIN mm USING (path, region_id)),
ps AS (SELECT pr.path, pr.region_id, CASE WHEN status = 'unchanged' OR modified IS NOT DISTINCT FROM false THEN 'same' ELSE 'touched' END AS scope
  FROM pr JOIN st USING (path) LEFT JOIN (SELECT path, prev_region_id AS region_id, modified FROM mm) USING (path, region_id)),
cv AS ({_sql_values('cr', 'cf')}), pv AS ({_sql_values('pr', 'pf')}), names(metric, nonzero) AS (VALUES {_NAMES})
"""


def _sql_totals(values: str) -> str:
    return f"SELECT metric, min(value) AS min, max(value) AS max, avg(value) AS avg, coalesce(sum(value), 0)::DOUBLE AS total, count(value) AS count, any_value(nonzero) AS nonzero FROM names LEFT JOIN {values} USING (metric) GROUP BY metric"


@query(_sql_totals("cv"))
def view_aggregate(spark, sf_dir):
    return A.aggregate(sides(snapshot(spark, sf_dir), None)[0], FIELDS)


@query("SELECT *, count / sum(count) OVER (PARTITION BY metric) AS ratio, sum(count) OVER (PARTITION BY metric ORDER BY value) / sum(count) OVER (PARTITION BY metric) AS cumulative FROM (SELECT metric, value, count(*) AS count FROM cv GROUP BY ALL)")
def view_distribution(spark, sf_dir):
    return A.distribution(sides(snapshot(spark, sf_dir), None)[0])


@query()
def view_distribution_compressed(spark, sf_dir):
    return compress_distribution(A.distribution(sides(snapshot(spark, sf_dir), None)[0]))


_DIFF = ", ".join(f"coalesce(a.{c}, 0) - coalesce(b.{c}, 0) AS diff_{c}" for c in ("min", "max", "avg", "total", "count"))


@query(f"SELECT a.*, {_DIFF} FROM ({_sql_totals('cv')}) a JOIN ({_sql_totals('pv')}) b USING (metric)")
def view_diff(spark, sf_dir):
    now, then = sides(*both(spark, sf_dir))
    return A.aggregate_diff(A.aggregate(now, FIELDS), A.aggregate(then, FIELDS))


@query("""SELECT metric, value, coalesce(a.count, 0) AS count, coalesce(a.count / sum(a.count) OVER (PARTITION BY metric), 0) AS ratio, coalesce(a.count, 0) - coalesce(b.count, 0) AS diff
FROM (SELECT metric, value, count(*) AS count FROM cv GROUP BY ALL) a FULL JOIN (SELECT metric, value, count(*) AS count FROM pv GROUP BY ALL) b USING (metric, value)""")
def view_distribution_diff(spark, sf_dir):
    now, then = sides(*both(spark, sf_dir))
    return A.distribution_diff(A.distribution(now), A.distribution(then))


def _sql_scope(values: str, scope: str, regions: str, files: str) -> str:
    return f"(SELECT {values}.* FROM {values} JOIN {scope} USING (path, region_id) WHERE scope IN ({regions}) UNION ALL SELECT {values}.* FROM {values} JOIN st USING (path) WHERE region_id IS NULL AND status IN ({files}))"


@query(_sql_totals(_sql_scope("cv", "cs", "'new'", "'new'") + " x"))
def view_scope_new(spark, sf_dir):
    return A.aggregate(sides(*both(spark, sf_dir), "new")[0], FIELDS)


@query(f"SELECT a.*, {_DIFF} FROM ({_sql_totals(_sql_scope('cv', 'cs', chr(39) + 'new' + chr(39) + ',' + chr(39) + 'touched' + chr(39), chr(39) + 'new' + chr(39) + ',' + chr(39) + 'modified' + chr(39)) + ' x')}) a JOIN ({_sql_totals(_sql_scope('pv', 'ps', chr(39) + 'touched' + chr(39), chr(39) + 'modified' + chr(39) + ',' + chr(39) + 'deleted' + chr(39)) + ' y')}) b USING (metric)")
def view_scope_touched(spark, sf_dir):
    now, then = sides(*both(spark, sf_dir), "touched")
    return A.aggregate_diff(A.aggregate(now, FIELDS), A.aggregate(then, FIELDS))


@query("SELECT path, region_id, prev_region_id, modified FROM mm")
def region_match(spark, sf_dir):
    cur, prev = both(spark, sf_dir)
    return match_regions(cur.regions, prev.regions)


def _sql_warn(where: str, column: str = "len", metric: Field = LENGTH, limit: float = 300, tail: str = "", muted: str = "AND NOT muted", source: str = "cr") -> str:
    kind = "CASE group_id WHEN 1 THEN 'global' WHEN 2 THEN 'class' ELSE 'function' END"
    return f"""SELECT path, region_id, name AS region, {kind} AS type, region_id AS cursor, '{metric.column}' AS metric, value, modified, trend, {limit}::DOUBLE AS "limit" FROM (
  SELECT {source}.*, {source}.{column}::DOUBLE AS value, NULL::BOOLEAN AS modified, NULL::DOUBLE AS trend FROM {source} WHERE {where} {muted} {tail})"""


_CHANGE = """, w AS (SELECT cr.*, cr.len::DOUBLE AS value, CASE WHEN status = 'new' THEN NULL WHEN status = 'unchanged' THEN false ELSE mm.modified END AS modified,
  CASE WHEN status = 'unchanged' THEN 0.0 WHEN status <> 'new' AND mm.modified IS NOT NULL THEN (cr.len - coalesce(pr.len, 0))::DOUBLE END AS trend
  FROM cr JOIN st USING (path) LEFT JOIN mm USING (path, region_id) LEFT JOIN pr ON pr.path = cr.path AND pr.region_id = mm.prev_region_id WHERE cr.len > 300)
SELECT path, region_id, name AS region, CASE group_id WHEN 1 THEN 'global' WHEN 2 THEN 'class' ELSE 'function' END AS type, region_id AS cursor, 'std.code.length:total' AS metric, value, modified, trend, 300::DOUBLE AS "limit" FROM w WHERE NOT muted """

_LONG = Limit("std.code.length:total", 300.0)


@query(_sql_warn("len > 300", muted=""))
def limit_suppress_disabled(spark, sf_dir):
    return warnings(snapshot(spark, sf_dir), _LONG, suppressions=False)


@query(_sql_warn("len > 300"))
def limit_max(spark, sf_dir):
    return warnings(snapshot(spark, sf_dir), _LONG)


@query(_sql_warn("len < 20", limit=20))
def limit_min(spark, sf_dir):
    return warnings(snapshot(spark, sf_dir), Limit("std.code.length:total", 20.0, "min"))


@query(_sql_warn("branches > 0 AND group_id = 16", "branches", BRANCHES, 0, muted=""))
def limit_region_types(spark, sf_dir):
    return warnings(snapshot(spark, sf_dir), Limit.parse("std.code.complexity:cyclomatic:0:function"))


@query(f"""SELECT path, NULL::INT AS region_id, NULL::VARCHAR AS region, NULL::VARCHAR AS type, NULL::INT AS cursor, '{SIZE.column}' AS metric, length(cf.text)::DOUBLE AS value, CASE WHEN status <> 'new' THEN status = 'modified' END AS modified,
CASE WHEN status = 'unchanged' THEN 0.0 WHEN status = 'modified' THEN (length(cf.text) - length(pf.text))::DOUBLE END AS trend, 5000::DOUBLE AS "limit" FROM cf JOIN st USING (path) LEFT JOIN pf USING (path) WHERE length(cf.text) > 5000 AND (status = 'new' OR status = 'modified')""")
def limit_files(spark, sf_dir):
    cur, prev = both(spark, sf_dir)
    return warnings(cur, Limit(SIZE.column, 5000.0), prev, "touched")


@query(_sql_warn("true", source="hot").replace("SELECT path, region_id, name", ", hot AS (SELECT * FROM cr WHERE len > 300 ORDER BY len DESC, path, region_id LIMIT 25) SELECT path, region_id, name", 1))
def limit_hotspots_all(spark, sf_dir):
    return warnings(snapshot(spark, sf_dir), _LONG, hotspots=25)


@query(_CHANGE + "AND (modified IS NULL OR modified) ORDER BY value DESC, path, region_id LIMIT 25")
def limit_hotspots_touched(spark, sf_dir):
    cur, prev = both(spark, sf_dir)
    return warnings(cur, _LONG, prev, "touched", hotspots=25)


def _mode(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        cur, prev = both(spark, sf_dir)
        return warnings(cur, _LONG, prev, mode)

    run.__name__ = f"limit_mode_{mode}"
    return run


for _name, _where in (("all", ""), ("new", "AND modified IS NULL"), ("touched", "AND (modified IS NULL OR modified)"), ("trend", "AND (modified IS NULL OR (modified AND trend > 0))")):
    query(_CHANGE + _where)(_mode(_name))


@query(f"""SELECT path AS file, name AS region, CASE group_id WHEN 1 THEN 'global' WHEN 2 THEN 'class' ELSE 'function' END AS type, modified, region_id AS "line start", region_id AS "line end", branches AS "{BRANCHES.column}", len AS "{LENGTH.column}", lines AS "{LINES.column}", numbers AS "{NUMBERS.column}", NULL::BIGINT AS "{SIZE.column}" FROM cr LEFT JOIN mm USING (path, region_id)
UNION ALL SELECT path, NULL, 'file', CASE WHEN status <> 'new' THEN status = 'modified' END, 1, 1, NULL, NULL, NULL, NULL, length(text) FROM cf JOIN st USING (path)""")
def export_wide(spark, sf_dir):
    return R.export(*both(spark, sf_dir))


@query("SELECT path, checksum, CASE status WHEN 'new' THEN '[new]' WHEN 'modified' THEN '[modified]' ELSE '' END AS change FROM cf JOIN st USING (path)")
def info_files(spark, sf_dir):
    return R.file_info(*both(spark, sf_dir))


@query("""SELECT a.property, a.value, CASE WHEN b.property IS NULL THEN '[new]' WHEN a.value = b.value THEN '' ELSE '[modified (was: ' || b.value || ')]' END AS change
FROM (SELECT n_name AS property, n_regionkey::VARCHAR AS value FROM nation) a LEFT JOIN (SELECT n_name AS property, (n_nationkey % 5)::VARCHAR AS value FROM nation WHERE n_regionkey <> 2) b USING (property)""", base=False)
def info_properties(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    cur = n.select(F.col("n_name").alias("property"), F.col("n_regionkey").cast("string").alias("value"))
    prev = n.filter("n_regionkey <> 2").select(F.col("n_name").alias("property"), (F.col("n_nationkey") % 5).cast("string").alias("value"))
    return R.property_info(cur, prev)


@query(f"""SELECT path, coalesce(n, 0) AS n_warnings, length(text)::VARCHAR AS "{SIZE.column}" FROM cf LEFT JOIN (SELECT path, count(*) AS n FROM cr WHERE len > 300 AND NOT muted GROUP BY path) USING (path)""")
def report_overview(spark, sf_dir):
    s = snapshot(spark, sf_dir)
    return R.overview(s, warnings(s, _LONG))


@query("SELECT path, name AS region, count_if(len > 300 AND NOT muted) AS n_warnings FROM cr GROUP BY ALL")
def report_region_warnings(spark, sf_dir):
    s = snapshot(spark, sf_dir)
    return R.warnings_by_region(s.regions, warnings(s, _LONG))


@query("SELECT DISTINCT 'dir' AS kind, split_part(path, '/', 2) AS name FROM pf")
def dir_subdirs(spark, sf_dir):
    return R.directory_content(files_of(spark, sf_dir, True), "./")


@query("SELECT DISTINCT CASE WHEN contains(substr(path, 11), '/') THEN 'dir' ELSE 'file' END AS kind, split_part(path, '/', 4) AS name FROM cf WHERE starts_with(path, './en/src0/')")
def dir_subfiles(spark, sf_dir):
    return R.directory_content(files_of(spark, sf_dir), "./en/src0")


def _text_metric(name: str, pattern: str, text: str = "text", table: str = "documents", key: str = "doc_id") -> None:
    def run(spark, sf_dir):
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, _count(F.coalesce(text, F.lit("")), pattern).alias("n"))

    run.__name__ = f"metric_{name}"
    quoted = pattern.replace("'", "''")
    query(f"SELECT {key}, len(regexp_extract_all(coalesce({text}, ''), '{quoted}'))::BIGINT AS n FROM {table}", base=False)(run)


_text_metric("lines", _LINE)
_text_metric("longlines", ".{81,}")
_text_metric("cyclomatic", _BRANCH)
_text_metric("cyclomatic_pages", _BRANCH, "html", "pages", "page_id")
_text_metric("switch_once", _ONCE, "html", "pages", "page_id")
_text_metric("magic", _NUMBER, "html", "pages", "page_id")
_text_metric("todo", r"\b(?:TODO|ToDo|FIXME|FixMe|TBD|HACK|XXX)\b", "html", "pages", "page_id")
_text_metric("fields", _MEMBER, "html", "pages", "page_id")


@query(f"""SELECT path, parent_id, nullif(count_if(group_id = 2), 0) AS "std.code.member:classes", nullif(count_if(group_id = 4), 0) AS "std.code.member:structs", nullif(count_if(group_id = 32), 0) AS "std.code.member:interfaces",
nullif(count_if(group_id IN (2, 4, 32)), 0) AS "std.code.member:types", nullif(count_if(group_id = 16), 0) AS "std.code.member:methods", nullif(count_if(group_id = 8), 0) AS "std.code.member:namespaces", sum(len)::BIGINT AS _inside
FROM (SELECT *, CASE WHEN region_id > 1 THEN 1 END AS parent_id FROM cr) WHERE parent_id IS NOT NULL GROUP BY path, parent_id""")
def metric_children(spark, sf_dir):
    r = snapshot(spark, sf_dir).regions
    return M.child_metrics(r.withColumns({"offset_begin": F.lit(0).cast("long"), "offset_end": F.col(f"`{LENGTH.column}`")}))


@query("""SELECT path, region_id, (CASE WHEN branches <= 7 THEN 1 WHEN branches <= 11 THEN 2 WHEN branches <= 19 THEN 3 WHEN branches <= 49 THEN 4 ELSE 5 END * CASE WHEN len <= 124 THEN 1 WHEN len <= 249 THEN 2 WHEN len <= 499 THEN 3 WHEN len <= 999 THEN 4 ELSE 5 END)::BIGINT AS mi FROM cr""")
def metric_mi(spark, sf_dir):
    r = snapshot(spark, sf_dir).regions
    return r.select("path", "region_id", M.maintainability(F.col(f"`{BRANCHES.column}`"), F.col(f"`{LENGTH.column}`")).alias("mi"))


@query("SELECT path, region_id, CASE WHEN coalesce(numbers + len, 0) <> 0 THEN (1000 * numbers // (numbers + len)) / 1000.0::DOUBLE ELSE 0.0 END::DOUBLE AS ratio FROM cr")
def metric_ratio(spark, sf_dir):
    r = snapshot(spark, sf_dir).regions
    return r.select("path", "region_id", M.comment_ratio(F.col(f"`{NUMBERS.column}`"), F.col(f"`{LENGTH.column}`")).alias("ratio"))


@query("SELECT path, status NOT IN ('new', 'modified') AS reused FROM st WHERE status <> 'deleted'")
def incremental_reuse(spark, sf_dir):
    cur, prev = both(spark, sf_dir)
    todo, same = reuse(cur.files, prev.files)
    return todo.select("path", F.lit(False).alias("reused")).unionByName(same.withColumn("reused", F.lit(True)))


@query("SELECT path, status FROM st")
def file_status(spark, sf_dir):
    cur, prev = both(spark, sf_dir)
    return file_classes(cur.files, prev.files)


#: Rows of lineitem that a task gets: it sorts and aggregates them several times at once, and a join makes some three of each.
ROWS = 400_000


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem, dealt by order: what follows is within orders and shuffles no more. Spark would deal by bytes, which are few a row."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return x.repartition(tasks_for(spark, x.count(), ROWS), "l_orderkey")


def _spans(x: DataFrame) -> DataFrame:
    begin = 2 * F.col("l_linenumber")  # small quantities leave a gap
    kind = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(4)
    return x.select("l_orderkey", begin.alias("begin"), (begin + F.when(F.col("l_quantity") > 10, 2).otherwise(1)).alias("end"), kind.alias("kind")).distinct()


_SPANS = "WITH s AS (SELECT DISTINCT l_orderkey, 2 * l_linenumber AS \"begin\", 2 * l_linenumber + CASE WHEN l_quantity > 10 THEN 2 ELSE 1 END AS \"end\", CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END AS kind FROM lineitem)"


@query(_SPANS + """, g AS (SELECT l_orderkey, "begin", "end", bit_or(kind) AS kind FROM s GROUP BY ALL),
f AS (SELECT *, CASE WHEN lag("end") OVER w = "begin" THEN 0 ELSE 1 END AS fresh FROM g WINDOW w AS (PARTITION BY l_orderkey ORDER BY "begin", "end")),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY "begin", "end" ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT l_orderkey, min("begin") AS "begin", max("end") AS "end", bit_or(kind) AS kind FROM i GROUP BY l_orderkey, island""", base=False)
def span_merge(spark, sf_dir):
    x = _spans(_items(spark, sf_dir)).groupBy("l_orderkey", "begin", "end").agg(F.bit_or("kind").alias("kind"))
    return merge_spans(x, ["l_orderkey"])


@query(_SPANS + """, r AS (SELECT DISTINCT l_orderkey, l_linenumber AS region_id, 2 * l_linenumber AS "begin", 2 * (9 - l_linenumber // 4) AS "end" FROM lineitem)
SELECT s.l_orderkey, s."begin", s."end", s.kind, arg_max(r.region_id, (r."begin", r.region_id)) AS region_id FROM s JOIN r ON s.l_orderkey = r.l_orderkey AND r."begin" <= s."begin" AND s."begin" < r."end" GROUP BY ALL""", base=False)
def span_innermost(spark, sf_dir):
    x = _items(spark, sf_dir)
    regions = x.select("l_orderkey", F.col("l_linenumber").alias("region_id"), (2 * F.col("l_linenumber")).alias("begin"), (2 * (9 - F.floor(F.col("l_linenumber") / 4))).cast("int").alias("end")).distinct()
    return innermost(_spans(x), regions, ["l_orderkey"])


@query()
def tokenize_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    lang = F.element_at(F.array(F.lit("cpp"), F.lit("cs"), F.lit("java")), (F.pmod("page_id", F.lit(3)) + 1).cast("int"))
    rows = tokenize(pages.select(F.concat(F.lit("./"), F.col("page_id").cast("string")).alias("path"), lang.alias("lang"), F.col("html").alias("text")))
    return rows.select("path", "lang", "region_id", "parent_id", "name", "group_id", "offset_begin", "offset_end", "line_begin", "line_end", "cursor", "checksum", "procerrors", F.size("spans").alias("n_spans"))
