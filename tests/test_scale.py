"""Tasks must not grow with the input: small files of which much is made, narrow tables with many rows."""

import pytest
from pyspark.sql import functions as F

from loomscan.operators import metrics as M
from loomscan.operators import suppress as S
from loomscan.operators.limit import Limit, warnings
from loomscan.operators.spans import tokenize
from loomscan.plans import generated as G
from loomscan.plans import queries as Q
from loomscan.workers import tasks_for

from helpers import SMALL


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Folders with a part table of so many rows, in one file with one row group."""

    def make(rows):
        folder = str(tmp_path_factory.mktemp("parts"))
        spark.range(rows).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{folder}/part.parquet")
        return folder

    return make


def largest_task(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_generated_files_are_dealt(spark, parts, monkeypatch):
    monkeypatch.setattr(G, "FILES", 1000)
    for rows in (8_000, 24_000):
        files = G.generated(spark, parts(rows), "cpp").select("path")
        assert files.distinct().count() == rows and largest_task(files) <= 1100


def test_few_files_stay_together(spark):
    assert [tasks_for(spark, n, 800) for n in (0, 99, 200, 801)] == [1, 1, 2, 4] and tasks_for(spark, 80_000, 800) == 100


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_not_broadcast(spark, parts):
    assert "BroadcastHashJoin" not in plan_of(G.code_line_numbers(spark, parts(100)))


def test_metrics_need_no_shuffle(spark):
    files = spark.createDataFrame([("./a.cpp", "cpp", "class A { class B {}; int f() { return 1; } };\n")], "path string, lang string, text string")
    for df in M.measure(tokenize(files), M.builtin()):
        assert "Exchange" not in plan_of(df) and "Join" not in plan_of(df)


def test_children_are_those_of_the_aggregation(spark):
    texts = ["namespace n { class A { int f() {} struct S {}; }; int g() {} }\nint h() {}\n", "class A { int f() {", "} } class B { void k() { } }", ""]
    files = spark.createDataFrame([(f"./{k}{lang}", lang, t) for k, t in enumerate(texts) for lang in ("cpp", "cs", "java")], "path string, lang string, text string")
    regions = M.measure(tokenize(files), M.builtin())[0]
    names = [f.column for f in M.CHILD_FIELDS]
    wanted = {(r["path"], r["parent_id"]): tuple(r[n] for n in names) + (r["_inside"],) for r in M.child_metrics(regions).collect()}
    got = {(r["path"], r["region_id"]): tuple(r[n] for n in names) + (r["offset_end"] - r["offset_begin"] - r[M.LENGTH.column],) for r in regions.collect()}
    assert wanted and {k: wanted.get(k, (None,) * len(names) + (0,)) for k in got} == got


def test_java_patterns_keep_their_meaning(spark):
    text = spark.createDataFrame([(" if if(é for\u00e9 |_while xcase\tcase\u2028case\n9if if9 \U0001d4b3if\U0001d4b3",)], "t string")
    for p in M._branches().values():
        assert "A-Z" not in M.java(p)
        assert text.select(F.regexp_count("t", F.lit(M.java(p))), F.regexp_count("t", F.lit(M.FLAGS + p))).first()[:] in [(n, n) for n in range(2, 12)]


def test_spans_of_orders_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(Q, "ROWS", 500)
    assert largest_task(Q._items(spark, SMALL)) <= 900  # of 6,000
    for name, shuffles in (("span_innermost", 2), ("span_merge", 1)):  # one a table
        assert plan_of(Q.QUERIES[name](spark, SMALL)).count("Exchange hashpartitioning(l_orderkey") <= shuffles
        assert "Exchange hashpartitioning" not in plan_of(Q.QUERIES[name](spark, SMALL)).replace("Exchange hashpartitioning(l_orderkey", "")


def test_suppressions_need_no_shuffle_and_limits_no_broadcast(spark, parts):
    s = G.collected(spark, parts(100))
    tokens = tokenize(spark.createDataFrame([("./a.cpp", "cpp", "int a;\n")], "path string, lang string, text string"))
    assert not any(x in plan_of(df) for df in S.suppressions(tokens, s.fields) for x in ("Exchange", "Join"))
    assert "BroadcastHashJoin" not in plan_of(warnings(s, Limit("std.code.complexity:cyclomatic", 3.0)))


def test_suppressions_said_twice_in_any_order(spark):
    size, cyclomatic = "std.general:size", "std.code.complexity:cyclomatic"
    text = "".join(f"// loomscan: suppress {m}\n" for m in (cyclomatic, size, "no:such", cyclomatic, size, "std.code.lines:code")) + "int a;\n"
    tokens = tokenize(spark.createDataFrame([("./a.cpp", "cpp", text)], "path string, lang string, text string"))
    good, bad = S.suppressions(tokens, M.fields_of(M.builtin()))
    assert {tuple(map(str, r)) for r in good.collect()} == {("./a.cpp", "1", "2", str([cyclomatic, "std.code.lines:code"])), ("./a.cpp", "None", "1", str([size]))}
    assert sorted((r["metric"], r["reason"]) for r in bad.collect()) == [("no:such", "unknown"), (cyclomatic, "duplicate"), (size, "duplicate")]


@pytest.mark.parametrize("name", [q for q in G.QUERIES if q.startswith("code_")])
def test_every_query_over_generated_files_deals_them(spark, parts, monkeypatch, name):
    monkeypatch.setattr(G, "FILES", 10)
    assert "RoundRobinPartitioning(20)" in plan_of(G.QUERIES[name](spark, parts(200)))
    spark.catalog.clearCache()
