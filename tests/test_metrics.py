import pytest
from pyspark.sql import functions as F

from loomscan.operators import metrics as M
from loomscan.operators.spans import tokenize
from loomscan.schema import Field

CODE = """// TODO one
/* FIXME and TODO */
int g1 = 0x1F;
static const int LIMIT = 100;

int rank(int a, int b)
{
    // notTODO here
    if (a > 10 && b < 20) {
        for (int i = 0; i < 3; i++) { while (b) { b--; } }
    }
    switch (a) { case 1: return 7; case 2: return 8; }
    return a ? 1 : 2;  /* c */ /* d */
}

class Box {
    int m1;
    int size;
    void f() { say("TODO in text", "line"); }
    struct In { int z1; };
};
int very_long_line_of_code_that_goes_on_and_on_and_on_and_on_until_it_is_longer_than_eighty_characters_1;
"""


@pytest.fixture(scope="module")
def measured(spark):
    files = spark.createDataFrame([("./a.cpp", "cpp", CODE)], "path string, lang string, text string")
    regions, whole = M.measure(tokenize(files), M.builtin())
    return {r["name"]: r.asDict() for r in regions.collect()}, whole.first().asDict()


def test_complexity(measured):
    rank = measured[0]["rank"]
    assert rank["std.code.complexity:cyclomatic"] == 7  # if, &&, for, while, two cases, ?
    assert rank["std.code.complexity:cyclomatic_switch_case_once"] == 6
    assert rank["std.code.complexity:maxindent"] == 4
    assert measured[0]["Box"]["std.code.complexity:cyclomatic"] is None


def test_lines(measured):
    regions, whole = measured
    assert regions["rank"]["std.code.lines:comments"] == 3  # two in one line are two
    assert regions["rank"]["std.code.lines:code"] == 8
    assert regions["rank"]["std.code.lines:total"] == 9
    assert whole["std.code.filelines:total"] == sum(bool(x.strip()) for x in CODE.split("\n"))
    assert regions["__global__"]["std.code.longlines:numbers"] == 1 and regions["rank"]["std.code.longlines:numbers"] is None


def test_numbers(measured):
    # 10 20 0 3 1 7 2 8 1 2; const values aren't magic
    assert measured[0]["rank"]["std.code.magic:numbers"] == 10
    assert measured[0]["__global__"]["std.code.magic:numbers"] == 1


def test_members(measured):
    box = measured[0]["Box"]
    assert box["std.code.member:fields"] == 1  # names of two characters count
    assert box["std.code.member:methods"] == 1 and box["std.code.member:structs"] == 1 and box["std.code.member:types"] == 1
    assert box["std.code.member:classes"] is None
    assert measured[0]["__global__"]["std.code.member:globals"] == 1 and measured[0]["__global__"]["std.code.member:classes"] == 1


def test_todo(measured):
    assert measured[0]["__global__"]["std.code.todo:comments"] == 3
    assert measured[0]["rank"]["std.code.todo:comments"] is None
    assert measured[0]["f"]["std.code.todo:strings"] == 1
    with pytest.raises(ValueError):
        M.todo_metrics(("no-tag",))


def test_length_is_without_children(measured):
    assert sum(r["std.code.length:total"] for r in measured[0].values()) == len(CODE)
    assert measured[1]["std.general:size"] == len(CODE)


def test_derived(measured):
    rank = measured[0]["rank"]
    assert rank["std.code.mi:simple"] == 1
    assert rank["std.code.ratio:comments"] == 0.272


@pytest.mark.parametrize("branches, lines, wanted", [(7, 124, 1), (8, 124, 2), (12, 250, 9), (20, 500, 16), (50, 1000, 25), (None, 300, 3)])
def test_maintainability(spark, branches, lines, wanted):
    df = spark.createDataFrame([(branches, lines)], "a long, b long")
    assert df.select(M.maintainability(F.col("a"), F.col("b"))).first()[0] == wanted


def test_own_metric_and_missing_language(spark):
    files = spark.createDataFrame([("./a.cpp", "cpp", "goto x; goto y;\n"), ("./b.cs", "cs", "goto z;\n")], "path string, lang string, text string")
    spec = M.MetricSpec(Field("my.own", "gotos"), {"cpp": r"\bgoto\b", "*": r"\bgoto z\b"})
    got = {r["path"]: r["my.own:gotos"] for r in M.measure(tokenize(files), [spec])[0].collect()}
    assert got == {"./a.cpp": 2, "./b.cs": 1}
    only = M.MetricSpec(Field("my.own", "gotos"), {"cpp": r"\bgoto\b"})
    with pytest.raises(Exception, match="no pattern for language"):
        M.measure(tokenize(files), [only])[0].collect()


def test_registry(spark):
    spec = M.MetricSpec(Field("my.own", "x"), {"*": "x"})
    M.register(spec)
    try:
        with pytest.raises(ValueError):
            M.register(spec)
    finally:
        M.REGISTRY.clear()


def test_empty_and_null_texts(spark):
    files = spark.createDataFrame([("./a.cpp", "cpp", None), ("./b.cpp", "cpp", "")], "path string, lang string, text string")
    regions, whole = M.measure(tokenize(files), M.builtin())
    assert regions.count() == 2 and whole.count() == 2
    regions, whole = M.measure(tokenize(files.limit(0)), M.builtin())
    assert regions.count() == 0 and whole.count() == 0
