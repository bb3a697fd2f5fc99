"""The command line end to end, renderers, histograms and streams."""

import ast
import json
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomscan.cli import main
from loomscan.operators import store
from loomscan.operators.histogram import compress
from loomscan.operators.metrics import builtin
from loomscan.streaming.incremental import collect_stream

OLD = {"a.cpp": "int f(int a) { if (a) { return 1; } return 2; }\nint g() { return 3; }\n", "sub/b.java": "class B { int m(int a) { return a; } }\n"}
NEW = OLD | {"a.cpp": OLD["a.cpp"].replace("return 3", "while (1) {} return 3"), "sub/c.cs": "class C { void x() { foreach (var i in y) {} } }\n"}
FLAGS = ["--std.code.complexity.cyclomatic", "--std.code.lines.code", "--std.code.lines.comments", "--std.code.maintindex.simple", "--std.code.ratio.comments", "--std.suppress"]


@pytest.fixture(scope="module")
def dbs(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("cli")
    for n, tree in (("old", OLD), ("new", NEW)):
        for name, text in tree.items():
            p = top / f"src-{n}" / name
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(text)
    assert main(["collect", f"--db-file={top}/old.db", *FLAGS, f"{top}/src-old"], spark) == 0
    assert main(["collect", f"--db-file={top}/new.db", f"--db-file-prev={top}/old.db", *FLAGS, f"{top}/src-new"], spark) == 0
    return str(top)


def run(spark, capsys, *args):
    code = main(list(args), spark)
    return code, capsys.readouterr().out


def test_view(spark, dbs, capsys):
    code, out = run(spark, capsys, "view", f"--db-file={dbs}/new.db", f"--db-file-prev={dbs}/old.db", "--format=python")
    tree = ast.literal_eval(out)
    data = tree["aggregated-data"]["std.code.complexity"]["cyclomatic"]
    assert code == 0 and (data["max"], data["total"], data["count"]) == (1.0, 3.0, 4)
    assert data["__diff__"]["count"] == 1 and data["__diff__"]["total"] == 2.0
    assert sum(b["count"] for b in data["distribution-bars"]) == 4
    assert tree["subdirs"] == ["sub"] and tree["subfiles"] == ["a.cpp"]


def test_view_of_a_file_nests(spark, dbs, capsys):
    _, out = run(spark, capsys, "view", f"--db-file={dbs}/new.db", "--format=python", "--nest-regions", "./sub/b.java")
    tree = ast.literal_eval(out)["file-data"]["regions"]
    assert [r["info"]["name"] for r in tree] == ["__global__"]
    assert tree[0]["subregions"][0]["subregions"][0]["info"]["name"] == "m"


def test_view_formats(spark, dbs, capsys):
    _, out = run(spark, capsys, "view", f"--db-file={dbs}/new.db", "--format=xml")
    assert ET.fromstring(out).tag
    _, out = run(spark, capsys, "view", f"--db-file={dbs}/new.db", "--format=prometheus", "./a.cpp")
    assert 'std_code_complexity_cyclomatic_total {file="./a.cpp"} 2.0' in out
    _, out = run(spark, capsys, "view", f"--db-file={dbs}/new.db", "--scope-mode=touched", f"--db-file-prev={dbs}/old.db")
    assert "Overall metrics for 'std.code.complexity:cyclomatic'" in out


def test_limit_counts_warnings(spark, dbs, capsys):
    code, out = run(spark, capsys, "limit", f"--db-file={dbs}/new.db", "--max-limit=std.code.complexity:cyclomatic:0")
    assert code == 3 and out.count("warning:") == 3
    code, _ = run(spark, capsys, "limit", f"--db-file={dbs}/new.db", f"--db-file-prev={dbs}/old.db", "--warn-mode=new", "--max-limit=std.code.complexity:cyclomatic:0")
    assert code == 1
    code, _ = run(spark, capsys, "limit", f"--db-file={dbs}/new.db", "./nowhere")
    assert code == 1


@pytest.mark.parametrize("args", [["limit", "--max-limit=x:y:1"], ["limit", "--warn-mode=new"], ["view", "--scope-mode=new"], ["collect", "--std.code.maintindex.simple"], ["collect", "--std.code.todo.comments", "--std.code.todo.tags=a-b"], ["nothing"]])
def test_wrong_use(spark, dbs, args):
    with pytest.raises(SystemExit) as e:
        main([args[0], *([f"--db-file={dbs}/new.db"] if args[0] != "nothing" else []), *args[1:]], spark)
    assert e.value.code == 2


def test_report_export_info(spark, dbs, capsys):
    _, out = run(spark, capsys, "report", f"--db-file={dbs}/new.db", "--format=json", "--max-limit=std.code.complexity:cyclomatic:0")
    assert sum(len(f["warnings"]) for f in json.loads(out)) == 3
    for form, ending in (("txt", "txt"), ("doxygen", "dox")):
        run(spark, capsys, "report", f"--db-file={dbs}/new.db", f"--format={form}", f"--output-dir={dbs}/out", "--max-limit=std.code.complexity:cyclomatic:0")
        assert "std.code.complexity:cyclomatic" in open(f"{dbs}/out/loomscan.{ending}").read()
    _, out = run(spark, capsys, "export", f"--db-file={dbs}/new.db", f"--db-file-prev={dbs}/old.db")
    lines = out.splitlines()
    assert lines[0].startswith("file,region,type,modified,line start,line end,") and len(lines) == 1 + 9 + 3
    _, out = run(spark, capsys, "info", f"--db-file={dbs}/new.db", f"--db-file-prev={dbs}/old.db")
    assert "[modified]" in out and "[new]" in out


@settings(max_examples=200, deadline=None)
@given(counts=st.lists(st.integers(0, 30), min_size=1, max_size=60), columns=st.integers(1, 20))
def test_bars_keep_counts(counts, columns):
    total = sum(counts)
    values = np.arange(len(counts), dtype=float)
    closes, ends, _ = compress(values, np.array(counts), columns)
    sums = [sum(counts[a:b]) for a, b in zip([0, *(c + 1 for c in closes)], [c + 1 for c in closes])]
    assert sum(sums) == total and len(ends) == len(closes) and closes == sorted(set(closes))
    assert not total or len(closes) <= columns + 1


def test_bars_of_a_distribution():
    values = np.array([0.0, 1, 2, 3, 7, 9])
    assert compress(values, np.array([50, 20, 10, 5, 10, 5]), 3)[:2] == ([0, 2, 5], [(0, 0), (1, 2), (3, 9)])
    assert compress(values, np.array([1, 1, 1, 1, 1, 1]), 0)[1] == [(v, v) for v in values]
    closes, ends, widths = compress(np.arange(100.0), np.full(100, 3), 20)  # nearly even: widths instead
    assert widths and ends[:2] == [(0, 5), (5, 10)] and closes[:2] == [5, 10]


def test_stream_of_files(spark, tmp_path):
    source = tmp_path / "in"
    schema = "path string, lang string, text string"
    spark.createDataFrame([("./a.cpp", "cpp", "int f() {}\n"), ("./b.cpp", "cpp", "int g() {}\n")], schema).coalesce(1).write.parquet(str(source))
    args = (f"{tmp_path}/snapshots", f"{tmp_path}/checkpoint", builtin())
    collect_stream(spark.readStream.schema(schema).parquet(str(source)), *args).awaitTermination()
    spark.createDataFrame([("./b.cpp", "cpp", "int g() { if (1) {} }\n")], schema).coalesce(1).write.mode("append").parquet(str(source))
    collect_stream(spark.readStream.schema(schema).parquet(str(source)), *args).awaitTermination()
    got = store.read(spark, f"{tmp_path}/snapshots/1").regions.filter("name <> '__global__'").collect()
    assert {(r["name"], r["std.code.complexity:cyclomatic"]) for r in got} == {("f", 0), ("g", 1)}
