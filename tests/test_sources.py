import zlib

import pytest
from pyspark.sql import functions as F

from loomscan.functions.decoding import decode
from loomscan.sources.files import keep_paths, language_of, normal_path, read_tree


@pytest.mark.parametrize(
    "data, text",
    [
        (b"plain\r\nlines\rhere", "plain\nlines\nhere"),
        ("é".encode(), "é"),
        ("﻿é".encode(), "é"),
        ("é x".encode("utf-16"), "é x"),
        ("é x".encode("utf-32"), "é x"),
        ("a b".encode("utf-16-le"), "a b"),
        ("a b".encode("utf-32-be"), "a b"),
        (b"caf\xe9", "caf\xe9"),
        (b"", ""),
    ],
)
def test_decoding(data, text):
    assert decode(data) == text


@pytest.fixture
def tree(tmp_path):
    for name, data in {
        "a.cpp": b"int a;\r\n", "sub/b.java": b"class B {}\n", "sub/deep/c.cs": "// é\n".encode(), "sub/notes.txt": b"no code",
        ".hidden/d.cpp": b"int d;\n", "sub/.e.cpp": b"int e;\n", "test/f.h": b"int f;\n",
    }.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(tmp_path)


def paths(df):
    return sorted(r["path"] for r in df.collect())


def test_tree(spark, tree):
    files = read_tree(spark, tree)
    assert paths(files) == ["./a.cpp", "./sub/b.java", "./sub/deep/c.cs", "./test/f.h"]
    a = files.filter("path = './a.cpp'").first()
    assert (a["lang"], a["text"], a["checksum"], a["n_chars"]) == ("cpp", "int a;\n", zlib.crc32(b"int a;\n"), 7)


def test_tree_filters(spark, tree):
    assert paths(read_tree(spark, tree, recursive=False)) == ["./a.cpp"]
    assert paths(read_tree(spark, tree, include=[r".*\.java", "f"])) == ["./sub/b.java", "./test/f.h"]
    assert paths(read_tree(spark, tree, exclude=["test"])) == ["./a.cpp", "./sub/b.java", "./sub/deep/c.cs"]
    assert paths(read_tree(spark, tree, exclude_dirs=[r"\./sub/deep"])) == ["./a.cpp", "./sub/b.java", "./test/f.h"]


def test_single_file(spark, tree):
    assert paths(read_tree(spark, f"{tree}/a.cpp")) == ["./a.cpp"]


def test_languages_and_paths(spark):
    df = spark.createDataFrame([("x/a.hpp",), ("b.cs",), ("c.txt",), ("d\\e.java",)], "path string")
    got = df.select(normal_path(F.col("path")).alias("p"), language_of(normal_path(F.col("path"))).alias("l")).collect()
    assert [tuple(r) for r in got] == [("./x/a.hpp", "cpp"), ("./b.cs", "cs"), ("./c.txt", None), ("./d/e.java", "java")]


def test_filters_on_an_empty_table(spark):
    assert keep_paths(spark.createDataFrame([], "path string"), exclude_dirs=["x"]).count() == 0
