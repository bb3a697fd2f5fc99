import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomscan.functions.tokenizer import LANGUAGES, region_rows, tokenize

SHAPES = """#include <vector>
#define LIMIT(x) \\
    ((x) + 1) // not a comment
namespace outer {

/* about shapes */
class Shape : public Base
{
public:
    Shape(int n) : size(n)
    {
        if (n > 0 && n < 9) { grow("a \\" { b"); }
    }
    virtual int area() const = 0;
    bool operator==(const Shape& o) const { return o.n == 'x'; }
    ~Shape() {}
private:
    struct { int m; };
    int n;
};

template<class T> int twice(T x) { return x * 2; }
union Both { int a; float b; };
}
"""


def named(lang, text):
    return [(r.name, r.type) for r in tokenize(lang, text).regions]


def test_cpp_regions():
    assert named("cpp", SHAPES) == [
        ("__global__", "global"), ("outer", "namespace"), ("Shape", "class"), ("Shape", "function"), ("operator==", "function"),
        ("~Shape", "function"), ("__noname__", "struct"), ("twice", "function"), ("Both", "struct"),
    ]


def test_cpp_lines_and_parents():
    p = tokenize("cpp", SHAPES)
    by_name = {(r.name, r.type): r for r in p.regions}
    ctor = by_name["Shape", "function"]
    assert ctor.cursor == SHAPES[: SHAPES.index("Shape(int")].count("\n") + 1
    assert SHAPES[ctor.begin : ctor.end].startswith("public:") or SHAPES[ctor.begin : ctor.end].startswith("Shape(")
    assert by_name["Shape", "class"].parent_id == by_name["outer", "namespace"].region_id
    assert by_name["twice", "function"].parent_id == by_name["outer", "namespace"].region_id
    assert p.regions[0].cursor == 0 and p.regions[0].parent_id is None and not p.errors


def test_markers():
    p = tokenize("cpp", SHAPES)
    said = [(k, SHAPES[b:e]) for b, e, k in p.markers]
    assert (1, "/* about shapes */") in said
    assert (2, 'a \\" { b') in said and (2, "x") in said
    assert any(k == 4 and "// not a comment" in t for k, t in said)
    assert not any(k == 1 and "not a comment" in t for k, t in said)


def test_digit_separators_are_no_strings():
    assert tokenize("cpp", "int x = 123'456;\nint y = 'a';\n").markers == [(26, 27, 2)]


def test_comment_at_end_of_text_needs_a_line_end():
    assert tokenize("cpp", "int x; // no").markers == []
    assert len(tokenize("cpp", "int x; // yes\n").markers) == 1


@pytest.mark.parametrize("text, errors", [("void f() { }\n}\n", 1), ("void f() { if (1) {\n", 2), ("void f() { }\n", 0)])
def test_brackets_without_partners(text, errors):
    assert len(tokenize("cpp", text).errors) == errors


CS = """using System;
namespace N.M {
    [Attr(1)]
    public class Box<T> : IBox {
        public int Size { get { return 1; } set { size = value; } }
        public int Auto { get; set; }
        void IBox.Open<T>(int a) { if (a > 1) { Close(); } }
        interface IInner { void F(); }
    }
}
"""


def test_csharp_regions():
    found = named("cs", CS)
    assert ("Box<T>", "class") in found and ("get", "function") in found and ("set", "function") in found
    assert ("IBox.Open<T>", "function") in found and ("IInner", "interface") in found
    assert not any(n.startswith("Attr") for n, _ in found)


JAVA = """package p;
@Note(1)
public class Box<T> {
    @Override
    public int $size(int a) { return a; }
    interface Inner { void f(); }
}
"""


def test_java_regions():
    assert named("java", JAVA) == [("__global__", "global"), ("Box", "class"), ("$size", "function"), ("Inner", "interface")]


PIECES = ["class A", "{", "}", ";", "f(", ")", "// c\n", "/* c */", '"s"', "'c'", "#define X\n", "\n\n", " ", "\n", "int x", "namespace n", "<", ">", ":", "é", "𝒳", "struct", "union U", "@", "["]


@settings(max_examples=150, deadline=None)
@given(lang=st.sampled_from(sorted(LANGUAGES)), parts=st.lists(st.sampled_from(PIECES), max_size=40))
def test_spans_cover_the_text(lang, parts):
    text = "".join(parts)
    rows = region_rows("./x", lang, text)
    whole, regions = rows[0], rows[1:]
    at = 0
    for s in whole[-1]:
        assert s["text"] == text[s["begin"] : s["end"]] and s["begin"] >= at
        at = s["end"]
    # quotes of strings belong to no span or to code; else nothing is lost
    assert whole[7] == len(text) and whole[11] == zlib.crc32(text.encode())
    assert [r[2] for r in regions] == list(range(1, len(regions) + 1))
    assert regions[0][4] == "__global__" and all(r[3] is None or r[3] < r[2] for r in regions)
    for r in regions:
        assert all(s["text"] == text[s["begin"] : s["end"]] for s in r[-1])
