import random
from collections import defaultdict

import pytest

from loomscan.operators import report as R
from loomscan.operators import store
from loomscan.operators.limit import Limit, warnings
from loomscan.operators.match import match_regions
from loomscan.operators.metrics import builtin
from loomscan.operators.suppress import suppressions
from loomscan.operators.spans import tokenize
from loomscan.sources.files import with_facts

SPECS = builtin()
ONE = "int f(int a) { return a; }\nint g(int a) { if (a) { return 1; } return 2; }\n"
TWO = "int f(int a) { return a; }\nint g(int a) { if (a) { while (a) a--; } return 2; }\nint h() { return 3; }\n"
KEPT = "class K { void k() { if (1) {} } };\n"
OLD = [("./one.cpp", ONE), ("./dir/kept.cpp", KEPT), ("./dir/gone.cpp", "int x() {}\n")]
NEW = [("./one.cpp", TWO), ("./dir/kept.cpp", KEPT), ("./dir/fresh.cpp", "int y() { if (1) {} }\n")]


def files(spark, rows):
    return with_facts(spark.createDataFrame([(p, "cpp", t) for p, t in rows], "path string, lang string, text string"))


@pytest.fixture(scope="module")
def snapshots(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("snapshots"))
    store.write(store.collect(files(spark, OLD), SPECS, properties={"a": "1"}), f"{folder}/old")
    old = store.read(spark, f"{folder}/old")
    store.write(store.collect(files(spark, NEW), SPECS, old), f"{folder}/new")
    store.write(store.collect(files(spark, NEW), SPECS), f"{folder}/full")
    return tuple(store.read(spark, f"{folder}/{n}") for n in ("old", "new", "full"))


def rows(df):
    return sorted(map(str, df.select(*sorted(f"`{c}`" for c in df.columns)).collect()))


def test_incremental_equals_full(snapshots):
    _, new, full = snapshots
    assert rows(new.files) == rows(full.files) and rows(new.regions) == rows(full.regions) and new.properties["config"] == full.properties["config"]


def test_modes(snapshots):
    old, new, _ = snapshots
    limit = Limit.parse("std.code.complexity:cyclomatic:0")

    def names(mode, **options):
        return sorted((r["path"], r["region"]) for r in warnings(new, limit, old, mode, **options).collect())

    assert names("all") == [("./dir/fresh.cpp", "y"), ("./dir/kept.cpp", "k"), ("./one.cpp", "g")]
    assert names("touched") == names("trend") == [("./dir/fresh.cpp", "y"), ("./one.cpp", "g")]
    assert names("new") == [("./dir/fresh.cpp", "y")]
    assert names("all", hotspots=1) == [("./one.cpp", "g")] and names("all", prefix="./dir") == [("./dir/fresh.cpp", "y"), ("./dir/kept.cpp", "k")]
    g = warnings(new, limit, old, "touched").filter("region = 'g'").first()
    assert (g["modified"], g["trend"], g["value"]) == (True, 1.0, 2.0)


def test_files_can_be_limited_too(snapshots):
    old, new, _ = snapshots
    got = warnings(new, Limit("std.general:size", 10.0), old, "touched").collect()
    assert sorted((r["path"], r["modified"]) for r in got) == [("./dir/fresh.cpp", None), ("./one.cpp", True)]


def test_wrong_limits(snapshots):
    with pytest.raises(ValueError):
        Limit.parse("a:b")
    with pytest.raises(ValueError):
        Limit.parse("a:b:1:planet")
    with pytest.raises(ValueError):
        warnings(snapshots[1], Limit("no.such:metric", 1.0))


def test_export_and_info(snapshots):
    old, new, _ = snapshots
    table = [r.asDict() for r in R.export(new, old).collect()]
    assert [r["type"] for r in table if r["file"] == "./one.cpp"] == ["global", "function", "function", "function", "file"]
    assert {r["region"]: r["modified"] for r in table if r["file"] == "./one.cpp" and r["type"] == "function"} == {"f": False, "g": True, "h": None}
    changes = {r["path"]: r["change"] for r in R.file_info(new, old).collect()}
    assert changes == {"./one.cpp": "[modified]", "./dir/kept.cpp": "", "./dir/fresh.cpp": "[new]"}


def test_region_tree(snapshots):
    trails = {r["trail"] for r in R.region_tree(snapshots[1].regions).collect()}
    assert "__global__/K/k" in trails


SUPPRESSED = """// loomscan: suppress std.general:size

// loomscan: suppress std.code.complexity:cyclomatic
/* loomscan: suppress std.general:size
   loomscan: suppress no.such:metric */
// loomscan: suppress std.code.complexity:cyclomatic
int f()
{
    // loomscan: suppress std.code.lines:code
    if (1) {}
}
"""


def test_suppressions(spark):
    s = store.collect(files(spark, [("./s.cpp", SUPPRESSED)]), SPECS)
    good, bad = suppressions(tokenize(spark.createDataFrame([("./s.cpp", "cpp", SUPPRESSED)], "path string, lang string, text string")), s.fields)
    assert {(r["region_id"], tuple(r["metrics"])) for r in good.collect()} >= {(2, ("std.code.complexity:cyclomatic",)), (None, ("std.general:size",))}
    assert {(r["region_id"], r["metric"], r["reason"]) for r in bad.collect()} == {(2, "std.general:size", "misplaced"), (2, "no.such:metric", "unknown"), (2, "std.code.complexity:cyclomatic", "duplicate")}
    limit = Limit("std.code.complexity:cyclomatic", 0.0)
    assert warnings(s, limit).count() == 0 and warnings(s, limit, suppressions=False).count() == 1
    assert warnings(s, Limit("std.general:size", 0.0)).count() == 0


def test_other_marks(spark):
    text = "// tool+x: suppress std.general:size\nint a;\n"
    f = files(spark, [("./s.cpp", text)])
    limit = Limit("std.general:size", 0.0)
    assert warnings(store.collect(f, SPECS), limit).count() == 1
    assert warnings(store.collect(f, SPECS, mark="tool+x:"), limit).count() == 0


def paired(cur, prev):
    """Pairs in order of appearance, by checksum and then by name."""
    out = {}
    for key in (2, 1):
        free = defaultdict(list)
        for r in prev:
            if r[0] not in {p for p, _ in out.values()}:
                free[r[key]].append(r[0])
        for r in cur:
            if r[0] not in out and free[r[key]]:
                out[r[0]] = (free[r[key]].pop(0), key == 1)
    return out


def test_matcher_is_first_come_first_served(spark):
    rng = random.Random(5)
    a, b, wanted = [], [], {}
    for f in range(60):
        cur, prev = ([(k, rng.choice("fgh"), rng.randrange(4)) for k in range(1, rng.randrange(2, 9))] for _ in range(2))
        a += [(f"./{f}", *r) for r in cur]
        b += [(f"./{f}", *r) for r in prev]
        wanted |= {(f"./{f}", k): v for k, v in paired(cur, prev).items()}
    schema = "path string, region_id int, name string, checksum long"
    got = match_regions(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()
    assert {(r["path"], r["region_id"]): (r["prev_region_id"], r["modified"]) for r in got} == wanted
