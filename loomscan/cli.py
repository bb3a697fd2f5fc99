"""Command line: collect, view, limit, report, export and info over snapshot folders."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import metrics as M
from .operators import report as R
from .operators import store
from .operators.limit import MODES, Limit, all_warnings
from .operators.suppress import MARK
from .plans.views import view
from .sinks import render
from .sources.files import PATTERNS, read_tree

_FLAGS = {
    "std.code.complexity.cyclomatic": lambda o: M.complexity_metrics()[:1],
    "std.code.complexity.cyclomatic_switch_case_once": lambda o: M.complexity_metrics()[1:2],
    "std.code.complexity.maxindent": lambda o: M.complexity_metrics()[2:],
    **{f"std.code.lines.{f}": lambda o, k=k: M.line_metrics()[k : k + 1] for k, f in enumerate(("code", "preprocessor", "comments", "total"))},
    **{f"std.code.filelines.{f}": lambda o, k=k: M.line_metrics(False)[k : k + 1] for k, f in enumerate(("code", "preprocessor", "comments", "total"))},
    "std.code.longlines": lambda o: M.long_line_metrics(o["std.code.longlines.limit"]),
    "std.code.magic.numbers": lambda o: M.magic_metrics(o["std.code.magic.numbers.simplier"]),
    **{f"std.code.member.{f}": lambda o, k=k: M.member_metrics()[k : k + 1] for k, f in enumerate(("fields", "globals"))},
    **{f"std.code.todo.{f}": lambda o, k=k: M.todo_metrics(tuple(o["std.code.todo.tags"].split(",")))[k : k + 1] for k, f in enumerate(("comments", "strings"))},
}
#: Derived or always there; their flags need others.
_DERIVED = {"std.code.maintindex.simple": {"std.code.complexity.cyclomatic", "std.code.lines.code"}, "std.code.ratio.comments": {"std.code.lines.comments", "std.code.lines.code"}}
_FREE = ("std.general.size", "std.general.procerrors", "std.general.proctime", "std.code.length.total", "std.suppress", *(f"std.code.member.{x}" for x in ("classes", "structs", "interfaces", "types", "methods", "namespaces")))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomscan")
    actions = top.add_subparsers(dest="action", required=True)

    def action(name: str) -> argparse.ArgumentParser:
        p = actions.add_parser(name)
        p.add_argument("--db-file", default="./loomscan.db")
        p.add_argument("--db-file-prev")
        p.add_argument("--log-level", default="WARN", choices=["DEBUG", "INFO", "WARN", "ERROR"])
        p.add_argument("paths", nargs="*", default=["./"])
        return p

    p = action("collect")
    for name in [*_FLAGS, *_DERIVED, *_FREE]:
        p.add_argument(f"--{name}", dest=name, action="store_true")
    p.add_argument("--std.code.longlines.limit", dest="std.code.longlines.limit", type=int, default=80)
    p.add_argument("--std.code.magic.numbers.simplier", dest="std.code.magic.numbers.simplier", action="store_true")
    p.add_argument("--std.code.todo.tags", dest="std.code.todo.tags", default=",".join(M.TODO_TAGS))
    p.add_argument("--std.suppress.mark", dest="std.suppress.mark", default=MARK)
    for lang, globs in PATTERNS.items():
        p.add_argument(f"--std.code.{lang}.files", dest=f"std.code.{lang}.files", default=globs)
    for name in ("include-files", "exclude-files", "exclude-directories"):
        p.add_argument(f"--{name}", action="append")
    p.add_argument("--non-recursively", action="store_true")
    p = action("view")
    p.add_argument("--format", default="txt", choices=list(render.FORMATS))
    p.add_argument("--nest-regions", action="store_true")
    p.add_argument("--max-distribution-rows", type=int, default=20)
    p.add_argument("--scope-mode", default="all", choices=["all", "new", "touched"])
    for name in ("limit", "report"):
        p = action(name)
        p.add_argument("--hotspots", type=int)
        p.add_argument("--disable-suppressions", action="store_true")
        p.add_argument("--warn-mode", default="all", choices=list(MODES))
        p.add_argument("--max-limit", action="append", default=[])
        p.add_argument("--min-limit", action="append", default=[])
        if name == "report":
            p.add_argument("--format", default="txt", choices=["txt", "doxygen", "json"])
            p.add_argument("--output-dir")
    action("export")
    action("info")
    return top


def _collect(spark: SparkSession, o: dict, fail) -> int:
    on = {n for n in [*_FLAGS, *_DERIVED] if o[n]}
    for name, needs in _DERIVED.items():
        if name in on and not needs <= on:
            fail(f"--{name} needs {', '.join('--' + n for n in sorted(needs))}")
    try:
        specs = [s for n in _FLAGS if n in on for s in _FLAGS[n](o)] + list(M.REGISTRY.values())
    except ValueError as e:
        fail(str(e))
    patterns = {lang: o[f"std.code.{lang}.files"] for lang in PATTERNS}
    files = None
    for path in o["paths"]:
        some = read_tree(spark, path, not o["non_recursively"], o["include_files"], o["exclude_files"], o["exclude_directories"], patterns)
        files = some if files is None else files.unionByName(some).dropDuplicates(["path"])
    prev = store.read(spark, o["db_file_prev"]) if o["db_file_prev"] else None
    store.write(store.collect(files, specs, prev, {"written": time.strftime("%Y-%m-%d %H:%M:%S")}, o["std.suppress.mark"]), o["db_file"])
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code: 2 for wrong use, for limit the number of warnings, and one more for each path that isn't there."""
    top = parser()
    o = vars(top.parse_args(argv))
    spark = spark or SparkSession.builder.appName("loomscan").getOrCreate()
    if o["action"] == "collect":
        return _collect(spark, o, top.error)
    cur = store.read(spark, o["db_file"])
    prev = store.read(spark, o["db_file_prev"]) if o["db_file_prev"] else None
    bad = [p for p in o["paths"] if not store.has_path(cur, p)]
    for p in bad:
        print(f"{p}:: error: bad path", file=sys.stderr)
    paths = [p for p in o["paths"] if p not in bad]
    code = len(bad)
    if o["action"] == "view":
        if o["scope_mode"] != "all" and prev is None:
            top.error("--scope-mode needs --db-file-prev")
        for p in paths:
            print(render.FORMATS[o["format"]](view(cur, prev, p, o["scope_mode"], o["max_distribution_rows"], o["nest_regions"])), end="")
    elif o["action"] in ("limit", "report"):
        if o["warn_mode"] != "all" and prev is None:
            top.error("--warn-mode needs --db-file-prev")
        try:
            limits = [Limit.parse(x, k) for k in ("max", "min") for x in o[f"{k}_limit"]]
            for x in limits:
                cur.field_of(x.metric)
        except ValueError as e:
            top.error(str(e))
        for p in paths:
            found = all_warnings(cur, limits, prev=prev, mode=o["warn_mode"], hotspots=o["hotspots"], suppressions=not o["disable_suppressions"], prefix=p) if limits else None
            rows = found.orderBy("metric", "path", "region_id").collect() if limits else []
            if o["action"] == "limit":
                print(render.warnings_text(rows), end="")
                for x in limits:
                    print(f"{p}:: info: {sum(r['metric'] == x.metric for r in rows)} regions exceeded the limit {x.metric}:{x.value:g}")
                code += len(rows)
            else:
                files = R.overview(store.below(cur, p), found if limits else spark.createDataFrame([], "path string")).orderBy("path").collect()
                said = render.report_text(files, rows, o["format"])
                if o["output_dir"]:
                    os.makedirs(o["output_dir"], exist_ok=True)
                    ending = {"txt": "txt", "doxygen": "dox", "json": "json"}[o["format"]]
                    with open(f"{o['output_dir']}/loomscan.{ending}", "w") as f:
                        f.write(said)
                else:
                    print(said, end="")
    elif o["action"] == "export":
        for p in paths:
            print(render.table_csv(R.export(store.below(cur, p), store.below(prev, p) if prev else None)), end="")
    else:
        for k, v in sorted(cur.properties.items()):
            was = f" [modified (was: {prev.properties.get(k)})]" if prev and prev.properties.get(k) != v else ""
            print(f"\t{k:<15}: {v}{was}")
        for f in sorted(cur.fields, key=lambda f: f.column):
            print(f"\t{f.column:<40}: {f.kind}{' [new]' if prev and f not in prev.fields else ''}")
        for p in paths:
            for r in R.file_info(store.below(cur, p), store.below(prev, p) if prev else None).orderBy("path").toLocalIterator():
                print(f"\t{r['path']:<40}: {r['checksum']:#x} {r['change']}".rstrip())
    return code


if __name__ == "__main__":
    sys.exit(min(main(), 255))
