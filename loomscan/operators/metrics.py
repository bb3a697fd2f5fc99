"""Declared metrics over spans, compiled to columns; the built-in ones and a registry for others."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ANY, REGION_TYPES, SPAN_KINDS, Field
from .spans import texts

CODE, STRING, COMMENT, PREPROCESSOR = (SPAN_KINDS[k] for k in ("code", "string", "comment", "preprocessor"))
TYPES = REGION_TYPES["class"] | REGION_TYPES["struct"] | REGION_TYPES["interface"]
#: Python's meaning of . and of \s, \w, \b in Java's regular expressions.
FLAGS = "(?dU)"
NO_WORD = "[^A-Za-z_0-9]"


def java(pattern: str) -> str:
    """A pattern as Java's regular expressions have it.

    Their class of ranges is a chain of calls in which threads of one JVM hinder each other; \\W is the same characters
    and a single call (with 8 threads, branches of 120,000 files took 0.25 instead of 4 seconds).
    """
    return FLAGS + pattern.replace(NO_WORD, r"(?-U:\W)")


Counter = Callable[[Column, str | None], Column]


def count_matches(found: Column, pattern: str | None) -> Column:
    """Matches in each text on its own, summed: none crosses the edge of a span."""
    return F.aggregate(found, F.lit(0).cast("long"), lambda n, t: n + F.regexp_count(t, F.lit(java(pattern))))


def count_where(keep: Callable[[Column], Column]) -> Counter:
    """A counter of the matches that keep() accepts."""

    def count(found: Column, pattern: str | None) -> Column:
        return F.aggregate(found, F.lit(0).cast("long"), lambda n, t: n + F.size(F.filter(F.regexp_extract_all(t, F.lit(java(pattern)), F.lit(0)), keep)))

    return count


def max_depth(found: Column, pattern: str | None) -> Column:
    """Deepest nesting of braces; the depth carries over from span to span."""
    zero = F.struct(F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c == "{", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    braces = F.flatten(F.transform(found, lambda t: F.regexp_extract_all(t, F.lit("[{}]"), F.lit(0))))
    return F.aggregate(braces, zero, step, lambda s: s["most"])


@dataclass(frozen=True)
class MetricSpec:
    """A metric counted in the spans of some kinds, of regions of some types (or of files).

    patterns: one for all languages under "*", or one a language; a language without one is an error when evaluated.
    """

    field: Field
    patterns: dict[str, str | None]
    kinds: int = ANY
    types: int = ANY
    merge: bool = False
    counter: Counter = count_matches
    spans: str = "spans"

    def column(self) -> Column:
        """Null where the metric doesn't apply, and for 0 where zeros aren't stored."""
        found = texts(F.col(self.spans), self.kinds, self.merge)
        if set(self.patterns) == {"*"}:
            value = self.counter(found, self.patterns["*"])
        else:
            no_match = F.raise_error(F.concat(F.lit(f"{self.field.column}: no pattern for language "), F.coalesce("lang", F.lit("null")))).cast("long")
            value = self.counter(found, self.patterns["*"]) if "*" in self.patterns else no_match
            for lang, p in self.patterns.items():
                if lang != "*":
                    value = F.when(F.col("lang") == lang, self.counter(found, p)).otherwise(value)
        applies = F.col("region_id").isNotNull() & (F.col("group_id").bitwiseAND(self.types) != 0) if self.field.regions else F.col("region_id").isNull()
        value = F.when(applies, value)
        return (F.nullif(value, F.lit(0)) if self.field.non_zero else value).alias(self.field.column)


def _keywords(*words: str) -> str:
    return rf"{NO_WORD}(?:{'|'.join(words)}){NO_WORD}"


def _branches(*, once: bool = False) -> dict[str, str]:
    words = ["if", "switch" if once else "case", "for", "while", "catch"]
    plain = _keywords(*words) + r"|&&|\|\||\?"
    return {"cpp": plain, "java": plain, "cs": _keywords(*words, "foreach") + r"|&&|\|\||\?\??"}


_LINE = r"[^\s].*"
_INT = r"(?:[1-9](?:'?[0-9])*|0(?:'?[0-7])*|0[xX][0-9A-Fa-f](?:'?[0-9A-Fa-f])*|0[bB][01](?:'?[01])*)"
_SUFFIX = r"(?:[uU]?(?:ll|LL|[lLzZ])?|(?:ll|LL|[lLzZ])[uU])"
_NUMBERS = {
    "cpp": rf"const(?:expr)?(?:\s+[A-Za-z_][A-Za-z_0-9]*)+\s*=\s*[-+]?{_INT}{_SUFFIX}\b|virtual\s+.*\s*=\s*0\s*[,;]|override\s+=\s*0\s*[,;]|\b{_INT}{_SUFFIX}\b",
    "cs": r"const(?:\s+[A-Za-z_][A-Za-z_0-9]*)+\s*=\s*[-+]?[0-9]+\b|\b[0-9]+\b",
    "java": r"const(?:\s+[$A-Za-z_][$A-Za-z_0-9]*)+\s*=\s*[-+]?[0-9]+\b|\b[0-9]+\b",
}
# The second name has exactly two characters: that is what is counted, whatever the metric's name promises.
_MEMBERS = {
    "cpp": r"[A-Za-z_][A-Za-z_0-9]*\s+[A-Za-z_][A-Za-z_0-9]\s*[;=]",
    "java": r"[$A-Za-z_][$A-Za-z_0-9]*\s+[$A-Za-z_][$A-Za-z_0-9]\s*[;=]",
    "cs": r"[A-Za-z_][A-Za-z_0-9]*\s+[A-Za-z_][A-Za-z_0-9]\s*(?:[;=]|\{\s*(?:(?:public|private|protected|internal)\s+)?[gs]et\s*;\s*[a-z \t\r\n]*\})",
}
TODO_TAGS = ("TODO", "ToDo", "FIXME", "FixMe", "TBD", "HACK", "XXX")


def _magic(simpler: bool) -> Counter:
    def keep(m: Column) -> Column:
        ok = ~m.rlike("^(?:const|virtual|override)")
        return ok & ~m.isin("0", "1", "-1", "+1") if simpler else ok

    return count_where(keep)


def complexity_metrics() -> list[MetricSpec]:
    fn = REGION_TYPES["function"]
    name = "std.code.complexity"
    return [
        MetricSpec(Field(name, "cyclomatic"), _branches(), CODE, fn),
        MetricSpec(Field(name, "cyclomatic_switch_case_once"), _branches(once=True), CODE, fn),
        MetricSpec(Field(name, "maxindent"), {"*": None}, CODE, fn, counter=max_depth),
    ]


def line_metrics(regions: bool = True) -> list[MetricSpec]:
    name, line = "std.code.lines" if regions else "std.code.filelines", {"*": _LINE}
    return [
        MetricSpec(Field(name, "code", regions=regions), line, CODE | STRING, merge=True),
        MetricSpec(Field(name, "preprocessor", regions=regions), line, PREPROCESSOR),
        MetricSpec(Field(name, "comments", regions=regions), line, COMMENT),
        MetricSpec(Field(name, "total", regions=regions), line, merge=True),
    ]


def long_line_metrics(limit: int = 80) -> list[MetricSpec]:
    return [MetricSpec(Field("std.code.longlines", "numbers", non_zero=True), {"*": f".{{{limit + 1},}}"}, CODE)]


def magic_metrics(simpler: bool = False) -> list[MetricSpec]:
    return [MetricSpec(Field("std.code.magic", "numbers", non_zero=True), _NUMBERS, CODE, counter=_magic(simpler))]


def member_metrics() -> list[MetricSpec]:
    """Fields and globals; counts of child regions are in child_metrics."""
    name = "std.code.member"
    return [
        MetricSpec(Field(name, "fields", non_zero=True), _MEMBERS, CODE, TYPES),
        MetricSpec(Field(name, "globals", non_zero=True), _MEMBERS, CODE, REGION_TYPES["global"] | REGION_TYPES["namespace"]),
    ]


def todo_metrics(tags: tuple[str, ...] = TODO_TAGS) -> list[MetricSpec]:
    if bad := [t for t in tags if not re.fullmatch("[A-Za-z0-9_]+", t)]:
        raise ValueError(f"tags may have letters, digits and _ only: {', '.join(bad)}")
    pattern = {"*": rf"\b(?:{'|'.join(sorted(tags))})\b"}
    return [MetricSpec(Field("std.code.todo", f, non_zero=True), pattern, kind) for f, kind in (("comments", COMMENT), ("strings", STRING))]


def builtin(longlines: int = 80, simpler_numbers: bool = False, tags: tuple[str, ...] = TODO_TAGS) -> list[MetricSpec]:
    return [*complexity_metrics(), *line_metrics(), *line_metrics(False), *long_line_metrics(longlines), *magic_metrics(simpler_numbers), *member_metrics(), *todo_metrics(tags)]


REGISTRY: dict[str, MetricSpec] = {}


def register(spec: MetricSpec) -> MetricSpec:
    """Adds a metric to those that collect() evaluates; names are unique."""
    if spec.field.column in REGISTRY:
        raise ValueError(f"metric is registered already: {spec.field.column}")
    REGISTRY[spec.field.column] = spec
    return spec


_CHILDREN = {"classes": "class", "structs": "struct", "interfaces": "interface", "types": "class,struct,interface", "methods": "function", "namespaces": "namespace"}
CHILD_FIELDS = [Field("std.code.member", f, non_zero=True) for f in _CHILDREN]
LENGTH = Field("std.code.length", "total")
MI = Field("std.code.mi", "simple")
RATIO = Field("std.code.ratio", "comments", kind="double")


_MASKS = {f: reduce(int.__or__, (REGION_TYPES[t] for t in ts.split(","))) for f, ts in _CHILDREN.items()}


def child_metrics(regions: DataFrame) -> DataFrame:
    """path, parent_id, number of direct children by type, their length: one aggregation for all seven metrics.

    For regions of any origin; of the tokenizer's rows, which know their children, measure() needs none.
    """
    counts = [F.nullif(F.count_if(F.col("group_id").bitwiseAND(m) != 0), F.lit(0)).alias(f"std.code.member:{f}") for f, m in _MASKS.items()]
    return regions.filter("parent_id is not null").groupBy("path", "parent_id").agg(*counts, F.sum(F.col("offset_end") - F.col("offset_begin")).alias("_inside"))


def _child_columns() -> list[Column]:
    """child_metrics() of the tokenizer's rows: each has the types of its children."""

    def count(mask: int) -> Column:
        return F.size(F.filter("children", lambda t: t.bitwiseAND(mask) != 0)).cast("long")

    return [F.nullif(count(m), F.lit(0)).alias(f"std.code.member:{f}") for f, m in _MASKS.items()]


def rank(value: Column, limits: list[int]) -> Column:
    """1 for values up to the first limit, and so on; one more than the limits for larger ones. Null stays null."""
    out = F.lit(len(limits) + 1)
    for k in range(len(limits), 0, -1):
        out = F.when(value <= limits[k - 1], k).otherwise(out)
    return F.when(value.isNotNull(), out)


def maintainability(cyclomatic: Column, code: Column) -> Column:
    """Product of the ranks of complexity and size; without complexity (not a function) that of size."""
    return (F.coalesce(rank(cyclomatic, [7, 11, 19, 49]), F.lit(1)) * rank(code, [124, 249, 499, 999])).cast("long")


def comment_ratio(comments: Column, code: Column) -> Column:
    """Share of comment lines, cut to 3 digits; 0 where there are no lines or no metric."""
    both = comments + code
    return F.coalesce(F.when(both != 0, F.floor(1000 * comments / both) / 1000.0), F.lit(0.0))


def measure(tokens: DataFrame, specs: list[MetricSpec]) -> tuple[DataFrame, DataFrame]:
    """(regions, files) with a column a metric, of the tokenizer's rows. Without a shuffle: a row has all that its metrics need."""
    own = [s.column() for s in specs if s.field.regions]
    whole = [s.column() for s in specs if not s.field.regions]
    keep = [F.col(c) for c in tokens.columns if c not in ("spans", "procerrors", "children", "inside")]
    length = (F.col("offset_end") - F.col("offset_begin") - F.col("inside")).cast("long").alias(LENGTH.column)
    regions = tokens.filter("region_id is not null").select(*keep, *own, *_child_columns(), length)
    c = {s.field.column for s in specs}
    cyclomatic, code, comments = "std.code.complexity:cyclomatic", "std.code.lines:code", "std.code.lines:comments"
    if {cyclomatic, code} <= c:
        regions = regions.withColumn(MI.column, maintainability(F.col(f"`{cyclomatic}`"), F.col(f"`{code}`")))
    if {comments, code} <= c:
        regions = regions.withColumn(RATIO.column, comment_ratio(F.col(f"`{comments}`"), F.col(f"`{code}`")))
    size = F.col("offset_end").cast("long").alias("std.general:size")
    errors = F.nullif(F.col("procerrors"), F.lit(0)).cast("long").alias("std.general:procerrors")
    files = tokens.filter("region_id is null").select("path", "lang", "checksum", size, errors, *whole)
    return regions, files


def fields_of(specs: list[MetricSpec]) -> list[Field]:
    c = {s.field.column for s in specs}
    out = [s.field for s in specs] + CHILD_FIELDS + [LENGTH, Field("std.general", "size", regions=False), Field("std.general", "procerrors", non_zero=True, regions=False)]
    out += [MI] if {"std.code.complexity:cyclomatic", "std.code.lines:code"} <= c else []
    return out + ([RATIO] if {"std.code.lines:comments", "std.code.lines:code"} <= c else [])
