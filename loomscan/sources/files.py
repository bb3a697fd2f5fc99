"""Source trees as DataFrames: listing, filters, language dispatch, decoding."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.decoding import decode
from ..workers import ship

#: Language to file-name patterns; the first language with a match is taken.
PATTERNS = {"cpp": "*.c,*.h,*.cpp,*.hpp,*.cc,*.hh,*.cxx,*.hxx", "cs": "*.cs", "java": "*.java"}


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _starts(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(f"^(?:{pattern})")


def normal_path(path: Column) -> Column:
    """Slashes only; a relative path starts with ./"""
    slashed = F.translate(path, "\\", "/")
    rooted = slashed.rlike("^(/|[A-Za-z]:|\\.{1,2}(/|$)|[A-Za-z][A-Za-z0-9+.-]*:)")
    return F.when(rooted, slashed).otherwise(F.concat(F.lit("./"), slashed))


def language_of(path: Column, patterns: dict[str, str] = PATTERNS) -> Column:
    """The first language one of whose name patterns fits, else null."""
    base = F.substring_index(path, "/", -1)
    out = F.lit(None).cast("string")
    for lang, globs in reversed(patterns.items()):
        rx = "|".join(fnmatch.translate(g.strip()).replace("(?s:", "(?:").removesuffix("\\Z").removesuffix("\\z") for g in globs.split(","))
        out = F.when(base.rlike(f"^(?:{rx})$"), lang).otherwise(out)
    return out


def keep_paths(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, exclude_dirs: list[str] | None = None, root: str = "./") -> DataFrame:
    """Rows whose path passes the filters; patterns match from the start of a name, as many as wanted of each.

    include: the file's name must fit one (default: any). exclude: neither the file's name nor that of a folder below
    root may fit (default: hidden ones; own patterns replace the default). exclude_dirs: no folder's whole path may fit.
    """
    rest = F.when(F.col("path").startswith(root), F.substring(F.col("path"), len(root) + 1, 1 << 30)).otherwise(F.col("path"))
    parts = F.filter(F.split(rest, "/"), lambda x: x != "")
    ok = _any([F.element_at(F.split("path", "/"), -1).rlike(f"^(?:{p})") for p in include or [".*"]])
    for p in [r"[.]"] if exclude is None else exclude:
        ok = ok & ~F.exists(parts, _starts(p))
    if exclude_dirs:
        n = F.size(parts)
        folders = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.concat(F.lit(root), F.array_join(F.slice(parts, 1, k), "/")))
        ok = ok & ~((n > 1) & _any([F.exists(folders, _starts(p)) for p in exclude_dirs]))
    return files.filter(ok)


@F.pandas_udf(StringType())
def decode_udf(content: pd.Series) -> pd.Series:
    return content.map(decode, na_action="ignore")


def read_tree(spark: SparkSession, path: str, recursive: bool = True, include: list[str] | None = None, exclude: list[str] | None = None, exclude_dirs: list[str] | None = None, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """Files of a tree that are source code: path, lang, text, checksum, n_chars.

    path is ./ and the place below the given folder (a single file: its name). Filters run on listings, before
    contents are decoded. A missing path is Spark's error.
    """
    ship(spark)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    base = re.sub(r"/+$", "", re.sub(r"^\w+:(//)?", "", path))
    plain = F.regexp_replace("path", "^[A-Za-z]+:/*", "/")
    below = F.when(plain.startswith(base + "/"), F.substring(plain, len(base) + 2, 1 << 30)).otherwise(F.substring_index(plain, "/", -1))
    files = raw.select(normal_path(below).alias("path"), "content")
    files = keep_paths(files, include, exclude, exclude_dirs).withColumn("lang", language_of(F.col("path"), patterns)).filter("lang is not null")
    return with_facts(files.select("path", "lang", decode_udf("content").alias("text")))


def with_facts(files: DataFrame) -> DataFrame:
    """Adds checksum (crc32 of the text) and n_chars to path, lang, text."""
    return files.select("path", "lang", "text", F.crc32("text").alias("checksum"), F.length("text").cast("long").alias("n_chars"))
