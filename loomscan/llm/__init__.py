"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, lines, mixing, neardup, quality, secretscan, tokens, urls, warc

_MODULES = (quality, tokens, neardup, warc, secretscan, urls, mixing, decontaminate, lines)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
