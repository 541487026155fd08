"""Registered queries over the standard tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import detect
from . import detection, tables, values

_MODULES = (values, detection, tables)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored detection under the default configuration; a row per candidate."""
    return detect.candidates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "text", detection.DEFAULT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in _MODULES for k, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.oracle_sql().items()}
