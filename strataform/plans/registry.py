"""All queries of the core, for the driver's entry module."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

import strataform.plans as plans


def _gather(what: str) -> dict:
    found: dict = {}
    for m in sorted(x.name for x in pkgutil.iter_modules(plans.__path__) if x.name.startswith("queries_")):
        found |= getattr(importlib.import_module(f"strataform.plans.{m}"), what)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["normal_call"](spark, sf_dir)
