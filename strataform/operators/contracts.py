"""Data contracts: they raise, or report, but never change rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Data that breaks a stated contract."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Raises if a column is missing; the check needs the schema only."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def expect_count(df: DataFrame, rows: int, what: str = "table") -> DataFrame:
    n = df.count()
    if n != rows:
        raise ContractError(f"{what}: {n} rows, expected {rows}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once with their number of rows; null keys count as equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def expect_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    bad = duplicate_keys(df, keys).limit(5).collect()
    if bad:
        raise ContractError(f"{what}: repeated keys {[tuple(r)[:-1] for r in bad]}")
    return df


def expect_not_null(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    found = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict()
    bad = {c: n for c, n in found.items() if n}
    if bad:
        raise ContractError(f"{what}: nulls {bad}")
    return df


def expect_finite(df: DataFrame, columns: list[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """Raises on NaN, infinite or out-of-range values; null is allowed."""
    def bad(c: str) -> Column:
        x = F.col(c).cast("double")
        out = F.isnan(x) | (F.abs(x) == float("inf"))
        out = out if low is None else out | (x < low)
        return out if high is None else out | (x > high)

    found = df.agg(*[F.count_if(bad(c)).alias(c) for c in columns]).first().asDict()
    if any(found.values()):
        raise ContractError(f"bad values: {found}")
    return df


def gate(checks: DataFrame) -> DataFrame:
    """Named checks (check, passed) with one more row ALL that passes only if all do; no checks pass."""
    total = checks.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed")).select(F.lit("ALL").alias("check"), "passed")
    return checks.select("check", "passed").unionByName(total)


def failed_share(df: DataFrame, failed: Column, most: float) -> DataFrame:
    """Raises if the share of failed rows is above most."""
    n, bad = df.agg(F.count("*"), F.count_if(failed)).first()
    if n and bad / n > most:
        raise ContractError(f"{bad} of {n} rows failed, more than {most:.3g}")
    return df


def guard_split(df: DataFrame, split: str, allowed: bool, closed: tuple[str, ...] = ("test", "external")) -> DataFrame:
    """Rows of a split; a closed split is refused before anything is read unless allowed is set."""
    if split in closed and not allowed:
        raise PermissionError(f"the split {split} is closed")
    return df.filter(F.col("split") == split)
