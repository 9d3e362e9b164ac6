"""Joins with contracts, set operations, pivots and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.operators.contracts import ContractError, duplicate_keys


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """A join that raises if the sides aren't unique as validate (one_to_one, many_to_one, one_to_many) says.

    The check is an aggregation of the keys alone. Null keys match nothing.
    """
    one_left, one_right = (x == "one" for x in validate.split("_to_"))
    for side, df, one in (("left", left, one_left), ("right", right, one_right)):
        if one and not duplicate_keys(df.select(*on).dropna(), on).isEmpty():
            raise ContractError(f"{validate} join: the {side} side repeats keys {on}")
    return left.join(right, on, how)


def suffixed_join(left: DataFrame, right: DataFrame, on: list[str], how: str, suffixes: tuple[str, str]) -> DataFrame:
    """A join in which columns of both sides get a suffix each."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    rename = lambda df, s: df.select(*[F.col(c).alias(c + s) if c in both else F.col(c) for c in df.columns])
    return rename(left, suffixes[0]).join(rename(right, suffixes[1]), on, how)


def lookup_all(left: DataFrame, right: DataFrame, on: list[str], value: str) -> DataFrame:
    """A left join that raises if a key has no value."""
    out = left.join(right, on, "left")
    missing = out.filter(F.col(value).isNull()).select(*on).limit(5).collect()
    if missing:
        raise ContractError(f"no {value} for {[tuple(r) for r in missing]}")
    return out


def membership_flag(left: DataFrame, right: DataFrame, on: list[str], flag: str) -> DataFrame:
    """left with a flag whether its key is in right; the flag is false for null keys."""
    keys = right.select(*on).distinct().withColumn(flag, F.lit(True))
    return left.join(keys, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def mapped_or(left: DataFrame, label: str, category: str, mapping: DataFrame) -> DataFrame:
    """Rows whose label or category is mapped (mapping: kind, name, target), each target once.

    The OR is two equi joins, so neither degrades to a nested loop.
    """
    parts = []
    for kind, column in (("label", label), ("category", category)):
        m = mapping.filter(F.col("kind") == kind).select(F.col("name").alias(column), "target")
        parts.append(left.join(m, column).select(*left.columns, "target"))
    return parts[0].unionByName(parts[1]).distinct()


def frames_equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether both have the same rows, repeats counted, in the same columns in any order."""
    if set(a.columns) != set(b.columns):
        return False
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def frame_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side (left or right), repeats counted."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def contingency(df: DataFrame, row: str, column: str, values: list, total: bool = False) -> DataFrame:
    """Counts of row x column over the stated values, 0 where there are none; total adds a row ALL."""
    df = df.select(F.col(row).cast("string").alias(row), column)
    keyed = df.rollup(row) if total else df.groupBy(row)
    out = keyed.agg(*[F.count_if(F.col(column) == v).alias(str(v)) for v in values], F.grouping(row).alias("_g") if total else F.lit(0).alias("_g"))
    return out.withColumn(row, F.when(F.col("_g") == 1, "ALL").otherwise(F.col(row))).drop("_g")


def with_total(df: DataFrame, group: str, *aggregates: Column, name: str = "ALL") -> DataFrame:
    """Aggregates of each group and of all rows, in one pass by grouping sets."""
    out = df.rollup(group).agg(*aggregates, F.grouping(group).alias("_g"))
    return out.withColumn(group, F.when(F.col("_g") == 1, name).otherwise(F.col(group))).drop("_g")


def overlapping_groups(df: DataFrame, groups: dict[str, Column], into: str) -> DataFrame:
    """A row once for each group whose condition holds, so that groups may overlap."""
    tags = F.array_compact(F.array(*[F.when(c, n) for n, c in groups.items()]))
    return df.withColumn(into, F.explode(tags))


def id_mismatches(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: joined rows and, for each column, how many differ (null against a value differs)."""
    joined = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns]), key)
    return joined.agg(F.count("*").alias("joined"), *[F.count_if(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"differ_{c}") for c in columns])
