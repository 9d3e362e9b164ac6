"""Names, paths and small text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snake(name: str) -> str:
    """Lower case with blanks and slashes as underscores."""
    return name.strip().lower().replace(" ", "_").replace("/", "_")


def snake_columns(df: DataFrame) -> DataFrame:
    """All headers in snake case; raises if two would be the same."""
    new = [snake(c) for c in df.columns]
    if len(set(new)) < len(new):
        raise ValueError(f"headers clash in snake case: {sorted(c for c in set(new) if new.count(c) > 1)}")
    return df.toDF(*new)


def snake_value(x: Column) -> Column:
    return F.translate(F.lower(F.trim(x)), " /", "__")


def templated_path(template: str, **parts: Column) -> Column:
    """A path from a template with {name} fields, each a column."""
    out, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        field, _, rest = rest.partition("}")
        out += [F.lit(head), parts[field].cast("string")]
    return F.concat(*out, F.lit(rest))


def capitalised(x: Column) -> Column:
    """The first letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def one_space(x: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))
