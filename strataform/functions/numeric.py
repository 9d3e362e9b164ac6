"""Scalar and array expressions; all stay on the JVM. NaN counts as missing and becomes null at the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN of float and double columns becomes null."""
    chosen = columns or [c for c, k in df.dtypes if k in ("float", "double")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in chosen})


def clip(x: Column, low: float, high: float) -> Column:
    """x between low and high; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    c = clip(p, eps, 1 - eps)
    return F.ln(c / (1 - c))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1), for counts."""
    return a / F.greatest(b, F.lit(1))


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if a side is null or lengths differ in a null element."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """Unit length; a zero vector gives null."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def weighted_mean(x: Column, w: Column) -> Column:
    """sum(w x) / max(sum w, 1e-6)."""
    total = F.aggregate(F.transform(w, lambda v: v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(x, w) / F.greatest(total, F.lit(1e-6))


def zscore_impute(x: Column, mean: Column, std: Column) -> list[Column]:
    """Standardised value with null replaced by the mean (so 0), and a flag that it was missing."""
    return [F.coalesce((x - mean) / (std + 1e-6), F.lit(0.0)), x.isNull().cast("int")]


def one_hot(x: Column, values: list) -> list[Column]:
    """One 0/1 column a value; null gives zeros."""
    return [F.coalesce((x == v).cast("int"), F.lit(0)) for v in values]


def outer(a: Column, b: Column) -> Column:
    """Row-major outer product of two arrays as one flat array."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x.cast("double") * y.cast("double"))))


def fractional_iou(a: Column, b: Column) -> Column:
    """sum(min) / sum(max) of two grids of weights; null where both are empty of weight."""
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    low = add(F.zip_with(a, b, lambda x, y: F.least(x.cast("double"), y.cast("double"))))
    high = add(F.zip_with(a, b, lambda x, y: F.greatest(x.cast("double"), y.cast("double"))))
    return F.when(high > 0, low / high)


def overlap_1d(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Length of the overlap of two intervals, 0 if none."""
    return F.greatest(F.lit(0.0), F.least(hi1, hi2) - F.greatest(lo1, lo2))


def two_prompt_softmax(a: Column, b: Column) -> Column:
    """exp(a) / (exp(a) + exp(b)), in the form that can't overflow."""
    return sigmoid(a - b)


def width_bin(p: Column, bins: int) -> Column:
    """Equal-width bin of [0, 1] from 0; an edge belongs to the bin above, 1.0 to the last."""
    return F.least(F.greatest(F.width_bucket(p, F.lit(0.0), F.lit(1.0), F.lit(bins)) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
