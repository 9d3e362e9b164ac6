"""Linear models: assembly, fitting with a held-out grid, calibration, cross-fitting, scoring and contributions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions.hashing import hash_bucket
from strataform.functions.numeric import zscore_impute
from strataform.operators.contracts import ContractError
from strataform.operators.metrics import auroc
from strataform.runtime import cut

GRID = (0.01, 0.1, 1.0, 10.0)


@dataclass
class Linear:
    """Weights by feature name; the order of names is part of the model."""

    names: list[str]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """The linear score of a row; null features count as 0."""
        return sum((F.coalesce(F.col(n).cast("double"), F.lit(0.0)) * w for n, w in zip(self.names, self.weights)), F.lit(self.intercept))

    def contributions(self, df: DataFrame, key: str, groups: dict[str, list[str]]) -> DataFrame:
        """(key, group, contribution): weight x value summed over the features of each group, intercept included."""
        by = dict(zip(self.names, self.weights))
        parts = [F.struct(F.lit(g).alias("group"), sum((F.coalesce(F.col(n).cast("double"), F.lit(0.0)) * by[n] for n in names), F.lit(0.0)).alias("contribution")) for g, names in groups.items()]
        parts.append(F.struct(F.lit("intercept").alias("group"), F.lit(self.intercept).alias("contribution")))
        return df.select(key, F.explode(F.array(*parts)).alias("p")).select(key, "p.*")


def check_names(df: DataFrame, names: list[str]) -> None:
    """Raises unless df has the features in exactly this order."""
    have = [c for c in df.columns if c in set(names)]
    if have != names:
        raise ContractError(f"features {have} don't match {names}")


def standardise(df: DataFrame, features: list[str], fit_on: Column) -> DataFrame:
    """Every feature as its z-score by the mean and population deviation of the fit rows, and <name>_missing."""
    ok = lambda c: F.when(fit_on & ~F.isnan(c), F.col(c))
    stats = df.agg(*[f(ok(c).cast("double")).alias(f"_{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    new = {}
    for c in features:
        z, miss = zscore_impute(F.when(~F.isnan(c), F.col(c)).cast("double"), F.col(f"_m_{c}"), F.col(f"_s_{c}"))
        new |= {c: z, f"{c}_missing": miss}
    return out.withColumns(new).drop(*stats.columns)


def fit_logistic(df: DataFrame, features: list[str], label: str, c: float, iterations: int = 100) -> Linear:
    """Logistic regression with penalty 1 / (c n), unstandardised; rows with a null label are left out."""
    known = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="error").transform(df.filter(F.col(label).isNotNull())).select("_x", F.col(label).cast("double").alias("_y"))
    n = known.count()
    m = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=iterations, tol=1e-8).fit(known)
    return Linear(features, [float(w) for w in m.coefficients], float(m.intercept))


def fit_grid(df: DataFrame, features: list[str], label: str, key: str, grid: tuple[float, ...] = GRID) -> tuple[Linear, float]:
    """The penalty with the best AUROC on a twentieth of the keys held out by hash, then refitted on all rows."""
    inner = hash_bucket("inner", F.col(key), 20) == 0
    best, best_c = -1.0, grid[0]
    for c in grid:
        m = fit_logistic(df.filter(~inner), features, label, c)
        a = auroc(df.filter(inner).select(F.col(label).alias("y"), m.score().alias("p")), []).first()
        value = (a["auroc"] if a is not None and a["auroc"] is not None else 0.5)
        if value > best + 1e-12:
            best, best_c = value, c
    return fit_logistic(df, features, label, best_c), best_c


def fit_groups(df: DataFrame, group: str, features: list[str], label: str, grid: tuple[float, ...] = GRID, most: int = 50) -> DataFrame:
    """(group, c, n, intercept, weights, gradient): a logistic model of every group and penalty, all fitted together.

    Newton steps need only sums over rows, so a step is one aggregation with one row a group and penalty, however large the
    groups are; the features squared times groups times penalties must fit on the driver (groups are nodes of an ontology).
    Rows with a null label or feature are left out. gradient is the largest derivative left; 0 up to rounding at the optimum.
    A group whose labels are all equal gets the penalised optimum too.
    """
    import numpy as np

    known = df.filter(F.col(label).isNotNull())
    for f in features:
        known = known.filter(F.col(f).isNotNull())
    known = cut(known.select(F.col(group).alias("g"), F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features]).alias("x"), F.col(label).cast("double").alias("y")))
    names = [r[0] for r in known.select("g").distinct().orderBy("g").collect()]
    d = len(features) + 1
    weights = {(g, c): np.zeros(d) for g in names for c in grid}
    out = {}
    kind = known.schema["g"].dataType.simpleString()
    for _ in range(most):
        todo = [k for k in weights if k not in out]
        if not todo:
            break
        table = known.sparkSession.createDataFrame([(g, float(c), [float(w) for w in weights[g, c]]) for g, c in todo], f"g {kind}, c double, w array<double>")
        rows = known.join(F.broadcast(table), "g")  # one row a group and penalty
        z = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        rows = rows.withColumn("p", 1 / (1 + F.exp(-z)))
        first = [F.sum((F.col("p") - F.col("y")) * F.col("x")[i]).alias(f"g{i}") for i in range(d)]
        second = [F.sum(F.col("p") * (1 - F.col("p")) * F.col("x")[i] * F.col("x")[j]).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)]
        for r in rows.groupBy("g", "c").agg(F.count("*").alias("n"), *first, *second).collect():
            w = weights[r.g, r.c]
            ridge = np.r_[0.0, np.full(d - 1, 1.0 / r.c)]
            gradient = np.array([r[f"g{i}"] for i in range(d)]) + ridge * w
            if np.abs(gradient).max() <= 1e-7 * max(1, r.n):
                out[r.g, r.c] = (r.n, float(np.abs(gradient).max()))
                continue
            hessian = np.diag(ridge + 1e-9)
            for i in range(d):
                for j in range(i, d):
                    hessian[i, j] += r[f"h{i}_{j}"]
                    hessian[j, i] = hessian[i, j]
            step = np.linalg.solve(hessian, gradient)
            weights[r.g, r.c] = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    rows = [(g, float(c), *out.get((g, c), (None, None)), float(w[0]), [float(v) for v in w[1:]]) for (g, c), w in weights.items()]
    return known.sparkSession.createDataFrame(rows, f"{group} {kind}, c double, n bigint, gradient double, intercept double, weights array<double>")


def conditional_rows(df: DataFrame, links: DataFrame, entity: str, node: str, label: str) -> DataFrame:
    """Rows of df that may teach P(node | parent): labelled, and of entities whose parent is labelled 1; roots keep all.

    links: (child, parent); of several parents the smallest counts.
    """
    of = F.broadcast(links.groupBy(F.col("child").alias(node)).agg(F.min("parent").alias("_parent")))  # as small as the ontology
    rows = df.filter(F.col(label).isNotNull()).join(of, node, "left")
    open_ = df.filter(F.col(label) == 1).select(F.col(entity), F.col(node).alias("_parent"))
    gated = rows.filter("_parent is not null").join(open_, [entity, "_parent"], "left_semi")
    return gated.select(*df.columns).unionByName(rows.filter("_parent is null").select(*df.columns))


def fit_platt(df: DataFrame, score: str, label: str) -> Linear:
    """A one-dimensional logistic map of scores to probabilities, practically without a penalty."""
    return fit_logistic(df, [score], label, 1e6)


def fit_multinomial(df: DataFrame, features: list[str], label: str, least: int = 200) -> DataFrame | None:
    """df with probabilities (array, in the order of the sorted labels) of a multinomial model, or None under least rows."""
    known = df.filter(F.col(label).isNotNull())
    if known.count() < least:
        return None
    names = sorted(r[0] for r in known.select(label).distinct().collect())
    index = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(label)).cast("double") - 1
    put = VectorAssembler(inputCols=features, outputCol="_x")
    m = LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial").fit(put.transform(known).withColumn("_y", index))
    return m.transform(put.transform(df)).withColumn("probabilities", vector_to_array("probability")).drop("_x", "rawPrediction", "probability", "prediction")


def cross_fit(df: DataFrame, features: list[str], label: str, cluster: str, fit_on: Column, folds: int, c: float = 1.0, salt: str = "fold") -> DataFrame:
    """df with oof: fit rows are scored by the model that hasn't seen their cluster, others by the mean of all models."""
    fold = hash_bucket(salt, F.col(cluster), folds)
    models = [fit_logistic(df.filter(fit_on & (fold != k)), features, label, c) for k in range(folds)]
    own = F.lit(None).cast("double")
    for k, m in enumerate(models):
        own = F.when(fold == k, m.score()).otherwise(own)
    return df.withColumn("oof", F.when(fit_on, own).otherwise(sum((m.score() for m in models), F.lit(0.0)) / folds))


def isotonic(df: DataFrame, group: str, score: str, label: str, least: int = 20) -> DataFrame:
    """df with calibrated: an isotonic map of the score for each group, or its base rate under least labelled rows.

    Groups are fitted one by one, so there should be few; their maps are broadcast, one row a group.
    """
    known = cut(df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).select(group, F.col(score).cast("double").alias("_x"), F.col(label).cast("double").alias("_y")))
    maps = []
    for g, n, rate in known.groupBy(group).agg(F.count("*"), F.avg("_y")).collect():
        if n < least:
            maps.append((g, None, [rate]))
            continue
        m = IsotonicRegression(featuresCol="_x", labelCol="_y").fit(known.filter(F.col(group).eqNullSafe(F.lit(g))))
        maps.append((g, [float(x) for x in m.boundaries], [float(y) for y in m.predictions]))
    kind = df.schema[group].dataType.simpleString()
    on = df.join(F.broadcast(df.sparkSession.createDataFrame(maps, f"_g {kind}, _xs array<double>, _ys array<double>")), F.col(group).eqNullSafe(F.col("_g")), "left")
    s, xs, ys = F.col(score), F.col("_xs"), F.col("_ys")
    i = F.size(F.filter(xs, lambda x: x <= s))  # knots at or below the score
    x0, x1, y0, y1 = F.get(xs, i - 1), F.get(xs, i), F.get(ys, i - 1), F.get(ys, i)
    inside = F.when(i == 0, F.get(ys, F.lit(0))).when(i == F.size(xs), y0).otherwise(y0 + (s - x0) / (x1 - x0) * (y1 - y0))
    return on.withColumn("calibrated", F.when(xs.isNull(), F.get(ys, F.lit(0))).when(s.isNotNull(), inside)).drop("_g", "_xs", "_ys")


def masked_weights(df: DataFrame, groups: list[str], label: str) -> DataFrame:
    """df with value (0 where unknown), mask, and the positive weight neg / pos of its group."""
    w = Window.partitionBy(*groups)
    pos, neg = F.count_if(F.col(label) == 1).over(w), F.count_if(F.col(label) == 0).over(w)
    return df.withColumn("value", F.coalesce(F.col(label), F.lit(0))).withColumn("mask", F.col(label).isNotNull().cast("int")).withColumn("pos_weight", neg / F.greatest(pos, F.lit(1)))


