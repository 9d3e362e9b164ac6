"""Ranking metrics, calibration, operating points, thresholds and bootstrap intervals.

Scores are first counted by group and value, so that ties are exact and no task sorts a whole group. Rows with a null label
(masked) or a null score are left out. Input columns: y (0, 1 or null) and p.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions.numeric import width_bin
from strataform.operators.ordered import running_before
from strataform.runtime import checked_broadcast, cores, cut, numbered_rows, read_parts, shared_folder

MIN_HITS = 10
#: Rows that a bootstrap folds at once, and bytes of the weights that one of its tasks holds.
FOLD_ROWS, WEIGHT_BYTES = 2048, 64 << 20
#: Cumulative probabilities of a Poisson variable of mean 1, by which a hash becomes a bootstrap weight.
POISSON_1 = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]


def by_value(df: DataFrame, group: list[str], weight: Column | None = None) -> DataFrame:
    """group, p, pos, neg: (weighted) numbers of positives and negatives of each value."""
    w = F.lit(1) if weight is None else weight
    known = df.filter("y is not null and p is not null and not isnan(p)")
    return known.groupBy(*group, "p").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, w).otherwise(0)).alias("neg"))


def auroc(df: DataFrame, group: list[str], weight: Column | None = None) -> DataFrame:
    """group, n_pos, n_neg, auroc (ties count half); auroc is null without both classes."""
    v = running_before(by_value(df, group, weight), group, "p", ["neg"], descending=False)
    out = v.groupBy(*group).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("u"))
    return out.select(*group, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"))


def average_precision(df: DataFrame, group: list[str], weight: Column | None = None) -> DataFrame:
    """group, auprc: the sum over distinct scores of gained recall times precision."""
    v = running_before(by_value(df, group, weight), group, "p", ["pos", "neg"], descending=True)
    tp, all_ = F.col("before_pos") + F.col("pos"), F.col("before_pos") + F.col("pos") + F.col("before_neg") + F.col("neg")
    out = v.filter(all_ > 0).groupBy(*group).agg(F.sum("pos").alias("n"), F.sum(F.col("pos") * tp / all_).alias("s"))
    return out.select(*group, F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("auprc"))


def calibration_error(df: DataFrame, group: list[str], bins: int = 15) -> DataFrame:
    """group, ece: equal-width bins, each weighted by its share of rows."""
    b = df.filter("y is not null and p is not null").withColumn("bin", width_bin(F.col("p"), bins)).groupBy(*group, "bin").agg(F.count("*").alias("n"), F.avg("y").alias("my"), F.avg("p").alias("mp"))
    return b.groupBy(*group).agg((F.sum(F.col("n") * F.abs(F.col("my") - F.col("mp"))) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, group: list[str]) -> DataFrame:
    """group, n, pos, prevalence, brier."""
    return df.filter("y is not null and p is not null").groupBy(*group).agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("pos"), F.avg(F.col("y").cast("double")).alias("prevalence"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))


def _per(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def operating_points(df: DataFrame, group: list[str], thresholds: DataFrame) -> DataFrame:
    """Counts and rates of each group at each of its thresholds (group, side, thr); present flags p >= thr, absent p <= thr."""
    known = df.filter("y is not null and p is not null").groupBy(*group, "p", "y").agg(F.count("*").alias("n"))
    on = known.join(F.broadcast(thresholds), group) if group else known.crossJoin(F.broadcast(thresholds))
    hit = F.when(F.col("side") == "present", F.col("p") >= F.col("thr")).otherwise(F.col("p") <= F.col("thr"))
    s = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    t = on.groupBy(*group, "side", "thr").agg(F.sum("n").alias("n"), s(hit).alias("hits"), s(hit & (F.col("y") == 1)).alias("hit_pos"), s(hit & (F.col("y") == 0)).alias("hit_neg"), s(F.col("y") == 1).alias("pos"), s(F.col("y") == 0).alias("neg"))
    present = F.col("side") == "present"
    c = F.col
    return t.select(
        *group, "side", "thr", (c("hits") / c("n")).alias("flagged"),
        F.when(present, _per(c("hit_pos"), c("pos"))).alias("sens"), F.when(present, _per(c("neg") - c("hit_neg"), c("neg"))).alias("spec"), F.when(present, _per(c("hit_pos"), c("hits"))).alias("ppv"),
        F.when(~present, _per(c("hit_neg"), c("hits"))).alias("npv"), F.when(~present, _per(c("hit_neg"), c("neg"))).alias("spec_absent"), F.when(~present, _per(c("hit_pos"), c("pos"))).alias("missed"),
    )


def curves(df: DataFrame, group: list[str]) -> DataFrame:
    """group, p and, for thresholds at p with ties: tp, fp (p >= it), fn, tn (p <= it) and the group's pos and neg."""
    v = by_value(df, group)
    d = running_before(v, group, "p", ["pos", "neg"], descending=True)
    total = v.groupBy(*group).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    d = d.join(total, group) if group else d.crossJoin(F.broadcast(total))
    c = F.col
    return d.select(*group, "p", (c("before_pos") + c("pos")).alias("tp"), (c("before_neg") + c("neg")).alias("fp"), (c("all_pos") - c("before_pos")).alias("fn"), (c("all_neg") - c("before_neg")).alias("tn"), "all_pos", "all_neg")


def present_threshold(curve: DataFrame, group: list[str], precision: float) -> DataFrame:
    """group, thr: the lowest score at which precision is reached with at least MIN_HITS true positives."""
    ok = curve.filter((F.col("tp") / (F.col("tp") + F.col("fp")) >= precision) & (F.col("tp") >= MIN_HITS))
    return ok.groupBy(*group).agg(F.min("p").alias("thr"))


def sensitivity_threshold(curve: DataFrame, group: list[str], target: float) -> DataFrame:
    """group, thr: the highest score at which sensitivity reaches the target."""
    return curve.filter(F.col("tp") / F.greatest(F.col("all_pos"), F.lit(1)) >= target).groupBy(*group).agg(F.max("p").alias("thr"))


def absent_threshold(curve: DataFrame, group: list[str], npv: float | None = None, missed: Column | float | None = None) -> DataFrame:
    """group, thr: the highest score up to which the NPV holds (with MIN_HITS true negatives), or at most missed positives lie."""
    if npv is not None:
        ok = curve.filter((F.col("tn") / (F.col("tn") + F.col("fn")) >= npv) & (F.col("tn") >= MIN_HITS))
    else:
        ok = curve.filter(F.col("fn") / F.greatest(F.col("all_pos"), F.lit(1)) <= missed)
    return ok.groupBy(*group).agg(F.max("p").alias("thr"))


def _thresholds() -> np.ndarray:
    """The least 60-bit numbers n whose n / 16^15 reaches each edge of POISSON_1, as doubles are compared."""
    out = []
    for edge in POISSON_1:
        n = int(edge * 16**15)
        n -= 1024  # a double near 2^60 stands for some 128 numbers
        while n / 16.0**15 < edge:
            n += 1
        out.append(n)
    return np.array(out, dtype=np.uint64)


def poisson_weights(clusters: list[str], replicates: range) -> np.ndarray:
    """Bootstrap weights of clusters (rows) in replicates (columns): the Poisson(1) number at a cluster's hash in a replicate.

    The hash is that of unit_hash: the first 15 hex digits of the SHA-256 of boot:replicate:cluster.
    """
    names, edges = [c.encode() for c in clusters], _thresholds()
    out = np.empty((len(names), len(replicates)), dtype=np.uint8)
    for k, r in enumerate(replicates):
        prefix = b"boot:%d:" % r
        digests = b"".join([sha256(prefix + c).digest() for c in names])
        u = np.frombuffer(digests, dtype=">u8")[::4].astype(np.uint64) >> np.uint64(4)
        out[:, k] = np.searchsorted(edges, u, side="right")
    return out


class _Fold:
    """Sums of weighted positives, negatives and pairs won of some replicates, over rows in the order of their scores.

    Rows come in parts of any size; a value that goes on in the next part is held open, so no value need fit into a part.
    """

    def __init__(self, replicates: int) -> None:
        self.pos, self.neg, self.u, self.open_pos, self.open_neg = (np.zeros(replicates) for _ in range(5))
        self.at: float | None = None

    def add(self, p: np.ndarray, up: np.ndarray, weights: np.ndarray) -> None:
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        pos, neg = (np.add.reduceat(np.where(up[:, None] == side, weights, 0.0), starts, axis=0) for side in (True, False))
        if self.at == p[0]:
            pos[0] += self.open_pos
            neg[0] += self.open_neg
        else:
            self.close()
        before = self.neg + np.cumsum(neg, axis=0) - neg
        self.u += (pos[:-1] * (before[:-1] + neg[:-1] / 2)).sum(0)
        self.pos += pos[:-1].sum(0)
        self.neg += neg[:-1].sum(0)
        self.at, self.open_pos, self.open_neg = p[-1], pos[-1], neg[-1]

    def close(self) -> None:
        self.u += self.open_pos * (self.neg + self.open_neg / 2)
        self.pos += self.open_pos
        self.neg += self.open_neg
        self.at, self.open_pos, self.open_neg = None, np.zeros_like(self.pos), np.zeros_like(self.neg)


def _fold_block(rows: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[tuple[int, _Fold]]:
    """(number of the group, its closed sums) from rows _g, _i (a cluster's row in weights), p, y, n in the order of _g and p."""
    group, fold = None, None
    for batch in rows:
        for start in range(0, batch.num_rows, FOLD_ROWS):
            g, i, p, y, n = (batch.column(c).slice(start, FOLD_ROWS).to_numpy(zero_copy_only=False) for c in ("_g", "_i", "p", "y", "n"))
            edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
            for lo, hi in zip(edges[:-1], edges[1:]):
                if g[lo] != group:
                    if fold is not None:
                        fold.close()
                        yield group, fold
                    group, fold = g[lo], _Fold(weights.shape[1])
                fold.add(p[lo:hi], y[lo:hi] == 1, weights[i[lo:hi]] * n[lo:hi, None].astype(np.float64))
    if fold is not None:
        fold.close()
        yield group, fold


def bootstrap_auroc(df: DataFrame, group: list[str], cluster: str, replicates: int, score: str = "p") -> DataFrame:
    """group, replicate, auroc with whole clusters drawn; auroc is null without both classes.

    Rows are first counted by cluster and value and written once, in the order of group and score, to the shared folder, with
    numbers in place of groups and clusters. A task takes a block of replicates: it draws the weights of all clusters for them
    (a byte each, WEIGHT_BYTES at most) and streams the rows past, so weights are neither stored nor shuffled.
    """
    spark = df.sparkSession
    known = df.filter(f"y is not null and {score} is not null and not isnan({score})").groupBy(*group, F.col(cluster).alias("_c"), F.col(score).cast("double").alias("p"), F.col("y").cast("int").alias("y")).agg(F.count("*").alias("n"))
    known = cut(known.filter("_c is not null"))
    clusters, groups = numbered_rows(known.select("_c").distinct(), "_i"), numbered_rows(known.select(*group).distinct(), "_g")
    folder = shared_folder(spark, "bootstrap")
    clusters.select("_i", F.col("_c").cast("string").alias("c")).write.parquet(f"{folder}/clusters")
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"o.{c}")) for c in group]
    marked = known.alias("k").join(checked_broadcast(groups).alias("o"), same).select("_g", "_c", "p", "y", "n") if group else known.withColumn("_g", F.lit(0).cast("bigint"))
    marked = marked.join(checked_broadcast(clusters), "_c").select("_g", "_i", "p", "y", "n")
    marked.repartitionByRange("_g", "p").sortWithinPartitions("_g", "p").write.parquet(f"{folder}/rows")
    size = clusters.count()
    width = max(1, min(-(-replicates // (2 * cores(spark))), WEIGHT_BYTES // max(1, size)))
    blocks = -(-replicates // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                own = range(block * width, min(replicates, (block + 1) * width))
                weights = np.zeros((size, len(own)), dtype=np.uint8)
                for part in read_parts(f"{folder}/clusters", ["_i", "c"]):
                    weights[part.column(0).to_numpy()] = poisson_weights(part.column(1).to_pylist(), own)
                for g, f in _fold_block(read_parts(f"{folder}/rows", ["_g", "_i", "p", "y", "n"]), weights):
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(own), pa.int64()), pa.array(list(own), pa.int32()), *(pa.array(x) for x in (f.pos, f.neg, f.u))], names=["_g", "replicate", "n_pos", "n_neg", "u"])

    # One task a block: the range has as many partitions as rows.
    sums = cut(spark.range(0, blocks, 1, blocks).mapInArrow(run, "_g bigint, replicate int, n_pos double, n_neg double, u double"))
    out = sums.join(checked_broadcast(groups), "_g") if group else sums
    return out.select(*group, "replicate", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"))


def paired_differences(replicates: DataFrame, name: str, value: str) -> DataFrame:
    """replicate, left, right, diff: left minus right for every pair of names, of which there are few, in each replicate."""
    per = replicates.groupBy("replicate").agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), F.col(value).alias("value")))).alias("a"))
    pairs = F.flatten(F.transform("a", lambda x, i: F.transform(F.slice("a", i + 2, F.size("a")), lambda y: F.struct(x["name"].alias("left"), y["name"].alias("right"), (x["value"] - y["value"]).alias("diff")))))
    return per.select("replicate", F.explode(pairs).alias("d")).select("replicate", "d.*")


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once: the product's rounding error is taken along (Dekker's products, Knuth's sums)."""
    halves = lambda x: (x * 134217729.0 - (x * 134217729.0 - x), x - (x * 134217729.0 - (x * 134217729.0 - x)))
    (ah, al), (bh, bl) = halves(a), halves(b)
    p = a * b
    lost = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    s = p + c
    return s + (((p - (s - (s - p))) + (c - (s - p))) + lost)


def _quantile(ordered: Column, q: float) -> Column:
    """The quantile of a sorted array between its two nearest values, rounded as DuckDB's quantile_cont does; null if empty."""
    at = (F.size(ordered) - 1) * F.lit(q)
    d = at - F.floor(at)
    value = lambda i: F.get(ordered, i.cast("int"))
    return _fused(value(F.floor(at)), 1 - d, value(F.ceil(at)) * d)


def interval(replicates: DataFrame, group: list[str], value: str, level: float = 0.95) -> DataFrame:
    """group, mean, low, high (percentiles, linear) and whether the interval excludes zero; replicates of a group fit a task."""
    a = (1 - level) / 2
    per = replicates.groupBy(*group).agg(F.avg(value).alias("mean"), F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("_v"))
    out = per.select(*group, "mean", _quantile(F.col("_v"), round(a, 12)).alias("low"), _quantile(F.col("_v"), round(1 - a, 12)).alias("high"))
    return out.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


def non_inferior(intervals: DataFrame, margin: float) -> DataFrame:
    return intervals.withColumn("non_inferior", F.col("low") > -margin)


def report_f1(claims: DataFrame, truth: DataFrame, group: list[str]) -> DataFrame:
    """node, tp, fp, fn, precision, recall, f1 of claimed against true (entity.., node) pairs, with rows MICRO and MACRO."""
    key = [*group, "node"]
    both = claims.select(*key).distinct().withColumn("c", F.lit(1)).join(truth.select(*key).distinct().withColumn("t", F.lit(1)), key, "full")
    per = both.groupBy("node").agg(F.count_if(F.col("c").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("c").isNull()).alias("fn"))
    c = F.col

    def rates(df: DataFrame) -> DataFrame:
        p, r = _per(c("tp"), c("tp") + c("fp")), _per(c("tp"), c("tp") + c("fn"))
        return df.select("node", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))

    each = rates(per)
    micro = rates(per.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).withColumn("node", F.lit("MICRO")))
    macro = each.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")).select(F.lit("MACRO").alias("node"), "tp", "fp", "fn", "precision", "recall", "f1")
    return each.unionByName(micro).unionByName(macro)


def running_sums(df: DataFrame, group: list[str]) -> DataFrame:
    """The curve over rows (not tie groups): running tp and rank by descending p, then id. For groups that fit a task."""
    w = Window.partitionBy(*group).orderBy(F.col("p").desc(), F.col("id").asc()).rowsBetween(Window.unboundedPreceding, 0)
    known = df.filter("y is not null and p is not null")
    return known.withColumn("k", F.count("*").over(w)).withColumn("tp", F.sum("y").over(w)).withColumn("ppv", F.col("tp") / F.col("k"))


def equivalence(a: DataFrame, b: DataFrame, keys: list[str], numbers: list[str], exact: list[str], tolerance: float) -> DataFrame:
    """One row: rows of one side only, and for each column how many differ (numbers by more than tolerance, nulls as values)."""
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in [*numbers, *exact]], F.lit(True).alias("_a"))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in [*numbers, *exact]], F.lit(True).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    far = lambda c: ~F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerance, F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNull())
    other = lambda c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return left.join(right, keys, "full").agg(
        F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"),
        *[F.count_if(both & far(c)).alias(f"differ_{c}") for c in numbers], *[F.count_if(both & other(c)).alias(f"differ_{c}") for c in exact],
    )


def variant_summary(intervals: DataFrame, group: list[str]) -> DataFrame:
    """group, better, worse, unclear: how many paired differences have an interval above, below or across zero."""
    return intervals.groupBy(*group).agg(F.count_if(F.col("low") > 0).alias("better"), F.count_if(F.col("high") < 0).alias("worse"), F.count_if((F.col("low") <= 0) & (F.col("high") >= 0)).alias("unclear"))


def attempt_summary(log: DataFrame) -> DataFrame:
    """One row from (item, attempt, passed, source): items, and shares that passed at first, were regenerated or fell back."""
    per = log.groupBy("item").agg(F.bool_or((F.col("attempt") == 1) & F.col("passed")).alias("first"), F.bool_or(F.col("source") == "template").alias("fell"), F.max("attempt").alias("attempts"))
    share = lambda c: F.count_if(c) / F.greatest(F.count("*"), F.lit(1))
    return per.agg(F.count("*").alias("items"), share(F.col("first")).alias("first_pass"), share(~F.col("first") & ~F.col("fell")).alias("regenerated"), share(F.col("fell")).alias("fallback"), F.max("attempts").alias("most_attempts"))


def signed_difference(df: DataFrame, wanted: DataFrame, first: str, second: str) -> DataFrame:
    """wanted's pairs (first, second) with diff, low and high of first less second, whichever order df holds them in.

    Turning a pair round negates the difference and swaps the ends of its interval; a pair df doesn't hold gets nulls.
    """
    keys = [c for c in wanted.columns if c not in (first, second)]
    straight = df.select(*keys, first, second, "diff", "low", "high")
    turned = df.select(*keys, F.col(second).alias(first), F.col(first).alias(second), (-F.col("diff")).alias("diff"), (-F.col("high")).alias("low"), (-F.col("low")).alias("high"))
    both = straight.withColumn("_turned", F.lit(0)).unionByName(turned.withColumn("_turned", F.lit(1)))
    found = both.groupBy(*keys, first, second).agg(F.min(F.struct("_turned", "diff", "low", "high")).alias("_b"))
    return wanted.join(found, [*keys, first, second], "left").select(*wanted.columns, F.col("_b.diff").alias("diff"), F.col("_b.low").alias("low"), F.col("_b.high").alias("high"))


def keep_or_drop(df: DataFrame, part: str, metric: str, node: str, falling: list[str], whole: str = "MACRO") -> DataFrame:
    """(part, keep, better, worse): whether a part of a model stays, by the intervals of with less without.

    A difference is better or worse if its interval excludes 0, in the direction of its metric (falling: lower is better).
    A part is dropped only if it is worse on the whole; better and worse list 'metric node', sorted.
    """
    up = ~F.col(metric).isin(falling)
    good, bad = F.when(up, F.col("low") > 0).otherwise(F.col("high") < 0), F.when(up, F.col("high") < 0).otherwise(F.col("low") > 0)
    name = F.concat_ws(" ", metric, node)
    lists = df.groupBy(part).agg(F.array_sort(F.collect_set(F.when(good, name))).alias("better"), F.array_sort(F.collect_set(F.when(bad & (F.col(node) == whole), name))).alias("worse"))
    return lists.select(part, (F.size("worse") == 0).alias("keep"), "better", "worse")
