"""Grouped scores, log-odds fusion and the fixpoint of rules over the statements of an entity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions.numeric import logit, sigmoid


def group_scores(scores: DataFrame, entity: str, group: str, n: int) -> DataFrame:
    """(entity, group, present, absent, best, rank): the highest present and absent score of each group, ranked by the greater.

    scores: (entity, group, polarity, score); null scores don't count; the n first groups of each entity are kept.
    """
    best = scores.groupBy(entity, group).agg(F.max(F.when(F.col("polarity") == "present", F.col("score"))).alias("present"), F.max(F.when(F.col("polarity") == "absent", F.col("score"))).alias("absent"))
    best = best.withColumn("best", F.greatest("present", "absent")).filter("best is not null")
    w = Window.partitionBy(entity).orderBy(F.col("best").desc(), F.col(group).asc())
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def priority_polarity(votes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, polarity): present before absent before uncertain."""
    r = F.when(F.col("polarity") == "present", 3).when(F.col("polarity") == "absent", 2).when(F.col("polarity") == "uncertain", 1)
    return votes.groupBy(*keys).agg(F.max_by("polarity", r).alias("polarity"))


def fuse(evidence: DataFrame, keys: list[str], base: Column, weights: dict[str, float], priors: list[str]) -> DataFrame:
    """(keys, prior_source, confidence): log odds of a prior plus weighted shifts of the other sources.

    evidence: (keys, source, score, base). The prior is the first of priors that has a score, else the base rate. Every
    other source shifts by weight x (logit(score) - logit(base)).
    """
    s = evidence.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("source", F.col("score").cast("double").alias("score")))).alias("m"), F.max(base).alias("base"))
    prior, name = F.col("base"), F.lit("base")
    for p in reversed(priors):
        has = F.try_element_at("m", F.lit(p))
        prior, name = F.when(has.isNotNull(), has).otherwise(prior), F.when(has.isNotNull(), p).otherwise(name)
    total = logit(prior)
    for source, weight in weights.items():
        x = F.try_element_at("m", F.lit(source))
        total = total + F.when(x.isNotNull() & (name != source), weight * (logit(x) - logit(F.col("base")))).otherwise(0.0)
    return s.select(*keys, name.alias("prior_source"), sigmoid(total).alias("confidence"))


def merge_sides(statements: DataFrame, keys: list[str], margin: float = 0.1) -> DataFrame:
    """(keys, side, score): the better of left and right, or bilateral if they are within margin; unspecified if alone."""
    m = statements.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == s, F.col("score"))).alias(s) for s in ("left", "right", "bilateral", "unspecified")])
    both = F.col("left").isNotNull() & F.col("right").isNotNull()
    side = F.when(F.col("bilateral").isNotNull() | (both & (F.abs(F.col("left") - F.col("right")) <= margin)), "bilateral").when(F.col("left") >= F.coalesce("right", F.lit(float("-inf"))), "left").when(F.col("right").isNotNull(), "right").otherwise("unspecified")
    return m.select(*keys, side.alias("side"), F.greatest("left", "right", "bilateral", "unspecified").alias("score"))


Rule = Callable[[pd.DataFrame], pd.DataFrame]


def exclusive(a: str, b: str) -> Rule:
    """Of two exclusive nodes of an entity the weaker is dropped, on a tie the second."""
    def rule(t: pd.DataFrame) -> pd.DataFrame:
        x, y = t[t.node == a].score.max(), t[t.node == b].score.max()
        return t if pd.isna(x) or pd.isna(y) else t[t.node != (b if x >= y else a)]

    return rule


def subsume_unspecified(t: pd.DataFrame) -> pd.DataFrame:
    """A statement without a side is dropped where its node has one with a side."""
    sided = set(t[t.side.isin(["left", "right", "bilateral"])].node)
    return t[~((t.side == "unspecified") & t.node.isin(sided))]


def valid_sides(allowed: set[str]) -> Rule:
    """Sides of nodes that have none are reset to unspecified."""
    def rule(t: pd.DataFrame) -> pd.DataFrame:
        t = t.copy()
        t.loc[~t.node.isin(allowed), "side"] = "unspecified"
        return t.sort_values(["node", "side", "score"], ascending=[True, True, False]).drop_duplicates(["node", "side"])

    return rule


def fixpoint(statements: DataFrame, entity: str, rules: list[Rule], passes: int = 5) -> DataFrame:
    """(entity, node, side, score, passes, settled) after rules are applied until nothing changes or passes are used up.

    Rules see one entity's statements at a time, of which there are few (at most nodes x sides after the pre-aggregation
    done here). A state seen before ends the loop as not settled.
    """
    schema = f"{entity} {statements.schema[entity].dataType.simpleString()}, node string, side string, score double, passes int, settled boolean"
    small = statements.groupBy(entity, "node", "side").agg(F.max("score").cast("double").alias("score"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        key, state, seen, n, settled = t[entity].iloc[0], t[["node", "side", "score"]].sort_values(["node", "side"]).reset_index(drop=True), set(), 0, False
        while n < passes:
            n += 1
            new = state
            for rule in rules:
                new = rule(new)
            new = new.sort_values(["node", "side"]).reset_index(drop=True)
            if new.equals(state):
                settled = True
                break
            mark = new.to_json()
            state = new
            if mark in seen:
                break
            seen.add(mark)
        return state.assign(**{entity: key, "passes": n, "settled": settled})[[entity, "node", "side", "score", "passes", "settled"]]

    return small.groupBy(entity).applyInPandas(run, schema)


def diverse(df: DataFrame, group: str, key: str, score: str, vector: str, most: float, n: int) -> DataFrame:
    """Greedy choice of at most n rows a group by descending score, leaving out rows with a cosine above most to a chosen one.

    The choice is sequential, so each group is taken in one task, but as a stream of its sorted rows: only chosen vectors
    are held. Null vectors are left out; equal scores go to the smaller key.
    """
    import numpy as np

    rows = df.filter(F.col(vector).isNotNull()).select(group, key, F.col(score).cast("double").alias(score), F.col(vector).cast("array<double>").alias(vector)).repartition(group).sortWithinPartitions(F.col(group), F.col(score).desc(), F.col(key))
    schema = f"{group} {rows.schema[group].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, {score} double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = object(), []
        for t in batches:
            out = []
            for g, k, s, v in zip(t[group], t[key], t[score], t[vector]):
                if g != now:
                    now, kept = g, []
                x = np.asarray(v)
                x = x / max(np.linalg.norm(x), 1e-300)
                if len(kept) < n and all(float(x @ y) <= most for y in kept):
                    kept.append(x)
                    out.append((g, k, s))
            yield pd.DataFrame(out, columns=[group, key, score])

    return rows.mapInPandas(run, schema)
