"""Bands from probabilities, ontology-driven changes to them, and the audit of every change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK = {"absent": 0, "silent": 1, "possible": 2, "present": 3}


def band(p: Column, present: Column, possible: Column, absent: Column) -> Column:
    """present at or above its threshold, else absent at or below its own, else possible, else silent.

    A null threshold is never met; a null p is silent.
    """
    ok = p.isNotNull() & ~F.isnan(p)
    return F.when(ok & (p >= present), "present").when(ok & (p <= absent), "absent").when(ok & (p >= possible), "possible").otherwise("silent")


def three_way(p: Column, low: Column, high: Column) -> Column:
    """abstain where high is 1 or more, else accept, reject or uncertain."""
    return F.when(high >= 1, "abstain").when(p >= high, "accept").when(p <= low, "reject").otherwise("uncertain")


def rank(b: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, r in RANK.items():
        out = F.when(b == name, r).otherwise(out)
    return out


def raise_parents(bands: DataFrame, pairs: DataFrame, entity: str = "entity") -> DataFrame:
    """(entity, node, band, raised): a band lifted to that of its most positive stated descendant (present over possible).

    pairs (ancestor, descendant) is a small closure; silent and absent descendants change nothing.
    """
    p = F.broadcast(pairs.filter("distance > 0").select(F.col("descendant").alias("node"), "ancestor"))
    stated = bands.filter(F.col("band").isin("present", "possible")).join(p, "node").groupBy(entity, F.col("ancestor").alias("node")).agg(F.max(rank(F.col("band"))).alias("best"))
    out = bands.join(stated, [entity, "node"], "left").withColumn("own", rank(F.col("band")))
    lifted = F.when(F.col("best") > F.col("own"), F.when(F.col("best") == 3, "present").otherwise("possible")).otherwise(F.col("band"))
    return out.select(entity, "node", "band", lifted.alias("raised"))


def normal_call(bands: DataFrame, root: str, critical: list[str], entity: str = "entity", column: str = "band") -> DataFrame:
    """(entity, normal): the root is absent and so is every critical node that the entity has; false without a root."""
    b = F.col(column)
    return bands.groupBy(entity).agg((F.coalesce(F.bool_or((F.col("node") == root) & (b == "absent")), F.lit(False)) & ~F.coalesce(F.bool_or(F.col("node").isin(critical) & (b != "absent")), F.lit(False))).alias("normal"))


def empty_bands(bands: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Nodes with an absent threshold but no absent row."""
    have = bands.filter("band = 'absent'").select("node").distinct()
    return thresholds.filter("absent is not null").select("node").join(have, "node", "left_anti")


def audit(before_after: DataFrame, keys: list[str], stages: list[tuple[str, str, str, str]]) -> DataFrame:
    """One row for each change: keys, seq, rule, field, before, after.

    stages: (rule, field, column before, column after) in order; a stage that changes nothing leaves no entry.
    """
    entries = F.array_compact(F.array(*[F.when(~F.col(b).eqNullSafe(F.col(a)), F.struct(F.lit(i).alias("seq"), F.lit(r).alias("rule"), F.lit(f).alias("field"), F.col(b).cast("string").alias("before"), F.col(a).cast("string").alias("after"))) for i, (r, f, b, a) in enumerate(stages)]))
    return before_after.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")


def side_of(left: Column, right: Column, threshold: Column) -> Column:
    """bilateral, left or right by which support reaches the threshold; null if none does or anything is unknown."""
    l, r = left >= threshold, right >= threshold
    return F.when(l.isNull() | r.isNull(), None).when(l & r, "bilateral").when(l, "left").when(r, "right")


def image_side(x: Column, view: Column, flip: Column, margin: float = 0.05) -> Column:
    """Patient side of an image position x in [0, 1]: the image's left half is the patient's right, unless flipped.

    unknown for a null x or a view that isn't PA or AP; midline nearer than margin to the middle.
    """
    known = x.isNotNull() & view.isin("PA", "AP")
    on_right = (x > 0.5) != F.coalesce(flip, F.lit(False))
    return F.when(~F.coalesce(known, F.lit(False)), "unknown").when(F.abs(x - 0.5) < margin, "midline").when(on_right, "left").otherwise("right")


def ratio_reliability(ratio: Column, view: Column) -> Column:
    """(value, reliable, note) of a measured ratio by view."""
    return F.struct(ratio.alias("value"), (ratio.isNotNull() & F.coalesce(view == "PA", F.lit(False))).alias("reliable"), F.when(ratio.isNull(), "not measured").when(view == "PA", F.lit(None).cast("string")).otherwise("view is not PA").alias("note"))


def demote(b: Column, support: Column, threshold: Column) -> Column:
    """present without enough support becomes possible; no threshold or no support changes nothing."""
    return F.when((b == "present") & (support < threshold), "possible").otherwise(b)


def withhold(side: Column, other: Column) -> Column:
    """The side, if another source gives the same; one that gives none disagrees."""
    return F.when(side == other, side)


def hedge(confidence: Column) -> Column:
    """Wording class of a confidence: sure from 0.8, likely from 0.5, else unsure."""
    return F.when(confidence >= 0.8, "sure").when(confidence >= 0.5, "likely").otherwise("unsure")


#: Words of a region's name that tell its zone, in the order they are tried, and words that rule a zone out.
ZONE_WORDS = [("apical", "upper"), ("upper", "upper"), ("mid", "middle"), ("middle", "middle"), ("lower", "lower"), ("costophrenic", "lower")]
LOBE_WORDS = ["lobe", "lingula"]


def zone_of(name: Column, strict: bool = False) -> Column:
    """Zone from a region's name; null for lobes. The words are sought anywhere in the name, with strict as whole words only."""
    low = F.lower(name)
    has = lambda w: low.rlike(rf"(^|[^a-z]){w}([^a-z]|$)") if strict else low.contains(w)
    out = F.lit(None).cast("string")
    for word, zone in reversed(ZONE_WORDS):
        out = F.when(has(word), zone).otherwise(out)
    lobe = F.lit(False)
    for word in LOBE_WORDS:
        lobe = lobe | low.contains(word)
    return F.when(~lobe, out)


def ground(localisations: DataFrame, region_nodes: DataFrame, containers: DataFrame, sides: DataFrame, allowed: DataFrame, entity: str = "entity") -> DataFrame:
    """Localisations (entity, node, region, score) with place, zone, side and valid; none is deleted.

    region_nodes: (region, place); containers: reflexive part-of closure (ancestor, descendant) of places; sides: (place,
    side) of places that have one, where a container's side counts for what it holds; allowed: (node, place), a node
    without rows is allowed anywhere. A region without a place is not valid.
    """
    small = lambda df: F.broadcast(df)  # noqa: E731  (an ontology's tables)
    up = containers.select(F.col("descendant").alias("place"), "ancestor")
    sided = up.join(sides.select(F.col("place").alias("ancestor"), "side"), "ancestor").groupBy("place").agg(F.min("side").alias("side"))
    ok = up.join(allowed.select("node", F.col("place").alias("ancestor")), "ancestor").select("node", "place", F.lit(True).alias("ok")).distinct()
    limited = allowed.select("node").distinct().withColumn("limited", F.lit(True))
    out = localisations.withColumn("region", F.lower(F.trim("region"))).join(small(region_nodes), "region", "left").join(small(sided), "place", "left")
    out = out.join(small(ok), ["node", "place"], "left").join(small(limited), "node", "left")
    valid = F.col("place").isNotNull() & (F.col("limited").isNull() | F.coalesce("ok", F.lit(False)))
    return out.select(entity, "node", "region", "score", "place", zone_of(F.col("place")).alias("zone"), "side", valid.alias("valid"))


def grounded_side(grounded: DataFrame, least: float = 0.5, entity: str = "entity") -> DataFrame:
    """(entity, node, side) from valid lateral localisations with at least that score: left, right, bilateral or null."""
    hit = F.col("valid") & (F.col("score") >= least)
    l, r = (F.coalesce(F.bool_or(hit & (F.col("side") == s)), F.lit(False)) for s in ("left", "right"))
    return grounded.groupBy(entity, "node").agg(F.when(l & r, "bilateral").when(l, "left").when(r, "right").alias("side"))


def best_zone(scores: DataFrame, entity: str = "entity") -> DataFrame:
    """(entity, node, side, zone, score): the highest-scoring zone of each side; ties go to upper, then middle. Nulls don't count."""
    place = F.when(F.col("zone") == "upper", 0).when(F.col("zone") == "middle", 1).otherwise(2)
    best = scores.filter("score is not null").groupBy(entity, "node", "side").agg(F.min(F.struct((-F.col("score")).alias("m"), place.alias("o"), "zone")).alias("b"))
    return best.select(entity, "node", "side", F.col("b.zone").alias("zone"), (-F.col("b.m")).alias("score"))


def statements(nodes: DataFrame, pairs: DataFrame, silent_nodes: list[str], always: list[str], if_present: dict[str, list[str]], zones_of: list[str], side_least: float = 0.8, entity: str = "entity") -> DataFrame:
    """(entity, node, band, side, zone, rule): what may be said of each node, rule naming why nothing is (else null).

    nodes: (entity, node, band, side, side_conf, zone); pairs: closure (ancestor, descendant). Nothing is said of silent
    nodes and of silent_nodes (P3), of a node with a descendant stated at least as surely (P1), and of absent ones that are
    neither always said nor asked for by a present node (P2). A side needs side_least confidence (P6); a zone needs a node
    of zones_of and one side (P8).
    """
    up = F.broadcast(pairs.filter("distance > 0").select(F.col("descendant").alias("node"), "ancestor"))
    sure = F.when(F.col("band") == "present", 2).when(F.col("band") == "possible", 1)
    said = nodes.filter(F.col("band").isin("present", "possible") & ~F.col("node").isin(silent_nodes)).select(entity, "node", sure.alias("sure"))
    below = said.join(up, "node").groupBy(entity, F.col("ancestor").alias("node")).agg(F.max("sure").alias("below"))
    present = nodes.filter("band = 'present'").groupBy(entity).agg(F.collect_set("node").alias("present"))  # at most the nodes of the ontology
    out = nodes.join(below, [entity, "node"], "left").join(present, entity, "left")
    asked = F.col("node").isin(always)
    for n, triggers in if_present.items():
        asked = asked | ((F.col("node") == n) & F.coalesce(F.arrays_overlap("present", F.array(*[F.lit(t) for t in triggers])), F.lit(False)))
    rule = (
        F.when((F.col("band") == "silent") | F.col("node").isin(silent_nodes), "P3")
        .when(F.col("band").isin("present", "possible") & (F.col("below") >= sure), "P1")
        .when((F.col("band") == "absent") & ~asked, "P2")
    )
    shown = F.when(F.col("band").isin("present", "possible") & (F.col("side_conf") >= side_least), F.col("side"))
    zone = F.when(shown.isin("left", "right") & F.col("node").isin(zones_of), F.col("zone"))
    said_at_all = rule.isNull()
    return out.select(entity, "node", "band", F.when(said_at_all, shown).alias("side"), F.when(said_at_all, zone).alias("zone"), rule.alias("rule"))
