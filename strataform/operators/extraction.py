"""Facts, tags, explicit sides, plain terms and prompts from short texts and their parses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.operators.contracts import ContractError
from strataform.operators.text import combined_polarity, laterality, polarity, temporal
from strataform.runtime import checked_broadcast

# Plain terms of every finding, in the order in which they are tried.
PLAIN_TERMS = {
    "lung_opacity": ["lung opacity", "opacity", "opacities", "pulmonary opacity", "parenchymal opacity"],
    "atelectasis": ["atelectasis"],
    "consolidation": ["consolidation"],
    "pneumonia": ["pneumonia"],
    "edema": ["pulmonary edema", "edema"],
    "lung_lesion": ["lung nodule", "pulmonary nodule", "nodule", "lung mass", "pulmonary mass", "mass"],
    "enlarged_cardiomediastinum": ["enlarged cardiomediastinum", "widened mediastinum", "mediastinal widening", "enlarged cardiomediastinal silhouette"],
    "cardiomegaly": ["cardiomegaly"],
    "pleural_effusion": ["pleural effusion", "effusion"],
    "pleural_other": ["pleural thickening", "pleural plaques", "pleural plaque"],
    "pneumothorax": ["pneumothorax"],
    "fracture": ["rib fracture", "fracture", "rib fractures"],
    "support_devices": ["support devices", "support device", "lines and tubes", "tubes and lines"],
    "no_finding": ["normal chest radiograph", "normal chest x-ray", "normal chest", "normal study"],
}
# Words that state a side or a place.
BOTH_SIDES = r"(?i)\b(bilateral|bilaterally|both|bibasilar|bibasal|biapical|bilobar|lungs)\b"
PLACES = (
    r"(?i)\b(upper|mid|middle|lower|apex|apices|apical|base|bases|basal|basilar|bibasilar|biapical|hilar|hila|hilum|perihilar|retrocardiac|lobe|lobes|lobar|lingula|lingular"
    r"|costophrenic|zone|zones|lateral|medial|paratracheal|subpulmonic|peripheral|central|infrahilar|suprahilar|paramediastinal|subsegmental)\b"
)


def normal_term(x: Column) -> Column:
    """Lower case, single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def plain_terms(df: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(node, key, term): for every node the row whose text is its first plain term that occurs at all.

    terms has node, term, priority; stops and blanks at the end of a text don't count. Of several rows with the term the
    smallest key is taken; nodes without a hit give no row, null texts never hit.
    """
    rows = df.select(F.col(key).alias("key"), F.regexp_replace(F.lower(text), r"[.\s]+$", "").alias("term"))
    met = rows.join(checked_broadcast(terms), "term")
    best = met.groupBy("node").agg(F.min(F.struct("priority", "key", "term")).alias("b"))
    return best.select("node", F.col("b.key").alias(key), F.col("b.term").alias("term"))


def vocabulary(df: DataFrame, node: str, synonyms: str) -> DataFrame:
    """(term, nodes): every synonym of every node in normal form, with the sorted nodes that claim it; blank ones left out."""
    rows = df.select(F.col(node).alias("node"), F.explode(synonyms).alias("term")).select("node", normal_term(F.col("term")).alias("term"))
    return rows.filter("node is not null and term is not null and term <> ''").groupBy("term").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def unambiguous(terms: DataFrame) -> DataFrame:
    """(term, node) of a vocabulary; raises if two nodes claim a term."""
    clash = terms.filter(F.size("nodes") > 1).orderBy("term").first()
    if clash is not None:
        raise ContractError(f"term {clash.term!r} is claimed by {', '.join(clash.nodes)}")
    return terms.select("term", F.col("nodes")[0].alias("node"))


def core_observation(entities: DataFrame, key: list[str]) -> DataFrame:
    """One entity (key, place, entity, located) of each key: the first that is located somewhere, else the longest, then the first."""
    length = F.when(F.col("located"), 0).otherwise(-F.length("entity"))
    best = entities.groupBy(*key).agg(F.min(F.struct((~F.col("located")).alias("loose"), length.alias("length"), "place", "entity")).alias("b"))
    return best.select(*key, F.col("b.place").alias("place"), F.col("b.entity").alias("entity"), (~F.col("b.loose")).alias("located"))


def concept_tags(df: DataFrame, key: str, text: str, core: DataFrame, terms: DataFrame, cues: list[tuple[str, str, str]]) -> DataFrame:
    """df's key and text with node, laterality, polarity, temporal and group_key.

    core has key, entity, certainty and anatomy (one row a key, may be missing); terms (term, node). The node is that of the
    core entity, else that of the whole text; cues (node, word, other) change it where the word occurs. group_key is
    node|anatomy|laterality, - for no anatomy, null for no node.
    """
    words = terms.select("term", "node")
    rows = df.select(key, text).join(core.select(key, "entity", "certainty", "anatomy"), key, "left")
    by_core = rows.withColumn("term", normal_term(F.col("entity"))).join(checked_broadcast(words), "term", "left").drop("term").withColumnRenamed("node", "of_core")
    both = by_core.withColumn("term", normal_term(F.col(text))).join(checked_broadcast(words), "term", "left").drop("term")
    node = F.coalesce("of_core", "node")
    for of, word, other in cues:
        node = F.when((node == of) & F.contains(F.lower(text), F.lit(word)), other).otherwise(node)
    when = temporal(F.col(text))
    out = both.select(key, text, "anatomy", node.alias("node"), laterality(F.col(text)).alias("laterality"), combined_polarity(polarity(F.col(text), F.col("certainty")), when).alias("polarity"), when.alias("temporal"))
    group = F.when(F.col("node").isNotNull(), F.concat_ws("|", "node", F.coalesce("anatomy", F.lit("-")), "laterality"))
    return out.withColumn("group_key", group)


def report_facts(sentences: DataFrame, key: list[str], observations: DataFrame, anatomy: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, node, anatomy, laterality, polarity, temporal, sentence): one fact for each observation of each sentence.

    sentences (key, sentence); observations (key, entity, certainty); anatomy (key, place, entity, rid, null where it is no
    known place): the longest that is known counts, then the first. Observations outside the vocabulary, and those whose
    polarity and temporal class exclude each other, give no fact.
    """
    where = anatomy.filter("rid is not null").groupBy(*key).agg(F.min(F.struct((-F.length("entity")).alias("l"), "place", "rid")).alias("b")).select(*key, F.col("b.rid").alias("anatomy"))
    known = observations.withColumn("term", normal_term(F.col("entity"))).join(checked_broadcast(terms.select("term", "node")), "term").select(*key, "node", "certainty")
    s = F.col("sentence")
    when = temporal(s)
    rows = sentences.join(known, key).join(where, key, "left")
    facts = rows.select(*key, "node", "anatomy", laterality(s).alias("laterality"), combined_polarity(polarity(s, F.col("certainty")), when).alias("polarity"), when.alias("temporal"), "sentence")
    return facts.filter("polarity is not null")


def stated_side(x: Column) -> Column:
    """bilateral, left or right if the text states it, else null."""
    left, right = x.rlike(r"(?i)\bleft\b|\blt\b"), x.rlike(r"(?i)\bright\b|\brt\b")
    return F.when(x.rlike(BOTH_SIDES) | (left & right), "bilateral").when(left, "left").when(right, "right")


def explicit_sides(df: DataFrame, key: list[str], phrase: str) -> DataFrame:
    """(key, side): the side that the phrases of a key state, bilateral for both sides, default where none does."""
    s = df.select(*key, stated_side(F.col(phrase)).alias("s")).groupBy(*key).agg(*[F.bool_or(F.col("s") == x).alias(x) for x in ("bilateral", "left", "right")])
    yes = lambda c: F.coalesce(c, F.lit(False))
    return s.select(*key, F.when(yes(F.col("bilateral")) | yes(F.col("left") & F.col("right")), "bilateral").when(F.col("left"), "left").when(F.col("right"), "right").otherwise("default").alias("side"))


def explicit_regions(df: DataFrame, key: list[str], region: str, phrase: str) -> DataFrame:
    """(key, region, explicit): whether some phrase names a place, on the region's own side or both if the region has a side."""
    own = F.regexp_extract(region, r"^(left|right) ", 1)
    side = stated_side(F.col(phrase))
    fits = (own == "") | F.coalesce((side == own) | (side == "bilateral"), F.lit(False))
    return df.groupBy(*key, region).agg(F.bool_or(F.coalesce(F.col(phrase).rlike(PLACES) & fits, F.lit(False))).alias("explicit"))


def prompts(statements: DataFrame, key: list[str], normal: str) -> DataFrame:
    """(key, prompt): the licensed statements of a key as a list, and nothing else.

    statements: key, node, label, certainty, side, zone and a flag normal; rows with a null node only carry the flag.
    """
    line = F.concat(F.lit("- "), F.lower("label"), F.lit(": "), "certainty", F.coalesce(F.concat(F.lit("; side: "), "side"), F.lit("")), F.coalesce(F.concat(F.lit("; zone: "), "zone"), F.lit("")))
    lines = F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("node", line.alias("line")))))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    per = statements.groupBy(*key).agg(F.bool_or(normal).alias("normal"), body.alias("body"))
    return per.select(*key, F.concat(F.lit("Study marked normal: "), F.when(F.col("normal"), "yes").otherwise("no"), F.lit("\nStatements:\n"), F.when(F.col("body") == "", "- none").otherwise(F.col("body"))).alias("prompt"))


def feedback(mismatches: DataFrame, key: list[str]) -> DataFrame:
    """(key, feedback): what a rewritten text must mend; mismatches: key, node, label, kind, expected, sentence (may be null)."""
    name, e = F.concat(F.lit("'"), F.lower(F.coalesce("label", F.lit(""))), F.lit("'")), F.col("expected")
    use = F.coalesce(F.concat(F.lit(' Write it as: "'), "sentence", F.lit('"')), F.lit(""))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kind = F.col("kind")
    must = (
        F.when(kind == "omitted", said("the statement about ", name, " (", F.coalesce(e, F.lit("")), ") is missing or not recognisable; include it as its own sentence.", use))
        .when(kind == "added", said("remove every mention of ", name, ": it is not in the list"))
        .when(kind == "added_negative", said("remove the negative statement about ", name, ": it is not in the list"))
        .when(kind.isin("polarity", "certainty"), said(name, " must be stated as ", F.coalesce(e, F.lit("")), ".", use))
        .when(kind == "side", said(F.when(e.isNotNull(), said("the side of ", name, " must be ", e, ".")).otherwise(said("do not give any side for ", name, ", and do not mention it in a sentence that names a side.")), use))
        .when(kind == "zone", F.when(e.isNotNull(), said("the zone of ", name, " must be ", e, ".")).otherwise(said("do not give any zone for ", name, ".")))
        .when(kind == "lobe", F.lit("do not mention any lung lobe"))
        .when(kind == "malformed", F.lit("use exactly the form 'FINDINGS: ...' then 'IMPRESSION: ...'"))
    )
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("node", F.lit("")).alias("node"), "kind", must.alias("m"))))
    text = F.array_join(F.transform(order, lambda x: x["m"]), " ")
    tail = " Rewrite the whole report following the statement list exactly, one statement per sentence, and do not summarise several findings in one sentence."
    return mismatches.groupBy(*key).agg(F.concat(F.lit("Your previous report broke these rules: "), text, F.lit(tail)).alias("feedback"))
