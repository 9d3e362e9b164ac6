"""Facts, tags, sides, terms and prompts; choosers, windows and conditional models; files written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators import extraction, metrics, model, text, vectors
from strataform.plans.base import HITS_SQL, IS_A, LINKS_SQL, SCORES_SQL, collector, hits, links, scores
from strataform.runtime import cut, table

QUERIES, ORACLE_SQL, query = collector()

NODES = sorted({c for c, _ in IS_A} | {p for _, p in IS_A} | {"support_devices"})
_NAMES = "|".join(sorted((n.replace("_", " ") for n in NODES), key=lambda x: (-len(x), x)))
_TERMS = [(n, t, i) for n, ts in extraction.PLAIN_TERMS.items() for i, t in enumerate(ts)]
_TERMS_SQL = "terms(node, term, priority) AS (VALUES " + ", ".join(f"('{n}', '{t}', {i})" for n, t, i in _TERMS) + ")"
_LAT = r"""CASE WHEN regexp_matches({0}, '(?i)\b(bilateral|both)\b') THEN 'bilateral' WHEN regexp_matches({0}, '(?i)\b(midline|central)\b') THEN 'midline' WHEN regexp_matches({0}, '(?i)\bleft\b') AND regexp_matches({0}, '(?i)\bright\b') THEN 'bilateral'
WHEN regexp_matches({0}, '(?i)\bleft\b') THEN 'left' WHEN regexp_matches({0}, '(?i)\bright\b') THEN 'right' ELSE 'unspecified' END"""
_WHEN = r"""CASE WHEN regexp_matches({0}, '(?i)\b(resolved|removed|removal)\b') THEN 'resolved' WHEN regexp_matches({0}, '(?i)\b(new|increased|worse|worsening)\b') THEN 'worse' WHEN regexp_matches({0}, '(?i)\b(decreased|improved|smaller)\b') THEN 'better'
WHEN regexp_matches({0}, '(?i)\b(stable|unchanged)\b') THEN 'stationary' END"""
_POLARITY = r"""CASE WHEN regexp_matches({0}, '(?i)\b(no|not|without|free of)\b') THEN 'absent' WHEN {1} = 'definitely absent' THEN 'absent' WHEN {1} = 'uncertain' THEN 'uncertain' WHEN {1} = 'definitely present' THEN 'present' END"""
_BOTH = """CASE WHEN {0} = 'absent' OR {1} = 'resolved' THEN 'absent' WHEN {0} = 'present' OR {1} IN ('worse', 'better') THEN 'present' WHEN {0} = 'uncertain' THEN 'indeterminate' WHEN {1} = 'stationary' THEN 'stationary' END"""


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TERMS, "node string, term string, priority int")


def names(spark: SparkSession) -> DataFrame:
    """The vocabulary of nodes: their names and their plain terms."""
    rows = spark.createDataFrame([(n, [n.replace("_", " "), *ts]) for n, ts in extraction.PLAIN_TERMS.items()], "node string, synonyms array<string>")
    return extraction.unambiguous(extraction.vocabulary(rows, "node", "synonyms"))


_VOCABULARY_SQL = _TERMS_SQL + ", vocabulary AS (SELECT DISTINCT term, node FROM (SELECT term, node FROM terms UNION ALL SELECT replace(node, '_', ' '), node FROM terms))"


def bank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "concept_bank")


@query(f"""WITH {_TERMS_SQL}, c AS (SELECT concept_id, regexp_replace(lower(regexp_extract(text, '\\b({_NAMES})\\b.*$', 1)), '[.\\s]+$', '') AS term FROM concept_bank),
m AS (SELECT node, concept_id, term, row_number() OVER (PARTITION BY node ORDER BY priority, concept_id) AS n FROM c JOIN terms USING (term)) SELECT node, concept_id, term FROM m WHERE n = 1""")
def plain_terms(spark: SparkSession, d: str) -> DataFrame:
    """The first plain term of every finding among the names in the concept texts."""
    c = bank(spark, d).select("concept_id", F.regexp_extract("text", rf"\b({_NAMES})\b.*$", 1).alias("name"))
    return extraction.plain_terms(c, "concept_id", "name", terms(spark))


@query(r"""WITH s AS (SELECT rid, unnest(list_append(coalesce(synonyms, []), label)) AS term FROM radlex_classes), k AS (
SELECT DISTINCT 'RID' || nullif(regexp_extract(rid, '(?i)rid\s*(\d+)\s*$', 1), '') AS node, trim(regexp_replace(lower(term), '\s+', ' ', 'g')) AS term FROM s)
SELECT term, count(*) AS n, min(node) AS first, max(node) AS last FROM k WHERE node IS NOT NULL AND term <> '' GROUP BY term HAVING count(*) > 1""")
def synonym_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Terms that several classes claim."""
    digits = F.regexp_extract("rid", r"(?i)rid\s*(\d+)\s*$", 1)
    rows = table(spark, d, "radlex_classes").select(F.when(digits != "", F.concat(F.lit("RID"), digits)).alias("node"), F.array_append(F.coalesce("synonyms", F.array().cast("array<string>")), F.col("label")).alias("s"))
    v = extraction.vocabulary(rows, "node", "s").filter(F.size("nodes") > 1)
    return v.select("term", F.size("nodes").cast("bigint").alias("n"), F.col("nodes")[0].alias("first"), F.element_at("nodes", -1).alias("last"))


def observed(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the concept texts: the finding's name, the first word and the word after the name."""
    t = bank(spark, d).select("concept_id", "text", "anatomy", F.regexp_extract("text", rf"\b({_NAMES})\b", 1).alias("name"))
    after = F.regexp_extract("text", rf"\b(?:{_NAMES})\s+(\w+)", 1)
    side = F.col("text").rlike(r"\b(left|right)\b")
    e = F.array(F.struct(F.lit(2).alias("place"), F.col("name").alias("entity"), side.alias("located")), F.struct(F.lit(1).alias("place"), F.substring_index("text", " ", 1).alias("entity"), F.lit(False).alias("located")), F.struct(F.lit(3).alias("place"), after.alias("entity"), F.lit(False).alias("located")))
    return t.select("concept_id", F.explode(e).alias("e")).select("concept_id", "e.*").filter("entity <> ''")


_OBSERVED_SQL = f"""o AS (SELECT concept_id, 2 AS place, regexp_extract(text, '\\b({_NAMES})\\b', 1) AS entity, regexp_matches(text, '\\b(left|right)\\b') AS located FROM concept_bank
UNION ALL SELECT concept_id, 1, string_split(text, ' ')[1], false FROM concept_bank UNION ALL SELECT concept_id, 3, regexp_extract(text, '\\b(?:{_NAMES})\\s+(\\w+)', 1), false FROM concept_bank),
core AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY NOT located, CASE WHEN located THEN 0 ELSE -length(entity) END, place) AS n FROM o WHERE entity <> '')"""


@query(f"WITH {_OBSERVED_SQL} SELECT concept_id, place, entity, located FROM core WHERE n = 1")
def core_observation(spark: SparkSession, d: str) -> DataFrame:
    return extraction.core_observation(observed(spark, d), ["concept_id"])


_TAGS_SQL = f"""WITH {_VOCABULARY_SQL}, {_OBSERVED_SQL}, r AS (SELECT b.concept_id, b.text, b.anatomy, CASE b.resolved_polarity WHEN 'absent' THEN 'definitely absent' WHEN 'uncertain' THEN 'uncertain' ELSE 'definitely present' END AS certainty, c.entity
FROM concept_bank b LEFT JOIN core c ON c.concept_id = b.concept_id AND c.n = 1),
g AS (SELECT r.*, coalesce(v.node, w.node) AS named, {_LAT.format('r.text')} AS laterality, {_WHEN.format('r.text')} AS temporal, {_POLARITY.format('r.text', 'r.certainty')} AS base
FROM r LEFT JOIN vocabulary v ON v.term = lower(r.entity) LEFT JOIN vocabulary w ON w.term = lower(r.text)),
t AS (SELECT concept_id, CASE WHEN named = 'pleural_other' AND contains(lower(text), 'hazy') THEN 'pleural_haze' ELSE named END AS node, anatomy, laterality, temporal, {_BOTH.format('base', 'temporal')} AS polarity FROM g)
SELECT concept_id, node, laterality, polarity, temporal, CASE WHEN node IS NOT NULL THEN node || '|' || coalesce(anatomy, '-') || '|' || laterality END AS group_key FROM t"""


@query(_TAGS_SQL)
def concept_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of the whole concept bank from its texts alone; a cue word turns one finding into another."""
    certainty = F.when(F.col("resolved_polarity") == "absent", "definitely absent").when(F.col("resolved_polarity") == "uncertain", "uncertain").otherwise("definitely present")
    core = extraction.core_observation(observed(spark, d), ["concept_id"]).join(bank(spark, d).select("concept_id", "anatomy", certainty.alias("certainty")), "concept_id", "right")
    tags = extraction.concept_tags(bank(spark, d).select("concept_id", "text"), "concept_id", "text", core, names(spark), [("pleural_other", "hazy", "pleural_haze")])
    return tags.select("concept_id", "node", "laterality", "polarity", "temporal", "group_key")


_FACT_NAMES = "|".join(sorted({t for ts in extraction.PLAIN_TERMS.values() for t in ts}, key=lambda x: (-len(x), x)))
_PLACES = {"upper lobe": "R1", "lower lobe": "R2", "lung": "R3", "pleura": "R4", "apex": "R5", "base": "R6", "hilum": "R7", "mediastinum": "R8"}
_PLACE_NAMES = "|".join(sorted(_PLACES, key=lambda x: (-len(x), x)))


@query(f"""WITH {_VOCABULARY_SQL}, places(entity, rid) AS (VALUES {", ".join(f"('{p}', '{r}')" for p, r in _PLACES.items())}),
p AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g'), '([.;\\n])[ \\t\\r\\n\\f\\v]+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, trim(s, ' ') AS s FROM p WHERE trim(s, ' ') <> ''),
o AS (SELECT DISTINCT doc_id, s, unnest(regexp_extract_all(lower(s), '\\b({_FACT_NAMES})\\b', 1)) AS term FROM s),
a AS (SELECT doc_id, s, e.entity, row_number() OVER (PARTITION BY doc_id, s ORDER BY -length(e.entity), strpos(lower(s), e.entity), e.entity) AS n, e.rid FROM s JOIN places e ON regexp_matches(lower(s), '\\b' || e.entity || '\\b')),
f AS (SELECT o.doc_id, v.node, a.rid AS anatomy, {_LAT.format('o.s')} AS laterality, {_WHEN.format('o.s')} AS temporal, {_POLARITY.format('o.s', "'definitely present'")} AS base FROM o JOIN vocabulary v USING (term) LEFT JOIN a ON a.doc_id = o.doc_id AND a.s = o.s AND a.n = 1)
SELECT node, anatomy, laterality, polarity, count(*) AS n, count(DISTINCT doc_id) AS texts FROM (SELECT *, {_BOTH.format('base', 'temporal')} AS polarity FROM f) WHERE polarity IS NOT NULL GROUP BY ALL""")
def report_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of all sentences of all texts, counted; every name of a finding is an observation. Characters outside ASCII part words."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", " ").alias("text"))
    s = cut(text.sentences(docs, ["doc_id"], "text").select("doc_id", "sentence").distinct())
    low = F.lower("sentence")
    seen = s.select("doc_id", "sentence", F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(rf"\b({_FACT_NAMES})\b"), F.lit(1)))).alias("entity"), F.lit("definitely present").alias("certainty"))
    place = F.array_compact(F.array(*[F.when(low.rlike(rf"\b{p}\b"), F.struct(F.instr(low, p).alias("place"), F.lit(p).alias("entity"), F.lit(r).alias("rid"))) for p, r in _PLACES.items()]))
    where = s.select("doc_id", "sentence", F.explode(place).alias("a")).select("doc_id", "sentence", "a.*")
    keyed = lambda df: df.withColumn("of", F.sha2("sentence", 256))
    facts = extraction.report_facts(keyed(s), ["doc_id", "of"], keyed(seen).drop("sentence"), keyed(where).drop("sentence"), names(spark))
    return facts.groupBy("node", "anatomy", "laterality", "polarity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("texts"))


def phrases(spark: SparkSession, d: str) -> DataFrame:
    """entity, region, node and the phrase that supports it: the hits with their concepts."""
    b = bank(spark, d)
    region = F.concat_ws(" ", F.when(F.col("laterality").isin("left", "right"), F.col("laterality")), F.coalesce("anatomy", F.lit("lung")))
    return hits(spark, d).join(F.broadcast(b.select("concept_id", region.alias("region"), F.col("canonical_finding").alias("finding"), "text")), "concept_id").select("entity", "region", "finding", F.col("text").alias("phrase"))  # 3,000 concepts at every scale


_PHRASES_SQL = HITS_SQL + r""", ph AS (SELECT entity, CASE WHEN laterality IN ('left', 'right') THEN laterality || ' ' ELSE '' END || coalesce(anatomy, 'lung') AS region, canonical_finding AS finding, text AS phrase FROM hits JOIN concept_bank USING (concept_id)),
st AS (SELECT *, CASE WHEN regexp_matches(phrase, '(?i)\b(bilateral|bilaterally|both|bibasilar|bibasal|biapical|bilobar|lungs)\b') OR (regexp_matches(phrase, '(?i)\bleft\b|\blt\b') AND regexp_matches(phrase, '(?i)\bright\b|\brt\b')) THEN 'bilateral'
WHEN regexp_matches(phrase, '(?i)\bleft\b|\blt\b') THEN 'left' WHEN regexp_matches(phrase, '(?i)\bright\b|\brt\b') THEN 'right' END AS side FROM ph)"""


@query(f"""WITH {_PHRASES_SQL} SELECT entity, finding, CASE WHEN bool_or(side = 'bilateral') OR (bool_or(side = 'left') AND bool_or(side = 'right')) THEN 'bilateral' WHEN bool_or(side = 'left') THEN 'left' WHEN bool_or(side = 'right') THEN 'right' ELSE 'default' END AS side FROM st GROUP BY ALL""")
def explicit_sides(spark: SparkSession, d: str) -> DataFrame:
    return extraction.explicit_sides(phrases(spark, d), ["entity", "finding"], "phrase")


@query(f"""WITH {_PHRASES_SQL} SELECT entity, finding, region, bool_or(regexp_matches(phrase, '{extraction.PLACES}') AND (NOT regexp_matches(region, '^(left|right) ') OR coalesce(side IN (string_split(region, ' ')[1], 'bilateral'), false))) AS explicit FROM st GROUP BY ALL""")
def explicit_regions(spark: SparkSession, d: str) -> DataFrame:
    return extraction.explicit_regions(phrases(spark, d), ["entity", "finding"], "region", "phrase")


def stated(spark: SparkSession, d: str) -> DataFrame:
    """One statement for every study and finding of the hits."""
    b = F.broadcast(bank(spark, d).select("concept_id", "canonical_finding", "resolved_polarity", "laterality", "anatomy"))  # 3,000 concepts
    c = F.when(F.col("resolved_polarity") == "absent", "absent").when(F.col("resolved_polarity") == "uncertain", "possible").otherwise("present")
    per = hits(spark, d).join(b, "concept_id").groupBy("entity", F.col("canonical_finding").alias("node")).agg(F.max(c).alias("certainty"), F.min(F.when(F.col("laterality").isin("left", "right"), F.col("laterality"))).alias("side"), F.min("anatomy").alias("zone"))
    return per.withColumn("label", F.replace("node", F.lit("_"), F.lit(" "))).withColumn("normal", F.col("certainty") == "absent")


_STATED_SQL = HITS_SQL + """, stated AS (SELECT entity, canonical_finding AS node, replace(canonical_finding, '_', ' ') AS label, max(CASE resolved_polarity WHEN 'absent' THEN 'absent' WHEN 'uncertain' THEN 'possible' ELSE 'present' END) AS certainty,
min(CASE WHEN laterality IN ('left', 'right') THEN laterality END) AS side, min(anatomy) AS zone FROM hits JOIN concept_bank USING (concept_id) GROUP BY entity, canonical_finding)"""


@query(f"""WITH {_STATED_SQL} SELECT entity, 'Study marked normal: ' || CASE WHEN bool_or(certainty = 'absent') THEN 'yes' ELSE 'no' END || chr(10) || 'Statements:' || chr(10) ||
string_agg('- ' || label || ': ' || certainty || coalesce('; side: ' || side, '') || coalesce('; zone: ' || zone, ''), chr(10) ORDER BY node) AS prompt FROM stated GROUP BY entity""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    return extraction.prompts(stated(spark, d), ["entity"], "normal")


@query(f"""WITH {_STATED_SQL}, m AS (SELECT *, CASE WHEN certainty = 'absent' THEN 'added_negative' WHEN side IS NOT NULL AND zone IS NOT NULL THEN 'omitted' WHEN side IS NOT NULL THEN 'side' WHEN zone IS NOT NULL THEN 'zone' WHEN certainty = 'possible' THEN 'certainty' ELSE 'added' END AS kind FROM stated),
f AS (SELECT entity, node, kind, CASE kind WHEN 'added_negative' THEN 'remove the negative statement about ''' || label || ''': it is not in the list' WHEN 'omitted' THEN 'the statement about ''' || label || ''' (' || certainty || ') is missing or not recognisable; include it as its own sentence. Write it as: "' || label || ' is ' || certainty || '."'
WHEN 'side' THEN 'the side of ''' || label || ''' must be ' || certainty || '. Write it as: "' || label || ' is ' || certainty || '."' WHEN 'zone' THEN 'the zone of ''' || label || ''' must be ' || certainty || '.' WHEN 'certainty' THEN '''' || label || ''' must be stated as possible. Write it as: "' || label || ' is ' || certainty || '."' ELSE 'remove every mention of ''' || label || ''': it is not in the list' END AS t FROM m)
SELECT entity, 'Your previous report broke these rules: ' || string_agg(t, ' ' ORDER BY node, kind) || ' Rewrite the whole report following the statement list exactly, one statement per sentence, and do not summarise several findings in one sentence.' AS feedback FROM f GROUP BY entity""")
def retry_feedback(spark: SparkSession, d: str) -> DataFrame:
    s = stated(spark, d)
    kind = F.when(F.col("certainty") == "absent", "added_negative").when(F.col("side").isNotNull() & F.col("zone").isNotNull(), "omitted").when(F.col("side").isNotNull(), "side").when(F.col("zone").isNotNull(), "zone").when(F.col("certainty") == "possible", "certainty").otherwise("added")
    return extraction.feedback(s.select("entity", "node", "label", kind.alias("kind"), F.col("certainty").alias("expected"), F.concat("label", F.lit(" is "), "certainty", F.lit(".")).alias("sentence")), ["entity"])


@query(f"""WITH {SCORES_SQL}, r AS (SELECT *, length(node) AS size, row_number() OVER (PARTITION BY entity ORDER BY p DESC, node) AS s, row_number() OVER (PARTITION BY entity ORDER BY length(node) DESC, node) AS z FROM scores)
SELECT entity, chooser, CASE chooser WHEN 'model' THEN m WHEN 'largest_region' THEN l ELSE round(a, 6) END AS hit FROM (SELECT entity, max(CASE WHEN s = 1 THEN y END)::DOUBLE AS m, max(CASE WHEN z = 1 THEN y END)::DOUBLE AS l, avg(y) AS a FROM r GROUP BY entity), (VALUES ('model'), ('largest_region'), ('random_region')) c(chooser)""")
def chooser_baselines(spark: SparkSession, d: str) -> DataFrame:
    rows = scores(spark, d).select("entity", "node", "p", F.length("node").alias("size"), F.col("y").alias("hit"))
    return vectors.chooser_baselines(rows, ["entity"], "node", "p", "size", ["hit"]).withColumn("hit", F.round("hit", 6))


@query("""WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), e AS (SELECT vec_id, v, list_aggregate(v, 'quantile_cont', 0.005) AS lo, list_aggregate(v, 'quantile_cont', 0.995) AS hi FROM q)
SELECT vec_id, list_sum(list_transform(v, lambda x: floor(least(greatest((x - lo) / (CASE WHEN hi <= lo THEN 1 ELSE hi - lo END), 0), 1) * 255 + 0.5)))::BIGINT AS total FROM e""")
def window_bytes(spark: SparkSession, d: str) -> DataFrame:
    w = vectors.window_bytes(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.aggregate(w, F.lit(0).cast("bigint"), lambda s, v: s + v).alias("total"))


@query("SELECT vec_id, label, len(embedding)::INT AS size FROM embeddings")
def rebuilt_rows(spark: SparkSession, d: str) -> DataFrame:
    """Vectors put back to their rows from shards in another order, one of which was written twice."""
    e = table(spark, d, "embeddings")
    shards = e.select("vec_id", F.size("embedding").alias("size"))
    again = shards.filter(F.pmod(F.xxhash64("vec_id"), F.lit(4)) == 0)
    return vectors.rebuild_in_order(shards.unionByName(again), e.select("vec_id", "label"), "vec_id", "label")


def gated(spark: SparkSession, d: str) -> DataFrame:
    s = cut(scores(spark, d))
    return model.conditional_rows(s, links(spark), "entity", "node", "y").select("node", F.col("p").alias("top"), (F.length(F.col("entity").cast("string")) / 10).alias("size"), "y")


@query(f"""WITH {SCORES_SQL}, {LINKS_SQL}, g AS (SELECT s.node FROM scores s LEFT JOIN (SELECT child, min(parent) AS parent FROM links GROUP BY child) l ON l.child = s.node LEFT JOIN scores p ON p.entity = s.entity AND p.node = l.parent WHERE s.y IS NOT NULL AND (l.parent IS NULL OR p.y = 1))
SELECT node, c, n, true AS optimal FROM (SELECT node, count(*) AS n FROM g GROUP BY node), (VALUES (0.01::DOUBLE), (0.1), (1.0), (10.0)) k(c)""")
def conditional_fit(spark: SparkSession, d: str) -> DataFrame:
    """For every node given its parent and every penalty: the rows it learns from, and whether the fit is at its optimum."""
    m = model.fit_groups(gated(spark, d), "node", ["top", "size"], "y")
    return m.select("node", "c", "n", (F.col("gradient") <= 1e-6 * F.col("n")).alias("optimal"))


@query(f"""WITH {SCORES_SQL}, e AS (SELECT node, avg(p - y) AS diff, 1.96 * stddev_samp(p - y) / sqrt(count(*)) AS h FROM scores WHERE y IS NOT NULL GROUP BY node), k AS (SELECT node, CASE WHEN length(node) % 2 = 0 THEN 'ECE' ELSE 'AUROC' END AS metric, diff - h AS low, diff + h AS high FROM e),
b AS (SELECT *, CASE metric WHEN 'AUROC' THEN low > 0 ELSE high < 0 END AS good, CASE metric WHEN 'AUROC' THEN high < 0 ELSE low > 0 END AS bad FROM k)
SELECT substr(node, 1, 1) AS part, count(*) FILTER (WHERE bad AND node = 'pneumonia') = 0 AS keep, coalesce(string_agg(metric || ' ' || node, ',' ORDER BY metric || ' ' || node) FILTER (WHERE good), '') AS better FROM b GROUP BY 1""")
def keep_or_drop(spark: SparkSession, d: str) -> DataFrame:
    """Which parts (findings by first letter) stay; half of the differences are held the other way round and turned back."""
    e = scores(spark, d).filter("y is not null").groupBy("node").agg(F.avg(F.col("p") - F.col("y")).alias("d"), (1.96 * F.stddev_samp(F.col("p") - F.col("y")) / F.sqrt(F.count("*"))).alias("h"))
    metric = F.when(F.length("node") % 2 == 0, "ECE").otherwise("AUROC").alias("metric")
    turned = F.col("node") < "d"
    at = lambda a, b: F.when(turned, a).otherwise(b)
    held = cut(e.select("node", metric, at(F.lit("without"), F.lit("with")).alias("first"), at(F.lit("with"), F.lit("without")).alias("second"), at(-F.col("d"), F.col("d")).alias("diff"), (at(-F.col("d"), F.col("d")) - F.col("h")).alias("low"), (at(-F.col("d"), F.col("d")) + F.col("h")).alias("high")))
    wanted = held.select("node", "metric", F.lit("with").alias("first"), F.lit("without").alias("second"))
    signed = metrics.signed_difference(held, wanted, "first", "second").withColumn("part", F.substring("node", 1, 1))
    out = metrics.keep_or_drop(signed, "part", "metric", "node", ["ECE"], "pneumonia")
    return out.select("part", "keep", F.array_join("better", ",").alias("better"))
