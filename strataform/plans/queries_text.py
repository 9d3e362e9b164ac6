"""Sections, sentences, lexicons, tags, claims and rendering of the report and concept texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators import ontology, text
from strataform.plans.base import CLOSURE_SQL, collector, links
from strataform.runtime import table

QUERIES, ORACLE_SQL, query = collector()


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", "text")


def bank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "concept_bank")


@query(r"""SELECT count(*) AS n, count(DISTINCT text) AS texts, count(DISTINCT lower(regexp_replace(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), '^ | $', '', 'g'))) AS folded, count(*) FILTER (WHERE regexp_matches(text, '^[ \t\r\n]*$')) AS empty, count(*) FILTER (WHERE contains(text, chr(10))) AS with_lines,
count(*) FILTER (WHERE regexp_matches(text, '[^\x00-\x7F]')) AS non_ascii, round(avg(length(text)), 4) AS mean_chars FROM documents WHERE text IS NOT NULL""")
def corpus_profile(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    folded = F.lower(F.regexp_replace(F.regexp_replace(t, r"[ \t\r\n]+", " "), "^ | $", ""))
    return docs(spark, d).agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"), F.countDistinct(folded).alias("folded"), F.count_if(t.rlike(r"^[ \t\r\n]*$")).alias("empty"), F.count_if(t.contains("\n")).alias("with_lines"), F.count_if(t.rlike(r"[^\x00-\x7F]")).alias("non_ascii"), F.round(F.avg(F.length(t)), 4).alias("mean_chars"))


_CATS = {"size": r"(?i)\b(small|large|enlarged)\b", "place": r"(?i)\b(upper|lower|base|apex)\b", "change": r"(?i)\b(stable|unchanged|increased|decreased)\b"}


@query(f"""WITH c AS (SELECT regexp_matches(text, '{_CATS["size"]}') AS a, regexp_matches(text, '{_CATS["place"]}') AS b, regexp_matches(text, '{_CATS["change"]}') AS c FROM documents WHERE text IS NOT NULL)
SELECT count(*) FILTER (WHERE a) AS size, count(*) FILTER (WHERE b) AS place, count(*) FILTER (WHERE c) AS change, count(*) FILTER (WHERE a AND b) AS size_place, count(*) FILTER (WHERE a AND NOT b AND NOT c) AS only_size, count(*) FILTER (WHERE NOT (a OR b OR c)) AS none FROM c""")
def category_overlap(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = (F.col("text").rlike(p) for p in _CATS.values())
    return docs(spark, d).agg(F.count_if(a).alias("size"), F.count_if(b).alias("place"), F.count_if(c).alias("change"), F.count_if(a & b).alias("size_place"), F.count_if(a & ~b & ~c).alias("only_size"), F.count_if(~(a | b | c)).alias("none"))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)pneumo[a-z]+') ORDER BY doc_id LIMIT 20")
def regex_grep(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).filter(F.col("text").rlike(r"(?i)pneumo[a-z]+")).select("doc_id").orderBy("doc_id").limit(20)


@query(r"""WITH s AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)^[ \t]*([A-Z][A-Z /&\-]{2,40}):', 1) AS h FROM documents WHERE text IS NOT NULL)
SELECT unnest(h) AS header, count(*) AS n, count(DISTINCT doc_id) AS texts FROM s GROUP BY 1""")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    s = text.sections(docs(spark, d), ["doc_id"], "text").filter("header is not null")
    return s.groupBy("header").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("texts"))


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, t, regexp_extract_all(t, '(?m)^[ \t]*([A-Z][A-Z /&\-]{2,40}):', 1) AS n, string_split_regex(t, '(?m)^[ \t]*[A-Z][A-Z /&\-]{2,40}:')[2:] AS b FROM s),
e AS (SELECT doc_id, trim(unnest(n), ' ') AS n, trim(regexp_replace(unnest(b), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS b FROM h),
p AS (SELECT doc_id, bool_or(n IN ('FINDINGS', 'FINDING', 'FINDINGS AND IMPRESSION', 'FINDINGS/IMPRESSION', 'IMPRESSION AND FINDINGS') AND b <> '') AS f, bool_or(n IN ('IMPRESSION', 'IMPRESSIONS', 'CONCLUSION', 'SUMMARY') AND b <> '') AS i FROM e GROUP BY doc_id)
SELECT CASE WHEN f AND i THEN 'sections' WHEN f THEN 'findings_only' WHEN i THEN 'impression_only' ELSE 'other' END AS source, count(*) AS n FROM s LEFT JOIN p USING (doc_id) GROUP BY 1""")
def section_sources(spark: SparkSession, d: str) -> DataFrame:
    """Where the findings and impression of the texts come from."""
    s = text.section_source(docs(spark, d), ["doc_id"], "text").select(F.when(F.col("source").isin("fallback", "empty"), "other").otherwise(F.col("source")).alias("source"))
    return s.groupBy("source").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, regexp_extract(text, '(?is)^\s*FINAL REPORT\s*EXAM:\s*(.*?)\s*INDICATION:\s*(.*?)\s*$', 1) AS first FROM documents WHERE regexp_matches(text, '(?is)^\s*FINAL REPORT\s*EXAM:\s*(.*?)\s*INDICATION:\s*(.*?)\s*$')""")
def two_section_parse(spark: SparkSession, d: str) -> DataFrame:
    two = text.two_sections(F.col("text"), r"FINAL REPORT\s*EXAM", "INDICATION")
    return docs(spark, d).select("doc_id", two["first"].alias("first")).filter("first is not null")


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.;\n])[ \t\r\n\f\v]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS sentences FROM p WHERE trim(s, ' ') <> '' GROUP BY doc_id""")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return text.sentences(docs(spark, d), ["doc_id"], "text").groupBy("doc_id").agg(F.count("*").alias("sentences"))


@query(r"""WITH t AS (SELECT doc_id, string_split_regex(trim(text, ' '), '[ \t\r\n\f\v]+') AS w FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM t), y AS (
SELECT doc_id, coalesce(sum(regexp_matches(token, '[.;]$')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM x WHERE token <> '')
SELECT doc_id, count(*) AS tokens, max(s)::BIGINT AS last FROM y GROUP BY doc_id""")
def sentence_index(spark: SparkSession, d: str) -> DataFrame:
    return text.sentence_index(docs(spark, d), ["doc_id"], "text").groupBy("doc_id").agg(F.count("*").alias("tokens"), F.max("sentence").alias("last"))


@query(r"""SELECT coalesce(CASE WHEN regexp_matches(text, '(?i)\b(resolved|removed)\b') THEN 'temporal' WHEN regexp_matches(text, '(?i)\b(no|not|without)\b') THEN 'negation' WHEN len(string_split(text, ' ')) > 5 THEN 'length' END, 'kept') AS why, count(*) AS n FROM concept_bank GROUP BY 1""")
def lexicon_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    c = text.cascade(bank(spark, d).select("text"), "text", [("temporal", t.rlike(r"(?i)\b(resolved|removed)\b")), ("negation", t.rlike(text.lexicon_pattern(["no", "not", "without"]))), ("length", F.size(F.split(t, " ")) > 5)])
    return c.groupBy(F.coalesce("dropped_by", F.lit("kept")).alias("why")).agg(F.count("*").alias("n"))


_LEX = {n: rf"(?i)\b{n.replace('_', ' ')}\b" for n in ("pneumonia", "consolidation", "lung_opacity", "edema", "atelectasis", "pneumothorax", "fracture")}
_TAG_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in _LEX.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH t AS (SELECT concept_id, {_TAG_SQL} AS tags FROM concept_bank) SELECT concept_id, CASE WHEN list_contains(tags, 'pneumonia') AND len(list_filter(tags, lambda x: x NOT IN ('pneumonia', 'consolidation', 'lung_opacity'))) = 0 THEN 'pneumonia' WHEN len(tags) = 1 THEN tags[1] END AS only FROM t""")
def exclusive_tagging(spark: SparkSession, d: str) -> DataFrame:
    return text.exclusive_tags(bank(spark, d).select("concept_id", "text"), "text", _LEX, {"pneumonia": ["consolidation", "lung_opacity"]}).select("concept_id", "only")


_LAT = r"""CASE WHEN regexp_matches(text, '(?i)\b(bilateral|both)\b') THEN 'bilateral' WHEN regexp_matches(text, '(?i)\b(midline|central)\b') THEN 'midline' WHEN regexp_matches(text, '(?i)\bleft\b') AND regexp_matches(text, '(?i)\bright\b') THEN 'bilateral'
WHEN regexp_matches(text, '(?i)\bleft\b') THEN 'left' WHEN regexp_matches(text, '(?i)\bright\b') THEN 'right' ELSE 'unspecified' END"""


@query(f"SELECT concept_id, {_LAT} AS side, {_LAT} = laterality AS agrees FROM concept_bank")
def laterality_tag(spark: SparkSession, d: str) -> DataFrame:
    side = text.laterality(F.col("text"))
    return bank(spark, d).select("concept_id", side.alias("side"), (side == F.col("laterality")).alias("agrees"))


@query(r"""WITH t AS (SELECT concept_id, CASE WHEN regexp_matches(text, '(?i)\b(no|not|without|free of)\b') THEN 'absent' WHEN resolved_polarity = 'uncertain' THEN 'uncertain' ELSE 'present' END AS p,
CASE WHEN regexp_matches(text, '(?i)\b(resolved|removed|removal)\b') THEN 'resolved' WHEN regexp_matches(text, '(?i)\b(new|increased|worse|worsening)\b') THEN 'worse' WHEN regexp_matches(text, '(?i)\b(decreased|improved|smaller)\b') THEN 'better' WHEN regexp_matches(text, '(?i)\b(stable|unchanged)\b') THEN 'stationary' END AS t FROM concept_bank)
SELECT concept_id, CASE WHEN p = 'absent' OR t = 'resolved' THEN 'absent' WHEN p = 'present' OR t IN ('worse', 'better') THEN 'present' WHEN p = 'uncertain' THEN 'indeterminate' WHEN t = 'stationary' THEN 'stationary' END AS polarity FROM t""")
def polarity_temporal(spark: SparkSession, d: str) -> DataFrame:
    certainty = F.when(F.col("resolved_polarity") == "uncertain", "uncertain").otherwise("definitely present")
    t = F.col("text")
    return bank(spark, d).select("concept_id", text.combined_polarity(text.polarity(t, certainty), text.temporal(t)).alias("polarity"))


@query("""WITH t AS (SELECT canonical_finding, laterality, coalesce(anatomy, '-') AS anatomy, group_key FROM concept_bank) SELECT canonical_finding || '|' || anatomy || '|' || laterality AS key, count(*) AS n, count(*) FILTER (WHERE group_key <> canonical_finding || '|' || anatomy || '|' || laterality) AS differ FROM t GROUP BY 1""")
def concept_group_keys(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("|", "canonical_finding", F.coalesce("anatomy", F.lit("-")), "laterality")
    return bank(spark, d).select(key.alias("key"), "group_key").groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("group_key") != F.col("key")).alias("differ"))


@query("""WITH w AS (SELECT concept_id AS k, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM concept_bank), q AS (SELECT item_id AS i, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM eval_items),
s AS (SELECT i, k, count(*) AS n, any_value(nl) AS nl, any_value(nr) AS nr FROM (SELECT i, len(w) AS nl, unnest(w) AS t FROM q) JOIN (SELECT k, len(w) AS nr, unnest(w) AS t FROM w) USING (t) GROUP BY i, k),
r AS (SELECT i, k, round(n / (nl + nr - n), 6) AS jaccard FROM s) SELECT item_id, concept_id, jaccard, rank FROM (SELECT i AS item_id, k AS concept_id, jaccard, row_number() OVER (PARTITION BY i ORDER BY jaccard DESC, k) AS rank FROM r) WHERE rank <= 3""")
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select("item_id", "text")
    return text.token_candidates(items, bank(spark, d).select("concept_id", F.col("text").alias("ctext")), "item_id", "concept_id", "text", "ctext", 3)


@query("""WITH t AS (SELECT concept_id, list_distinct(string_split(text, ' ')) AS a, list_distinct(string_split(lag(text) OVER (ORDER BY concept_id), ' ')) AS b FROM concept_bank) SELECT concept_id, round(2 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS f1 FROM t WHERE b IS NOT NULL""")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    b = bank(spark, d).select("concept_id", F.split("text", " ").alias("a"))
    before = b.select((F.col("concept_id") + 1).alias("concept_id"), F.col("a").alias("b"))  # ids have no gaps
    return b.join(before, "concept_id").select("concept_id", F.round(text.set_f1(F.col("a"), F.col("b")), 6).alias("f1"))


def statements(spark: SparkSession, d: str) -> DataFrame:
    b = bank(spark, d)
    c = F.when(F.col("resolved_polarity") == "absent", "absent").when(F.col("resolved_polarity") == "uncertain", "possible").otherwise("present")
    per = b.groupBy((F.col("concept_id") % 300).alias("doc"), F.col("canonical_finding").alias("node")).agg(F.max(c).alias("certainty"), F.min(F.when(F.col("laterality").isin("left", "right"), F.col("laterality"))).alias("side"), F.min("anatomy").alias("zone"))
    return per


_ST = """(SELECT concept_id % 300 AS doc, canonical_finding AS node, max(CASE resolved_polarity WHEN 'absent' THEN 'absent' WHEN 'uncertain' THEN 'possible' ELSE 'present' END) AS certainty, min(CASE WHEN laterality IN ('left', 'right') THEN laterality END) AS side, min(anatomy) AS zone FROM concept_bank GROUP BY 1, 2)"""


# The claims about the same documents, by the remainder of doc: dropped, negated, given a side, or those of the next document.
_FAULTY = """(SELECT doc, node, CASE WHEN doc % 4 = 1 THEN CASE certainty WHEN 'absent' THEN 'present' ELSE 'absent' END ELSE certainty END AS certainty, CASE WHEN doc % 4 = 2 THEN coalesce(side, 'left') ELSE side END AS side, zone FROM e WHERE doc % 4 IN (1, 2)
UNION ALL SELECT (doc + 299) % 300, node, certainty, side, zone FROM e WHERE doc % 4 = 0)"""


def faulty(spark: SparkSession, d: str) -> DataFrame:
    s = statements(spark, d)
    out = s.filter("doc % 4 = 0").withColumn("doc", (F.col("doc") + 299) % 300)
    for k, how in enumerate(("drop", "negate", "add_side")):
        out = out.unionByName(text.corrupt(s.filter(f"doc % 4 = {k}"), how))
    return out


@query(f"""WITH RECURSIVE {CLOSURE_SQL}, e AS {_ST}, c AS {_FAULTY}, fine AS (SELECT DISTINCT e.doc, ancestor AS node FROM e JOIN closure ON descendant = e.node WHERE certainty <> 'absent'),
f AS (SELECT coalesce(e.doc, c.doc) AS doc, coalesce(e.node, c.node) AS node, e.certainty AS ec, c.certainty AS cc, e.side AS es, c.side AS cs, e.zone AS ez, c.zone AS cz FROM e FULL JOIN c ON e.doc = c.doc AND e.node = c.node),
k AS (SELECT 'omitted' AS kind FROM f WHERE cc IS NULL UNION ALL SELECT CASE WHEN (ec <> 'absent') <> (cc <> 'absent') THEN 'polarity' ELSE 'certainty' END FROM f WHERE ec <> cc
UNION ALL SELECT 'side' FROM f WHERE ec <> 'absent' AND cc IS NOT NULL AND (es IS NOT NULL AND es IS DISTINCT FROM cs OR es IS NULL AND cs IS NOT NULL)
UNION ALL SELECT 'zone' FROM f WHERE ec <> 'absent' AND cc IS NOT NULL AND (ez IS NOT NULL AND ez IS DISTINCT FROM cz OR ez IS NULL AND cz IS NOT NULL AND node = 'pneumonia')
UNION ALL SELECT CASE WHEN cc = 'absent' THEN 'added_negative' ELSE 'added' END FROM f WHERE ec IS NULL AND NOT EXISTS (SELECT 1 FROM fine WHERE fine.doc = f.doc AND fine.node = f.node)) SELECT kind, count(*) AS n FROM k GROUP BY kind""")
def claim_compare(spark: SparkSession, d: str) -> DataFrame:
    pairs = ontology.closure(links(spark)).select(F.col("descendant").alias("node"), "ancestor")
    return text.compare_claims(statements(spark, d), faulty(spark, d), pairs, ["doc"], ["pneumonia"]).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH e AS {_ST} SELECT doc, string_agg(CASE certainty WHEN 'absent' THEN 'No ' || replace(node, '_', ' ') || '.' WHEN 'possible' THEN 'Possible ' || coalesce(side || ' ', '') || replace(node, '_', ' ') || '.' ELSE 'There is ' || coalesce(side || ' ', '') || replace(node, '_', ' ') || '.' END, ' ' ORDER BY node) AS text FROM e GROUP BY doc""")
def render_template(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("certainty") == "absent", "No {name}.").when(F.col("certainty") == "possible", "Possible {side}{name}.").otherwise("There is {side}{name}.")
    s = text.fill_template(t, side=F.concat("side", F.lit(" ")), name=F.replace("node", F.lit("_"), F.lit(" ")))
    return text.render(statements(spark, d).withColumn("s", s), ["doc"], "node", "s")


@query()
def corruption_detected(spark: SparkSession, d: str) -> DataFrame:
    """How many statements are flagged after each kind of fault: a comparison must catch every one."""
    e = statements(spark, d)
    none = spark.createDataFrame([], "node string, ancestor string")
    out = None
    for how in ("drop", "negate", "add_side"):
        base = e.filter("side is null and certainty <> 'absent'") if how == "add_side" else e
        found = text.compare_claims(base, text.corrupt(base, how), none, ["doc"]).filter("kind in ('omitted', 'polarity', 'side')").select("doc", "node").distinct().agg(F.count("*").alias("flagged")).crossJoin(base.agg(F.count("*").alias("statements"))).withColumn("fault", F.lit(how))  # one row each
        out = found if out is None else out.unionByName(found)
    return out


@query()
def claim_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Claims of parsed concept texts: the entities are the words of each text, linked in their order."""
    e = bank(spark, d).select("concept_id", F.posexplode(F.split("text", " ")).alias("start", "tokens"), "canonical_finding", "resolved_polarity")
    last = F.substring_index(F.replace("canonical_finding", F.lit("_"), F.lit(" ")), " ", -1)
    label = F.when(F.col("tokens") == last, F.concat(F.lit("Observation::definitely "), F.when(F.col("resolved_polarity") == "absent", "absent").otherwise("present"))).otherwise("Anatomy::definitely present")
    entity = e.select("concept_id", F.col("start").cast("string").alias("entity"), "tokens", label.alias("label"))
    link = e.filter("start > 0").select("concept_id", F.col("start").cast("string").alias("source"), F.lit("modify").alias("kind"), (F.col("start") - 1).cast("string").alias("target"))
    return text.claims(entity, link, "concept_id", {"lung_opacity": "^opacity$", "lung_lesion": "^lesion$", "pleural_effusion": "^effusion$", "pneumonia": "^pneumonia$", "edema": "^edema$", "atelectasis": "^atelectasis$"})
