"""Sections, sentences, lexicons, tags, comparison and rendering of short texts, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions.names import capitalised
from strataform.runtime import cut

# Section headers of English reports.
HEADER = r"(?m)^[ \t]*([A-Z][A-Z /&\-]{2,40}):"
FINDINGS = ["FINDINGS", "FINDING", "FINDINGS AND IMPRESSION", "FINDINGS/IMPRESSION", "IMPRESSION AND FINDINGS"]
IMPRESSION = ["IMPRESSION", "IMPRESSIONS", "CONCLUSION", "SUMMARY"]
NON_CLINICAL = [
    "INDICATION", "INDICATIONS", "HISTORY", "CLINICAL HISTORY", "REASON FOR EXAMINATION", "REASON FOR EXAM", "COMPARISON", "COMPARISONS", "TECHNIQUE", "EXAMINATION", "EXAM", "PROCEDURE",
    "CLINICAL INFORMATION", "NOTIFICATION", "RECOMMENDATION", "RECOMMENDATIONS", "WET READ", "ADDENDUM", "FINAL REPORT",
]


def ascii_words(x: Column) -> Column:
    """Lower-case words of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"([a-z0-9]+)"), F.lit(1))


def sections(df: DataFrame, key: list[str], text: str, header: str = HEADER) -> DataFrame:
    """(key, pos, header, body): a text cut at its headers; what is before the first has a null header and position 0.

    header must have one group. Bodies are trimmed; an empty text gives no rows.
    """
    mark = "\x01"
    marked = F.regexp_replace(F.regexp_replace(F.col(text), r"\r\n?", "\n"), header, f"{mark}$1\x02")
    parts = df.select(*key, F.posexplode(F.split(marked, mark)).alias("pos", "part"))
    has = F.col("part").contains("\x02")
    out = parts.select(*key, "pos", F.when(has, F.substring_index("part", "\x02", 1)).alias("header"), F.trim(F.regexp_replace(F.when(has, F.substring_index("part", "\x02", -1)).otherwise(F.col("part")), r"\s+", " ")).alias("body"))
    return out.filter("header is not null or body <> ''")


def two_sections(x: Column, first: str, second: str) -> Column:
    """(first, second) bodies of a text 'FIRST: .. SECOND: ..'; null if it has another form."""
    pattern = rf"(?is)^\s*{first}:\s*(.*?)\s*{second}:\s*(.*?)\s*$"
    return F.when(x.rlike(pattern), F.struct(F.regexp_extract(x, pattern, 1).alias("first"), F.regexp_extract(x, pattern, 2).alias("second")))


def section_source(df: DataFrame, key: list[str], text: str, header: str = HEADER, findings: list[str] | None = None, impression: list[str] | None = None, other: list[str] | None = None) -> DataFrame:
    """(key, findings, impression, source) of every text that isn't null.

    source: sections (both), findings_only, impression_only, fallback (the text after the last of the other headers, or all
    of it, without a leading FINAL REPORT) or empty. key must be unique.
    """
    h = F.trim("header")
    joined = lambda names: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(h.isin(names) & (F.col("body") != ""), F.struct("pos", "body")))), lambda x: x["body"]), " ")
    per = sections(df, key, text, header).groupBy(*key).agg(joined(findings or FINDINGS).alias("f"), joined(impression or IMPRESSION).alias("i"))
    names = "|".join(sorted(NON_CLINICAL if other is None else other, key=len, reverse=True))
    lines = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    tail = F.regexp_replace(lines, rf"(?s)^(?:.*\n)?[ \t]*(?:{names}):", "")
    tail = F.regexp_replace(F.trim(F.regexp_replace(tail, r"\s+", " ")), r"^FINAL REPORT\s*", "")
    out = df.filter(F.col(text).isNotNull()).select(*key, tail.alias("tail")).join(per, key, "left")
    f, i = (F.coalesce(F.col(c), F.lit("")) for c in ("f", "i"))
    source = F.when((f != "") & (i != ""), "sections").when(f != "", "findings_only").when(i != "", "impression_only").when(F.col("tail") != "", "fallback").otherwise("empty")
    return out.select(*key, F.when((f != "") | (i != ""), f).otherwise(F.col("tail")).alias("findings"), i.alias("impression"), source.alias("source"))


def sentences(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, pos, sentence): split after a full stop, semicolon or line end that white space follows; blanks left out."""
    parts = df.select(*key, F.posexplode(F.split(text, r"(?<=[.;\n])\s+")).alias("pos", "sentence"))
    return parts.withColumn("sentence", F.trim("sentence")).filter("sentence <> ''")


def sentence_index(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, pos, token, sentence): tokens of a text with the running number of sentence ends before them."""
    tokens = df.select(*key, F.posexplode(F.split(F.trim(text), r"\s+")).alias("pos", "token")).filter("token <> ''")
    w = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("sentence", F.coalesce(F.sum(F.col("token").rlike(r"[.;]$").cast("int")).over(w), F.lit(0)))


def lexicon_pattern(phrases: list[str]) -> str:
    """Alternation of phrases between word ends, the longest first."""
    esc = [p.replace(".", r"\.") for p in sorted(set(phrases), key=lambda p: (-len(p), p))]
    return r"(?i)\b(" + "|".join(esc) + r")\b"


def cascade(df: DataFrame, text: str, filters: list[tuple[str, Column]]) -> DataFrame:
    """df with dropped_by: the first filter (name, condition) that drops a row, or null."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(filters):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return df.withColumn("dropped_by", out)


def laterality(x: Column) -> Column:
    """bilateral, midline, left, right or unspecified; left and right together are bilateral. Null stays null."""
    l, r = x.rlike(r"(?i)\bleft\b"), x.rlike(r"(?i)\bright\b")
    return F.when(x.isNull(), None).when(x.rlike(r"(?i)\b(bilateral|both)\b"), "bilateral").when(x.rlike(r"(?i)\b(midline|central)\b"), "midline").when(l & r, "bilateral").when(l, "left").when(r, "right").otherwise("unspecified")


def polarity(x: Column, certainty: Column) -> Column:
    """absent if a negation word is there, whatever the parser said; else by certainty."""
    return F.when(x.rlike(r"(?i)\b(no|not|without|free of)\b"), "absent").when(certainty == "definitely absent", "absent").when(certainty == "uncertain", "uncertain").when(certainty == "definitely present", "present")


def temporal(x: Column) -> Column:
    """resolved, worse, better or stationary by the first lexicon that matches; null for none."""
    return F.when(x.rlike(r"(?i)\b(resolved|removed|removal)\b"), "resolved").when(x.rlike(r"(?i)\b(new|increased|worse|worsening)\b"), "worse").when(x.rlike(r"(?i)\b(decreased|improved|smaller)\b"), "better").when(x.rlike(r"(?i)\b(stable|unchanged)\b"), "stationary")


def combined_polarity(lexical: Column, when: Column) -> Column:
    """The decision table of polarity and temporal class; null excludes the row."""
    return F.when((lexical == "absent") | (when == "resolved"), "absent").when((lexical == "present") | when.isin("worse", "better"), "present").when(lexical == "uncertain", "indeterminate").when(when == "stationary", "stationary")


def exclusive_tags(df: DataFrame, text: str, lexicon: dict[str, str], allowed: dict[str, list[str]]) -> DataFrame:
    """df with tags (all nodes whose pattern matches) and only: the node whose tags are all itself or allowed with it, or null."""
    tags = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), n) for n, p in lexicon.items()]))
    only = F.lit(None).cast("string")
    for n in reversed(list(lexicon)):
        only = F.when(F.array_contains("tags", n) & (F.size(F.array_except("tags", F.array(*[F.lit(x) for x in [n, *allowed.get(n, [])]]))) == 0), n).otherwise(only)
    return df.withColumn("tags", F.coalesce(tags, F.array().cast("array<string>"))).withColumn("only", only)


def token_candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_text: str, right_text: str, n: int, stop: list[str] | None = None) -> DataFrame:
    """(left_id, right_id, jaccard, rank): the n best right rows of every left row by shared words.

    Words are exploded and joined, so only rows that share a word meet; words of the stop list don't count as shared.
    """
    def words(df: DataFrame, key: str, text: str, size: str) -> DataFrame:
        w = F.array_distinct(ascii_words(F.col(text)))
        return df.select(key, F.size(w).alias(size), F.explode(w).alias("w"))

    shared = words(left, left_id, left_text, "nl").join(words(right, right_id, right_text, "nr"), "w")
    shared = shared.filter(~F.col("w").isin(stop)) if stop else shared
    both = shared.groupBy(left_id, right_id, "nl", "nr").agg(F.count("*").alias("n"))
    scored = both.select(left_id, right_id, F.round(F.col("n") / (F.col("nl") + F.col("nr") - F.col("n")), 6).alias("jaccard"))
    w = Window.partitionBy(left_id).orderBy(F.col("jaccard").desc(), F.col(right_id).asc())
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two sets given as arrays; two empty sets give 1."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    hit, total = F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)
    return F.when(total == 0, 1.0).otherwise(2.0 * hit / total)


def compare_claims(expected: DataFrame, claimed: DataFrame, tolerated: DataFrame, key: list[str], zoned: list[str] | None = None) -> DataFrame:
    """(key, node, kind) of every mismatch between expected and claimed statements (key, node, certainty, side, zone).

    expected has a row a node, claimed may have several. Kinds: omitted, polarity, certainty, side (another than expected,
    or any where none is expected), zone (the same, the latter for zoned nodes only), added, added_negative. Claims about
    an ancestor of a stated node are tolerated; tolerated: (node, ancestor). Sides and zones of absent statements don't count.
    """
    said = claimed.groupBy(*key, "node").agg(*[F.collect_set(c).alias(f"c_{c}") for c in ("certainty", "side", "zone")])
    e = expected.select(*key, "node", "certainty", "side", "zone", F.lit(True).alias("_e"))
    fine = expected.filter("certainty <> 'absent'").select(*key, "node").join(F.broadcast(tolerated), "node").select(*key, F.col("ancestor").alias("node"), F.lit(True).alias("_f")).distinct()
    both = e.join(said, [*key, "node"], "full").join(fine, [*key, "node"], "left")
    has = lambda c: F.coalesce(F.size(f"c_{c}") > 0, F.lit(False))
    holds = lambda c: F.coalesce(F.array_contains(f"c_{c}", F.col(c)), F.lit(False))
    claimed_at_all = F.col("c_certainty").isNotNull()
    stated = F.col("certainty").isin("present", "possible")
    positive = F.coalesce(F.arrays_overlap("c_certainty", F.array(F.lit("present"), F.lit("possible"))), F.lit(False))
    differs = lambda c, extra: stated & F.when(F.col(c).isNotNull(), ~holds(c)).otherwise(has(c) & extra)
    here = F.col("_e").isNotNull()
    new = ~here & F.col("_f").isNull()
    in_zone = F.lit(True) if zoned is None else F.col("node").isin(zoned)
    kinds = F.array_compact(F.array(
        F.when(here & ~claimed_at_all, "omitted"),
        F.when(here & claimed_at_all & ~holds("certainty"), F.when(stated != positive, "polarity").otherwise("certainty")),
        F.when(here & claimed_at_all & differs("side", F.lit(True)), "side"),
        F.when(here & claimed_at_all & differs("zone", in_zone), "zone"),
        F.when(new, F.when(positive, "added").otherwise("added_negative")),
    ))
    return both.select(*key, "node", F.explode(kinds).alias("kind"))


def lobe_mentions(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, node, kind) with kind lobe for every text that names a lobe, which is never licensed."""
    return df.filter(F.col(text).rlike(r"(?i)\blobes?\b|\blingula")).select(*key, F.lit(None).cast("string").alias("node"), F.lit("lobe").alias("kind"))


def regenerate(pending: DataFrame, key: list[str], generate, check, template: DataFrame, attempts: int = 3) -> DataFrame:
    """(key, text, attempt, source) after generating, checking and trying again; what never passes takes its template.

    generate(rows, attempt) gives (key, text); check(texts) gives (key, kind) rows of what is wrong. Every attempt works on
    the rows left over by an anti join, so there are at most attempts rounds, whatever the number of rows.
    """
    done, left = None, pending
    for attempt in range(1, attempts + 1):
        texts = cut(generate(left, attempt).select(*key, "text"))
        wrong = check(texts).select(*key).distinct()
        good = texts.join(wrong, key, "left_anti").select(*key, "text", F.lit(attempt).alias("attempt"), F.lit("generated").alias("source"))
        done = good if done is None else done.unionByName(good)
        left = cut(left.join(good.select(*key), key, "left_anti"))
        if left.isEmpty():
            return done
    rest = left.select(*key).join(template.select(*key, "text"), key).select(*key, "text", F.lit(attempts).alias("attempt"), F.lit("template").alias("source"))
    return done.unionByName(rest)


def corrupt(statements: DataFrame, how: str) -> DataFrame:
    """Statements with one fault each, to test a comparison: drop, negate or add_side."""
    if how == "drop":
        return statements.filter("false")
    if how == "negate":
        return statements.withColumn("certainty", F.when(F.col("certainty") == "absent", "present").otherwise("absent"))
    return statements.withColumn("side", F.coalesce("side", F.lit("left")))


def fill_template(template: Column, **fields: Column) -> Column:
    """{name} and {Name} (capitalised) in a template replaced; null fields by nothing."""
    out = template
    for name, value in fields.items():
        v = F.coalesce(value, F.lit(""))
        out = F.replace(F.replace(out, F.lit("{" + name + "}"), v), F.lit("{" + name.capitalize() + "}"), capitalised(v))
    return out


def render(df: DataFrame, key: list[str], order: str, sentence: str) -> DataFrame:
    """(key, text): sentences that aren't null or empty joined by blanks in their order."""
    ordered = F.array_sort(F.collect_list(F.when(F.col(sentence) != "", F.struct(F.col(order).alias("o"), F.col(sentence).alias("s")))))
    return df.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["s"]), " ").alias("text"))


def entity_tables(parses: DataFrame, key: str, entities: str) -> tuple[DataFrame, DataFrame]:
    """Entity rows (key, entity, tokens, label, start) and link rows (key, source, kind, target) of parse maps.

    entities: map<string, struct<tokens, label, start_ix, relations: array<struct<kind, target>>>>.
    """
    one = parses.select(key, F.explode(entities).alias("entity", "e"))
    links = one.select(key, F.col("entity").alias("source"), F.explode("e.relations").alias("r")).select(key, "source", "r.kind", "r.target")
    return one.select(key, "entity", "e.tokens", "e.label", F.col("e.start_ix").alias("start")), links


def claims(entity: DataFrame, links: DataFrame, key: str, lexicon: dict[str, str]) -> DataFrame:
    """(key, node, certainty, side, zone) claimed by parsed entities with the words linked to them over up to two links.

    The node is the first pattern of the lexicon that the observation's words match. The most positive certainty of a node
    counts; sides take bilateral over left over right (both sides are bilateral), zones upper over middle over lower.
    """
    words = entity.select(key, F.col("entity"), F.lower("tokens").alias("t"), "label")
    hop = links.select(key, F.col("source").alias("entity"), "target")
    one = hop.join(words.select(key, F.col("entity").alias("target"), F.col("t").alias("w")), [key, "target"]).select(key, "entity", "w")
    second = hop.select(key, "entity", F.col("target").alias("mid")).join(links.select(key, F.col("source").alias("mid"), "target"), [key, "mid"])
    two = second.join(words.select(key, F.col("entity").alias("target"), F.col("t").alias("w")), [key, "target"]).select(key, "entity", "w")
    context = one.unionByName(two).groupBy(key, "entity").agg(F.array_join(F.array_sort(F.collect_set("w")), " ").alias("context"))
    node = F.lit(None).cast("string")
    for n, p in reversed(lexicon.items()):
        node = F.when(F.col("t").rlike(p), n).otherwise(node)
    seen = words.filter("label like 'Observation%'").withColumn("node", node).filter("node is not null").join(context, [key, "entity"], "left")
    near = F.concat_ws(" ", "t", "context")
    certain = F.when(F.col("label").endswith("definitely absent"), "absent").when(F.col("label").endswith("uncertain"), "possible").otherwise("present")
    rank = F.when(F.col("certainty") == "present", 2).when(F.col("certainty") == "possible", 1).otherwise(0)
    rows = seen.select(key, "node", certain.alias("certainty"), F.when(laterality(near) != "unspecified", laterality(near)).alias("side"), F.when(near.rlike(r"\b(upper|apical|apex)\b"), "upper").when(near.rlike(r"\b(middle|mid)\b"), "middle").when(near.rlike(r"\b(lower|basal|base)\b"), "lower").alias("zone"))
    side = F.when(F.bool_or(F.col("side") == "bilateral") | (F.bool_or(F.col("side") == "left") & F.bool_or(F.col("side") == "right")), "bilateral").when(F.bool_or(F.col("side") == "left"), "left").when(F.bool_or(F.col("side") == "right"), "right")
    zone = F.when(F.bool_or(F.col("zone") == "upper"), "upper").when(F.bool_or(F.col("zone") == "middle"), "middle").when(F.bool_or(F.col("zone") == "lower"), "lower")
    return rows.groupBy(key, "node").agg(F.max_by("certainty", rank).alias("certainty"), side.alias("side"), zone.alias("zone"))
