"""Ranks, deduplication, curves, samples and quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataform.functions.hashing import hex_number
from strataform.operators import metrics, ordered
from strataform.plans.base import SCORES_SQL, collector, scores
from strataform.runtime import table

QUERIES, ORACLE_SQL, query = collector()


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY
CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS n FROM lineitem) WHERE n = 1""")
def one_per_study(spark: SparkSession, d: str) -> DataFrame:
    prefer = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    order = [prefer, *[F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")]]
    return ordered.first_per_group(table(spark, d, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders")
def row_number_in_group(spark: SparkSession, d: str) -> DataFrame:
    return ordered.numbered(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "n")


@query("""WITH f AS (SELECT p_type, min(p_partkey) AS first FROM part GROUP BY p_type), g AS (SELECT p_type, dense_rank() OVER (ORDER BY first) AS grp FROM f)
SELECT grp, count(*) AS n FROM part JOIN g USING (p_type) GROUP BY grp""")
def dense_phrase_id(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "part").groupBy("p_type").agg(F.min("p_partkey").alias("first"), F.count("*").alias("n"))
    return first.select(F.dense_rank().over(Window.orderBy("first")).alias("grp"), "n")  # one row a type


@query("""SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY round(o_totalprice / 1000)) + (count(*) OVER (PARTITION BY o_orderpriority, round(o_totalprice / 1000)) - 1) / 2 AS rank FROM orders""")
def avg_rank(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice") / 1000).alias("s"))
    return ordered.average_rank(o, ["o_orderpriority"], "s").select("o_orderkey", "rank")


@query(f"""WITH {SCORES_SQL} SELECT node, entity, (sum(y) OVER w)::BIGINT AS tp, count(*) OVER w AS k, round(sum(y) OVER w / count(*) OVER w, 6) AS ppv FROM scores WHERE y IS NOT NULL
WINDOW w AS (PARTITION BY node ORDER BY p DESC, entity ROWS UNBOUNDED PRECEDING)""")
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).withColumnRenamed("entity", "id")
    return metrics.running_sums(s, ["node"]).select("node", F.col("id").alias("entity"), "tp", "k", F.round("ppv", 6).alias("ppv"))


@query("""SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 3""")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    return ordered.top_k(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


@query("SELECT c_custkey, ('0x' || substr(sha256('pick:' || c_custkey), 1, 15))::BIGINT AS h FROM customer ORDER BY h, c_custkey LIMIT 50")
def sample_hash_n(spark: SparkSession, d: str) -> DataFrame:
    c = ordered.hash_sample(table(spark, d, "customer").select("c_custkey"), "pick", "c_custkey", 50)
    return c.select("c_custkey", hex_number(F.concat(F.lit("pick:"), F.col("c_custkey").cast("string")), 15).alias("h"))


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority, o_totalprice > 350000 AS pos, ('0x' || substr(sha256('neg:' || o_orderkey), 1, 15))::BIGINT AS h FROM orders),
n AS (SELECT o_orderpriority, count(*) FILTER (WHERE pos) AS np FROM o GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS k FROM o WHERE NOT pos)
SELECT o_orderkey, o_orderpriority, pos FROM o WHERE pos UNION ALL SELECT o_orderkey, o_orderpriority, pos FROM r JOIN n USING (o_orderpriority) WHERE k <= 4 * np""")
def neg_subsample(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") > 350000).alias("pos"))
    return ordered.capped_negatives(o, ["o_orderpriority"], F.col("pos"), "o_orderkey", 4, "neg")


@query("""WITH v AS (SELECT n_chars::DOUBLE AS x, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL), q(q) AS (VALUES (0.1::DOUBLE), (0.5), (0.9), (0.99))
SELECT q, x AS value FROM v JOIN q ON i = least(n - 1, floor(q * n))""")
def nearest_index_quantile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("n_chars")
    out = None
    for q in (0.1, 0.5, 0.9, 0.99):
        one = ordered.nearest_index_quantile(docs, "n_chars", q)
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderkey, round(100 * o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def share_of_partition(spark: SparkSession, d: str) -> DataFrame:
    total = F.sum("o_totalprice").over(Window.partitionBy("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", F.round(100 * F.col("o_totalprice") / total, 6).alias("share"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 25")
def sorted_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice").orderBy(F.desc("p_size"), "p_retailprice", "p_partkey").limit(25)


@query("""WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE value >= 50) AS kept, max(value) AS best, max(CASE WHEN rank = 1 THEN event_id END) AS best_id FROM r GROUP BY user_id""")
def rank_kept_summary(spark: SparkSession, d: str) -> DataFrame:
    best = F.min(F.struct((-F.col("value")).alias("m"), "event_id"))
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 50).alias("kept"), F.max("value").alias("best"), best["event_id"].alias("best_id"))


@query("""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents WHERE text IS NOT NULL)
SELECT t, count(*) AS n FROM w WHERE t NOT IN ('the', 'and', 'of', 'a', 'in', 'is', 'to') GROUP BY t ORDER BY n DESC, t LIMIT 40""")
def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("t"))
    return words.filter(~F.col("t").isin("the", "and", "of", "a", "in", "is", "to")).groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(40)


@query("""WITH b(lo, hi) AS (VALUES (0, 1), (1, 100), (100, 300), (300, 1000), (1000, 5000), (5000, 20000), (20000, 10000000)) SELECT lo, hi, count(doc_id) AS n FROM b LEFT JOIN documents ON n_chars >= lo AND n_chars < hi GROUP BY lo, hi""")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    edges = [0, 1, 100, 300, 1000, 5000, 20000, 10_000_000]
    n = F.col("n_chars")
    at = F.lit(None).cast("int")
    for lo, hi in zip(edges[:-1], edges[1:]):
        at = F.when((n >= lo) & (n < hi), lo).otherwise(at)
    counts = table(spark, d, "documents").groupBy(at.alias("lo")).agg(F.count("*").alias("n"))
    b = spark.createDataFrame(list(zip(edges[:-1], edges[1:])), "lo int, hi int")
    return b.join(counts, "lo", "left").na.fill(0, ["n"])


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 0 ORDER BY n_chars, doc_id LIMIT 5")
def shortest_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("n_chars > 0").select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(5)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(sha256('strat:' || doc_id), 1, 15))::BIGINT, doc_id) AS n FROM documents) WHERE n <= 2")
def stratified_pick(spark: SparkSession, d: str) -> DataFrame:
    h = hex_number(F.concat(F.lit("strat:"), F.col("doc_id").cast("string")), 15)
    return ordered.top_k(table(spark, d, "documents").select("source", "doc_id", h.alias("h")), ["source"], [F.col("h"), F.col("doc_id")], 2).select("source", "doc_id")
