"""Projections, joins, aggregations, pivots and set operations on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions.hashing import hash_bucket, split_rule, unit_hash
from strataform.functions.names import capitalised, one_space, snake_value, templated_path
from strataform.functions.numeric import fractional_iou, one_hot, overlap_1d, two_prompt_softmax, zscore_impute
from strataform.operators import contracts, relational
from strataform.plans.base import BUCKET_SQL, UNIT_SQL, collector
from strataform.runtime import table

QUERIES, ORACLE_SQL, query = collector()


@query("SELECT o_orderkey, c_name, c_mktsegment, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def study_table_left_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice")


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def inner_join_totals(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def checked_join_many_to_one(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return relational.checked_join(o, c, ["k"], validate="many_to_one").select("o_orderkey", "c_nationkey")


@query("SELECT c_custkey, c_nationkey AS nation_c, s_nationkey AS nation_s FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def suffix_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("nation"))
    return relational.suffixed_join(c, s, ["c_custkey"], "left", ("_c", "_s"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def aligned_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return relational.lookup_all(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.broadcast(n), ["c_nationkey"], "n_name").select("c_custkey", "n_name")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_f FROM customer")
def split_membership_semi(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.membership_flag(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], "has_f")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def missing_anti(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("""SELECT count(*) AS joined, count(*) FILTER (WHERE c_nationkey IS DISTINCT FROM s_nationkey) AS differ_nation
FROM customer JOIN supplier ON c_custkey = s_suppkey""")
def id_mismatch_count(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    return relational.id_mismatches(c, s, "k", ["nation"])


@query("""WITH m(kind, name, target) AS (VALUES ('label', 'FOB', 'free'), ('label', 'MAIL', 'post'), ('category', 'R', 'returned'), ('category', 'A', 'returned'))
SELECT DISTINCT l_orderkey, l_linestatus, l_returnflag, target FROM lineitem JOIN m ON (kind = 'label' AND name = l_linestatus) OR (kind = 'category' AND name = l_returnflag)""")
def mapped_or_join(spark: SparkSession, d: str) -> DataFrame:
    m = spark.createDataFrame([("label", "FOB", "free"), ("label", "MAIL", "post"), ("category", "R", "returned"), ("category", "A", "returned")], "kind string, name string, target string")
    return relational.mapped_or(table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag"), "l_linestatus", "l_returnflag", F.broadcast(m))


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders")
def counts_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderpriority").alias("priorities"))


@query("""SELECT o_custkey, sum((o_orderstatus = 'F')::INT)::BIGINT AS f, sum((o_orderstatus = 'O')::INT)::BIGINT AS o, sum((o_orderstatus = 'P')::INT)::BIGINT AS p FROM orders GROUP BY o_custkey""")
def vote_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"])


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, count(l_discount) AS known, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_returnflag""")
def named_multi_agg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.count("l_discount").alias("known"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT c_nationkey, array_to_string(list_sort(list_distinct(list(c_mktsegment))), '|') AS segments FROM customer GROUP BY c_nationkey")
def sorted_distinct_collect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), "|").alias("segments"))


@query("SELECT subject_id, count(DISTINCT study_id) AS studies, min(view_position) AS view FROM study_records WHERE subject_id IS NOT NULL GROUP BY subject_id")
def distinct_and_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "study_records").filter("subject_id is not null").groupBy("subject_id").agg(F.countDistinct("study_id").alias("studies"), F.min("view_position").alias("view"))


@query("""SELECT count(*) FILTER (WHERE l_quantity > 40) AS large, count(*) FILTER (WHERE l_discount = 0) AS full_price, count(*) FILTER (WHERE l_returnflag = 'R' AND l_tax > 0.05) AS returned FROM lineitem""")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count_if(F.col("l_quantity") > 40).alias("large"), F.count_if(F.col("l_discount") == 0).alias("full_price"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.05)).alias("returned"))


@query("SELECT view_position, count(*) AS n, round(count(*) / (SELECT count(*) FROM study_records), 6) AS share FROM study_records GROUP BY view_position")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "study_records")
    counts = r.groupBy("view_position").agg(F.count("*").alias("n"))
    total = r.agg(F.count("*").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("view_position", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority""")
def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("""SELECT coalesce(view_position, CASE WHEN grouping(view_position) = 1 THEN 'ALL' END) AS view_position,
count(*) FILTER (WHERE patient_orientation = 'Erect') AS "Erect", count(*) FILTER (WHERE patient_orientation = 'Recumbent') AS "Recumbent" FROM study_records GROUP BY ROLLUP (view_position)""")
def contingency_fill0(spark: SparkSession, d: str) -> DataFrame:
    return relational.contingency(table(spark, d, "study_records"), "view_position", "patient_orientation", ["Erect", "Recumbent"], total=True)


@query("""SELECT CASE WHEN grouping(p_brand) = 1 THEN 'ALL' ELSE p_brand END AS p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY ROLLUP (p_brand)""")
def group_plus_total(spark: SparkSession, d: str) -> DataFrame:
    return relational.with_total(table(spark, d, "part"), "p_brand", F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean"))


@query("""SELECT g, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_quantity > 10 THEN 'over10' END, CASE WHEN l_quantity > 30 THEN 'over30' END, 'all'], lambda x: x IS NOT NULL)) AS g FROM lineitem) GROUP BY g""")
def overlapping_group_counts(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return relational.overlapping_groups(table(spark, d, "lineitem").select("l_quantity"), {"over10": q > 10, "over30": q > 30, "all": F.lit(True)}, "g").groupBy("g").agg(F.count("*").alias("n"))


@query("SELECT round(avg(m), 6) AS macro FROM (SELECT avg(l_discount) AS m FROM lineitem GROUP BY l_returnflag, l_linestatus)")
def macro_mean(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("m"))
    return per.agg(F.round(F.avg("m"), 6).alias("macro"))


@query("""SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd,
round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.05), 4) AS p5 FROM orders GROUP BY o_orderpriority""")
def quantile_summary(spark: SparkSession, d: str) -> DataFrame:
    x = "o_totalprice"
    r = lambda c, n: F.round(c, 4).alias(n)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), r(F.avg(x), "mean"), r(F.stddev_samp(x), "sd"), r(F.median(x), "med"), r(F.percentile(x, 0.05), "p5"))


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS x FROM events), s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM v)
SELECT event_id, round(coalesce((x - m) / (sd + 1e-6), 0), 6) AS z, (x IS NULL)::INT AS missing FROM v, s""")
def zscore_impute_flag(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("x"))
    s = v.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    z, missing = zscore_impute(F.col("x"), F.col("m"), F.col("sd"))
    return v.crossJoin(F.broadcast(s)).select("event_id", F.round(z, 6).alias("z"), missing.alias("missing"))


@query("""SELECT l_orderkey, max(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS most_f, max(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS most_o, max(l_quantity) AS most FROM lineitem GROUP BY l_orderkey""")
def nanmax_by_side(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(*[F.max(F.when(F.col("l_linestatus") == s, q)).alias(f"most_{s.lower()}") for s in "FO"], F.max(q).alias("most"))


@query("""SELECT user_id, event_type, best FROM (SELECT user_id, event_type, max(value) AS best, row_number() OVER (PARTITION BY user_id ORDER BY max(value) DESC, event_type) AS n FROM events GROUP BY user_id, event_type) WHERE n = 1""")
def argmax_region(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("best"))
    top = per.groupBy("user_id").agg(F.min(F.struct((-F.col("best")).alias("m"), "event_type")).alias("t"))
    return top.select("user_id", F.col("t.event_type").alias("event_type"), (-F.col("t.m")).alias("best"))


@query("SELECT l_orderkey, bool_or(l_quantity > 49) AS any_large, bool_and(l_discount < 0.1) AS all_small FROM lineitem GROUP BY l_orderkey")
def any_violation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_quantity") > 49).alias("any_large"), F.bool_and(F.col("l_discount") < 0.1).alias("all_small"))


@query("SELECT p_type, p_size, count(*) AS n FROM part GROUP BY p_type, p_size ORDER BY n DESC, p_type, p_size LIMIT 10")
def topn_counter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_type", "p_size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type", "p_size").limit(10)


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, max(abs(l_tax - l_discount)) AS most FROM lineitem")
def correlation_and_diff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.max(F.abs(F.col("l_tax") - F.col("l_discount"))).alias("most"))


@query("""SELECT p_partkey, replace(replace(lower(trim(p_type)), ' ', '_'), '/', '_') AS snake, 'files/' || substr(p_brand, 1, 2) || '/' || p_partkey || '.txt' AS path,
upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS title, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class,
coalesce(CASE WHEN p_size % 5 <> 0 THEN p_size END, -1) AS filled, regexp_replace(trim(p_name), '\\s+', ' ', 'g') AS clean FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23')""".replace("\\\\", "\\"))
def projections(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, d, "part").filter(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#23")).select(
        "p_partkey", snake_value(F.col("p_type")).alias("snake"), templated_path("files/{a}/{b}.txt", a=F.substring("p_brand", 1, 2), b=F.col("p_partkey")).alias("path"), capitalised(F.col("p_name")).alias("title"),
        F.when(size < 10, "small").when(size < 30, "medium").otherwise("large").alias("size_class"), F.coalesce(F.when(size % 5 != 0, size), F.lit(-1)).alias("filled"), one_space(F.col("p_name")).alias("clean"),
    )


_SPLIT = UNIT_SQL.format("'split_v1:' || c_custkey")


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 97 = 0 THEN 'excluded' WHEN c_custkey % 10 = 0 THEN 'test' WHEN {_SPLIT} < 0.8 THEN 'train' WHEN {_SPLIT} < 0.8 + 0.1 THEN 'validate' ELSE 'test' END AS split, round({_SPLIT}, 12) AS u FROM customer""")
def unit_hash_split(spark: SparkSession, d: str) -> DataFrame:
    u, k = unit_hash("split_v1", F.col("c_custkey")), F.col("c_custkey")
    return table(spark, d, "customer").select(k, split_rule(F.when(k % 10 == 0, "test"), k % 97 == 0, u, {"train": 0.8, "validate": 0.1, "test": 0.1}).alias("split"), F.round(u, 12).alias("u"))


@query(f"SELECT o_orderkey, {BUCKET_SQL.format(chr(39) + 'fold:' + chr(39) + ' || o_custkey', 5)} AS fold FROM orders")
def fold_assign(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", hash_bucket("fold", F.col("o_custkey"), 5).alias("fold"))


@query(f"""WITH f AS (SELECT DISTINCT o_custkey AS k, {BUCKET_SQL.format(chr(39) + 'fold:' + chr(39) + ' || o_custkey', 5)} AS fold FROM orders)
SELECT a.fold AS a, b.fold AS b, count(*) AS shared FROM f a JOIN f b USING (k) WHERE a.fold < b.fold GROUP BY ALL UNION ALL SELECT -1, -1, count(DISTINCT k) FROM f""")
def split_disjointness(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), hash_bucket("fold", F.col("o_custkey"), 5).cast("bigint").alias("fold")).distinct()
    shared = f.withColumnRenamed("fold", "a").join(f.withColumnRenamed("fold", "b"), "k").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return shared.unionByName(f.agg(F.lit(-1).cast("bigint").alias("a"), F.lit(-1).cast("bigint").alias("b"), F.countDistinct("k").alias("shared")))


@query("""SELECT 'left' AS side, c_nationkey AS k FROM customer EXCEPT ALL SELECT 'left', s_nationkey FROM supplier
UNION ALL (SELECT 'right' AS side, s_nationkey AS k FROM supplier EXCEPT ALL SELECT 'right', c_nationkey FROM customer)""")
def frozen_equality(spark: SparkSession, d: str) -> DataFrame:
    return relational.frame_difference(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("""SELECT k, 'both' AS where_ FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL SELECT k, 'customer' FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("where_", F.lit("both")).unionByName(c.subtract(s).withColumn("where_", F.lit("customer")))


@query("SELECT 'c' AS t, c_custkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.lit("c").alias("t"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    s = table(spark, d, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("k"), F.lit("s").alias("t"))
    return c.unionByName(s)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").dropDuplicates()


@query("""SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS building, (c_mktsegment = 'MACHINERY')::INT AS machinery, round(1 / (1 + exp(-(c_acctbal / 1000 - 1))), 6) AS share,
greatest(0, least(c_acctbal, 5000) - greatest(c_nationkey * 100, 0))::DOUBLE AS overlap FROM customer""")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    b, m = one_hot(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"])
    bal = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", b.alias("building"), m.alias("machinery"), F.round(two_prompt_softmax(bal / 1000, F.lit(1.0)), 6).alias("share"), overlap_1d(F.col("c_nationkey") * 100.0, bal, F.lit(0.0), F.lit(5000.0)).alias("overlap"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS v FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: least(z[1], z[2]))) / list_sum(list_transform(list_zip(a.v, b.v), lambda z: greatest(z[1], z[2]))), 6) AS iou
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def pairwise_iou(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))
    a, b = e.select(F.col("vec_id").alias("a"), F.col("v").alias("va")), e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("v").alias("vb"))
    return a.join(b, "a").select("a", "b", F.round(fractional_iou(F.col("va"), F.col("vb")), 6).alias("iou"))


@query("""SELECT "check", passed FROM (VALUES ('unique', (SELECT count(*) = count(DISTINCT c_custkey) FROM customer)), ('orders_known', (SELECT count(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))),
('no_negative', (SELECT count(*) = 0 FROM lineitem WHERE l_quantity < 0))) t("check", passed) UNION ALL SELECT 'ALL', true""")
def contract_gate(spark: SparkSession, d: str) -> DataFrame:
    unique = contracts.duplicate_keys(table(spark, d, "customer"), ["c_custkey"]).agg((F.count("*") == 0).alias("passed")).select(F.lit("unique").alias("check"), "passed")
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    known = o.join(c, o.o_custkey == c.c_custkey, "left_anti").agg((F.count("*") == 0).alias("passed")).select(F.lit("orders_known").alias("check"), "passed")
    sign = table(spark, d, "lineitem").agg((F.count_if(F.col("l_quantity") < 0) == 0).alias("passed")).select(F.lit("no_negative").alias("check"), "passed")
    return contracts.gate(unique.unionByName(known).unionByName(sign))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 2, 4, 5, 7, 8, 10)")
def pushed_in_filter(spark: SparkSession, d: str) -> DataFrame:
    from strataform.sources.files import parquet_where

    return parquet_where(spark, f"{d}/orders.parquet", "o_custkey", [1, 2, 4, 5, 7, 8, 10], ["o_orderkey", "o_custkey"])


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def schema_only_columns(spark: SparkSession, d: str) -> DataFrame:
    from strataform.sources.files import parquet_with

    return parquet_with(spark, f"{d}/customer.parquet", ["c_custkey", "c_name"], ["c_nationkey", "c_unknown"])


@query("""SELECT event_id, json_extract_string(props, '$.k')::INT AS k, (json_extract_string(props, '$.k') IS NULL) AS missing FROM events""")
def nested_json_attributes(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), k.isNull().alias("missing"))


@query("""SELECT split2 AS split, view_position, count(*) AS n, count(*) < 50 AS few FROM (SELECT substr(lower(trim(split)), 1, 2) AS split2, view_position FROM study_records WHERE split IS NOT NULL) GROUP BY ALL""")
def positives_per_split(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "study_records").filter("split is not null").select(F.substring(F.lower(F.trim("split")), 1, 2).alias("split"), "view_position")
    return r.groupBy("split", "view_position").agg(F.count("*").alias("n"), (F.count("*") < 50).alias("few"))


@query("""SELECT l_orderkey, (l_quantity > 25)::INT + (l_discount > 0.05)::INT + (l_tax > 0.04)::INT AS hits FROM lineitem""")
def row_true_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", ((F.col("l_quantity") > 25).cast("int") + (F.col("l_discount") > 0.05).cast("int") + (F.col("l_tax") > 0.04).cast("int")).alias("hits"))


@query("""SELECT a.user_id, CASE WHEN a.user_id < b.user_id THEN round(d, 6) ELSE round(-d, 6) END AS diff FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id) a
JOIN (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id) b ON b.user_id = a.user_id + 1, LATERAL (SELECT a.m - b.m AS d)""")
def sign_normalised(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"))
    b = m.select((F.col("user_id") - 1).alias("user_id"), F.col("user_id").alias("other"), F.col("m").alias("mb"))
    diff = F.round(F.col("m") - F.col("mb"), 6)
    return m.join(b, "user_id").select("user_id", F.when(F.col("user_id") < F.col("other"), diff).otherwise(-diff).alias("diff"))
