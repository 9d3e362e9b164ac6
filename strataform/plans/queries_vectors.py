"""Cosine scores, exact neighbours with group exclusion, features from neighbours, grids and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions.hashing import hash_bucket
from strataform.functions.numeric import dot, l2_normalise, weighted_mean
from strataform.operators import vectors
from strataform.plans.base import collector
from strataform.runtime import table

QUERIES, ORACLE_SQL, query = collector()


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding"))


_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_NN = f"""{_E}, nn AS (SELECT query, neighbour, similarity, rank FROM (SELECT q.vec_id AS query, c.vec_id AS neighbour, round(list_cosine_similarity(q.v, c.v), 6) AS similarity,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, c.v), 6) DESC, c.vec_id) AS rank FROM e q JOIN e c ON q.label <> c.label WHERE q.vec_id % 50 = 0) WHERE rank <= {{k}})"""


def neighbours(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = embeddings(spark, d)
    return vectors.nearest(e.filter("vec_id % 50 = 0"), e, "vec_id", "label", "embedding", k)


@query(f"WITH {_E} SELECT q.vec_id AS left_id, c.vec_id AS right_id, round(list_cosine_similarity(q.v, c.v), 6) AS similarity FROM e q, (SELECT * FROM e WHERE vec_id % 50 = 0) c")
def cosine_scores(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    a = e.select(F.col("vec_id").alias("left_id"), "embedding")
    bank = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("right_id"), "embedding")
    return vectors.cosine_scores(a, bank, "left_id", "right_id", "embedding").withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_NN.format(k=10)} SELECT query, neighbour, similarity, rank FROM nn")
def knn_excl_group(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d, 10)


_L = "l AS (SELECT vec_id AS neighbour, CASE WHEN ('0x' || substr(sha256('nl:' || vec_id), 1, 8))::BIGINT % 3 < 2 THEN (label::INT % 2) END AS label FROM embeddings)"


def neighbour_labels(spark: SparkSession, d: str) -> DataFrame:
    known = hash_bucket("nl", F.col("vec_id"), 3) < 2
    return embeddings(spark, d).select(F.col("vec_id").alias("neighbour"), F.when(known, F.col("label").cast("int") % 2).alias("label"))


@query(f"WITH {_NN.format(k=25)}, {_L} SELECT query, k, round(avg(label), 6) AS fraction, count(label) AS n_known, round(avg(similarity), 6) AS mean_similarity FROM nn LEFT JOIN l USING (neighbour), (VALUES (5), (10), (25)) t(k) WHERE rank <= k GROUP BY query, k")
def knn_label_fraction(spark: SparkSession, d: str) -> DataFrame:
    f = vectors.neighbour_features(neighbours(spark, d, 25), neighbour_labels(spark, d), [5, 10, 25])
    return f.select("query", "k", F.round("fraction", 6).alias("fraction"), "n_known", F.round("mean_similarity", 6).alias("mean_similarity"))


@query(f"WITH {_NN.format(k=5)}, {_L} SELECT query, list(neighbour ORDER BY rank) AS ids, list(round(similarity, 4) ORDER BY rank) AS similarities, count(*) FILTER (WHERE label = 1) AS pos, count(label) AS known FROM nn LEFT JOIN l USING (neighbour) GROUP BY query")
def case_evidence(spark: SparkSession, d: str) -> DataFrame:
    return vectors.case_evidence(neighbours(spark, d, 5), neighbour_labels(spark, d), 5)


@query(f"""WITH {_NN.format(k=10)}, votes AS (SELECT vec_id AS neighbour, 'c' || (vec_id % 7) AS concept, CASE WHEN vec_id % 3 = 0 THEN 'absent' ELSE 'present' END AS polarity FROM embeddings),
v AS (SELECT query, concept, coalesce(sum(similarity) FILTER (WHERE polarity = 'present'), 0) AS present, coalesce(sum(similarity * 0.3) FILTER (WHERE polarity = 'absent'), 0) AS absent FROM nn JOIN votes USING (neighbour) GROUP BY ALL)
SELECT query, concept, round(present, 6) AS present, round(absent + 3e-8, 6) AS absent, round(present - absent + 3e-8, 6) AS support FROM v WHERE greatest(present, absent) >= 0.05""")
def similarity_vote(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    votes = embeddings(spark, d).select(i.alias("neighbour"), F.concat(F.lit("c"), (i % 7).cast("string")).alias("concept"), F.when(i % 3 == 0, "absent").otherwise("present").alias("polarity"))
    v = vectors.weighted_votes(neighbours(spark, d, 10), votes.unionByName(votes), 0.3, 0.05)
    off = F.lit(3e-8)  # away from rounding ties: 0.3 of six decimals has seven
    return v.select("query", "concept", F.round("present", 6).alias("present"), F.round(F.col("absent") + off, 6).alias("absent"), F.round(F.col("support") + off, 6).alias("support"))


@query("SELECT count(*) AS rows, count(DISTINCT vec_id) AS keys, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_size FROM embeddings")
def index_contract(spark: SparkSession, d: str) -> DataFrame:
    return vectors.index_contract(embeddings(spark, d), "vec_id", "embedding", 64).select("rows", "keys", "wrong_size")


@query(f"""WITH {_E} SELECT vec_id, round(list_inner_product(v, v), 6) AS norm2, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round((list_inner_product(list_transform(v, lambda x: abs(x)), v)) / greatest(list_sum(list_transform(v, lambda x: abs(x))), 1e-6), 6) AS pooled FROM e""")
def vector_functions(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return embeddings(spark, d).select("vec_id", F.round(dot(v, v), 6).alias("norm2"), F.round(l2_normalise(v)[0], 6).alias("first"), F.round(weighted_mean(v, F.transform(v, lambda x: F.abs(x))), 6).alias("pooled"))


_BOX = """b AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey % 300 + 0.0::DOUBLE AS x1, l_suppkey % 200 + 0.0::DOUBLE AS y1, l_partkey % 300 + l_quantity AS x2, l_suppkey % 200 + l_quantity * 2 AS y2 FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem))"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").distinct()
    x, y, q = F.col("l_partkey") % 300 + F.lit(0.0), F.col("l_suppkey") % 200 + F.lit(0.0), F.col("l_quantity")
    return l.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), x.alias("x1"), y.alias("y1"), (x + q).alias("x2"), (y + q * 2).alias("y2"))


@query(f"""WITH {_BOX}, g AS (SELECT unnest(range(8)) AS cell_x), h AS (SELECT unnest(range(8)) AS cell_y) SELECT cell_x::INT AS cell_x, cell_y::INT AS cell_y, round(sum(greatest(0, least(x2, (cell_x + 1) * 50) - greatest(x1, cell_x * 50)) / 50 * greatest(0, least(y2, (cell_y + 1) * 40) - greatest(y1, cell_y * 40)) / 40), 4) AS share
FROM b, g, h WHERE least(x2, (cell_x + 1) * 50) > greatest(x1, cell_x * 50) AND least(y2, (cell_y + 1) * 40) > greatest(y1, cell_y * 40) GROUP BY ALL""")
def box_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = vectors.box_cells(boxes(spark, d), 8, F.lit(400.0), F.lit(320.0))
    return c.groupBy("cell_x", "cell_y").agg(F.round(F.sum("share"), 4).alias("share"))


_RLE = """r AS (SELECT user_id AS id, 100 + user_id % 50 AS width, list(event_id % 40 * 97 + 1 ORDER BY event_id) AS s, list(1 + event_id % 60 ORDER BY event_id) AS l FROM events GROUP BY user_id)"""


def masks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id")
    pair = F.struct("event_id", F.concat_ws(" ", (F.col("event_id") % 40 * 97 + 1).cast("string"), (1 + F.col("event_id") % 60).cast("string")).alias("t"))
    return e.groupBy(F.col("user_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["t"]), " ").alias("rle")).withColumn("width", 100 + F.col("id") % 50)


@query(f"WITH {_RLE} SELECT id, list_sum(l)::BIGINT AS area, len(l) AS runs FROM r")
def rle_area(spark: SparkSession, d: str) -> DataFrame:
    return vectors.run_lengths(masks(spark, d), "rle").groupBy("id").agg(F.sum("length").alias("area"), F.count("*").alias("runs"))


@query(f"""WITH {_RLE}, p AS (SELECT id, width, unnest(range(s0 - 1, s0 - 1 + l0)) AS i FROM (SELECT id, width, unnest(s) AS s0, unnest(l) AS l0 FROM r)), c AS (SELECT id, i // width AS y, i % width AS x FROM p)
SELECT id, count(*) AS area, min(x)::BIGINT AS x_min, max(x)::BIGINT AS x_max, min(y)::BIGINT AS y_min, max(y)::BIGINT AS y_max, round(avg(x), 6) AS x_mean, round(avg(y), 6) AS y_mean FROM c GROUP BY id""")
def mask_shapes(spark: SparkSession, d: str) -> DataFrame:
    m = vectors.mask_shape(vectors.run_lengths(masks(spark, d), "rle"), ["id"], "width")
    return m.select("id", "area", "x_min", "x_max", "y_min", "y_max", F.round("x_mean", 6).alias("x_mean"), F.round("y_mean", 6).alias("y_mean"))


@query("""WITH p AS (SELECT p_partkey, p_size + 10.0::DOUBLE AS w, p_partkey % 90 + 20.0::DOUBLE AS h FROM part) SELECT p_partkey, round(5 * 512 / w, 4) AS sx, round(7 * 512 / h, 4) AS sy,
round(5 * floor(w * (512 / greatest(w, h))) / w + floor((512 - floor(w * (512 / greatest(w, h)))) / 2), 4) AS lx FROM p""")
def canvas_maps(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("p_size") + F.lit(10.0), F.col("p_partkey") % 90 + F.lit(20.0)
    sx, sy = vectors.canvas(F.lit(5.0), F.lit(7.0), w, h, 512, False)
    lx, _ = vectors.canvas(F.lit(5.0), F.lit(7.0), w, h, 512, True)
    return table(spark, d, "part").select("p_partkey", F.round(sx, 4).alias("sx"), F.round(sy, 4).alias("sy"), F.round(lx, 4).alias("lx"))
