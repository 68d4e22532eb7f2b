"""Queries on vectors: search, evaluation, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import fusion, retrieval


def _split(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """All rows as points, and as queries those whose id is divisible by 50; a query's own row is no point for it."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("point_id"), "embedding", "label"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("truth"))


def _shown(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_SCORED = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label AS truth FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT vec_id AS point_id, embedding::DOUBLE[] AS v, label FROM embeddings),
c AS (SELECT query_id, truth, point_id, label, list_cosine_similarity(p.v, q.v) AS cos FROM p, q WHERE point_id <> query_id)"""


def _topk_sql(score: str, where: str = "true") -> str:
    return f"""{_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, point_id) AS hit_rank FROM c WHERE {where})
SELECT query_id, hit_rank, point_id, round({score}, 6) AS score FROM r WHERE hit_rank <= 10"""


def _topk(metric: str, where=None):
    def run(spark, d):
        points, queries = _split(spark, d)
        return _shown(retrieval.search(points, queries, 10, metric, where, others=True), "score")

    return run


def _cells(spark, d):
    points, queries = _split(spark, d)
    return _shown(retrieval.search_cells(points, queries, 10, others=True), "score")


def _lists(spark, d):
    """Of each query the points of its own label parity that lie within a narrow band of ids, so that some find nothing."""
    points, queries = _split(spark, d)
    out = retrieval.search_batch(points, queries, 3, where=(F.col("label") == 3) & (F.col("point_id") % 7 == 0), others=True)
    return out.select("query_id", F.size("hits").alias("n"), F.coalesce(F.array_join(F.transform("hits", lambda h: h["point_id"].cast("string")), ","), F.lit("")).alias("points"))


def _payload(spark, d):
    points, queries = _split(spark, d)
    points = points.withColumn("sku", F.concat(F.lit("p"), F.col("point_id").cast("string")))
    return _shown(retrieval.search_with_payload(points, queries, 5, ["label", "sku"], others=True), "similarity")


def _empty(spark, d):
    """A collection that has nothing yet gives every query an empty list."""
    points, queries = _split(spark, d)
    return retrieval.search_batch(points.where("point_id < 0"), queries, 10).select("query_id", F.size("hits").alias("n"))


def per_query(spark, d):
    points, queries = _split(spark, d)
    ranks = retrieval.rank_truth(points.withColumnRenamed("label", "part_id"), queries.withColumnRenamed("truth", "part_id"), others=True)
    return retrieval.score_ranks(ranks)


_PER_QUERY = f"""{_SCORED}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, point_id) AS hit_rank FROM c),
f AS (SELECT query_id, label AS part_id, min(hit_rank) AS first FROM h GROUP BY 1, 2),
r AS (SELECT query_id, part_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM f),
pq AS (SELECT q.query_id, q.truth AS part_id, t.part_id AS top1, r.rank, coalesce(1 / r.rank, 0.0) AS ap,
  coalesce((r.rank <= 1)::INT, 0) AS recall_1, coalesce((r.rank <= 5)::INT, 0) AS recall_5, coalesce((r.rank <= 10)::INT, 0) AS recall_10
  FROM q LEFT JOIN r ON r.query_id = q.query_id AND r.part_id = q.truth LEFT JOIN r t ON t.query_id = q.query_id AND t.rank = 1)"""


def recall_map(spark, d):
    return per_query(spark, d).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall_1", "recall_5", "recall_10")], F.round(F.avg("ap"), 6).alias("map"), F.count("*").alias("n_queries"))


def bootstrap(spark, d):
    return retrieval.bootstrap(per_query(spark, d).select(F.col("query_id").alias("i"), F.col("ap").alias("value")), 1000, 42)


def paired(spark, d):
    diff = per_query(spark, d).select(F.col("query_id").alias("i"), (F.col("recall_5") - F.col("recall_1")).cast("double").alias("value"))
    return retrieval.bootstrap(diff, 2000, 0)


def _bootstrap_sql(value: str, resamples: int, seed: int) -> str:
    drawn = " + ".join(f"(u >= {t})::INT" for t in retrieval._DRAWN)
    return f"""{_PER_QUERY}, v AS (SELECT query_id AS id, {value} AS value FROM pq),
dr AS (SELECT r, value, ('0x' || substr(md5('{seed}:' || r || ':' || id), 1, {retrieval._DRAW}))::BIGINT AS u FROM range({resamples}) t(r), v),
m AS (SELECT r, sum(({drawn}) * value) / nullif(sum({drawn}), 0) AS m FROM dr GROUP BY r)
SELECT (SELECT round(avg(value), 6) FROM v) AS mean, round(quantile_cont(m::DOUBLE, 0.025), 6) AS ci_low, round(quantile_cont(m::DOUBLE, 0.975), 6) AS ci_high FROM m"""


def _points(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").withColumn("product_id", F.col("vec_id") % 37)


def remove(spark, d):
    gone = spark.range(5).withColumnRenamed("id", "product_id")
    return retrieval.stats(retrieval.remove_product(_points(spark, d), gone))


def unit_norm(spark, d):
    return retrieval.norm_faults(_points(spark, d), 64).agg(F.count("*").alias("faults"))


def _fusion_input(spark, d) -> tuple[DataFrame, DataFrame]:
    """Hits and queries of fusion: every id divisible by 50 asks all other vectors; all of part is dealt to the queries."""
    e, q = _split(spark, d)
    k = (F.col("query_id") / 50).cast("long")
    image = retrieval.search(e, q, 40, others=True).select("query_id", F.lit("image").alias("source"), (F.col("point_id") % 50).alias("product_id"), F.round("score", 6).alias("score"), F.col("hit_rank").cast("double").alias("hit_rank"))
    n = e.agg(F.max("point_id").alias("last"))
    part = spark.read.parquet(f"{d}/part.parquet").crossJoin(F.broadcast(n)).withColumn("query_id", F.col("p_partkey") % (F.floor(F.col("last") / 50) + 1) * 50)
    part = part.join(q.select("query_id"), "query_id", "left_semi").withColumn("product_id", F.col("p_partkey") % 50)
    # The key only parts equal sizes, however large it is.
    text = part.where("p_size > 10").select("query_id", F.lit("text").alias("source"), "product_id", F.round(F.col("p_size") / 50.0, 6).alias("score"), (1000 - F.col("p_size") * 10 + F.col("p_partkey") / 1e9).alias("hit_rank"))
    cat = part.where("p_size <= 25").select("query_id", F.lit("catalog").alias("source"), "product_id", F.lit(1.0).alias("score"), F.col("p_partkey").cast("double").alias("hit_rank"))
    own = k % 3 == 0
    queries = q.select("query_id", (k % 10 / 10.0).alias("confidence"), F.when(own, 0.4).alias("alpha"), F.when(own, 0.3).alias("beta"), F.when(k % 6 == 0, 0.25).alias("gamma"))
    return image.unionByName(text).unionByName(cat), queries


_FUSED = """
WITH q AS (SELECT vec_id AS query_id, vec_id // 50 AS k, embedding::DOUBLE[] AS v, vec_id // 50 % 10 / 10.0::DOUBLE AS confidence, CASE WHEN vec_id // 50 % 3 = 0 THEN 0.4::DOUBLE END AS alpha,
  CASE WHEN vec_id // 50 % 3 = 0 THEN 0.3::DOUBLE END AS beta, CASE WHEN vec_id // 50 % 6 = 0 THEN 0.25::DOUBLE END AS gamma FROM embeddings WHERE vec_id % 50 = 0),
im AS (SELECT query_id, vec_id AS point_id, list_cosine_similarity(embedding::DOUBLE[], q.v) AS score FROM embeddings, q WHERE vec_id <> query_id),
ir AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS hit_rank FROM im),
pa AS (SELECT *, p_partkey % ((SELECT max(vec_id) FROM embeddings) // 50 + 1) * 50 AS query_id FROM part WHERE p_partkey % ((SELECT max(vec_id) FROM embeddings) // 50 + 1) * 50 IN (SELECT query_id FROM q)),
hits AS (
  SELECT query_id, 'image' AS source, point_id % 50 AS product_id, round(score, 6) AS score, hit_rank::DOUBLE AS hit_rank FROM ir WHERE hit_rank <= 40
  UNION ALL SELECT query_id, 'text', p_partkey % 50, round(p_size / 50.0::DOUBLE, 6), 1000 - p_size * 10 + p_partkey / 1e9::DOUBLE FROM pa WHERE p_size > 10
  UNION ALL SELECT query_id, 'catalog', p_partkey % 50, 1.0, p_partkey::DOUBLE FROM pa WHERE p_size <= 25),
b AS (SELECT query_id, product_id, arg_max(score, hit_rank) FILTER (source = 'image') AS image, arg_max(score, hit_rank) FILTER (source = 'text') AS text,
  arg_max(score, hit_rank) FILTER (source = 'catalog') AS catalog, min(CASE source WHEN 'catalog' THEN 0 WHEN 'image' THEN 1e9 ELSE 2e9 END + hit_rank) AS came FROM hits GROUP BY 1, 2),
w AS (SELECT b.*, confidence, CASE WHEN alpha IS NOT NULL AND beta IS NOT NULL THEN alpha WHEN confidence < 0.5 THEN 0.7 ELSE 0.4 END AS wi,
  CASE WHEN alpha IS NOT NULL AND beta IS NOT NULL THEN beta ELSE 0.2 END AS wt,
  CASE WHEN alpha IS NOT NULL AND beta IS NOT NULL THEN coalesce(gamma, greatest(0.0, 1 - alpha - beta)) WHEN confidence < 0.5 THEN 0.3 ELSE 0.6 END AS wc FROM b JOIN q USING (query_id)),
s AS (SELECT query_id, product_id, confidence, came, coalesce(image, 0.0::DOUBLE) * wi AS wimage, coalesce(text, 0.0::DOUBLE) * wt AS wtext, coalesce(catalog, 0.0::DOUBLE) * wc AS wcatalog,
  (image IS NOT NULL)::INT + (text IS NOT NULL)::INT + (catalog IS NOT NULL AND product_id <> 0)::INT AS n,
  CASE WHEN image IS NOT NULL THEN 'image' WHEN text IS NOT NULL THEN 'text' WHEN catalog IS NOT NULL AND product_id <> 0 THEN 'metadata' ELSE 'unknown' END AS one FROM w),
t AS (SELECT query_id, product_id, confidence, came, wimage AS image, wtext AS text, wcatalog AS catalog, CASE WHEN n >= 2 THEN 'hybrid' ELSE one END AS match_type, wimage + wtext + wcatalog AS score FROM s),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, came) AS rank FROM t)"""


def _fused(spark, d) -> DataFrame:
    return fusion.merge(*_fusion_input(spark, d))


def fused(spark, d):
    return _shown(_fused(spark, d), "image", "text", "catalog", "score", digits=9)


def fused_types(spark, d):
    return _fused(spark, d).groupBy("match_type").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


def fused_diverse(spark, d):
    return _shown(fusion.diversify(_fused(spark, d), max_results=10), "score", digits=9)


def fused_rerank(spark, d):
    out = fusion.rerank(_fused(spark, d), {"hybrid": 1.2, "metadata": 1.0, "image": 0.9})
    return _shown(out.select("query_id", "rank", "product_id", "score"), "score", digits=9)


def fused_details(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("product_id"), "p_name", "p_brand").where("product_id % 3 <> 0")
    return fusion.with_details(_fused(spark, d).select("query_id", "rank", "product_id", "score"), parts)


def confidence_rules(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    conf = F.round(F.col("p_size") / 50.0, 4)
    w = fusion.confidence_weights(conf)
    top = F.round(F.col("p_partkey") % 100 / 100.0, 3)
    warning = F.when(F.col("p_partkey") % 7 == 0, "blurry")
    return part.select("p_partkey", w["alpha"].alias("alpha"), w["beta"].alias("beta"), w["gamma"].alias("gamma"), fusion.gate(conf, F.col("p_type")).alias("gated"), fusion.overall_confidence(conf, F.when(F.col("p_partkey") % 2 == 0, 0.5), F.lit(None).cast("double")).alias("overall"), fusion.message(warning, F.col("p_partkey") % 5, top).alias("message"))


QUERIES = {
    "vector_topk_exact": _topk("cosine"),
    "vector_topk_l2": _topk("l2"),
    "vector_topk_ip": _topk("inner_product"),
    "vector_topk_prefilter": lambda spark, d: _topk("cosine", F.col("label") % 2 == 0)(spark, d),
    "vector_topk_cells": _cells,
    "vector_search_lists": _lists,
    "vector_search_payload": _payload,
    "vector_search_empty": _empty,
    "vector_stats": lambda spark, d: retrieval.stats(_points(spark, d)),
    "vector_remove": remove,
    "vector_unit_norm": unit_norm,
    "eval_per_query": per_query,
    "eval_recall_map": recall_map,
    "eval_bootstrap_ci": bootstrap,
    "eval_paired_bootstrap": paired,
    "fusion_weighted": fused,
    "fusion_match_type": fused_types,
    "fusion_diversity": fused_diverse,
    "fusion_rerank": fused_rerank,
    "fusion_details": fused_details,
    "fusion_confidence_rules": confidence_rules,
}
_MERGED = "SELECT query_id, rank, product_id, round(score, 9) AS score, match_type, confidence, round(image, 9) AS image, round(text, 9) AS text, round(catalog, 9) AS catalog FROM m WHERE rank <= 20"
ORACLE = {
    "vector_topk_exact": _topk_sql("cos"),
    "vector_topk_l2": _topk_sql("1 / (1 + greatest(0.0, 2 - 2 * cos))"),
    "vector_topk_ip": _topk_sql("greatest(0.0, (cos + 1) / 2)"),
    "vector_topk_prefilter": _topk_sql("cos", "label % 2 = 0"),
    "vector_stats": "SELECT count(*) AS total_vectors, count(DISTINCT vec_id % 37) AS n_products, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ready' END AS status FROM embeddings",
    "vector_remove": "SELECT count(*) AS total_vectors, count(DISTINCT vec_id % 37) AS n_products, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ready' END AS status FROM embeddings WHERE vec_id % 37 >= 5",
    "vector_unit_norm": "SELECT count(*) AS faults FROM embeddings WHERE len(embedding) <> 64 OR abs(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) - 1) > 1e-3",
    "eval_per_query": f"{_PER_QUERY} SELECT * FROM pq",
    "eval_recall_map": f"{_PER_QUERY} SELECT round(avg(recall_1), 6) AS recall_1, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(ap), 6) AS map, count(*) AS n_queries FROM pq",
    "eval_bootstrap_ci": _bootstrap_sql("ap", 1000, 42),
    "eval_paired_bootstrap": _bootstrap_sql("(recall_5 - recall_1)::DOUBLE", 2000, 0),
    "fusion_weighted": f"{_FUSED} {_MERGED}",
    "fusion_match_type": f"{_FUSED} SELECT match_type, count(*) AS n, round(avg(score), 4) AS mean_score FROM m WHERE rank <= 20 GROUP BY 1",
    "fusion_rerank": f"{_FUSED}, x AS (SELECT query_id, rank AS r0, product_id, score * CASE match_type WHEN 'hybrid' THEN 1.2 WHEN 'metadata' THEN 1.0 WHEN 'image' THEN 0.9 ELSE 1.0 END::DOUBLE AS score FROM m WHERE rank <= 20) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0) AS rank, product_id, round(score, 9) AS score FROM x",
    "fusion_details": f"{_FUSED} SELECT query_id, rank, product_id, round(score, 3) AS score, p_name, p_brand FROM m LEFT JOIN part ON p_partkey = product_id AND p_partkey % 3 <> 0 WHERE rank <= 20",
    "fusion_diversity": f"""{_FUSED}, l AS (SELECT query_id, list(struct_pack(product_id := product_id, score := score) ORDER BY rank) AS x FROM m WHERE rank <= 20 GROUP BY 1),
rec AS (WITH RECURSIVE f(query_id, x, i, k, last, pid, score, took) AS (
  SELECT query_id, x, 1, 1, x[1].score, x[1].product_id, x[1].score, true FROM l
  UNION ALL SELECT query_id, x, i + 1, k + (last - x[i + 1].score > (1 - 0.8::DOUBLE) * last)::INT, CASE WHEN last - x[i + 1].score > (1 - 0.8::DOUBLE) * last THEN x[i + 1].score ELSE last END,
    x[i + 1].product_id, x[i + 1].score, last - x[i + 1].score > (1 - 0.8::DOUBLE) * last FROM f WHERE i < len(x) AND (i = 1 OR k < 10)) SELECT * FROM f)
SELECT query_id, k AS rank, pid AS product_id, round(score, 9) AS score FROM rec WHERE took""",
    "fusion_confidence_rules": """WITH p AS (SELECT *, round(p_size / 50.0::DOUBLE, 4) AS c, round(p_partkey % 100 / 100.0::DOUBLE, 3) AS top FROM part)
SELECT p_partkey, CASE WHEN c < 0.5 THEN 0.75 ELSE 0.4 END::DOUBLE AS alpha, CASE WHEN c < 0.5 THEN 0.0 ELSE 0.4 END::DOUBLE AS beta, CASE WHEN c < 0.5 THEN 0.25 ELSE 0.2 END::DOUBLE AS gamma,
CASE WHEN c >= 0.4 THEN p_type END AS gated, greatest(c, CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 0 END)::DOUBLE AS overall,
CASE WHEN p_partkey % 7 = 0 THEN 'Image quality warning: blurry' WHEN p_partkey % 5 = 0 THEN 'No matching products found. Try a clearer photo or different angle.'
WHEN top < 0.35 THEN 'No confident match found. Please verify the product or try another photo.' WHEN top < 0.6 THEN 'Low confidence match. Please verify the product or try another photo.' END AS message FROM p""",
    "vector_search_lists": f"""{_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, point_id) AS hit_rank FROM c WHERE label = 3 AND point_id % 7 = 0)
SELECT q.query_id, count(point_id)::INT AS n, coalesce(string_agg(point_id, ',' ORDER BY hit_rank), '') AS points FROM q LEFT JOIN r ON r.query_id = q.query_id AND hit_rank <= 3 GROUP BY 1""",
    "vector_search_payload": f"""{_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, point_id) AS hit_rank FROM c)
SELECT query_id, hit_rank, point_id, round(cos, 6) AS similarity, label, 'p' || point_id AS sku FROM r WHERE hit_rank <= 5""",
    "vector_search_empty": "SELECT vec_id AS query_id, 0 AS n FROM embeddings WHERE vec_id % 50 = 0",
}
