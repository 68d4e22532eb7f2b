"""Queries on the outputs of detector and reader, the product catalogue, and the search service as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import dictionaries as D
from millrace.functions import imaging as I
from millrace.operators import catalogue, detections, retrieval, service
from millrace.plans.text_queries import _first_sql

#: What boxes and lines are made of, as the tables have none, and names of categories.
CLASSES = ["oil_filter", "brake_pad", "hood", "odd_thing", "radio", "truck"]
TEXTS = ["  Bosch 0986 ", "brake pad BP1234", "made in", "W712/80 oil filter", "   ", "mann W71280", "radiator cap 10w"]
CATEGORIES = ["Hood", "Filter", "Brake", "Automotive", "Interior", "spark_plug", "radiator", "Oil_Filter", "engine_oil", "brake_pad", "unknown", "muffler"]


def _pick(values: list[str], at):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (at % len(values) + 1).cast("int"))


def _queries(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 50 = 0")
    k = (F.col("vec_id") / 50).cast("long")
    return e.select(F.col("vec_id").alias("query_id"), k.alias("k"), F.col("embedding").alias("query"), F.when(k % 9 == 0, "blurry").alias("warning"))


def _boxes(spark, d) -> DataFrame:
    q = _queries(spark, d).select("query_id", "k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("det"))
    k, n = F.col("k"), F.col("det")
    bbox = F.array(10 * n, 5 * n, 10 * n + 20 + k % 50 * 5, 5 * n + 10 + k % 40 * 5).cast("array<int>")
    return q.select("query_id", "det", _pick(CLASSES, k + n).alias("class_name"), ((k * 7 + n * 31) % 100 / 100.0).alias("confidence"), bbox.alias("bbox"), F.lit(640).alias("img_w"), F.lit(480).alias("img_h"))


def _lines(spark, d) -> DataFrame:
    q = _queries(spark, d).select("query_id", "k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("line"))
    return q.select("query_id", "line", _pick(TEXTS, F.col("k") * 3 + F.col("line")).alias("text"), ((F.col("k") * 13 + F.col("line") * 29) % 100 / 100.0).alias("confidence"))


def _products(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 5 == 0, " Bosch").when(k % 5 == 1, " BP1234").when(k % 5 == 2, " mann W71280").otherwise(""))
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("product_id"), name.alias("name"), (F.col("p_size") % 12).cast("long").alias("category_id"), F.when(k % 4 != 0, F.concat(F.lit("http://x/"), k.cast("string"))).alias("image_url"))


def _categories(spark) -> DataFrame:
    return spark.range(len(CATEGORIES)).select(F.col("id").alias("category_id"), _pick(CATEGORIES, F.col("id")).alias("name"))


_listed = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
_ANY = " OR ".join(f"contains(lower({{0}}), '{b}')" for b in D.READER_BRANDS)
_CONF = " ".join(f"WHEN contains(lower(ocr_text), '{a.replace(chr(39), chr(39) * 2)}') THEN least(1.0::DOUBLE, {len(a)}::DOUBLE / greatest(length(ocr_text), 1))" for aliases in D.BRANDS.values() for a in aliases)
_LONGEST = "list_reduce({0}, lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END)"
_BASE = f"""
WITH q AS (SELECT vec_id AS query_id, vec_id // 50 AS k, embedding::DOUBLE[] AS v, CASE WHEN vec_id // 50 % 9 = 0 THEN 'blurry' END AS warning FROM embeddings WHERE vec_id % 50 = 0),
bx AS (SELECT query_id, k, det, list_extract({_listed(CLASSES)}, ((k + det) % 6 + 1)::INT) AS class_name, (k * 7 + det * 31) % 100 / 100.0::DOUBLE AS confidence, 20 + k % 50 * 5 AS bw, 10 + k % 40 * 5 AS bh FROM q, range(3) r(det)),
kb AS (SELECT *, {_first_sql('class_name', D.CLASS_KEYWORDS, " ELSE 'unknown'")} AS part_type, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, det) AS rank FROM bx WHERE confidence >= 0.5 AND bw * bh / 307200.0::DOUBLE * 100 >= 2),
ln AS (SELECT query_id, line, list_extract({_listed(TEXTS)}, ((k * 3 + line) % 7 + 1)::INT) AS raw, (k * 13 + line * 29) % 100 / 100.0::DOUBLE AS confidence FROM q, range(3) r(line)),
kl AS (SELECT query_id, line, trim(raw) AS text, confidence, {_ANY.format('raw')} AS is_brand, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, line) AS rank FROM ln WHERE confidence >= 0.5),
t AS (SELECT query_id, string_agg(text, ' ' ORDER BY rank) FILTER (text <> '') AS ocr_text, max(confidence) AS ocr_confidence, arg_min(text, rank) FILTER (is_brand) AS btext, arg_min(confidence, rank) FILTER (is_brand) AS bconf, count(*) AS n FROM kl GROUP BY 1),
rd AS (SELECT q.*, b.part_type AS box_type, b.confidence AS box_confidence, ocr_text, coalesce(ocr_confidence, 0) AS ocr_confidence, btext, bconf, n FROM q LEFT JOIN kb b ON b.query_id = q.query_id AND b.rank = 1 LEFT JOIN t ON t.query_id = q.query_id),
nu AS (SELECT *, regexp_extract_all(upper(coalesce(ocr_text, '')), '\\b[A-Z]{{2,4}}\\d{{2,5}}[A-Z]?\\b') AS n1, regexp_extract_all(upper(coalesce(ocr_text, '')), '\\b[A-Z]{{1,4}}\\d{{2,4}}[/-]\\d{{1,4}}\\b') AS n2, regexp_extract_all(upper(coalesce(ocr_text, '')), '\\b\\d{{4,6}}[A-Z]{{1,4}}\\b') AS n3 FROM rd),
re AS (SELECT *, coalesce(CASE WHEN box_type <> 'unknown' THEN box_type END, {_first_sql('ocr_text', D.PART_KEYWORDS)}, box_type) AS part_type,
  CASE WHEN ocr_text IS NOT NULL THEN CASE WHEN btext IS NOT NULL THEN btext ELSE {_first_sql('ocr_text', D.BRANDS)} END END AS brand_name,
  CASE WHEN ocr_text IS NOT NULL THEN CASE WHEN btext IS NOT NULL THEN bconf ELSE CASE {_CONF} ELSE 0 END END END::DOUBLE AS brand_confidence,
  regexp_replace(CASE WHEN len(n1) > 0 THEN {_LONGEST.format('n1')} WHEN len(n2) > 0 THEN {_LONGEST.format('n2')} WHEN len(n3) > 0 THEN {_LONGEST.format('n3')} END, '[\\s\\-/]+', '', 'g') AS part_number FROM nu),
rr AS (SELECT *, CASE WHEN box_confidence IS NOT NULL OR n IS NOT NULL THEN greatest(coalesce(box_confidence, 0), ocr_confidence, coalesce(brand_confidence, 0)) ELSE 0 END::DOUBLE AS confidence FROM re),
pr AS (SELECT p_partkey AS product_id, p_name || CASE p_partkey % 5 WHEN 0 THEN ' Bosch' WHEN 1 THEN ' BP1234' WHEN 2 THEN ' mann W71280' ELSE '' END AS name, (p_size % 12)::BIGINT AS category_id, CASE WHEN p_partkey % 4 <> 0 THEN 'http://x/' || p_partkey END AS image_url FROM part),
ca AS (SELECT i AS category_id, list_extract({_listed(CATEGORIES)}, (i + 1)::INT) AS name FROM range({len(CATEGORIES)}) r(i))"""


def _answers(spark, d):
    images = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("point_id"), (F.col("vec_id") % 50).alias("product_id"), "embedding")
    return service.search(_queries(spark, d), _boxes(spark, d), _lines(spark, d), images, _products(spark, d), _categories(spark), 10, _text_hits(spark, d), others=True)


def _text_hits(spark, d) -> DataFrame:
    """Hits of a search by text, made from what the queries' numbers and the ranks give."""
    q = _queries(spark, d).select("query_id", "k", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("hit_rank"))
    return q.select("query_id", ((F.col("k") * 3 + F.col("hit_rank") * 7) % 60).alias("product_id"), F.round(1 - F.col("hit_rank") / 40.0, 6).alias("score"), "hit_rank")


def answers(spark, d):
    return _answers(spark, d).select("query_id", "part_type", "brand_name", "part_number", "confidence", F.size("results").alias("n"), "message")


def results(spark, d):
    return _answers(spark, d).select("query_id", F.explode("results").alias("r")).select("query_id", "r.rank", "r.product_id", "r.score", "r.match_type")


_SERVICE = f"""{_BASE},
gt AS (SELECT *, CASE WHEN coalesce(box_confidence, 0) >= 0.4 THEN part_type END AS gated FROM rr),
ci AS (SELECT gt.*, nullif(c.category_id, 0) AS cid FROM gt LEFT JOIN (SELECT lower(name) AS name, max(category_id) AS category_id FROM ca GROUP BY 1) c ON c.name = lower(gated)),
ch AS (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY product_id) AS hit_rank FROM ci JOIN pr ON (cid IS NULL OR pr.category_id = cid) AND (brand_name IS NULL OR brand_name = '' OR contains(lower(pr.name), lower(brand_name))) AND (part_number IS NULL OR part_number = '' OR contains(lower(pr.name), lower(part_number)))),
im AS (SELECT query_id, vec_id AS point_id, list_cosine_similarity(embedding::DOUBLE[], q.v) AS score FROM embeddings, q WHERE vec_id <> query_id),
ir AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS hit_rank FROM im),
th AS (SELECT query_id, (k * 3 + j * 7) % 60 AS product_id, round(1 - j / 40.0::DOUBLE, 6) AS score, j AS hit_rank FROM ci, range(1, 31) r(j) WHERE ocr_text IS NOT NULL AND j <= 20),
hits AS (SELECT query_id, 'image' AS source, point_id % 50 AS product_id, score, hit_rank FROM ir WHERE hit_rank <= 20 UNION ALL SELECT query_id, 'text', product_id, score, hit_rank FROM th UNION ALL SELECT query_id, 'catalog', product_id, 1.0, hit_rank FROM ch WHERE hit_rank <= 20),
b AS (SELECT query_id, product_id, arg_max(score, hit_rank) FILTER (source = 'image') AS image, arg_max(score, hit_rank) FILTER (source = 'text') AS text, arg_max(score, hit_rank) FILTER (source = 'catalog') AS catalog, min(CASE source WHEN 'catalog' THEN 0 WHEN 'image' THEN 1e9 ELSE 2e9 END + hit_rank) AS came FROM hits GROUP BY 1, 2),
w AS (SELECT b.*, coalesce(image, 0::DOUBLE) * CASE WHEN ocr_confidence < 0.5 THEN 0.75 ELSE 0.4 END::DOUBLE + coalesce(text, 0::DOUBLE) * CASE WHEN ocr_confidence < 0.5 THEN 0 ELSE 0.4 END::DOUBLE + coalesce(catalog, 0::DOUBLE) * CASE WHEN ocr_confidence < 0.5 THEN 0.25 ELSE 0.2 END::DOUBLE AS score,
  (image IS NOT NULL)::INT + (text IS NOT NULL)::INT + (catalog IS NOT NULL AND product_id <> 0)::INT AS n FROM b JOIN ci USING (query_id)),
m AS (SELECT query_id, product_id, round(score, 3) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, came) AS rank, CASE WHEN n >= 2 THEN 'hybrid' WHEN image IS NOT NULL THEN 'image' WHEN text IS NOT NULL THEN 'text' WHEN catalog IS NOT NULL AND product_id <> 0 THEN 'metadata' ELSE 'unknown' END AS match_type FROM w)"""


def _asked(spark, d):
    return detections.read(_queries(spark, d), _boxes(spark, d), _lines(spark, d))


def read(spark, d):
    return _asked(spark, d).select("query_id", "ocr_text", "ocr_confidence", "part_type", "brand_name", "part_number", F.round("confidence", 6).alias("confidence"))


def regions(spark, d):
    box = detections.best(_boxes(spark, d)).select("query_id", "bbox")
    q = _queries(spark, d).select("query_id", F.explode(F.array(*[F.lit(r) for r in I.REGIONS])).alias("region")).join(box, "query_id", "left")
    r = I.query_region(F.col("region"), F.lit(640), F.lit(480), F.col("bbox"))
    return q.select("query_id", "region", *[F.round(r[c], 4).alias(c) for c in ("left", "top", "right", "bottom")], r["detected"].alias("detected"))


def _sides_sql() -> str:
    crops = "".join(f" WHEN '{name}' THEN greatest(bw + 2 * floor(bw * {p}::DOUBLE), bh + 2 * floor(bh * {p}::DOUBLE))" for name, p in I.CROP_PADDING.items())
    return f"CASE region{crops} END::DOUBLE"


def filters(spark, d):
    p = _products(spark, d)
    pages = [("category", catalogue.by_category(p, 3, 5, 10)), ("brand", catalogue.search(p, brand="BOSCH", skip=2, limit=7)), ("all", catalogue.search(p, 3, "bosch", "a", 0, 5)), ("first", catalogue.search(p))]
    out = None
    for name, df in pages:
        df = df.select(F.lit(name).alias("asked"), "product_id", "score")
        out = df if out is None else out.unionByName(df)
    return out


def lookups(spark, d):
    names = _asked(spark, d).select("query_id", "part_type")
    return catalogue.category_ids(names, _categories(spark)).select("query_id", "part_type", "category_id")


def multi_get(spark, d):
    ids = _queries(spark, d).select((F.col("query_id") * 3).alias("product_id"))
    return catalogue.with_images(catalogue.get_products(_products(spark, d), ids)).select("product_id", "name")


def faults(spark, d):
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{d}/part.parquet").select((k % 1500).alias("image_id"), F.when(k % 5 == 0, "index").when(k % 7 == 0, "other").otherwise("query").alias("role"), _pick(["A", "B", "C", "D"], k).alias("shot_type"), F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise("valid").alias("split"), F.when(k % 13 != 0, "x").alias("phash"))
    rows = rows.withColumn("shot_type", F.when(F.col("image_id") % 3 != 0, F.col("shot_type")))
    return catalogue.schema_faults(rows, ["phash"], ["image_id"])


def requests(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    path = _pick(["/health", "/api/v1/search-by-image", "/docs", "/api/v1/brands"], F.col("event_id"))
    key = F.when(F.col("user_id") % 3 == 0, "secret").when(F.col("user_id") % 3 == 1, "wrong")
    return e.groupBy(path.alias("path"), catalogue.request_status(path, key, "secret").alias("status")).agg(F.count("*").alias("n"))


def indexes(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("vec_id") % 300).alias("product_id"), "embedding")
    images, texts = retrieval.dual_index(_products(spark, d), e.where("product_id % 2 = 0"), e)
    left_i, left_t, status = retrieval.delete_product(images, texts, 2)
    rows = [("image", images), ("text", texts), ("image after delete", left_i), ("text after delete", left_t)]
    out = None
    for name, df in rows:
        df = retrieval.stats(df).select(F.lit(name).alias("part"), "total_vectors", "n_products", F.lit(status).alias("delete_status"))
        out = df if out is None else out.unionByName(df)
    return out


def models(spark, d):
    names = [*retrieval.MODEL_DIMENSIONS, "another/model"]
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.groupBy(retrieval.model_dimension(_pick(names, F.col("vec_id"))).alias("dimension")).agg(F.count("*").alias("n"))


def flags(spark, d):
    k = F.col("p_partkey")
    f = I.analysis_flags((k * 7 % 256).cast("double"), (k * 3 % 120).cast("double"), (k % 20).cast("double"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", *[f[c].alias(c) for c in ("is_dark", "is_bright", "is_low_contrast", "is_high_contrast", "is_noisy")])


QUERIES = {
    "service_answers": answers,
    "service_results": results,
    "detection_best": lambda spark, d: detections.best(_boxes(spark, d)).select("query_id", "det", "class_name", "part_type", "confidence"),
    "detection_top_k": lambda spark, d: detections.top(_boxes(spark, d), 2).select("query_id", "rank", "det", "part_type"),
    "detection_rate": lambda spark, d: detections.detection_rate(_queries(spark, d), _boxes(spark, d)).withColumn("rate", F.round("rate", 6)),
    "ocr_lines": lambda spark, d: detections.lines(_lines(spark, d)).select("query_id", "line", "text", "confidence", "is_brand", "rank"),
    "ocr_best_line": lambda spark, d: detections.best_line(_lines(spark, d)),
    "read_queries": read,
    "query_regions": regions,
    "catalog_filters": filters,
    "category_lookup": lookups,
    "product_multi_get": multi_get,
    "schema_faults": faults,
    "request_status": requests,
    "index_maintenance": indexes,
    "model_dimensions": models,
    "analysis_flags": flags,
}

_LINE_BRAND = " ".join(f"WHEN contains(lower(raw), '{b}') THEN upper('{b}')" for b in D.READER_BRANDS)
ORACLE = {
    "service_answers": f"""{_SERVICE}, s AS (SELECT query_id, count(*)::INT AS n, arg_min(score, rank) AS top FROM m WHERE rank <= 10 GROUP BY 1)
SELECT query_id, gated AS part_type, brand_name, part_number, round(confidence, 3) AS confidence, coalesce(s.n, 0) AS n, CASE WHEN warning IS NOT NULL THEN 'Image quality warning: ' || warning WHEN s.n IS NULL THEN 'No matching products found. Try a clearer photo or different angle.'
WHEN top < 0.35 THEN 'No confident match found. Please verify the product or try another photo.' WHEN top < 0.6 THEN 'Low confidence match. Please verify the product or try another photo.' END AS message FROM ci LEFT JOIN s USING (query_id)""",
    "service_results": f"{_SERVICE} SELECT query_id, rank, product_id, score, match_type FROM m WHERE rank <= 10",
    "detection_best": f"{_BASE} SELECT query_id, det, class_name, part_type, confidence FROM kb WHERE rank = 1",
    "detection_top_k": f"{_BASE} SELECT query_id, rank, det, part_type FROM kb WHERE rank <= 2",
    "detection_rate": f"{_BASE} SELECT count(*) AS n_queries, count(b.query_id) AS detected, round(avg((b.query_id IS NOT NULL)::INT), 6) AS rate FROM q LEFT JOIN kb b ON b.query_id = q.query_id AND b.rank = 1",
    "ocr_lines": f"{_BASE} SELECT query_id, line, text, confidence, is_brand, rank FROM kl",
    "ocr_best_line": f"{_BASE}, x AS (SELECT *, CASE {_LINE_BRAND} END AS brand FROM ln WHERE confidence >= 0.5) SELECT query_id, coalesce(brand, trim(raw)) AS text, confidence, brand IS NOT NULL AS is_brand FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY brand IS NULL, CASE WHEN brand IS NULL THEN -confidence END, line) = 1",
    "read_queries": f"{_BASE} SELECT query_id, ocr_text, ocr_confidence, part_type, brand_name, part_number, round(confidence, 6) AS confidence FROM rr",
    "query_regions": f"""{_BASE}, b1 AS (SELECT * FROM kb WHERE rank = 1), x AS (SELECT q.query_id, region, det, bw, bh, {_sides_sql()} AS side, (20 * det + bw) / 2.0::DOUBLE AS cx, (10 * det + bh) / 2.0::DOUBLE AS cy FROM q CROSS JOIN (SELECT unnest({_listed(I.REGIONS)}) AS region) LEFT JOIN b1 ON b1.query_id = q.query_id)
SELECT query_id, region, round(CASE WHEN region = 'centre_70' THEN (640 - 640 * 0.7::DOUBLE) / 2 WHEN side IS NULL THEN 0 ELSE greatest(0, cx - side / 2) END, 4) AS "left", round(CASE WHEN region = 'centre_70' THEN (480 - 480 * 0.7::DOUBLE) / 2 WHEN side IS NULL THEN 0 ELSE greatest(0, cy - side / 2) END, 4) AS top,
round(CASE WHEN region = 'centre_70' THEN 640 - (640 - 640 * 0.7::DOUBLE) / 2 WHEN side IS NULL THEN 640 ELSE least(640, cx + side / 2) END, 4) AS "right", round(CASE WHEN region = 'centre_70' THEN 480 - (480 - 480 * 0.7::DOUBLE) / 2 WHEN side IS NULL THEN 480 ELSE least(480, cy + side / 2) END, 4) AS bottom, side IS NOT NULL AS detected FROM x""",
    "catalog_filters": f"""{_BASE}, f AS (SELECT 'category' AS asked, product_id, row_number() OVER (ORDER BY product_id) AS r FROM pr WHERE category_id = 3 UNION ALL SELECT 'brand', product_id, row_number() OVER (ORDER BY product_id) FROM pr WHERE contains(lower(name), 'bosch')
UNION ALL SELECT 'all', product_id, row_number() OVER (ORDER BY product_id) FROM pr WHERE category_id = 3 AND contains(lower(name), 'bosch') AND contains(lower(name), 'a') UNION ALL SELECT 'first', product_id, row_number() OVER (ORDER BY product_id) FROM pr)
SELECT asked, product_id, 1.0::DOUBLE AS score FROM f WHERE CASE asked WHEN 'category' THEN r BETWEEN 6 AND 15 WHEN 'brand' THEN r BETWEEN 3 AND 9 WHEN 'all' THEN r <= 5 ELSE r <= 20 END""",
    "category_lookup": f"{_BASE} SELECT query_id, part_type, nullif(c.category_id, 0) AS category_id FROM rr LEFT JOIN (SELECT lower(name) AS name, max(category_id) AS category_id FROM ca GROUP BY 1) c ON c.name = lower(part_type)",
    "product_multi_get": f"{_BASE} SELECT product_id, name FROM pr WHERE product_id IN (SELECT query_id * 3 FROM q) AND image_url IS NOT NULL",
    "schema_faults": """WITH r AS (SELECT p_partkey % 1500 AS image_id, CASE WHEN p_partkey % 5 = 0 THEN 'index' WHEN p_partkey % 7 = 0 THEN 'other' ELSE 'query' END AS role, CASE WHEN p_partkey % 1500 % 3 <> 0 THEN list_extract(['A', 'B', 'C', 'D'], (p_partkey % 4 + 1)::INT) END AS shot, CASE WHEN p_partkey % 11 <> 0 THEN 'valid' END AS split, p_partkey % 13 <> 0 AS hashed FROM part)
SELECT 'role not allowed' AS fault, count(*) FILTER (role = 'other') AS n FROM r UNION ALL SELECT 'shot_type not allowed', count(*) FILTER (shot = 'D') FROM r UNION ALL SELECT 'split not allowed', count(*) FILTER (split IS NULL) FROM r UNION ALL SELECT 'phash missing', count(*) FILTER (NOT hashed) FROM r
UNION ALL SELECT 'image_id repeated', count(*) - count(DISTINCT image_id) FROM r""",
    "request_status": "WITH e AS (SELECT list_extract(['/health', '/api/v1/search-by-image', '/docs', '/api/v1/brands'], (event_id % 4 + 1)::INT) AS path, user_id FROM events) SELECT path, CASE WHEN path NOT IN ('/health', '/docs') AND user_id % 3 <> 0 THEN 401 ELSE 200 END AS status, count(*) AS n FROM e GROUP BY 1, 2",
    "index_maintenance": f"""{_BASE}, e AS (SELECT vec_id % 300 AS product_id FROM embeddings), sh AS (SELECT product_id FROM pr WHERE image_url IS NOT NULL), i AS (SELECT * FROM e WHERE product_id % 2 = 0 AND product_id IN (SELECT product_id FROM sh)), x AS (SELECT * FROM e WHERE product_id IN (SELECT product_id FROM i))
SELECT 'image' AS part, count(*) AS total_vectors, count(DISTINCT product_id) AS n_products, 200 AS delete_status FROM i UNION ALL SELECT 'text', count(*), count(DISTINCT product_id), 200 FROM x UNION ALL SELECT 'image after delete', count(*), count(DISTINCT product_id), 200 FROM i WHERE product_id <> 2 UNION ALL SELECT 'text after delete', count(*), count(DISTINCT product_id), 200 FROM x WHERE product_id <> 2""",
    "model_dimensions": "SELECT CASE WHEN vec_id % 5 < 2 THEN 512 ELSE 768 END AS dimension, count(*) AS n FROM embeddings GROUP BY 1",
    "analysis_flags": "SELECT p_partkey, p_partkey * 7 % 256 < 60 AS is_dark, p_partkey * 7 % 256 > 200 AS is_bright, p_partkey * 3 % 120 < 30 AS is_low_contrast, p_partkey * 3 % 120 > 80 AS is_high_contrast, p_partkey % 20 > 10 AS is_noisy FROM part",
}
