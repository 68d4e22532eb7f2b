"""Queries on tables: validation, cleaning, joins, copies, splits, reports, rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.vectors import sign_hash
from millrace.operators import catalogue, dedup, listings, quality, reports, splits
from millrace.streaming import rate_limit


def _t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _batch(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    e = lambda m, x: F.when(k % m == 0, "").otherwise(x)
    return _t(spark, d, "part").select(
        "p_partkey", e(13, F.concat(F.lit("W "), k.cast("string"))).alias("part_number_raw"), F.when(k % 4 == 0, "").when(k % 4 == 1, "Bosch GmbH").when(k % 4 == 2, "acme").otherwise("NGK").alias("brand"), F.concat(F.lit("c"), (k % 9).cast("string")).alias("category"), e(17, F.col("p_name")).alias("name"),
        F.lit("u").alias("source_url"), F.lit("s").alias("source_site"), e(19, F.lit("me")).alias("collected_by"), F.when(k % 3 == 0, "TRUE").when(k % 3 == 1, "no").otherwise(F.when(k % 7 == 0, "maybe").otherwise("")).alias("is_distractor"), F.lit("1").alias("verified"))


def _validated(spark, d):
    categories = spark.range(7).select(F.concat(F.lit("c"), "id").alias("label"))
    return quality.validate(_batch(spark, d), categories)


def errors(spark, d):
    return _validated(spark, d).select("p_partkey", F.array_join("errors", "; ").alias("errors"), F.size("errors").alias("n")).where("n > 0")


def valid(spark, d):
    return _validated(spark, d).where(F.size("errors") == 0).select("p_partkey", "part_number", F.col("brand_known").alias("brand"), "distractor", "checked")


_ROWS = """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'W ' || p_partkey END AS raw, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Bosch GmbH' WHEN 2 THEN 'acme' ELSE 'NGK' END AS brand, 'c' || (p_partkey % 9) AS category,
  CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 19 = 0 THEN '' ELSE 'me' END AS who, CASE WHEN p_partkey % 3 = 0 THEN 'TRUE' WHEN p_partkey % 3 = 1 THEN 'no' WHEN p_partkey % 7 = 0 THEN 'maybe' ELSE '' END AS dis FROM part),
v AS (SELECT *, list_filter([CASE WHEN raw = '' THEN 'missing required field ''part_number_raw''' END, CASE WHEN name = '' THEN 'missing required field ''name''' END, CASE WHEN who = '' THEN 'missing required field ''collected_by''' END,
  CASE WHEN category IN ('c7', 'c8') THEN 'category ''' || category || ''' not in taxonomy' END, CASE WHEN dis = 'maybe' THEN 'is_distractor=''maybe'' is not a valid boolean' END,
  CASE WHEN brand = 'acme' THEN 'brand ''acme'' not in known brand list' WHEN brand = '' AND dis <> 'TRUE' THEN 'brand is required for non-distractor (D3) rows' END], lambda e: e IS NOT NULL) AS errors FROM r)"""


def catalog_page(spark, d):
    products = _t(spark, d, "part").where("p_size >= 10").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.lit(None).cast("long").alias("category_id"))
    found = catalogue.search(products, name="A", skip=20, limit=50)
    return found.select(F.col("product_id").alias("p_partkey"), F.col("name").alias("p_name"), "score")


def orphans(spark, d):
    orders, lines = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    some = orders.where("o_orderkey % 10 <> 0")
    customers = _t(spark, d, "customer").where("c_custkey % 5 <> 0")
    a = quality.foreign_keys(lines, some, "l_orderkey", "o_orderkey").agg(F.count("*").alias("n")).select(F.lit("lineitem").alias("child"), "n")
    b = quality.foreign_keys(orders, customers, "o_custkey", "c_custkey").agg(F.count("*").alias("n")).select(F.lit("orders").alias("child"), "n")
    return a.unionByName(b)


def token_semi(spark, d):
    tokens = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("([a-z]{9,})"), F.lit(1)))
    marks = _t(spark, d, "benchmark").select(F.explode(tokens(F.col("text"))).alias("token")).distinct()
    docs = _t(spark, d, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("token"))
    return docs.join(marks, "token", "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared"))


def _hashed(spark, d):
    return _t(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("hash"))


def copies(spark, d):
    g = dedup.exact_groups(_hashed(spark, d), "hash", "source")
    return g.select("hash", "n", "sources")


def copy_counts(spark, d):
    g = _hashed(spark, d).groupBy("hash").agg(F.count("*").alias("n"))
    return g.agg(F.sum(F.col("n") - 1).alias("surplus"), F.count("*").alias("distinct_texts"), F.max("n").alias("largest"))


def overlap(spark, d):
    return copies(spark, d).where(F.contains("sources", F.lit(" + "))).groupBy("sources").agg(F.count("*").alias("groups")).orderBy(F.desc("groups"), "sources")


def primary(spark, d):
    return dedup.primary(_hashed(spark, d), "hash", ["doc_id"]).groupBy("is_primary").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def stock(spark, d):
    return dedup.shown_by_several(_hashed(spark, d), "hash", "source", "stock").select("doc_id", "stock")


def _signs(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", "label", sign_hash(F.col("embedding")).alias("h"))


def near_pairs(spark, d):
    return dedup.near_pairs(_signs(spark, d), "vec_id", "h", 18)


def components(spark, d):
    return dedup.groups(_signs(spark, d), "vec_id", dedup.near_pairs(_signs(spark, d), "vec_id", "h", 20))


def generic(spark, d):
    pairs = dedup.near_pairs(_signs(spark, d), "vec_id", "h", 20)
    return dedup.without_generic(pairs, _signs(spark, d).select(F.col("vec_id").alias("id"), (F.col("vec_id") % 10).alias("part")), 2).select("a", "b", "distance")


def leader_clusters(spark, d):
    return dedup.leaders(_signs(spark, d), "label", "vec_id", "h", 22)


_HASH = "WITH h AS (SELECT vec_id, label, list_reduce(list_prepend(0::UBIGINT, list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN 1::UBIGINT << (i - 1)::UBIGINT ELSE 0::UBIGINT END)), lambda a, b: a | b) AS h FROM embeddings)"
_PAIRS = "p AS (SELECT x.vec_id AS a, y.vec_id AS b, bit_count(xor(x.h, y.h)) AS distance FROM h x JOIN h y ON x.vec_id < y.vec_id AND bit_count(xor(x.h, y.h)) <= {t})"


def pack(spark, d):
    g = _t(spark, d, "part").groupBy(F.col("p_brand").alias("category"), F.col("p_size").alias("grp")).agg(F.count("*").alias("size"))
    return splits.pack_ratios(g, "category", "grp", "size")


def type_split(spark, d):
    return splits.split_types(_t(spark, d, "part").select("p_partkey", "p_type"), "p_type", "p_partkey").groupBy("p_type", "side").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


def group_split(spark, d):
    g = _t(spark, d, "part").select("p_size").distinct()
    return splits.split_groups(g, "p_size", 0.2, 5, 1)


def capped(spark, d):
    return splits.cap_side(_t(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", "p_partkey", F.col("p_size") > 35, 20).select("p_partkey", "p_brand")


def leakage(spark, d):
    k = F.col("p_partkey")
    rows = _t(spark, d, "part").select(k.alias("item"), F.when(k % 5 == 0, "query").when(k % 5 == 1, "gallery").otherwise("train").alias("side"), F.when(k % 2 == 0, k % 997).alias("photo"), "p_size", F.lit(False).alias("made"))
    return splits.leakage(rows, "item", "side", "photo", F.col("p_size") == 7, F.col("made"))


def brand_vote(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_suppkey") % 3 == 0, "unknown").otherwise(F.concat(F.lit("b"), (F.col("l_suppkey") % 5).cast("string"))).alias("brand"))
    return quality.vote(rows.withColumn("seen", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "l_partkey", "brand", "seen")


def gallery_seller(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("seller"))
    return listings.gallery_sellers(rows, 3).select(F.col("part_id").alias("l_partkey"), F.col("gallery_seller").alias("l_suppkey"), "n")


def limited(spark, d):
    return rate_limit.accepted(_t(spark, d, "events"), "user_id", "ts", "event_id", 2, 86400.0)


def slices(spark, d):
    j = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    return reports.slices(j, "source", ["quality", "toxic"]).withColumns({c: F.round(c, 6) for c in ("quality", "toxic")})


def alpha_curve(spark, d):
    return reports.mean_std(_t(spark, d, "lineitem"), "l_discount", "l_quantity").withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 5)})


def source_counts(spark, d):
    return reports.counts(_t(spark, d, "documents"), ["source", "lang"], {"undersized": F.col("n_chars") < 400}, {"n_chars": ("least", "most")})


def quantiles(spark, d):
    orders = _t(spark, d, "orders")
    ends = reports.interval(orders, "o_orderpriority", "o_totalprice").withColumns({c: F.round(c, 4) for c in ("low", "high")})
    return reports.together(ends, "o_orderpriority", reports.best_of(orders, "o_orderpriority", "o_orderkey", "o_totalprice", "o_orderkey", name="dearest"))


def remap(spark, d):
    part = _t(spark, d, "part").select((F.col("p_partkey") % 12).cast("int").alias("class_id"), "p_partkey")
    mapping = spark.range(12).select(F.col("id").cast("int").alias("class_id"), F.when(F.col("id") % 4 == 0, -1).otherwise(100 + F.col("id") % 3).cast("int").alias("new_id")).where("class_id < 11")
    return quality.remap_labels(part, mapping).groupBy("class_id").agg(F.count("*").alias("n"))


def token_groups(spark, d):
    """Parts that share a rare token, two to six of them, tied to the first."""
    t = _t(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit("/"), (F.col("p_partkey") % 13).cast("string")).alias("token"))
    return listings.shared_by_few(t, "token", "p_partkey").select(F.col("b").alias("a"), F.col("a").alias("b"))


QUERIES = {"catalog_errors": errors, "catalog_validate": valid, "catalog_search_paged": catalog_page, "fk_checks": orphans, "token_semi_join": token_semi, "exact_dup_groups": copies, "dup_counts": copy_counts, "cross_source_overlap": overlap, "primary_copy": primary, "stock_flag": stock, "near_dup_pairs": near_pairs, "components": components, "generic_suppression": generic, "leader_clusters": leader_clusters, "split_ratio_pack": pack, "split_type": type_split, "split_group_holdout": group_split, "cap_side": capped, "leakage_checks": leakage, "brand_vote_mode": brand_vote, "gallery_seller": gallery_seller, "rate_limit": limited, "source_slice_report": slices, "alpha_mean_std": alpha_curve, "source_counts": source_counts, "quantiles_argmax": quantiles, "class_remap": remap, "token_groups": token_groups}

_DOC = "WITH g AS (SELECT md5(text) AS hash, count(*) AS n, string_agg(DISTINCT source, ' + ' ORDER BY source) AS sources, count(DISTINCT source) AS k, min(doc_id) AS first FROM documents GROUP BY 1)"
ORACLE = {
    "catalog_errors": f"{_ROWS} SELECT p_partkey, array_to_string(errors, '; ') AS errors, len(errors)::INT AS n FROM v WHERE len(errors) > 0",
    "catalog_validate": f"{_ROWS} SELECT p_partkey, replace(raw, ' ', '') AS part_number, CASE brand WHEN 'Bosch GmbH' THEN 'Bosch' ELSE brand END AS brand, dis = 'TRUE' AS distractor, true AS checked FROM v WHERE len(errors) = 0",
    "catalog_search_paged": "SELECT p_partkey, p_name, 1.0::DOUBLE AS score FROM part WHERE p_size >= 10 AND contains(lower(p_name), 'a') ORDER BY p_partkey LIMIT 50 OFFSET 20",
    "fk_checks": "SELECT 'lineitem' AS child, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)",
    "token_semi_join": "WITH m AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS token FROM benchmark), t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS token FROM documents) SELECT doc_id, count(*) AS shared FROM t WHERE token IN (SELECT token FROM m) GROUP BY 1",
    "exact_dup_groups": f"{_DOC} SELECT hash, n, sources FROM g WHERE n > 1",
    "dup_counts": f"{_DOC} SELECT sum(n - 1)::BIGINT AS surplus, count(*) AS distinct_texts, max(n) AS largest FROM g",
    "cross_source_overlap": f"{_DOC} SELECT sources, count(*) AS groups FROM g WHERE k > 1 GROUP BY 1",
    "primary_copy": f"{_DOC} SELECT d.doc_id = g.first AS is_primary, count(*) AS n, sum(d.doc_id)::BIGINT AS ids FROM documents d JOIN g ON md5(d.text) = g.hash GROUP BY 1",
    "stock_flag": f"{_DOC} SELECT doc_id, g.k > 1 AS stock FROM documents d JOIN g ON md5(d.text) = g.hash",
    "leader_clusters": f"""{_HASH.replace('WITH ', 'WITH RECURSIVE ')}, o AS (SELECT label, vec_id, h, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM h),
f(label, vec_id, r, hs, ids, leader) AS (SELECT label, vec_id, r, [h], [vec_id], vec_id FROM o WHERE r = 1
UNION ALL SELECT label, vec_id, r, CASE WHEN near IS NULL THEN list_append(hs, h) ELSE hs END, CASE WHEN near IS NULL THEN list_append(ids, vec_id) ELSE ids END, coalesce(ids[near], vec_id) FROM (SELECT o.label, o.vec_id, o.r, o.h, f.hs, f.ids, list_filter(range(1, len(f.hs) + 1), lambda i: bit_count(xor(f.hs[i], o.h)) <= 22)[1] AS near FROM f JOIN o ON o.label = f.label AND o.r = f.r + 1))
SELECT label, vec_id, leader FROM f""",
    "near_dup_pairs": f"{_HASH}, {_PAIRS.format(t=18)} SELECT a, b, distance FROM p",
    "components": f"{_HASH}, {_PAIRS.format(t=20)}, r AS (WITH RECURSIVE c(id, low) AS (SELECT vec_id, vec_id FROM h UNION SELECT e.y, c.low FROM c JOIN (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p) e ON e.x = c.id AND c.low < e.y) SELECT * FROM c) SELECT id, min(low) AS \"group\" FROM r GROUP BY id",
    "generic_suppression": f"{_HASH}, {_PAIRS.format(t=20)}, q AS (SELECT * FROM p WHERE a % 10 <> b % 10), o AS (SELECT a AS id, b % 10 AS other FROM q UNION ALL SELECT b, a % 10 FROM q), x AS (SELECT id FROM o GROUP BY id HAVING count(DISTINCT other) > 2) SELECT a, b, distance FROM q WHERE a NOT IN (SELECT id FROM x) AND b NOT IN (SELECT id FROM x)",
    "split_ratio_pack": "WITH g AS (SELECT p_brand AS category, p_size AS grp, count(*) AS size FROM part GROUP BY 1, 2), w AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY category ORDER BY md5('0:' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, sum(size) OVER (PARTITION BY category) AS total FROM g) SELECT category, grp, size, CASE WHEN done < 0.7::DOUBLE * total THEN 'train' WHEN done < (0.7::DOUBLE + 0.15::DOUBLE) * total THEN 'val' ELSE 'test' END AS partition FROM w",
    "split_type": "WITH w AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY md5('0:' || p_partkey), p_partkey) AS r, count(*) OVER (PARTITION BY p_type) AS n FROM part), e AS (SELECT *, least(n, greatest(4, round_even(n * 0.2::DOUBLE, 0)::BIGINT)) AS ne FROM w) SELECT p_type, CASE WHEN r <= least(20, ne // 2) THEN 'query' WHEN r <= ne THEN 'gallery' ELSE 'train' END AS side, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM e GROUP BY 1, 2",
    "split_group_holdout": "WITH g AS (SELECT DISTINCT p_size FROM part), w AS (SELECT p_size, row_number() OVER (ORDER BY md5('1:' || p_size), p_size) AS r, (SELECT count(*) FROM g) AS n FROM g) SELECT p_size, CASE WHEN r <= 5 THEN 'far' WHEN r <= 5 + greatest(1, round_even((n - 5) * 0.2::DOUBLE, 0)::BIGINT) THEN 'valid' ELSE 'train' END AS side FROM w",
    "cap_side": "WITH w AS (SELECT p_partkey, p_brand, p_size > 35 AS s, sum((p_size > 35)::INT) OVER (PARTITION BY p_brand) AS kept, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand, p_size > 35 ORDER BY md5('0:' || p_partkey), p_partkey) AS r FROM part), x AS (SELECT *, least(n - kept, greatest(20 - least(kept, 6), 20 - kept)) AS k FROM w) SELECT p_partkey, p_brand FROM x WHERE CASE WHEN s THEN r <= greatest(0, 20 - k) ELSE r <= k END",
    "leakage_checks": "WITH r AS (SELECT p_partkey AS item, CASE p_partkey % 5 WHEN 0 THEN 'query' WHEN 1 THEN 'gallery' ELSE 'train' END AS side, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 997 END AS photo, p_size FROM part) SELECT 'items' AS \"check\", NOT EXISTS (SELECT item FROM r GROUP BY item HAVING count(DISTINCT side) > 1) AS ok UNION ALL SELECT 'groups', NOT EXISTS (SELECT photo FROM r WHERE photo IS NOT NULL GROUP BY photo HAVING bool_or(side = 'train') AND bool_or(side <> 'train')) UNION ALL SELECT 'heldout', NOT EXISTS (SELECT 1 FROM r WHERE side = 'train' AND p_size = 7) UNION ALL SELECT 'synthetic', true",
    "brand_vote_mode": "WITH n AS (SELECT l_partkey, CASE WHEN l_suppkey % 3 = 0 THEN 'unknown' ELSE 'b' || (l_suppkey % 5) END AS brand, count(*) AS votes, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1, 2) SELECT l_partkey, brand, votes FROM n QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY (brand = 'unknown')::INT, votes DESC, first) = 1",
    "gallery_seller": "WITH n AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, md5('3:' || l_suppkey), l_suppkey) = 1",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f(user_id, event_id, i, held, ok) AS (SELECT user_id, event_id, i, [t], true FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN len(list_filter(f.held, lambda x: x > e.t - 86400000000)) < 2 THEN list_append(list_filter(f.held, lambda x: x > e.t - 86400000000), e.t) ELSE list_filter(f.held, lambda x: x > e.t - 86400000000) END,
len(list_filter(f.held, lambda x: x > e.t - 86400000000)) < 2 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) SELECT user_id, event_id, ok AS accepted FROM f""",
    "source_slice_report": "SELECT source, count(*) AS n, round(avg(quality::DOUBLE), 6) AS quality, round(avg(toxic::DOUBLE), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source)",
    "alpha_mean_std": "SELECT l_discount, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 5) AS sd, count(*) AS n FROM lineitem GROUP BY 1",
    "source_counts": "SELECT source, lang, count(*) AS n, count(*) FILTER (n_chars < 400) AS undersized, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY 1, 2",
    "quantiles_argmax": "SELECT o_orderpriority, round(quantile_cont(o_totalprice::DOUBLE, 0.025), 4) AS low, round(quantile_cont(o_totalprice::DOUBLE, 0.975), 4) AS high, arg_max(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) AS dearest FROM orders GROUP BY 1",
    "class_remap": "SELECT (100 + (p_partkey % 12) % 3)::INT AS class_id, count(*) AS n FROM part WHERE p_partkey % 12 < 11 AND p_partkey % 12 % 4 <> 0 GROUP BY 1",
    "token_groups": "WITH t AS (SELECT p_partkey, p_brand || '/' || p_size || '/' || (p_partkey % 13) AS token FROM part), g AS (SELECT token, min(p_partkey) AS head FROM t GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6) SELECT head AS a, p_partkey AS b FROM t JOIN g USING (token) WHERE p_partkey <> head",
}
