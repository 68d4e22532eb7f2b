"""Queries that build, clean and group listings. The tables have none, so they are made from part, a row an item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import dictionaries as D
from millrace.functions import text as X
from millrace.operators import dedup, listings
from millrace.plans.service_queries import _listed, _pick
from millrace.storage import written

LEAVES = [*D.LEAF_LABELS, "Other"]
DIST = 6


def _number(g):
    """Of a group's number: mostly K and a number, some long, some no numbers at all."""
    code = F.concat(F.lit("K"), (1000 + g).cast("string"), F.when(g % 3 == 0, "XY77").otherwise(""))
    return F.when(g == 7, "UPDATE77").when(g == 9, "ABC").when(g == 11, "").otherwise(code)


def _items(spark, d) -> DataFrame:
    i = F.col("p_partkey")
    g = i % 150
    v = (i + F.floor(i / 150)) % 6
    extra = F.when(v == 0, F.concat(F.lit("no "), _number(g))).when(v == 1, "Front + Rear").when(v == 2, "for K1004").when(v == 3, "brake kit").otherwise("")
    return spark.read.parquet(f"{d}/part.parquet").select(
        i.alias("item_id"), i.alias("seq"), _number(g).alias("mpn"), F.when(i % 11 == 0, "").when(g % 2 == 0, "acme").when(i % 13 == 0, "other").otherwise("zeta").alias("brand"), F.concat(F.lit("s"), (F.floor(i / 150) % 4).cast("string")).alias("seller"),
        F.concat("p_name", F.lit(" "), extra).alias("title"), F.col("p_type").alias("query"), F.concat(F.lit("Parts|Car|"), _pick(LEAVES, g)).alias("category"), F.concat(_number(g), F.lit(", OEM"), (1000 + i % 90).cast("string"), F.lit("; X1")).alias("mpn_raw"),
        F.concat(F.lit("http://x/"), i.cast("string"), F.lit("?v=1")).alias("url"))


def _images(spark, d) -> DataFrame:
    i, j = F.col("item_id"), F.col("j")
    rows = _items(spark, d).select("item_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("j"))
    seed = F.when((i % 5 == 0) & (j == 0), F.concat(F.lit("c"), (i % 150).cast("string"))).when((i % 7 == 0) & (j == 1), F.concat(F.lit("u"), (i - 600).cast("string"), F.lit("_1"))).otherwise(F.concat(F.lit("u"), i.cast("string"), F.lit("_"), j.cast("string")))
    h = F.conv(F.substring(F.md5(seed), 1, 15), 16, 10).cast("long").bitwiseXOR(i % 3)
    return rows.where("j = 0 or item_id % 4 != 1").select("item_id", F.concat(F.lit("img/"), i.cast("string"), F.lit("_"), j.cast("string"), F.lit(".jpg")).alias("image"), h.alias("phash"), (150 + i % 300).alias("side"), (i * 2 + j).alias("n"))


def _checked(spark, d) -> DataFrame:
    i = F.col("p_partkey")
    return spark.read.parquet(f"{d}/part.parquet").where("p_partkey < 150 and p_partkey % 10 = 3").select(F.lower(_number(i)).alias("mpn"), _pick(["n", "m", "?", "y"], F.floor(i / 10)).alias("mark"))


def _built(spark, d, near=None):
    return listings.build(_items(spark, d), _images(spark, d), min_sellers=2, dup_dist=DIST, least_side=200, long_number=8, seed=42, near=near)


def _cleaned(spark, d):
    return listings.clean(*_built(spark, d), _checked(spark, d))


_NUM = "CASE {0} WHEN 7 THEN 'UPDATE77' WHEN 9 THEN 'ABC' WHEN 11 THEN '' ELSE 'K' || (1000 + {0}) || CASE WHEN {0} % 3 = 0 THEN 'XY77' ELSE '' END END"
_NORM = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_LABEL = "CASE {0} " + " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v}'" for k, v in D.LEAF_LABELS.items()) + " END"
_INPUT = f"""
WITH RECURSIVE it AS (SELECT p_partkey AS i, {_NUM.format('(p_partkey % 150)')} AS mpn, CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 150 % 2 = 0 THEN 'acme' WHEN p_partkey % 13 = 0 THEN 'other' ELSE 'zeta' END AS brand0, 's' || (p_partkey // 150 % 4) AS seller,
  p_name || ' ' || CASE (p_partkey + p_partkey // 150) % 6 WHEN 0 THEN 'no ' || {_NUM.format('(p_partkey % 150)')} WHEN 1 THEN 'Front + Rear' WHEN 2 THEN 'for K1004' WHEN 3 THEN 'brake kit' ELSE '' END AS title, p_type AS query, 'Parts|Car|' || list_extract({_listed(LEAVES)}, (p_partkey % 150 % {len(LEAVES)} + 1)::INT) AS category FROM part),
im AS (SELECT i, j, 'img/' || i || '_' || j || '.jpg' AS image, xor(('0x' || substr(md5(CASE WHEN i % 5 = 0 AND j = 0 THEN 'c' || (i % 150) WHEN i % 7 = 0 AND j = 1 THEN 'u' || (i - 600) || '_1' ELSE 'u' || i || '_' || j END), 1, 15))::BIGINT, i % 3) AS phash, 150 + i % 300 AS side FROM it, range(2) r(j) WHERE j = 0 OR i % 4 <> 1)"""
_BUILD = f"""{_INPUT},
v0 AS (SELECT *, coalesce(nullif(brand0, ''), 'unknown') AS brand1 FROM it WHERE mpn <> ''),
vt AS (SELECT mpn, brand1 AS voted FROM (SELECT mpn, brand1, count(*) AS n, min(i) AS first FROM v0 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY mpn ORDER BY (brand1 = 'unknown')::INT, n DESC, first) = 1),
ky AS (SELECT v0.*, CASE WHEN length(mpn) >= 8 THEN voted ELSE brand1 END AS brand FROM v0 JOIN vt USING (mpn)),
rw AS (SELECT brand || '::' || mpn AS part_id, ky.*, image, j, phash FROM ky JOIN im ON im.i = ky.i AND side >= 200),
hs AS (SELECT DISTINCT phash FROM rw),
hp AS (SELECT a.phash AS a, b.phash AS b FROM hs a JOIN hs b ON a.phash < b.phash AND bit_count(xor(a.phash, b.phash)) <= {DIST}),
hc(id, low) AS (SELECT phash, phash FROM hs UNION SELECT e.y, hc.low FROM hc JOIN (SELECT a AS x, b AS y FROM hp UNION ALL SELECT b, a FROM hp) e ON e.x = hc.id AND hc.low < e.y),
cl AS (SELECT id AS phash, min(low) AS cluster FROM hc GROUP BY id),
sk AS (SELECT cluster FROM rw JOIN cl USING (phash) GROUP BY 1 HAVING count(DISTINCT seller) > 1),
r2 AS (SELECT rw.*, cluster IN (SELECT cluster FROM sk) AS stock FROM rw JOIN cl USING (phash)),
pn AS (SELECT part_id, count(DISTINCT seller) AS n_sellers FROM r2 GROUP BY 1),
gs AS (SELECT part_id, seller AS gseller FROM (SELECT part_id, seller, count(*) AS n FROM r2 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY n DESC, md5('42:' || seller)) = 1),
r3 AS (SELECT r2.*, n_sellers, gseller FROM r2 JOIN pn USING (part_id) JOIN gs USING (part_id) WHERE n_sellers >= 2),
ga AS (SELECT * FROM r3 WHERE seller = gseller),
ot AS (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY i, image) AS place FROM r3 o WHERE seller <> gseller AND NOT stock AND NOT EXISTS (SELECT 1 FROM ga g WHERE g.part_id = o.part_id AND bit_count(xor(g.phash, o.phash)) <= {DIST})),
gr(part_id, place, leads, took) AS (SELECT part_id, place, [phash], true FROM ot WHERE place = 1
  UNION ALL SELECT o.part_id, o.place, CASE WHEN len(list_filter(leads, lambda x: bit_count(xor(x, o.phash)) <= {DIST})) = 0 THEN list_append(leads, o.phash) ELSE leads END, len(list_filter(leads, lambda x: bit_count(xor(x, o.phash)) <= {DIST})) = 0 FROM gr JOIN ot o ON o.part_id = gr.part_id AND o.place = gr.place + 1),
qu AS (SELECT ot.* FROM ot JOIN gr USING (part_id, place) WHERE took),
qn AS (SELECT part_id, count(*) AS n_query FROM qu GROUP BY 1),
g2 AS (SELECT ga.* FROM ga JOIN qn USING (part_id)),
ct AS (SELECT part_id, arg_min(struct_pack(brand := brand, mpn := mpn, title := title, query := query, category := category, n_sellers := n_sellers), struct_pack(i := i, image := image)) AS x, count(*) AS n_gallery FROM g2 GROUP BY 1),
ca AS (SELECT part_id, x.brand AS brand, x.mpn AS mpn, x.title AS title, x.query AS query_term, x.category AS category, x.n_sellers AS n_sellers, n_gallery, n_query FROM ct JOIN qn USING (part_id))"""
_TOKENS = "list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9-]{{2,}}[A-Za-z0-9]'), lambda t: regexp_replace(lower(t), '[^a-z0-9]', '', 'g')), lambda t: t <> own AND regexp_matches(t, '[0-9]'))"
_JOINT = r"regexp_matches(title, '(?i)front\s*[+&/]\s*rear|rear\s*[+&/]\s*front')"
_SEVERAL = r"regexp_matches(title, '(?i)front\s*[+&/]\s*rear|rear\s*[+&/]\s*front|\bkit\b|\blot\b|\bbulk\b|\bassorted\b')"
_CLEAN = f"""{_BUILD},
c0 AS (SELECT *, {_NORM.format('mpn')} AS own, list_extract(string_split(category, '|'), -1) AS leaf FROM ca),
al AS (SELECT list(DISTINCT own) AS numbers FROM c0 WHERE length(own) >= 4),
mk AS (SELECT {_NORM.format(_NUM.format('p_partkey'))} AS own, list_extract(['n', 'm', '?', 'y'], (p_partkey // 10 % 4 + 1)::INT) AS mark FROM part WHERE p_partkey < 150 AND p_partkey % 10 = 3),
c1 AS (SELECT c0.*, {_LABEL.format('leaf')} AS label, CASE WHEN mark IN ('n', 'm', '?') THEN mark END AS mark, CASE WHEN NOT contains({_NORM.format('title')}, c0.own) THEN list_filter({_TOKENS.format('title').replace('own', 'c0.own')}, lambda t: list_contains(numbers, t))[1] END AS other FROM c0 CROSS JOIN al LEFT JOIN mk ON mk.own = c0.own),
c2 AS (SELECT *, CASE WHEN brand = 'unknown' THEN 'unknown_brand' WHEN mark IS NOT NULL THEN 'hand_check_' || mark WHEN NOT regexp_matches(own, '[0-9]') OR starts_with(own, 'update') OR length(own) < 4 THEN 'junk_mpn' WHEN other IS NOT NULL THEN 'gallery_title_names_' || other WHEN label IS NULL THEN 'unmapped_category:' || leaf END AS reason FROM c1),
q1 AS (SELECT qu.part_id, qu.image, qu.title, qu.i, qu.phash, c2.own, c2.label, substr(sha1(qu.seller), 1, 10) AS seller_hash, contains({_NORM.format('qu.title')}, c2.own) AS names_own FROM qu JOIN c2 USING (part_id) WHERE reason IS NULL),
q2 AS (SELECT *, CASE WHEN NOT names_own AND CASE WHEN label = 'lighting' THEN {_JOINT} ELSE {_SEVERAL} END THEN 'multi_item_title' WHEN NOT names_own AND len(list_filter({_TOKENS.format('title')}, lambda t: list_contains(numbers, t))) > 0 THEN 'query_title_names_other_part' END AS reason FROM q1 CROSS JOIN al),
gq AS (SELECT part_id, image, substr(sha1(seller), 1, 10) AS seller_hash, stock::INT AS stock, label FROM g2 JOIN c2 USING (part_id) WHERE reason IS NULL),
kp AS (SELECT part_id, n_query, n_gallery, n_stock FROM (SELECT part_id, count(*) AS n_query FROM q2 WHERE reason IS NULL GROUP BY 1) JOIN (SELECT part_id, count(*) AS n_gallery, count(*) FILTER (stock = 1) AS n_stock FROM gq GROUP BY 1) USING (part_id)),
se AS (SELECT part_id, count(DISTINCT seller_hash) AS n_sellers FROM (SELECT part_id, seller_hash FROM q2 WHERE reason IS NULL UNION ALL SELECT part_id, seller_hash FROM gq) GROUP BY 1),
pa AS (SELECT part_id, regexp_replace(replace(part_id, '::', '__'), '[^A-Za-z0-9._-]+', '_', 'g') AS part_dir, brand, mpn, title, label AS category, category AS listing_category, se.n_sellers, kp.n_gallery, kp.n_query, n_stock AS n_gallery_stock, (length(own) <= 4)::INT AS short_mpn FROM c2 JOIN kp USING (part_id) JOIN se USING (part_id) WHERE reason IS NULL),
dr AS (SELECT part_id, '' AS image, reason FROM c2 WHERE reason IS NOT NULL UNION ALL SELECT part_id, image, reason FROM q2 WHERE reason IS NOT NULL UNION ALL SELECT part_id, '', 'no_gallery_or_no_query_left' FROM c2 WHERE reason IS NULL AND part_id NOT IN (SELECT part_id FROM kp))"""


def unknown_parts(spark, d):
    return listings.near_unknowns(_items(spark, d), _images(spark, d), _known(spark, d), per_category=5)


def _known(spark, d) -> DataFrame:
    """What the catalogue has: the numbers of the first sixty groups, some of whose titles hold another number."""
    i = F.col("p_partkey")
    return spark.read.parquet(f"{d}/part.parquet").where("p_partkey < 60").select(_number(i).alias("mpn"), F.concat("p_name", F.when(i % 7 == 0, F.concat(F.lit(" K"), (1061 + i).cast("string"), F.lit("XY77"))).otherwise("")).alias("title"))


_UNKNOWN = f"""{_INPUT},
it2 AS (SELECT *, {_NORM.format('mpn')} AS number, {_LABEL.format("list_extract(string_split(category, '|'), -1)")} AS label FROM it),
ft AS (SELECT * FROM it2 WHERE number NOT IN ({', '.join(f"'{x}'" for x in listings.NO_NUMBER)}) AND length(number) >= 5 AND brand0 <> '' AND label IN ({', '.join(f"'{x}'" for x in listings.NEAR_LABELS)})),
kn AS (SELECT {_NORM.format(_NUM.format('p_partkey'))} AS own, p_name || CASE WHEN p_partkey % 7 = 0 THEN ' K' || (1061 + p_partkey) || 'XY77' ELSE '' END AS title FROM part WHERE p_partkey < 60),
tk AS (SELECT own AS token FROM kn UNION SELECT unnest(list_filter(list_transform(regexp_extract_all(title, '[A-Za-z0-9][A-Za-z0-9-]*[A-Za-z0-9]'), lambda t: regexp_replace(lower(t), '[^a-z0-9]', '', 'g')), lambda t: length(t) >= 7 AND regexp_matches(t, '[0-9]'))) FROM kn),
sm AS (SELECT DISTINCT number FROM (SELECT number, unnest(list_append(list_filter(list_transform(regexp_extract_all(title, '[A-Za-z0-9][A-Za-z0-9-]*[A-Za-z0-9]'), lambda t: regexp_replace(lower(t), '[^a-z0-9]', '', 'g')), lambda t: length(t) >= 7 AND regexp_matches(t, '[0-9]')), number)) AS token FROM ft) WHERE token IN (SELECT token FROM tk)),
sh AS (SELECT i, image, row_number() OVER (PARTITION BY i ORDER BY image) AS place FROM im),
cn AS (SELECT ft.*, (SELECT count(*) FROM sh WHERE sh.i = ft.i AND place <= 3) AS n_images FROM ft),
nb AS (SELECT number, arg_min(struct_pack(i := i, brand := brand0, title := title, label := label, n := n_images), struct_pack(n := -n_images, i := i)) AS b, count(*) AS n_listings FROM cn GROUP BY 1),
wy AS (SELECT *, CASE WHEN number IN (SELECT own FROM kn) THEN 'in_catalogue' WHEN number IN (SELECT number FROM sm) THEN 'same_product_as_catalogue' WHEN b.n = 0 THEN 'no_images' END AS why FROM nb),
ch AS (SELECT *, b.label AS label FROM wy WHERE why IS NULL QUALIFY row_number() OVER (PARTITION BY b.label ORDER BY md5('42:' || number), number) <= 5)"""


def groups(spark, d):
    near = written(dedup.near_hashes(_images(spark, d).select("phash").distinct(), "phash", DIST), "group-pairs")
    catalog, _, queries = _built(spark, d, near)
    catalog = written(catalog.select("part_id", "mpn", "title"), "group-parts")
    parts = catalog.withColumn("pos", F.col("part_id"))
    images = _images(spark, d).join(_items(spark, d).select("item_id", "mpn"), "item_id").join(catalog.select("part_id", "mpn"), "mpn").select(F.concat("part_id", F.lit("/"), "image").alias("image"), "part_id", "phash")
    return listings.product_groups(parts, queries.select("part_id", "title"), _items(spark, d), images, DIST, 4, near)


_GROUPS = f"""{_BUILD},
nm AS (SELECT part_id, unnest(list_filter(list_transform(regexp_extract_all(title, '[A-Za-z0-9][A-Za-z0-9-]*[A-Za-z0-9]'), lambda t: regexp_replace(lower(t), '[^a-z0-9]', '', 'g')), lambda t: length(t) >= 7 AND regexp_matches(t, '[0-9]'))) AS token FROM (SELECT part_id, title FROM ca UNION ALL SELECT part_id, title FROM qu)
  UNION SELECT part_id, {_NORM.format('mpn')} FROM ca WHERE length({_NORM.format('mpn')}) >= 7),
lp AS (SELECT {_NORM.format('mpn')} AS number, max(part_id) AS part_id FROM ca GROUP BY 1),
co AS (SELECT DISTINCT lp.part_id, t.token FROM (SELECT {_NORM.format('mpn')} AS number, unnest(list_filter(list_transform(regexp_split_to_array(mpn || ', OEM' || (1000 + i % 90) || '; X1', '[,;/]'), lambda c: regexp_replace(lower(c), '[^a-z0-9]', '', 'g')), lambda c: length(c) >= 6 AND regexp_matches(c, '[0-9]'))) AS token FROM it) t JOIN lp USING (number)),
ow AS (SELECT 'n' || token AS token, part_id FROM nm UNION SELECT 'c' || token, part_id FROM co),
fw AS (SELECT token, min(part_id) AS head FROM ow GROUP BY 1 HAVING count(DISTINCT part_id) BETWEEN 2 AND 6),
gi AS (SELECT ca.part_id || '/' || im.image AS image, ca.part_id, im.phash FROM im JOIN it ON it.i = im.i JOIN ca ON ca.mpn = it.mpn),
gp AS (SELECT x.image AS a, y.image AS b, x.part_id AS pa, y.part_id AS pb FROM gi x JOIN gi y ON x.part_id <> y.part_id AND x.image < y.image AND bit_count(xor(x.phash, y.phash)) <= {DIST}),
gn AS (SELECT id FROM (SELECT a AS id, pb AS other FROM gp UNION ALL SELECT b, pa FROM gp) GROUP BY 1 HAVING count(DISTINCT other) > 4),
ed AS (SELECT part_id AS x, head AS y FROM ow JOIN fw USING (token) WHERE part_id <> head UNION SELECT pa, pb FROM gp WHERE a NOT IN (SELECT id FROM gn) AND b NOT IN (SELECT id FROM gn)),
pg(id, low) AS (SELECT part_id, part_id FROM ca UNION SELECT e.y, pg.low FROM pg JOIN (SELECT x, y FROM ed UNION ALL SELECT y, x FROM ed) e ON e.x = pg.id AND pg.low < e.y)"""


def equivalents(spark, d):
    k = F.col("p_partkey")
    name = F.concat_ws("-", F.concat((10000 + k).cast("string"), F.lit("-KGH-901")), F.when(k % 2 == 0, F.concat(F.lit("IP-01-"), F.lpad((k % 9999).cast("string"), 4, "0"))), F.when(k % 3 == 0, "misc"))
    out = listings.equivalences(spark.read.parquet(f"{d}/part.parquet").select(name.alias("name")), shapes=X.LONG_CODE_SHAPES)
    return out.select("name", F.array_join("members", ",").alias("members"), "needs_check")


def projects(spark, d):
    k = F.col("p_partkey")
    images = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("project"), F.concat(F.lit("p"), (k % 40).cast("string"), F.when(k % 40 < 5, "-K03-1").when(k % 40 < 8, "-KWB-2").otherwise("")).alias("part"))
    return listings.project_rows(images, "site", "me", "https://x/").select("part_number_raw", "name", "source_url", "notes")


def stream(spark, d):
    k = F.col("p_partkey")
    url = F.when(k % 5 != 0, F.concat(F.lit("http://x/"), k.cast("string")))
    details = F.map_from_arrays(F.array(F.lit("mpn"), F.lit("Part Number")), F.array(F.when(k % 3 == 0, F.concat(F.lit(" M"), k.cast("string"))).otherwise(""), F.when(k % 2 == 0, F.concat(F.lit("N"), k.cast("string"))).otherwise("")))
    items = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("id"), k.cast("string")).alias("id"), F.concat(F.lit(" "), "p_name").alias("title"), F.col("p_brand").alias("store"), details.alias("details"), F.array(F.create_map(F.lit("thumb"), F.lit("")), F.create_map(F.lit("large"), url)).alias("images"))
    return listings.stream_items(items, 2**31 - 1).select("part_number_raw", "brand", "name", "evidence", "image_url", "slug")


QUERIES = {
    "listing_catalog": lambda spark, d: _built(spark, d)[0],
    "listing_gallery": lambda spark, d: _built(spark, d)[1],
    "listing_queries": lambda spark, d: _built(spark, d)[2],
    "listing_clean_parts": lambda spark, d: _cleaned(spark, d)[0],
    "listing_clean_queries": lambda spark, d: listings.copy_paths(_cleaned(spark, d)[2], "out", "queries").select("part_id", "image", "category", "part_dir", "dst"),
    "listing_dropped": lambda spark, d: _cleaned(spark, d)[3],
    "listing_report": lambda spark, d: listings.clean_report(*(lambda x: (x[0], x[3]))(_cleaned(spark, d))),
    "near_unknowns": lambda spark, d: unknown_parts(spark, d)[0],
    "near_unknowns_skipped": lambda spark, d: unknown_parts(spark, d)[1],
    "product_groups": groups,
    "equivalences": equivalents,
    "project_rows": projects,
    "stream_items": stream,
}
ORACLE = {
    "listing_catalog": f"{_BUILD} SELECT * FROM ca",
    "listing_gallery": f"{_BUILD} SELECT part_id, image, i AS item_id, substr(sha1(seller), 1, 10) AS seller_hash, phash, stock::INT AS stock FROM g2",
    "listing_queries": f"{_BUILD} SELECT part_id, image, i AS item_id, substr(sha1(seller), 1, 10) AS seller_hash, phash, title FROM qu",
    "listing_clean_parts": f"{_CLEAN} SELECT * FROM pa",
    "listing_clean_queries": f"{_CLEAN} SELECT q2.part_id, image, label AS category, part_dir, 'out/queries/' || replace(label, ' ', '_') || '/' || part_dir || '/' || list_extract(string_split(image, '/'), -1) AS dst FROM q2 JOIN pa USING (part_id) WHERE reason IS NULL",
    "listing_dropped": f"{_CLEAN} SELECT * FROM dr",
    "listing_report": f"""{_CLEAN}, bc AS (SELECT category AS name, count(*) AS parts, sum(n_gallery)::BIGINT AS gallery, sum(n_query)::BIGINT AS queries, sum(short_mpn)::BIGINT AS short FROM pa GROUP BY 1)
SELECT 'parts' AS what, name, parts AS n FROM bc UNION ALL SELECT 'gallery', name, gallery FROM bc UNION ALL SELECT 'queries', name, queries FROM bc UNION ALL SELECT 'short', name, short FROM bc UNION ALL SELECT 'dropped', split_part(reason, ':', 1), count(*) FROM dr GROUP BY 2""",
    "near_unknowns": f"{_UNKNOWN} SELECT ch.b.brand || '::' || number AS part_id, ch.b.brand AS brand, number AS mpn, ch.b.title AS title, ch.b.label AS category, image, ch.b.i AS item_id, 'http://x/' || ch.b.i AS item_url, 'near_unknown' AS kind FROM ch JOIN sh ON sh.i = ch.b.i AND place <= 3",
    "near_unknowns_skipped": f"{_UNKNOWN} SELECT why, count(*) AS n FROM wy WHERE why IS NOT NULL GROUP BY 1",
    "product_groups": f'{_GROUPS} SELECT id AS part_id, min(low) AS "group" FROM pg GROUP BY id',
    "equivalences": """WITH x AS (SELECT list_filter([(10000 + p_partkey) || '-KGH-901', CASE WHEN p_partkey % 2 = 0 THEN 'IP-01-' || lpad((p_partkey % 9999)::VARCHAR, 4, '0') END, CASE WHEN p_partkey % 3 = 0 THEN 'misc' END], lambda v: v IS NOT NULL) AS c FROM part),
m AS (SELECT array_to_string(c, '-') AS name, list_transform(c, lambda v: regexp_replace(upper(v), '[\\s\\-/]+', '', 'g')) AS m FROM x WHERE len(c) >= 2)
SELECT name, array_to_string(m, ',') AS members, len(list_distinct(m)) < len(m) OR len(list_filter(m, lambda v: length(v) < 6)) > 0 AS needs_check FROM m""",
    "project_rows": f"""WITH r AS (SELECT p_brand AS project, 'p' || (p_partkey % 40) || CASE WHEN p_partkey % 40 < 5 THEN '-K03-1' WHEN p_partkey % 40 < 8 THEN '-KWB-2' ELSE '' END AS part FROM part), g AS (SELECT project, part, count(*) AS n FROM r GROUP BY 1, 2)
SELECT part AS part_number_raw, project || ' part ' || part AS name, 'https://x/' || project AS source_url, 'auto-imported from ' || project || ', ' || n || ' image(s), is_distractor candidate -- verify part number before indexing' || CASE WHEN regexp_matches(part, '-(K03|KWB|K62|GFP|GF6)-') THEN '{listings.MOTORCYCLE_NOTE}' ELSE '' END AS notes FROM g""",
    "stream_items": """WITH x AS (SELECT *, coalesce(CASE WHEN p_partkey % 3 = 0 THEN 'M' || p_partkey END, CASE WHEN p_partkey % 2 = 0 THEN 'N' || p_partkey END, '') AS mpn FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(nullif(mpn, ''), 'id' || p_partkey) AS part_number_raw, p_brand AS brand, substr(p_name, 1, 120) AS name, CASE WHEN mpn <> '' THEN 'has_real_mpn' ELSE 'asin_only_no_verified_part_number' END AS evidence, 'http://x/' || p_partkey AS image_url,
upper(trim(regexp_replace(coalesce(nullif(mpn, ''), 'id' || p_partkey), '[^A-Za-z0-9]+', '-', 'g'), '-')) AS slug FROM x""",
}
