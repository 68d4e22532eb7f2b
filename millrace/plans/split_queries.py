"""Queries on splits of parts, types and photos, on copies checked by content, and on reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.vectors import sign_hash
from millrace.operators import audit, dedup, quality, splits
from millrace.plans.table_queries import _HASH, _PAIRS
from millrace.sources import labels

#: Hamming distance that gives near pairs among the tables' vectors, and the difference of contents that some of them pass.
NEAR, CONTENT = 18, 14.0
#: Types that are held out, and names of classes of two sets of labels.
HELD = ["5", "7"]
NAMES = {"a": ["Front-Bumper", "hood", "Back Door", "d008", "brake disc"], "b": ["hood", "New Thing", "clutch", "back_door", "other"]}
KNOWN = ["front_bumper", "rear_bumper", "hood", "rear_door"]


def _vectors(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    content = F.transform("embedding", lambda x: F.round(x * 100).cast("int"))
    return e.select(F.col("vec_id").alias("image"), F.concat(F.lit("p"), F.lpad((F.col("vec_id") % 40).cast("string"), 2, "0")).alias("part"), F.col("label").cast("string").alias("label"), sign_hash(F.col("embedding")).alias("phash"), content.alias("content"), (F.col("vec_id") % 3).alias("src"), F.when(F.col("vec_id") % 3 == 2, F.concat(F.lit("g"), (F.col("vec_id") % 37).cast("string"))).alias("photo"))


def checked_pairs(spark, d):
    return dedup.near_pairs_checked(_vectors(spark, d), "image", "phash", "content", NEAR, CONTENT)


_CHECKED = f"""{_HASH.replace('WITH ', 'WITH RECURSIVE ')}, {_PAIRS.format(t=NEAR)}, t AS (SELECT vec_id, list_transform(embedding, lambda x: round(x * 100)::INT) AS c FROM embeddings),
k AS (SELECT a, b, distance FROM p JOIN t x ON x.vec_id = a JOIN t y ON y.vec_id = b WHERE list_sum(list_transform(range(1, 65), lambda i: abs(x.c[i] - y.c[i]))) / 64.0::DOUBLE <= {CONTENT}),
u(id, low) AS (SELECT vec_id, vec_id FROM h UNION SELECT e.y, u.low FROM u JOIN (SELECT a AS x, b AS y FROM k UNION ALL SELECT b, a FROM k) e ON e.x = u.id AND u.low < e.y),
cl AS (SELECT id AS image, min(low) AS cluster, 'p' || lpad((id % 40)::VARCHAR, 2, '0') AS part FROM u GROUP BY id)"""


def _clustered(spark, d) -> DataFrame:
    v = _vectors(spark, d)
    clusters = dedup.groups(v, "image", checked_pairs(spark, d)).select(F.col("id").alias("image"), F.col("group").alias("cluster"))
    return v.join(clusters, "image")


def part_sides(spark, d):
    """Parts with two images or more, one a cluster; groups of parts that share a cluster; far, valid and train by group."""
    rows = _clustered(spark, d)
    kept = splits.first_of_each(rows.withColumn("key", F.concat_ws("/", "part", "cluster")), "key", "image").drop("key")
    parts = audit.parts_with_several(kept)
    groups = splits.part_groups(rows, "part", "cluster")
    sides = splits.split_groups(groups.select("group").distinct(), "group", 0.15, 3, 42)
    return parts.groupBy("part").agg(F.count("*").alias("n")).join(groups, "part").join(sides, "group").select("part", "group", "side", "n")


def valid_images(spark, d):
    """Of valid parts one drawn image as query and the rest as gallery, of far ones the first image, of train ones all."""
    sides = part_sides(spark, d).select("part", "side")
    rows = splits.first_of_each(_clustered(spark, d).withColumn("key", F.concat_ws("/", "part", "cluster")), "key", "image").join(sides, "part")
    valid = splits.one_query_each(rows.where("side = 'valid'").drop("side"), "part", "image", 42).select("part", "image", "side")
    far = splits.first_of_each(rows.where("side = 'far'"), "part", "image").select("part", "image", F.lit("far_unknown").alias("side"))
    return valid.unionByName(far).unionByName(rows.where("side = 'train'").select("part", "image", "side"))


_SIDES = f"""{_CHECKED}, kp AS (SELECT part, cluster, min(image) AS image FROM cl GROUP BY 1, 2), pt AS (SELECT part, count(*) AS n FROM kp GROUP BY 1 HAVING count(*) >= 2),
pe AS (SELECT DISTINCT part, min(part) OVER (PARTITION BY cluster) AS least FROM cl),
pg(part, low) AS (SELECT part, part FROM pe UNION SELECT e.y, pg.low FROM pg JOIN (SELECT part AS x, least AS y FROM pe UNION ALL SELECT least, part FROM pe) e ON e.x = pg.part AND pg.low < e.y),
gg AS (SELECT part, min(low) AS grp FROM pg GROUP BY 1), gr AS (SELECT DISTINCT grp FROM gg),
gs AS (SELECT grp, row_number() OVER (ORDER BY md5('42:' || grp)) AS r, count(*) OVER () AS n FROM gr),
sd AS (SELECT grp, CASE WHEN r <= 3 THEN 'far' WHEN r <= 3 + greatest(1, round_even((n - 3) * 0.15::DOUBLE, 0)::BIGINT) THEN 'valid' ELSE 'train' END AS side FROM gs),
ps AS (SELECT part, grp, side, n FROM pt JOIN gg USING (part) JOIN sd USING (grp))"""


def _best_of_clusters(spark, d) -> DataFrame:
    """The best image of each cluster of one label, of labels with thirty images or more."""
    rows = dedup.groups(_vectors(spark, d), "image", dedup.near_pairs(_vectors(spark, d), "image", "phash", NEAR))
    rows = _vectors(spark, d).join(rows.select(F.col("id").alias("image"), F.col("group").alias("cluster")), "image")
    return splits.large_types(splits.one_label_clusters(rows, "cluster", "label", [F.col("src"), F.col("image")]), "label", 30)


def type_sides(spark, d):
    """Drawn held-out types to gallery and queries, the others to train, gallery and queries."""
    best = _best_of_clusters(spark, d).select("label", "image")
    held = splits.heldout_types(best, "label", sample=2, seed=42)
    seen = splits.split_types(best.join(held, "label", "left_anti"), "label", "image", 0.2, 20, 42)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(splits.shuffle_key(42, "image"), "image"))
    n = F.count("*").over(Window.partitionBy("label"))
    out = best.join(held, "label", "left_semi").withColumn("side", F.when(rank <= F.least(F.lit(20), F.floor(n / 2)), "heldout_query").otherwise("gallery"))
    return seen.unionByName(out)


_BEST = f"""{_HASH.replace('WITH ', 'WITH RECURSIVE ')}, {_PAIRS.format(t=NEAR)},
u(id, low) AS (SELECT vec_id, vec_id FROM h UNION SELECT e.y, u.low FROM u JOIN (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p) e ON e.x = u.id AND u.low < e.y),
cl AS (SELECT id AS image, min(low) AS cluster FROM u GROUP BY id), rw AS (SELECT image, cluster, label::VARCHAR AS label, image % 3 AS src FROM cl JOIN embeddings ON vec_id = image),
ok AS (SELECT cluster FROM rw GROUP BY 1 HAVING count(DISTINCT label) = 1),
b1 AS (SELECT * FROM rw WHERE cluster IN (SELECT cluster FROM ok) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY src, image) = 1),
be AS (SELECT label, image, src FROM b1 WHERE label IN (SELECT label FROM b1 GROUP BY 1 HAVING count(*) >= 30))"""


def photo_sides(spark, d):
    """Merged types: photos stay on one side, each side is capped, held-out types take part in evaluation only."""
    rows = _best_of_clusters(spark, d).select("label", "image", "src", "photo")
    # Tables whose held-out types have no rows left are split too.
    held = rows.where(F.col("label").isin(HELD)).select("label").distinct()
    photos = splits.photo_sides(rows, "photo", 0.2, 42).withColumn("seen", F.lit(True))
    rows = rows.join(photos, "photo", "left").join(held.withColumn("held", F.lit(True)), "label", "left")
    web = F.col("photo").isNull()
    rank = F.row_number().over(Window.partitionBy("label", web).orderBy(splits.shuffle_key(42, "image"), "image"))
    n_web = F.count("*").over(Window.partitionBy("label", web))
    evaluated = F.when(web, F.coalesce("held", rank <= F.greatest(F.lit(2), F.bround(n_web * F.lit(0.2)).cast("long")))).otherwise(F.coalesce("seen", F.lit(False)))
    rows = rows.withColumn("eval", evaluated).where("eval or held is null")
    shot = F.col("photo").isNotNull()
    train = splits.cap_side(rows.where("not eval"), "label", "image", shot, 20, 42).withColumn("side", F.lit("train"))
    ev = splits.cap_side(rows.where("eval"), "label", "image", shot, 12, 42)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(splits.shuffle_key(42, "image"), "image"))
    n = F.count("*").over(Window.partitionBy("label"))
    ev = ev.withColumn("side", F.when(rank <= F.least(F.lit(20), F.floor(n / 2)), "query").otherwise("gallery"))
    return train.unionByName(ev).select("label", "image", "photo", "side")


def photo_leaks(spark, d):
    rows = photo_sides(spark, d)
    return splits.leakage(rows, "image", "side", "photo", F.col("label").isin(HELD), F.lit(False))


_PHOTO = f"""{_BEST}, ph AS (SELECT *, CASE WHEN image % 3 = 2 THEN 'g' || (image % 37) END AS photo FROM be),
pr AS (SELECT photo, row_number() OVER (ORDER BY md5('42:' || photo), photo) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT photo FROM ph WHERE photo IS NOT NULL)), ep AS (SELECT photo FROM pr WHERE r <= round_even(n * 0.2::DOUBLE, 0)),
e1 AS (SELECT *, label IN ('5', '7') AS held, row_number() OVER (PARTITION BY label, photo IS NULL ORDER BY md5('42:' || image), image) AS r, count(*) OVER (PARTITION BY label, photo IS NULL) AS nw FROM ph),
e2 AS (SELECT *, CASE WHEN photo IS NULL THEN held OR r <= greatest(2, round_even(nw * 0.2::DOUBLE, 0)) ELSE photo IN (SELECT photo FROM ep) END AS ev FROM e1),
e3 AS (SELECT *, photo IS NOT NULL AS s, CASE WHEN ev THEN 12 ELSE 20 END AS cap FROM e2 WHERE ev OR NOT held),
e4 AS (SELECT *, sum(s::INT) OVER (PARTITION BY label, ev) AS kept, count(*) OVER (PARTITION BY label, ev) AS n, row_number() OVER (PARTITION BY label, ev, s ORDER BY md5('42:' || image), image) AS rs FROM e3),
e5 AS (SELECT *, least(n - kept, greatest(cap - least(kept, cap // 3), cap - kept)) AS k FROM e4),
e6 AS (SELECT * FROM e5 WHERE CASE WHEN s THEN rs <= greatest(0, cap - k) ELSE rs <= k END),
e7 AS (SELECT *, row_number() OVER (PARTITION BY label, ev ORDER BY md5('42:' || image), image) AS q, count(*) OVER (PARTITION BY label, ev) AS m FROM e6),
e8 AS (SELECT label, image, photo, CASE WHEN NOT ev THEN 'train' WHEN q <= least(20, m // 2) THEN 'query' ELSE 'gallery' END AS side FROM e7)"""


def _entities(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select(F.concat("p_brand", F.lit("/"), (F.col("p_partkey") % 400).cast("string")).alias("grp"), F.col("p_partkey").alias("part"), (F.col("p_partkey") % 7).cast("string").alias("cat0"), "p_type").withColumn("category", F.when(F.col("part") % 3 == 0, F.col("cat0")).otherwise(F.substring(F.md5("grp"), 1, 1)))


def held_groups(spark, d):
    g = splits.heldout_groups(_entities(spark, d), "grp", "part", "category", HELD)
    return splits.pack_heldout(g, (0.6, 0.2), 42)


_ENTITY = "SELECT p_brand || '/' || (p_partkey % 400) AS grp, p_partkey AS part, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 7)::VARCHAR ELSE substr(md5(p_brand || '/' || (p_partkey % 400)), 1, 1) END AS category FROM part"
_HELD = f"""WITH e AS ({_ENTITY}), n AS (SELECT grp, category, count(*) AS n FROM e GROUP BY 1, 2),
g AS (SELECT grp, min(category) FILTER (category IN ('5', '7')) AS held, arg_min(category, struct_pack(n := -n, c := category)) AS common, sum(n)::BIGINT AS members, count(*) > 1 AS spans FROM n GROUP BY 1),
h AS (SELECT grp, coalesce(held, common) AS category, held IS NOT NULL AS held, members, spans FROM g),
w AS (SELECT *, coalesce(sum(members) OVER (PARTITION BY category ORDER BY md5('42:' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, sum(members) OVER (PARTITION BY category) AS total FROM h)"""


def _pictures(spark, d) -> DataFrame:
    k = F.col("doc_id")
    return spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("f"), k.cast("string")).alias("path"), "source", F.when(k % 17 != 0, F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").bitwiseXOR(F.when(k % 5 == 0, 3).otherwise(0))).alias("phash"), (300 + k * 7 % 400).cast("int").alias("width"), (250 + k * 13 % 500).cast("int").alias("height"))


_PICTURES = "WITH i AS (SELECT 'f' || doc_id AS path, source, CASE WHEN doc_id % 17 <> 0 THEN xor(('0x' || substr(md5(text), 1, 15))::BIGINT, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 0 END) END AS phash, 300 + doc_id * 7 % 400 AS width, 250 + doc_id * 13 % 500 AS height FROM documents)"


def manifest(spark, d):
    sources = [r[0] for r in spark.read.parquet(f"{d}/documents.parquet").select("source").distinct().orderBy("source").limit(6).collect()]
    kept = audit.kept_sources(_pictures(spark, d).where("phash is not null"), sources, sources[:1], 350)
    return audit.clean_manifest(kept).select("path", "phash", "split", "is_primary")


def folders(spark, d):
    k = F.col("p_partkey")
    part = F.when(k % 10 == 0, F.concat(F.lit("KAGGLE50_"), (k % 30).cast("string"))).when(k % 10 == 1, "IMAGES").otherwise(F.concat(F.lit("p"), (k % 1900).cast("string")))
    images = spark.read.parquet(f"{d}/part.parquet").select(part.alias("part"), F.concat(F.lit("x/"), k.cast("string"), F.lit(".JPG")).alias("path"))
    rows = audit.parts_with_several(audit.part_folders(images))
    return splits.numbered_files(rows, "part", "path").select("part", "path", "file")


def _lines(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    source = F.when(k % 2 == 0, "a").otherwise("b")
    split = F.when(k % 5 == 0, "valid").when(k % 5 == 1, "test").otherwise("train")
    return spark.read.parquet(f"{d}/part.parquet").select(source.alias("source"), split.alias("split"), F.concat(F.lit("f"), (k % 700).cast("string")).alias("file"), (F.floor(k / 2) % 6).cast("int").alias("class_id"), F.concat(F.lit("0.5 "), k.cast("string")).alias("box"))


def _mapping(spark):
    maps, known = {}, KNOWN
    for source, names in NAMES.items():
        maps[source], known = labels.class_mapping(names, known)
    return labels.mapping_table(spark, maps)


def merged_labels(spark, d):
    return labels.offset_classes(labels.merged(_lines(spark, d), _mapping(spark)), 100)


def runs_report(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 5 = 0")
    runs = e.select(F.col("vec_id").alias("image"), F.explode(F.array(F.lit("full_image"), F.lit("crop_15"), F.lit("centre_70"))).alias("region"))
    hit = F.col("image") * 7 + F.length("region") * 3
    runs = runs.select("region", "image", (hit % 4 != 0).cast("int").alias("recall_1"), (1.0 / (1 + hit % 5)).alias("ap"), ((F.col("region") == "crop_15") & (F.col("image") % 3 != 0)).alias("detected"))
    sources = e.select(F.col("vec_id").alias("image"), F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string")).alias("src"))
    out = audit.region_report(runs, sources)
    return out.withColumns({c: F.round(c, 6) for c in ("recall_1", "map", "detected_recall_1", "same_recall_1")})


def visible(spark, d):
    """Share of documents with a visible number, as the ground truth's table states it."""
    return spark.read.parquet(f"{d}/documents.parquet").groupBy("lang").agg(F.round(F.avg(F.col("text").rlike("[0-9]{4}").cast("double")), 6).alias("visible"), F.count("*").alias("n"))


def last_wins(spark, d):
    """Numbers that several rows have belong to the last of them; unknown numbers go."""
    k = F.col("p_partkey")
    p = spark.read.parquet(f"{d}/part.parquet")
    owner = p.groupBy((k % 700).alias("number")).agg(F.max("p_partkey").alias("part"))
    return spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 900).alias("number")).join(owner, "number").groupBy("number", "part").agg(F.count("*").alias("n"))


QUERIES = {
    "near_pairs_checked": checked_pairs,
    "split_part_groups": part_sides,
    "split_part_images": valid_images,
    "split_types": type_sides,
    "split_photos": photo_sides,
    "split_photo_leaks": photo_leaks,
    "split_heldout_groups": held_groups,
    "split_positions": lambda spark, d: splits.split_ranks(spark.read.parquet(f"{d}/part.parquet").select("p_partkey"), "p_partkey"),
    "split_carve": lambda spark, d: splits.carve(spark.read.parquet(f"{d}/part.parquet").select("p_type", "p_partkey"), "p_type", "p_partkey"),
    "sample_per_class": lambda spark, d: splits.sample_each(spark.read.parquet(f"{d}/part.parquet").select("p_type", "p_partkey"), "p_type", "p_partkey", 3),
    "group_sizes": lambda spark, d: audit.largest_groups(_entities(spark, d), "grp"),
    "queries_against_gallery": lambda spark, d: dedup.without_near(_vectors(spark, d).where("src = 0"), _vectors(spark, d).where("src > 0"), "label", "phash", 22).select("image", "label"),
    "audit_report": lambda spark, d: audit.report(_pictures(spark, d), near_limit=None),
    "audit_sources": lambda spark, d: audit.by_source(_pictures(spark, d)),
    "audit_copies": lambda spark, d: audit.copies(_pictures(spark, d)),
    "clean_manifest": manifest,
    "part_folders": folders,
    "class_distribution": lambda spark, d: audit.class_distribution(_lines(spark, d)),
    "merged_labels": merged_labels,
    "region_report": runs_report,
    "visible_numbers": visible,
    "lookup_last_wins": last_wins,
    "unmapped_labels": lambda spark, d: quality.remap_labels(_lines(spark, d).select("class_id", "file"), spark.range(4).select(F.col("id").cast("int").alias("class_id"), (F.col("id") - 1).cast("int").alias("new_id"))).groupBy("class_id").agg(F.count("*").alias("n")),
}


def _mapping_sql() -> str:
    maps, known = {}, KNOWN
    for source, names in NAMES.items():
        maps[source], known = labels.class_mapping(names, known)
    return "(VALUES " + ", ".join(f"('{s}', {a}, {b})" for s, m in maps.items() for a, b in m.items()) + ") m(source, class_id, new_id)"


_LINES = "WITH l AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS source, CASE p_partkey % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'test' ELSE 'train' END AS split, 'f' || (p_partkey % 700) AS file, (p_partkey // 2 % 6)::INT AS class_id, '0.5 ' || p_partkey AS box FROM part)"
ORACLE = {
    "near_pairs_checked": f"{_CHECKED} SELECT a, b, distance FROM k",
    "split_part_groups": f'{_SIDES} SELECT part, grp AS "group", side, n FROM ps',
    "split_part_images": f"""{_SIDES}, im AS (SELECT kp.part, image, side, row_number() OVER (PARTITION BY kp.part ORDER BY md5('42:' || image), image) AS r, row_number() OVER (PARTITION BY kp.part ORDER BY image) AS f FROM kp JOIN ps ON ps.part = kp.part)
SELECT part, image, CASE WHEN side = 'valid' THEN CASE WHEN r = 1 THEN 'query' ELSE 'gallery' END WHEN side = 'far' THEN 'far_unknown' ELSE side END AS side FROM im WHERE side <> 'far' OR f = 1""",
    "split_types": f"""{_BEST}, hd AS (SELECT label FROM (SELECT DISTINCT label FROM be) ORDER BY md5('42:' || label), label LIMIT 2), w AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || image), image) AS r, count(*) OVER (PARTITION BY label) AS n, label IN (SELECT label FROM hd) AS held FROM be),
x AS (SELECT *, least(n, greatest(4, round_even(n * 0.2::DOUBLE, 0)::BIGINT)) AS ne FROM w) SELECT label, image, CASE WHEN held THEN CASE WHEN r <= least(20, n // 2) THEN 'heldout_query' ELSE 'gallery' END WHEN r <= least(20, ne // 2) THEN 'query' WHEN r <= ne THEN 'gallery' ELSE 'train' END AS side FROM x""",
    "split_photos": f"{_PHOTO} SELECT * FROM e8",
    "split_photo_leaks": f"""{_PHOTO} SELECT 'items' AS "check", NOT EXISTS (SELECT image FROM e8 GROUP BY 1 HAVING count(DISTINCT side) > 1) AS ok UNION ALL SELECT 'groups', NOT EXISTS (SELECT photo FROM e8 WHERE photo IS NOT NULL GROUP BY 1 HAVING bool_or(side = 'train') AND bool_or(side <> 'train'))
UNION ALL SELECT 'heldout', NOT EXISTS (SELECT 1 FROM e8 WHERE side = 'train' AND label IN ('5', '7')) UNION ALL SELECT 'synthetic', true""",
    "split_heldout_groups": f"{_HELD} SELECT grp, category, held, members, spans, CASE WHEN held THEN 'heldout' WHEN done < 0.6::DOUBLE * total THEN 'train' WHEN done < (0.6::DOUBLE + 0.2::DOUBLE) * total THEN 'val' ELSE 'test' END AS partition FROM w",
    "split_positions": "WITH w AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('42:' || p_partkey)) AS r, count(*) OVER () AS n FROM part) SELECT p_partkey, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM w",
    "split_carve": "WITH w AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY md5('42:' || p_partkey), p_partkey) AS r, count(*) OVER (PARTITION BY p_type) AS n FROM part), e AS (SELECT *, least(n, greatest(4, round_even(n * 0.1::DOUBLE, 0)::BIGINT)) AS ne FROM w) SELECT p_type, p_partkey, CASE WHEN r <= ne // 2 THEN 'query' WHEN r <= ne THEN 'gallery' ELSE 'train' END AS side FROM e",
    "sample_per_class": "SELECT p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY md5('42:' || p_partkey), p_partkey) <= 3",
    "group_sizes": f"SELECT grp, count(*) AS size FROM ({_ENTITY}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "queries_against_gallery": f"{_HASH} SELECT vec_id AS image, label::VARCHAR AS label FROM h q WHERE vec_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM h g WHERE g.vec_id % 3 > 0 AND g.label = q.label AND bit_count(xor(g.h, q.h)) <= 22)",
    "audit_report": f"""{_PICTURES}, h AS (SELECT phash, count(*) AS n FROM i WHERE phash IS NOT NULL GROUP BY 1) SELECT (SELECT count(*) FROM i) AS n_scanned, (SELECT count(*) FROM i WHERE phash IS NULL) AS n_corrupt, (SELECT count(*) FROM i WHERE phash IS NOT NULL AND least(width, height) < 400) AS n_undersized,
count(*) AS n_unique_phash, sum(n - 1)::BIGINT AS n_exact_duplicates, (SELECT count(*) FROM h a JOIN h b ON a.phash < b.phash AND bit_count(xor(a.phash, b.phash)) <= 6) AS near_pairs FROM h""",
    "audit_sources": f"{_PICTURES} SELECT source, count(*) AS n, count(*) FILTER (phash IS NULL) AS corrupt, count(*) FILTER (phash IS NOT NULL AND least(width, height) < 400) AS undersized FROM i GROUP BY 1",
    "audit_copies": f"{_PICTURES} SELECT phash, count(*) AS n_copies, string_agg(path, ' | ' ORDER BY path) AS files FROM i WHERE phash IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "clean_manifest": f"""{_PICTURES}, s AS (SELECT source, row_number() OVER (ORDER BY source) AS k FROM (SELECT DISTINCT source FROM documents)), f AS (SELECT i.* FROM i JOIN s USING (source) WHERE k BETWEEN 2 AND 6 AND phash IS NOT NULL AND least(width, height) >= 350),
c AS (SELECT phash, row_number() OVER (ORDER BY md5('42:' || phash)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT phash FROM f)) SELECT path, phash, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'valid' ELSE 'test' END AS split, row_number() OVER (PARTITION BY phash ORDER BY path) = 1 AS is_primary FROM f JOIN c USING (phash)""",
    "part_folders": "WITH i AS (SELECT 'p' || (p_partkey % 1900) AS part, 'x/' || p_partkey || '.JPG' AS path FROM part WHERE p_partkey % 10 > 1) SELECT part, path, row_number() OVER (PARTITION BY part ORDER BY path) || '.jpg' AS file FROM i QUALIFY count(*) OVER (PARTITION BY part) >= 2",
    "class_distribution": f"{_LINES} SELECT class_id, count(DISTINCT file) AS n_files FROM l GROUP BY 1",
    "merged_labels": f"{_LINES} SELECT l.source, CASE WHEN split = 'train' THEN 'train' ELSE 'val' END AS split, l.source || '_' || file AS file, (new_id + 100)::INT AS class_id, box FROM l JOIN {_mapping_sql()} ON m.source = l.source AND m.class_id = l.class_id",
    "region_report": """WITH e AS (SELECT vec_id AS image, region, vec_id * 7 + length(region) * 3 AS hit FROM embeddings, (SELECT unnest(['full_image', 'crop_15', 'centre_70']) AS region) WHERE vec_id % 5 = 0),
r AS (SELECT region, image, 's' || (image % 4) AS src, (hit % 4 <> 0)::INT AS recall_1, 1.0::DOUBLE / (1 + hit % 5) AS ap, region = 'crop_15' AND image % 3 <> 0 AS detected, ((image * 7 + 30) % 4 <> 0)::INT AS base FROM e)
SELECT region, src, count(*) AS n, round(avg(recall_1), 6) AS recall_1, round(avg(ap), 6) AS map, count(*) FILTER (detected) AS detected_n, round(avg(recall_1) FILTER (detected), 6) AS detected_recall_1, round(avg(base) FILTER (detected), 6) AS same_recall_1 FROM r GROUP BY GROUPING SETS ((region, src), (region))""",
    "visible_numbers": "SELECT lang, round(avg(regexp_matches(text, '[0-9]{4}')::INT), 6) AS visible, count(*) AS n FROM documents GROUP BY 1",
    "lookup_last_wins": "WITH o AS (SELECT p_partkey % 700 AS number, max(p_partkey) AS part FROM part GROUP BY 1) SELECT number, part, count(*) AS n FROM (SELECT o_custkey % 900 AS number FROM orders) JOIN o USING (number) GROUP BY 1, 2",
    "unmapped_labels": f"{_LINES} SELECT (class_id - 1)::INT AS class_id, count(*) AS n FROM l WHERE class_id BETWEEN 1 AND 3 GROUP BY 1",
}
