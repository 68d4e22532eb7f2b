import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from millrace.operators import audit, dedup, fusion, listings, quality, retrieval, splits
from millrace.operators.components import connected_components
from millrace.plans import listing_queries, split_queries, text_queries
from millrace.streaming import ingest, rate_limit
from tests.duck import same_rows

HITS = "query_id int, source string, product_id long, score double, hit_rank int"
QUERY = "query_id int, confidence double, alpha double, beta double, gamma double"


def merged(spark, hits, query=(1, 0.9, None, None, None), **k):
    return fusion.merge(spark.createDataFrame([(1, *h) for h in hits], HITS), spark.createDataFrame([query], QUERY), **k).orderBy("rank").collect()


def test_fusion_sum(spark):
    r = merged(spark, [("image", 5, 0.9, 1), ("text", 5, 0.8, 1), ("catalog", 5, 1.0, 1)], (1, 0.9, 0.4, 0.3, 0.3))[0]
    assert r.score == pytest.approx(0.9) and r.match_type == "hybrid"


def test_fusion_rules(spark):
    assert merged(spark, [("text", 5, 0.85, 1)])[0].score == pytest.approx(0.17)
    assert merged(spark, [("image", 5, 0.9, 1), ("image", 5, 0.3, 2)])[0].score == pytest.approx(0.12)  # the last hit counts
    assert [r.match_type for r in merged(spark, [("catalog", 0, 1.0, 1)])] == ["unknown"]
    assert [r.match_type for r in merged(spark, [("catalog", 0, 1.0, 1), ("image", 0, 1.0, 1)])] == ["image"]
    assert merged(spark, [("catalog", None, 1.0, 1)]) == []
    assert [r.product_id for r in merged(spark, [("image", 7, 0.6, 1), ("catalog", 8, 0.4, 1)])] == [8, 7]  # equal: the catalogue came first


def test_diversity_gives_two_for_one(spark):
    rows = [(1, k + 1, k, s) for k, s in enumerate((1.0, 0.5, 0.45, 0.1))]
    df = spark.createDataFrame(rows, "query_id int, rank int, product_id long, score double")
    assert [r.product_id for r in fusion.diversify(df, 4).orderBy("rank").collect()] == [0, 1, 3]
    assert len(fusion.diversify(df, 1).collect()) == 2


def test_pooling_and_scores(spark):
    hits = spark.createDataFrame([(1, p, k + 1) for k, p in enumerate("abacb")], "query_id int, part_id string, hit_rank int")
    ranked = retrieval.pool_hits(hits)
    assert [r.part_id for r in ranked.orderBy("rank").collect()] == ["a", "b", "c"]
    truth = spark.createDataFrame([(1, "b"), (2, "z")], "query_id int, part_id string")
    one, two = retrieval.score_queries(ranked, truth, (1, 5)).orderBy("query_id").collect()
    assert (one["rank"], one.ap, one.recall_1, one.recall_5) == (2, 0.5, 0, 1) and (two["rank"], two.ap, two.recall_5) == (None, 0.0, 0)


def test_search_filters_first(spark):
    points = spark.createDataFrame([(k, [1.0, float(k)], "ab"[k % 2]) for k in range(4)], "point_id int, embedding array<double>, category string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query array<double>")
    assert [r.point_id for r in retrieval.search(points, q, 2, where=F.col("category") == "b").orderBy("hit_rank").collect()] == [1, 3]
    assert retrieval.search(points, q, 2, where=F.col("category") == "c").collect() == []


def test_index(spark, tmp_path):
    points = spark.createDataFrame([(7, [1.0]), (7, [1.0]), (8, [1.0])], "product_id long, embedding array<double>")
    path = str(tmp_path / "index")
    retrieval.append_points(points, path)
    retrieval.append_points(points, path, dedupe=True)
    stored = spark.read.parquet(path)
    assert stored.count() == 3 and stored.select("point_id").distinct().count() == 3
    gone = spark.createDataFrame([(7,)], "product_id long")
    assert retrieval.stats(retrieval.remove_product(stored, gone)).first() == (1, 1, "ready")
    assert retrieval.stats(stored.limit(0)).first().status == "empty"


def test_bootstrap_brackets_the_mean(spark):
    values = spark.createDataFrame([(k, float(k % 2)) for k in range(30)], "i long, value double")
    r = retrieval.bootstrap(values, 200, 1).first()
    assert r.ci_low < r["mean"] < r.ci_high and r == retrieval.bootstrap(values, 200, 1).first()


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(None, 3)], [(5, 3), (3, 5), (9, 8), (8, 5)]])
def test_components(spark, edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in up}


def test_near_pairs_and_leaders(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(20)]
    rows = [(k, base[k % 20] ^ sum(1 << rng.randrange(63) for _ in range(rng.randint(0, 3)))) for k in range(150)]
    df = spark.createDataFrame([(k, h, k % 3) for k, h in rows], "id long, h long, part int")
    want = {(a, b, (x ^ y).bit_count()) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 5}
    assert {tuple(r) for r in dedup.near_pairs(df, "id", "h", 5).collect()} == want
    lead, out = {0: [], 1: [], 2: []}, {}
    for k, h in rows:
        mine = next((i for i, g in lead[k % 3] if (g ^ h).bit_count() <= 5), None)
        if mine is None:
            lead[k % 3].append((k, h))
        out[k] = k if mine is None else mine
    assert {r.id: r.leader for r in dedup.leaders(df, "part", "id", "h", 5).collect()} == out


def test_validation(spark):
    row = {"part_number_raw": "W 712", "brand": "Bosch", "category": "filters", "name": "n", "source_url": "u", "source_site": "s", "collected_by": "c", "is_distractor": "false", "verified": "true"}
    cases = [{}, {"name": ""}, {"category": "x"}, {"brand": "acme"}, {"brand": "", "is_distractor": "true"}, {"brand": ""}, {"verified": "maybe"}, {"part_number_raw": "-/-"}]
    rows = [tuple({**row, **c}.values()) for c in cases]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in row)).coalesce(1)
    labels = spark.createDataFrame([("filters",)], "label string")
    errors = {(r.name, r.category, r.brand, r.is_distractor, r.verified, r.part_number_raw): r.errors for r in quality.validate(df, labels).collect()}
    got = [errors[tuple({**row, **c}[k] for k in ("name", "category", "brand", "is_distractor", "verified", "part_number_raw"))] for c in cases]
    assert [len(e) for e in got] == [0, 1, 1, 1, 0, 1, 1, 1] and quality.validate(df).where("category = 'x'").first().errors == []


def test_cap_and_leakage(spark):
    rows = [(k, "t", "web" if k < 200 else "hitl") for k in range(250)]
    df = spark.createDataFrame(rows, "item long, part string, src string")
    kept = splits.cap_side(df, "part", "item", F.col("src") == "hitl", 100).groupBy("src").count().collect()
    assert {r.src: r["count"] for r in kept} == {"web": 67, "hitl": 33}
    sides = lambda rows: {r.check: r.ok for r in splits.leakage(spark.createDataFrame(rows, "i long, side string, g string, held boolean, made boolean"), "i", "side", "g", F.col("held"), F.col("made")).collect()}
    assert all(sides([(1, "train", "a", False, True), (2, "query", "b", True, False), (3, "gallery", None, False, False)]).values())
    assert sides([(1, "train", "a", True, False), (2, "query", "a", False, True)]) == {"items": True, "groups": False, "heldout": False, "synthetic": False}
    assert sides([(1, "train", None, False, False), (1, "query", None, False, False)])["items"] is False


def test_rate_limit_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, f"u{rng.randrange(4)}", rng.randrange(300)) for k in range(200)]
    df = spark.createDataFrame(rows, "o long, user string, s long").withColumn("ts", F.timestamp_seconds("s"))
    held, want = {}, {}
    for o, user, s in sorted(rows, key=lambda r: (r[2], r[0])):
        mine = held[user] = [t for t in held.get(user, []) if t > s - 60]
        want[o] = len(mine) < 3
        if want[o]:
            mine.append(s)
    assert {r.o: r.accepted for r in rate_limit.accepted(df, "user", "ts", "o", 3, 60).collect()} == want
    path = str(tmp_path / "in")
    df.write.parquet(path)
    stream = rate_limit.accepted_stream(spark.readStream.schema(df.schema).parquet(path), "user", "ts", "o", 3, 60)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {r.o: r.accepted for r in spark.table("limited").collect()} == want


def test_ingest_goes_on_where_it_was(spark, tmp_path):
    path, out, check = (str(tmp_path / x) for x in "abc")
    for batch in ([(1, "x"), (2, "y")], [(2, "y"), (3, "z")]):
        spark.createDataFrame(batch, "item long, v string").write.mode("append").json(path)
        ingest.run_once(ingest.new_items(spark, path, "item long, v string", "item"), out, check)
    done = spark.read.parquet(out)
    assert sorted(r.item for r in done.collect()) == [1, 2, 3]
    assert ingest.to_do(spark.range(6).withColumnRenamed("id", "item"), done.select("item"), spark.createDataFrame([(4,)], "item long"), "item").count() == 2


def test_exploded_bands_are_not_broadcast(spark):
    rows = spark.createDataFrame([(k, k * 0x9E3779B97F4A7C15 % 2**62) for k in range(500)], "i long, h long")
    plan = dedup.near_pairs(rows, "i", "h", 6)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [k#" in plan and "BroadcastHashJoin [k#" not in plan


def test_report_counts_near_pairs_however_many_hashes(spark):
    images = spark.createDataFrame([("a", "s", 0, 500, 500), ("b", "s", 1, 500, 500), ("c", "s", 1 << 40, 500, 500)], "path string, source string, phash long, width int, height int")
    assert audit.report(images, near_limit=2).first().near_pairs is None
    assert audit.report(images, near_limit=None).first().near_pairs == 3


def test_query_reports_whole_tables(spark, monkeypatch):
    monkeypatch.setattr(audit.report, "__defaults__", (audit.SHORT_EDGE, 1))
    assert split_queries.QUERIES["audit_report"](spark, "/root/testdata/sf0.001").first().near_pairs is not None


def test_held_out_types_without_rows(spark, tmp_path):
    # No vector has a held-out label.
    vectors = [[float((k * 7919 + j * 104729 + k * j) % 1009 - 504) for j in range(64)] for k in range(120)]
    spark.createDataFrame([(k, v, 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("split_photos", "split_photo_leaks"):
        same_rows(split_queries.QUERIES[name](spark, str(tmp_path)), split_queries.ORACLE[name], str(tmp_path))


def test_codes_of_keys_with_six_digits(spark, tmp_path):
    spark.range(89_990, 90_020).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    for plans, name in ((listing_queries, "equivalences"), (text_queries, "split_codes")):
        same_rows(plans.QUERIES[name](spark, str(tmp_path)), plans.ORACLE[name], str(tmp_path))


@pytest.mark.parametrize("most", [1, 4, 5, 6, 8, 10])
def test_near_hashes_at_the_radii(spark, most):
    """Differences at most, and one above it, dealt over the four bands in every way."""
    rng = random.Random(most)
    deals = [d for d in product(range(17), repeat=4) if sum(d) in (most, most + 1)]
    whole = lambda x: x - 2**64 if x >= 2**63 else x
    hashes, want = set(), set()
    for d in deals:
        g = rng.getrandbits(64)
        h = g ^ sum(1 << 16 * k + bit for k in range(4) for bit in rng.sample(range(16), d[k]))
        hashes |= {whole(g), whole(h)}
        if sum(d) == most:
            want.add((min(whole(g), whole(h)), max(whole(g), whole(h))))
    got = dedup.near_hashes(spark.createDataFrame([(h,) for h in hashes], "h long"), "h", most).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_product_groups_never_pairs_images(spark, monkeypatch):
    parts = spark.createDataFrame([(p, p, "", "") for p in "pqr"], "part_id string, pos string, mpn string, title string")
    images = spark.createDataFrame([(k, "pq"[k % 2], 5) for k in range(400)] + [(400, "r", 2**40 - 1)], "image long, part_id string, phash long")
    titles, items = parts.select("part_id", "title"), parts.select("mpn", F.col("mpn").alias("mpn_raw"))
    edges, real = [], listings.connected_components
    monkeypatch.setattr(listings, "connected_components", lambda e, a, b: edges.append(e.count()) or real(e, a, b))
    got = {r.part_id: r.group for r in listings.product_groups(parts, titles, items, images).collect()}
    assert got == {"p": "p", "q": "p", "r": "r"} and edges == [1]


@pytest.mark.parametrize("seed", range(3))
def test_parts_by_image_against_pairs(spark, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(63) for _ in range(25)]
    rows = [(k, rng.choice([*"abcdefghijklmnopqrstuvwxyz", None]), base[k % 25] ^ sum(1 << rng.randrange(63) for _ in range(rng.choice([0, 0, 1, 4])))) for k in range(90)]
    rows += [(90, "a", None), (91, "b", None)] + [(100 + k, x, 77) for k, x in enumerate("abcdefgh")] + [(120 + k, x, 7 << 40) for k, x in enumerate("ijklmn")] + [(130, "z", 7 << 40 | 1)]
    images = spark.createDataFrame(rows, "image long, part string, h long")
    pairs = dedup.without_generic(dedup.near_pairs(images, "image", "h", 6), images.select(F.col("image").alias("id"), "part"), 2 + seed)
    near = dedup.near_hashes(images.select("h").distinct(), "h", 6)
    found = lambda e: {r.id: r.component for r in connected_components(e, "a", "b").collect()}
    want = found(pairs.select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    assert want and found(dedup.parts_by_image(images, "part", "h", near, 2 + seed)) == want
