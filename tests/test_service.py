import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import catalogue, dedup, detections, retrieval, service, splits
from millrace.streaming import rate_limit


def test_service_answers(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [0.0, 1.0], "blurry"), (3, [1.0, 1.0], None)], "query_id long, query array<double>, warning string")
    boxes = spark.createDataFrame([(1, 0, "oil_filter", 0.9, [0, 0, 50, 50], 100, 100), (1, 1, "hood", 0.95, [0, 0, 5, 5], 100, 100), (2, 0, "hood", 0.45, [0, 0, 50, 50], 100, 100)], "query_id long, det int, class_name string, confidence double, bbox array<int>, img_w int, img_h int")
    lines = spark.createDataFrame([(1, 0, " W712/80 ", 0.8), (1, 1, "BOSCH filter", 0.7), (1, 2, "weak", 0.2), (3, 0, "brake pad", 0.6)], "query_id long, line int, text string, confidence double")
    images = spark.createDataFrame([(10, 100, [1.0, 0.1]), (11, 101, [0.1, 1.0]), (12, 100, [0.9, 0.0])], "point_id long, product_id long, embedding array<double>")
    products = spark.createDataFrame([(100, "Bosch Filter w71280", 7), (101, "hood", 8), (102, "bosch filter W71280 extra", 9)], "product_id long, name string, category_id long")
    categories = spark.createDataFrame([(7, "Filter"), (0, "brake")], "category_id long, name string")
    got = {r.query_id: r for r in service.search(queries, boxes, lines, images, products, categories, 2).collect()}
    one = got[1]
    # The larger box counts, the brand is the line as read, and the category keeps the other product out.
    assert (one.part_type, one.brand_name, one.part_number, one.confidence) == ("filter", "BOSCH filter", "W71280", 0.9)
    assert [(r.product_id, r.match_type) for r in one.results][0] == (100, "hybrid") and 102 not in {r.product_id for r in one.results}
    # A box below the gate gives no type, so the catalogue isn't filtered; a category with the id 0 is none either.
    assert got[2].part_type is None and got[2].message == "Image quality warning: blurry"
    assert got[3].part_type is None and len(got[3].results) == 2
    nothing = service.search(queries, boxes, lines, images.limit(0), products.limit(0), categories, 2).collect()
    assert {r.query_id: (len(r.results), r.message) for r in nothing}[1] == (0, "No matching products found. Try a clearer photo or different angle.")


def test_lines_of_text(spark):
    lines = spark.createDataFrame([(1, 0, "x", 0.9), (1, 1, "made by ngk", 0.6), (2, 0, "a", 0.7), (2, 1, " b ", 0.7), (3, 0, "c", 0.1)], "query_id long, line int, text string, confidence double")
    assert {r.query_id: (r.text, r.is_brand) for r in detections.best_line(lines).collect()} == {1: ("NGK", True), 2: ("a", False)}
    assert [r.text for r in detections.lines(lines).where("query_id = 2").orderBy("rank").collect()] == ["a", "b"]
    assert detections.lines(lines, brands=["a"]).where("is_brand").count() == 2


def test_catalogue(spark):
    p = spark.createDataFrame([(1, "Bosch A", 3, 0.5), (2, "bosch b", 3, None), (3, "c", 4, None)], "product_id long, name string, category_id long, score double")
    assert [(r.product_id, r.score) for r in catalogue.search(p, 3, "BOSCH").collect()] == [(1, 0.5), (2, 1.0)]
    assert catalogue.search(p, skip=2, limit=5).count() == 1 and catalogue.by_category(p, 9).collect() == []
    ids = spark.createDataFrame([(1,), (1,), (9,)], "product_id long")
    assert [r.product_id for r in catalogue.get_products(p, ids).collect()] == [1]
    asked = spark.createDataFrame([(1, None, None, None), (2, 3, None, None), (3, None, "bosch", "b"), (4, 4, "bosch", None), (5, None, "", ""), (6, 8, None, None)], "query_id long, category_id long, brand_name string, part_number string")
    got = {}
    for r in catalogue.hits(p, asked, 2).orderBy("query_id", "hit_rank").collect():
        got.setdefault(r.query_id, []).append(r.product_id)
    assert got == {1: [1, 2], 2: [1, 2], 3: [1, 2], 5: [1, 2]}


def test_index_files(spark, tmp_path):
    path = str(tmp_path / "index")
    assert retrieval.create_index(spark, path, 3).count() == 0
    retrieval.index_product(spark, path, 7, [1, 0, 0], "brake")
    retrieval.index_product(spark, path, 7, [0, 1, 0])
    points = retrieval.create_index(spark, path, 3)
    assert retrieval.count_points(points) == 2 and retrieval.count_points(points, product_id=7) == 2 and retrieval.count_points(points, product_id=8) == 0
    with pytest.raises(ValueError):
        retrieval.create_index(spark, path, 4)
    products = spark.createDataFrame([(1, "u", "c"), (2, "", "c"), (3, "u", None)], "product_id long, image_url string, category_name string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None)], "product_id long, embedding array<double>")
    assert retrieval.rebuild(products, vectors, path) == (1, 1)
    assert retrieval.create_index(spark, path, 3, clear=True).count() == 0
    mock = retrieval.mock_points(spark, 20, 8, 1)
    assert retrieval.norm_faults(mock, 8).count() == 0 and mock.collect() == retrieval.mock_points(spark, 20, 8, 1).collect()
    left, _, status = retrieval.delete_product(mock, mock, 3)
    assert left.count() == 19 and status == 200 and retrieval.delete_product(mock, mock, 99)[2] == 404


@pytest.mark.parametrize("most", [0, 3, 6, 11, 12, 20])
def test_near_pairs_against_all(spark, most, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 64)
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(60)]
    rows = [(k, (h := base[k % 60] ^ sum(1 << rng.randrange(64) for _ in range(k % 7)) & (2**64 - 1)) - (2**64 if h >= 2**63 else 0)) for k in range(300)]
    rows += [(1000 + k, rows[5][1]) for k in range(4)] + [(2000, None)]
    got = sorted((r.a, r.b, r.distance) for r in dedup.near_pairs(spark.createDataFrame(rows, "i long, h long"), "i", "h", most).collect())
    ok = [(i, h & (2**64 - 1)) for i, h in rows if h is not None]
    assert got == sorted((a, b, d) for x, (a, g) in enumerate(ok) for b, h in ok[x + 1 :] if (d := bin(g ^ h).count("1")) <= most)


def test_leaders_and_limits_in_order(spark):
    rng = random.Random(2)
    rows = [(k % 3, k, rng.getrandbits(8)) for k in range(400)] + [(None, 900, 1), (1, 901, None)]
    got = {r.o: r.leader for r in dedup.leaders(spark.createDataFrame(rows, "key long, o long, h long").repartition(5), "key", "o", "h", 2).collect()}
    lead, want = {}, {}
    for key, o, h in rows:
        if h is not None:
            mine = lead.setdefault(key, [])
            near = next((p for p, g in mine if bin(g ^ h).count("1") <= 2), None)
            if near is None:
                mine.append((o, h))
            want[o] = o if near is None else near
    assert got == want
    events = [(k % 2, f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}", k) for k in range(300)]
    df = spark.createDataFrame(events, "u long, t string, n long").withColumn("t", F.to_timestamp("t"))
    ok = {r.n for r in rate_limit.accepted(df.repartition(4), "u", "t", "n", 3, 20.0).where("accepted").collect()}
    held, want = {0: [], 1: []}, set()
    for u, _, n in events:
        held[u] = [x for x in held[u] if x > n - 20]
        if len(held[u]) < 3:
            held[u].append(n), want.add(n)
    assert ok == want


def test_splits(spark):
    rows = spark.createDataFrame([(c, "t", k) for k, c in enumerate("aabbcc")] + [("b", "u", 9)], "cluster string, label string, k long")
    assert sorted(r.k for r in splits.one_label_clusters(rows, "cluster", "label", [F.desc("k")]).collect()) == [1, 5]
    with pytest.raises(ValueError):
        splits.heldout_types(rows, "label", fixed=["t", "zz"])
    groups = spark.createDataFrame([("p1", 1), ("p2", 1), ("p2", 2), ("p3", 2), ("p4", 4)], "part string, cluster long")
    assert {r.part: r.group for r in splits.part_groups(groups, "part", "cluster").collect()} == {"p1": "p1", "p2": "p1", "p3": "p1", "p4": "p4"}
    n = splits.split_ranks(spark.range(25), "id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in n} == {"train": 20, "valid": 2, "test": 3}
    assert sorted(r["rank"] for r in splits.shuffled_rank(spark.range(500), "id", 3).collect()) == list(range(1, 501))


def test_points_of_a_stream(spark, tmp_path):
    from millrace.streaming import ingest

    src, index = str(tmp_path / "in"), str(tmp_path / "index")
    for k in range(2):
        spark.createDataFrame([(k, [1.0, 0.0], {"category": "c"})], "product_id long, embedding array<float>, payload map<string,string>").write.mode("append").json(src)
        points = spark.readStream.schema("product_id long, embedding array<float>, payload map<string,string>").json(src)
        ingest.index_stream(points, index, str(tmp_path / "checkpoint"))
        found = spark.read.parquet(index)
        assert sorted(r.product_id for r in found.collect()) == list(range(k + 1)) and found.select("point_id").distinct().count() == k + 1
