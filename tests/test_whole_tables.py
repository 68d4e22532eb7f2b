"""Queries over whole tables. Their SQL is held against them in test_sql; here is what SQL does not say."""

import pytest

from millrace.operators import retrieval
from millrace.plans import text_queries, vector_queries
from tests.duck import same_rows


def test_match_key_join_counts_all_of_part(spark):
    sf = "/root/testdata/sf0.01"
    assert max(r.last_b for r in text_queries.match_key_join(spark, sf).collect()) > 1000


@pytest.mark.parametrize("name", ["vector_topk_exact", "eval_per_query", "fusion_weighted", "fusion_diversity"])
def test_larger_tables(spark, name):
    sf = "/root/testdata/sf0.1"
    df = vector_queries.QUERIES[name](spark, sf)
    same_rows(df, vector_queries.ORACLE[name], sf)
    assert {r.query_id for r in df.collect()} == set(range(0, 2000, 50))


@pytest.mark.parametrize("at", ["sf0.01", "sf0.1"])
def test_cells_find_nine_of_ten(spark, at):
    exact, found = ([(r.query_id, r.point_id) for r in vector_queries.QUERIES[n](spark, f"/root/testdata/{at}").collect()] for n in ("vector_topk_exact", "vector_topk_cells"))
    assert len(found) == len(exact) and len(set(found) & set(exact)) >= 0.9 * len(exact)
    assert all(q != p for q, p in found)


def test_all_cells_are_exact_search(spark):
    points = spark.createDataFrame([(k, [0.05, 1.0 + k, (k * 7 % 5) - 2.0]) for k in range(40)], "point_id long, embedding array<double>")
    q = spark.createDataFrame([(k, [1.0, 0.1 * k, 0.5]) for k in range(6)], "query_id long, query array<double>")
    got, want = retrieval.search_cells(points, q, 10, cells=5, share=1.0).collect(), retrieval.search(points, q, 10).collect()
    assert sorted((r.query_id, r.hit_rank, r.point_id) for r in got) == sorted((r.query_id, r.hit_rank, r.point_id) for r in want) and len(got) == 60


def test_queries_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    sf = "/root/testdata/sf0.001"
    for name in ("vector_topk_exact", "eval_per_query"):
        same_rows(vector_queries.QUERIES[name](spark, sf), vector_queries.ORACLE[name], sf)


def test_ties_odd_vectors_and_nothing(spark):
    points = spark.createDataFrame([(5, [1.0, 0.0]), (3, [2.0, 0.0]), (9, [0.0, 0.0]), (7, None), (1, [0.0, 1.0])], "point_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, query array<double>")
    got = sorted((r.query_id, r.hit_rank, r.point_id, r.score) for r in retrieval.search(points, q, 3).collect())
    assert got == [(1, 1, 3, 1.0), (1, 2, 5, 1.0), (1, 3, 1, 0.0), (2, 1, 1, 0.0), (2, 2, 3, 0.0), (2, 3, 5, 0.0)]
    assert retrieval.search(points, q.limit(0), 3).collect() == [] == retrieval.search(points.limit(0), q, 3).collect()
    lists = retrieval.search_batch(points.limit(0), q, 3).collect()
    assert {r.query_id: r.hits for r in lists} == {1: [], 2: []}
