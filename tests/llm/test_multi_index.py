import numpy as np
import pandas as pd

from millrace.llm import multi_index


def brute(rows, k, every):
    ok = sorted((i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v))
    out = {}
    for i, q in ok:
        if i % every == 0:
            out[i] = sorted((-float((v * q).sum()), j) for j, v in ok if j != i and len(v) == len(q))[:k]
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = [(i, [float(x) for x in base[i % 30] + rng.normal(scale=0.4, size=16)]) for i in range(1500)]
    rows += [(1500 + i, rows[40][1]) for i in range(40)]
    got = {}
    for r in multi_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append(r)
    want = brute(rows, 20, 20)
    assert set(got) == set(want)
    hit = 0
    vectors = dict(rows)
    for i, rs in got.items():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, 21))
        assert all(abs(r.score - np.dot(vectors[i], vectors[r.vec_id])) < 1e-9 for r in rs)
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        hit += len({r.vec_id for r in rs} & {j for _, j in want[i]})
    assert hit / sum(map(len, want.values())) >= 0.9
    assert [r.vec_id for r in got[40]][:20] == [j for _, j in want[40]]


def test_few_and_odd_rows(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, [3.0, 2.0, 1.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [float("nan"), 1.0, 1.0]), (5, [None, 1.0, 1.0]), (6, []), (20, [1.0]), (40, [2.0]), (7, [-1.0, 0.5, 2.0]), (7, [-1.0, 0.5, 2.0]), (None, [1.0, 1.0, 1.0]), (60, [float("inf"), 0.0, 0.0])]
    got = multi_index.nearest(spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, rank int")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 10.0), (0, 2, 7, 6.0), (0, 3, 7, 6.0), (20, 1, 40, 2.0), (40, 1, 20, 2.0)]


def test_empty(spark):
    assert multi_index.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_traversal_falls():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=7), rng.normal(size=5)
    many = rng.integers(0, 4, 35)
    cells = multi_index.traverse(a, b, many, int(many.sum()))
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sums == sorted(sums, reverse=True) and sorted(cells) == np.flatnonzero(many).tolist()


def test_table_recall(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, 20, 20)
    got = {(r.query_id, r.vec_id) for r in multi_index.op10(spark, sf).collect()}
    assert sum((i, j) in got for i, js in want.items() for _, j in js) >= 0.9 * sum(map(len, want.values()))


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [2.0, 0.5]), (3, [0.5, 3.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in multi_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect())
    assert got == sorted([(20, 1, 3, 2.0), (20, 2, 3, 0.5), (20, 3, 20, 0.0), (20, 1, 3, 3.0), (20, 2, 3, 0.5), (20, 3, 20, 0.0)])


def test_bounded_sample(spark):
    from pyspark.sql import functions as F

    from millrace.llm.sampling import bounded

    df = spark.range(60_000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    for most in (10, 500, 20_000):
        for key in ("id", "k"):
            n = bounded(df, "x", F.col(key), most).count()
            assert most // 4 <= n <= most, (most, key, n)
    assert bounded(df, "x", F.col("id"), 60_000).count() == 60_000


def test_what_travels_with_a_query_does_not_follow_the_cells(spark):
    rng = np.random.default_rng(4)
    a, b, many = rng.normal(size=40), rng.normal(size=30), rng.integers(0, 5, 1200)
    total = int(many.sum())
    for enough in (1, total // 40, total // 3, total - 1):
        cells, last = multi_index.traverse(a, b, many, enough), multi_index.last_sum(a, b, many, enough)
        assert sorted(cells) == [c for c in np.flatnonzero(many) if a[c // 30] + b[c % 30] >= last]
    assert multi_index.last_sum(a, b, many, total) == -np.inf
    q = spark.createDataFrame([(0, 20, [1.0, 2.0], 2)], "row long, id long, v array<double>, dim int")
    books = {2: (np.ones((3, 1)), np.ones((2, 1)))}
    assert multi_index._visits(q, books, {2: np.ones(6, np.int64)}, {2: 4}).dtypes[4:] == [("least", "double")]
    v = rng.normal(size=(1000, 64)).astype(np.float32)
    got = multi_index._entries({64: (v[:8, :32].astype(float), v[:8, 32:].astype(float))})(pd.DataFrame({"row": np.arange(1000), "id": np.arange(1000), "v": list(v), "dim": 64, "shard": 0}))
    assert len(got["blob"][0]) / 1000 * multi_index.SHARD_ROWS < 24e6
