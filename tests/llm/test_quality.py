import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import quality


def split(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rated = quality.graded(spark.read.parquet(f"{path}/labels.parquet"))
    return docs, rated.where("doc_id % 4 != 0"), {r.doc_id: r.grade for r in rated.where("doc_id % 4 = 0").collect()}


def test_held_out_accuracy(spark):
    docs, rated, held = split(spark, "/root/testdata/sf0.01")
    model = quality.train(docs, rated)
    assert (np.diff(model.thresholds) > 0).all()
    rows = {r.doc_id: r for r in quality.grade(docs, model).collect()}
    assert len(rows) == docs.count()
    clean = [rows[i].kept for i, g in held.items() if g == 2]
    poor = [rows[i].kept for i, g in held.items() if g < 2]
    assert np.mean(clean) >= 0.97 and np.mean(poor) <= 0.2
    means = [np.mean([rows[i].expected_grade for i, g in held.items() if g == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    kept = sorted(r.doc_id for r in quality.select(docs, model).collect())
    assert kept == sorted(i for i, r in rows.items() if r.kept)


def test_model_reruns_agree(spark, sf):
    docs, rated, _ = split(spark, sf)
    a, b = quality.train(docs, rated), quality.train(docs.repartition(3), rated)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, " \n", 1.0), (None, "some words", 1.0), (4, "x" * 100_000, 1.0), (4, "x" * 100_000, 1.0)], "doc_id long, text string, kept double")
    labels = spark.createDataFrame([(1, 1, 0), (4, None, 1), (None, 1, 1), (5, 0, None), (6, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id, r.grade) for r in quality.graded(labels).collect()) == [(1, 2), (5, 1), (6, 0)]
    model = quality.train(docs, quality.graded(labels))
    rows = quality.grade(docs, model).collect()
    assert len(rows) == 6 and all(r.expected_grade == 0 and not r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert quality.grade(docs.limit(0), model).collect() == [] == quality.select(docs.limit(0), model).collect()
    empty = quality.train(docs.limit(0), quality.graded(labels.limit(0)))
    assert all(r.kept for r in quality.grade(docs, empty).collect() if r.doc_id in (None, 4))


def plain_probability(s, t, y):
    """P(grade = y) of the cumulative-link model."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    above = [1.0, *(sig(s - x) for x in t), 0.0]
    return above[y] - above[y + 1]


def test_slopes_against_differences():
    rng = np.random.default_rng(2)
    s, t, y = rng.normal(size=50), np.array([-0.7, 0.9]), rng.integers(0, 3, 50)
    by_score, by_threshold = quality.slopes(s, t, y)
    loss = lambda s, t: -sum(math.log(plain_probability(a, t, b)) for a, b in zip(s, y))
    e = 1e-6
    for k in range(50):
        step = np.eye(50)[k] * e
        assert by_score[k] == pytest.approx((loss(s + step, t) - loss(s - step, t)) / (2 * e), abs=1e-5)
    for k in range(2):
        step = np.eye(2)[k] * e
        assert by_threshold[k] == pytest.approx((loss(s, t + step) - loss(s, t - step)) / (2 * e), abs=1e-4)


def test_fit_against_plain_steps():
    # The same steps on the likelihood, one document and one feature at a time.
    rng = random.Random(4)
    rows, grades = [], []
    for _ in range(300):
        g = rng.choice([0, 1, 2])
        rows.append(np.array(sorted({rng.randrange(5) + 10 * g if rng.random() < 0.7 else 100 + rng.randrange(40) for _ in range(6)}), dtype=np.int64))
        grades.append(g)
    got = quality.fit(rows, np.array(grades))
    # Features that fall on the grades unevenly enough.
    use = []
    for f in sorted({int(x) for r in rows for x in r}):
        g2 = 0.0
        for has in (True, False):
            cells = [sum((f in r) == has for r, y in zip(rows, grades) if y == g) for g in range(3)]
            for g, c in enumerate(cells):
                expected = grades.count(g) * sum(cells) / len(rows)
                g2 += 2 * c * math.log(c / expected) if c else 0
        if g2 >= quality.LEAST_TELLING:
            use.append(f)
    assert 5 <= len(use) < 60
    w, seen = dict.fromkeys(use, 0.0), dict.fromkeys(use, 1e-8)
    share = [min(max(sum(y >= k for y in grades) / len(grades), 0.01), 0.99) for k in (1, 2)]
    t = [-math.log(p / (1 - p)) for p in share]
    base, gap, seen_t = t[0], math.log(max(t[1] - t[0], 0.1)), [1e-8, 1e-8]
    order, mean, steps = np.random.default_rng(0), dict.fromkeys([*use, "base", "gap"], 0.0), 0
    for epoch in range(quality.PASSES):
        perm = order.permutation(len(rows))
        for at in range(0, len(rows), quality.STEP_DOCS):
            pick = perm[at : at + quality.STEP_DOCS].tolist()
            t = [base, base + math.exp(gap)]
            scores = [sum(w.get(int(f), 0.0) for f in rows[i]) for i in pick]
            slope, by_t = quality.slopes(np.array(scores), np.array(t), np.array([grades[i] for i in pick]))
            grad = dict.fromkeys(use, 0.0)
            for i, x in zip(pick, slope):
                for f in rows[i]:
                    if int(f) in grad:
                        grad[int(f)] += x / len(pick)
            for f, x in grad.items():
                if x:
                    seen[f] += x * x
                    rate = quality.RATE / math.sqrt(seen[f])
                    moved = w[f] - rate * x
                    w[f] = math.copysign(max(abs(moved) - rate * quality.PULL, 0.0), moved)
            for k, x in enumerate(((by_t[0] + by_t[1]) / len(pick), math.exp(gap) * by_t[1] / len(pick))):
                seen_t[k] += x * x
                step = quality.RATE * x / math.sqrt(seen_t[k])
                base, gap = (base - step, gap) if not k else (base, min(max(gap - step, -6), 4))
            if epoch >= quality.PASSES // 2:
                steps += 1
                for f in use:
                    mean[f] += w[f]
                mean["base"], mean["gap"] = mean["base"] + base, mean["gap"] + gap
    assert {int(f) for f in np.flatnonzero(got.weights)} <= set(use)
    assert [float(got.weights[f]) for f in use] == pytest.approx([mean[f] / steps for f in use], rel=1e-5, abs=1e-6)
    assert got.thresholds.tolist() == pytest.approx([mean["base"] / steps, mean["base"] / steps + math.exp(mean["gap"] / steps)], rel=1e-9)


def test_query_against_plain_scores(spark, sf):
    # Every document's grade from the model's weights, one feature at a time.
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, quality.graded(spark.read.parquet(f"{sf}/labels.parquet")))
    got = {r.doc_id: r for r in quality.op3(spark, sf).collect()}
    for d in docs.collect():
        found = quality.features(d.text or "", quality._Words())
        s = math.fsum(float(model.weights[f]) for f in found)
        tails = [1 / (1 + math.exp(t - s)) if len(found) else 0.0 for t in model.thresholds]
        r = got[d.doc_id]
        assert r.expected_grade == pytest.approx(sum(tails), abs=1e-6) and r.p_good == pytest.approx(tails[-1], abs=1e-6)
        assert r.kept == (tails[-1] >= quality.KEEP) or abs(tails[-1] - quality.KEEP) < 1e-6
    assert len(got) == docs.count()


def test_fit_takes_less_than_its_features():
    # All features in one array, their documents beside them and copies by grade were several times the sample.
    rng = np.random.default_rng(7)
    rows = [rng.integers(0, quality.DIMENSIONS, 3_000).astype(np.int32) for _ in range(4_000)]
    grades = rng.integers(0, quality.GRADES, len(rows))
    tracemalloc.start()
    try:
        quality.fit(rows, grades)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < sum(r.nbytes for r in rows)


def test_first_rows():
    # Two batches, the second cut from a longer one; ids repeat across them, and the smaller hash counts, without features none.
    schema = pa.schema([("doc_id", pa.int64()), ("places", pa.list_(pa.int32())), ("mixed", pa.int64()), ("grade", pa.int32())])
    one = pa.record_batch([[5, 2, 9], [[7, 8], [1], [3]], [4, 6, 1], [2, 0, 1]], schema=schema)
    two = pa.record_batch([[0, 5, 1, 2], [[6], [9], [], [2, 4]], [0, 3, 2, 8], [1, 2, 1, 0]], schema=schema).slice(1)
    rows, grades = quality._first_rows(pa.Table.from_batches([one, two]))
    assert [r.tolist() for r in rows] == [[1], [9], [3]] and grades.tolist() == [0, 2, 1]
    rows, grades = quality._first_rows(pa.Table.from_batches([], schema))
    assert rows == [] and len(grades) == 0
