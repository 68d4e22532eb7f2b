import random

import numpy as np
import pytest

from millrace.llm import minhash
from tests.llm import brute


def made(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 90))] for _ in range(n // 5)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(words) if rng.random() < 0.8 else " ".join(words).upper()))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed, 400)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_duplicates(rows)


def test_chains_inside_a_bucket(spark):
    # Each document is near the next and far from the ends: one component, though few link to the bucket's least.
    words = [f"x{k}" for k in range(300)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 120])) for k in range(25)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_duplicates(rows) and len({c for _, c in got.values()}) == 1


def test_table_over_its_folder(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute.near_duplicates([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \n\t", 1), (4, "Ab c", 1), (5, "aB  C", 1), (6, "ab c d", 1), (7, "É b c", 1), (8, "é b c", 1), (9, "z " * 30000, 1), (10, "z " * 90, 1), (10, "z " * 90, 1), (None, "ab c", 1)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].component_id for k in range(1, 11)] == [1, 2, 3, 4, 4, 6, 7, 8, 9, 9]
    assert [by[k].n_shingles for k in (1, 2, 3, 4, 6, 9, None)] == [0, 0, 0, 1, 1, 1, 1]
    assert by[None].component_id is None and by[None].kept is False
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimate_is_near_the_truth():
    rng = random.Random(7)
    a = [f"t{rng.randrange(10**6)}" for _ in range(600)]
    for share in (0.3, 0.85, 1.0):
        b = [x if rng.random() < share ** 0.2 else f"u{rng.randrange(10**6)}" for x in a]
        x, y = (minhash.shingle_hashes(" ".join(w), minhash._Hashes()) for w in (a, b))
        truth = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs(float(minhash.estimate(minhash.signature(x)[1], minhash.signature(y)[1])) - truth) < 0.16


def test_large_family_in_blocks(spark, monkeypatch):
    # Families and buckets larger than a block: every block meets the first, then what is outside the largest component the rest.
    rows = made(5, 300)
    words = [f"y{k}" for k in range(400)]
    rows += [(1000 + k, " ".join(words[3 * k : 3 * k + 100])) for k in range(90)]
    rows += [(2000 + k, " ".join([*words[:150], *(f"z{k}{j}" for j in range(k % 26))])) for k in range(60)]
    for percent in (85, 80):
        want = brute.near_duplicates(rows, percent)
        for block, shingles in ((8, 2**19), (1024, 700)):
            monkeypatch.setattr(minhash, "BLOCK", block)
            monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
            assert got == want


def test_repeated_ids_with_other_texts(spark):
    words = [f"w{k}" for k in range(60)]
    near = lambda base, k: " ".join([*(f"{base}{w}" for w in words), f"end{k}"])
    # 5 stands for two texts, each with a near copy: all are one component, through the repeated id.
    rows = [(5, near("a", 0)), (5, near("b", 0)), (3, near("a", 1)), (9, near("b", 2)), (7, near("c", 0)), (5, near("b", 0))]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (5, 3, False), (7, 7, True), (9, 3, False)]


def test_bands_follow_the_threshold(spark):
    assert minhash.banding(85) == (24, 6) and minhash.banding(80) == (29, 5)
    for percent in range(10, 100):
        bands, rows = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1 / minhash.MISSED and bands * rows <= minhash.MINIMA
    rows = made(3, 400)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    assert got == brute.near_duplicates(rows, 80) != brute.near_duplicates(rows)
