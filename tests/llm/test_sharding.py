import zlib
from collections import Counter
from hashlib import md5

import pytest

from millrace.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 97, 1000, 1024])
def test_permutation(n):
    assert sorted(sharding.permute(k, n) for k in range(n)) == list(range(n))


def test_columns_equal_numbers(spark):
    for n in (1, 3, 7, 500, 1023):
        rows = sharding.permuted(spark.range(n), "id", n, "p").collect()
        assert {r.id: r.p for r in rows} == {k: sharding.permute(k, n) for k in range(n)}


def test_table(spark, sf):
    rows = sharding.op8(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    order = sorted(docs, key=lambda i: md5(f"{i}:{md5(docs[i].encode()).hexdigest()}".encode()).hexdigest())
    place = {i: sharding.permute(k, len(docs)) for k, i in enumerate(order)}
    assert {r.doc_id: (r["shard"], r.slot) for r in rows} == {i: (p % 40, p // 40) for i, p in place.items()}
    assert all(r.size == len(docs[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in rows)


def test_sql(spark, sf):
    from tests.llm.duck import same_rows

    same_rows(sharding.op8(spark, sf), sharding.ORACLE_OP8, sf)


def test_a_row_that_is_most_of_the_table(spark, monkeypatch):
    from millrace.operators import ordering

    monkeypatch.setattr(ordering, "COPIES", 16)
    rows = [(1, "t")] * 100 + [(k, "t") for k in range(50)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=7).collect()
    many = Counter(r["shard"] for r in got)
    assert len(got) == 150 and max(many.values()) - min(many.values()) <= 1
    assert sorted((r["shard"], r.slot) for r in got) == [(s, k) for s in range(7) for k in range(many[s])]


def test_odd_rows(spark):
    rows = [(k, "t", 1) for k in range(83)] + [(1, "t", 1)] * 20 + [(None, None, 2), (None, "é", 2), (5, "", 2), (6, "x" * 10**6, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard(docs).collect()
    many = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(many.values()) - min(many.get(k, 0) for k in range(40)) <= 1
    assert sorted((r["shard"], r.slot) for r in got) == [(s, k) for s in range(40) for k in range(many[s])]
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard(docs).collect()))
    assert sharding.shard(docs.limit(0)).collect() == []
