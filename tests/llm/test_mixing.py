import re
from collections import defaultdict

import pytest

from millrace.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights):
    """Excess above three times the size handed round until none is left."""
    total = sum(sizes)
    target = [total * w / sum(weights) for w in weights]
    stopped = set()
    while True:
        over = [k for k, t in enumerate(target) if t > 3 * sizes[k] + 1e-9]
        if not over:
            return target
        excess = sum(target[k] - 3 * sizes[k] for k in over)
        for k in over:
            target[k] = 3.0 * sizes[k]
        stopped.update(over)
        rest = [k for k in range(len(sizes)) if k not in stopped]
        for k in rest:
            target[k] += excess * weights[k] / sum(weights[j] for j in rest)


def check(rows, got, near):
    by_source = defaultdict(int)
    for _, text, source in rows:
        by_source[source] += words(text)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, plain_targets([by_source[s] for s in order], [k % 3 + 1 for k in range(len(order))])))
    source_of = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == by_source[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= near * want[s] + 2, s


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = mixing.op7(spark, sf).collect()
    check(rows, got, 0.01)
    assert sorted(got) == sorted(mixing.op7(spark, sf).collect())
    assert {r.doc_id: r.size for r in got} == {i: words(t) for i, t, _ in rows}


def test_skew_and_odd_rows(spark):
    rows = [(k, "w " * (k % 50), "big") for k in range(400)] + [(1000 + k, "a b\nc\x0bd", "small") for k in range(3)] + [(2000, None, "none"), (2001, "x y z " * 30, None), (2002, "", ""), (2003, "é " * 20000, "long")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    check(rows, mixing.mix(docs).collect(), 0.02)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).collect() == []
    only = spark.createDataFrame([(1, None, "a"), (None, "  ", "b")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(only).collect()] == [(0, 0.0, 0)] * 2


def test_schedule_keeps_proportions_everywhere(spark):
    plan = [{"no": k, "source": str(k), "docs": 1, "size": 1, "target": 1.0, "blocks": 10**6, "slots": w} for k, w in enumerate((1000.0, 2000.0, 3000.0))]
    rows = sorted(mixing._schedule(spark, plan).collect())
    assert [r.slot for r in rows] == list(range(6000))
    seen = [0, 0, 0]
    for r in rows:
        assert r.turn == seen[r.no]
        seen[r.no] += 1
        assert all(abs(n - (r.slot + 1) * w / 6) < 4 for n, w in zip(seen, (1, 2, 3)))


def test_pieces_add_up(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    pieces = mixing.schedule(docs).selectExpr("doc_id", "end - begin AS n").groupBy("doc_id").sum("n").collect()
    assert {r.doc_id: r["sum(n)"] for r in pieces} == taken


@pytest.mark.parametrize("at", ["sf0.001", "sf0.01"])
def test_sql(spark, at):
    from tests.llm.duck import same_rows

    same_rows(mixing.op7(spark, f"/root/testdata/{at}"), mixing.ORACLE_OP7, f"/root/testdata/{at}")


def test_repeated_rows_and_clashing_names(spark):
    # Rows of one id, text and source; rows of one id and text in two sources; columns named like the operator's own.
    rows = [(1, "a b c d", "s", "x")] * 200 + [(1, "a b c d", "t", "y"), (1, "other words", "s", "z"), (2, " \n", "s", "w"), (3, "p q\nr  s", "t", "v")]
    docs = spark.createDataFrame([(*r, 1, "h", 7) for r in rows], "doc_id long, text string, source string, lang string, size int, h string, many int")
    taken = defaultdict(int)
    for r in mixing.mix(docs).collect():
        taken[r.doc_id, r.size, r.source_size] += r.taken
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        assert (r.lang, r.source) in {("x", "s"), ("y", "t"), ("z", "s"), ("v", "t")} and r.h == "h"
        whole = next(t for i, t, s, la in rows if la == r.lang)
        assert whole.startswith(r.text) and r.text
        got[r.source] += words(r.text)
    sizes = {"s": 802, "t": 8}
    assert {s: sum(n for (_, _, size), n in taken.items() if size == sizes[s]) for s in sizes} == got
