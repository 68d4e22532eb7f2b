import hashlib
import random
from collections import defaultdict

from millrace.llm.line_dedup import dedup_lines
from tests.llm.brute import ascii_lower

BLANK = "\t\n\x0b\x0c\r "


def plain(rows):
    low = -(2**63)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = ascii_lower(line.strip(BLANK))
            if len(key) >= 40:
                holders[key].add(low if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = []
        for line in lines:
            h = holders.get(ascii_lower(line.strip(BLANK)), ())
            if len(h) < 5 or max(h) == (low if i is None else i):
                keep.append(line)
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    pool = ["short", "", " \t", "É" * 39, "É" * 40, "x" * 40, "Long line number one, with some words in it", "LONG LINE NUMBER ONE, with some words in it\x0b", "  another line that is long enough to count here\r", "y" * 5000]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (None, pool[6]), (None, pool[7]), (5, pool[6] + "\nother"), rows[7], rows[7]]
    got = dedup_lines(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_lines string")).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=key) == sorted(plain(rows), key=key)
    assert any(r.n_dropped for r in got)


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_digest_is_of_the_text(spark, sf):
    from millrace.llm.line_dedup import op6

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain([(r.doc_id, r.text) for r in docs])}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op6(spark, sf).collect()} == want
