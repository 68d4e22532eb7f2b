from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import bpe, quality
from tests.llm import brute, test_line_dedup, test_mixing


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    steps = dict(corpus_pipeline.STAGES)
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}

    good = steps["quality classifier"](spark, docs, sf).cache()
    model = quality.train(docs, quality.graded(spark.read.parquet(f"{sf}/labels.parquet")))
    want = {r.doc_id for r in quality.grade(docs, model).collect() if r.kept}
    assert good.columns == columns and {r.doc_id: r for r in good.collect()} == {i: before[i] for i in want}

    lines = steps["line dedup"](spark, good, sf).cache()
    want = {i: t for i, _, _, t in test_line_dedup.plain([(r.doc_id, r.text) for r in good.collect()])}
    assert lines.columns == columns and {r.doc_id: r.text for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    once = steps["minhash near-dedup"](spark, lines, sf).cache()
    groups = brute.near_duplicates(list(want.items()), corpus_pipeline.NEAR)
    assert sorted(r.doc_id for r in once.collect()) == sorted(i for i, (_, c) in groups.items() if c == i)

    mix = steps["mixing sources"](spark, once, sf).cache()
    rows = once.collect()
    size = {r.doc_id: test_mixing.words(r.text) for r in rows}
    taken, source = defaultdict(int), {r.doc_id: r.source for r in rows}
    got = mix.collect()
    for r in got:
        taken[r.doc_id] += test_mixing.words(r.text)
    assert mix.columns == columns and all(n <= 3 * size[i] for i, n in taken.items())
    by = Counter()
    for i, n in size.items():
        by[source[i]] += n
    order = sorted(by)
    for s, t in zip(order, test_mixing.plain_targets([by[s] for s in order], [k % 3 + 1 for k in range(len(order))])):
        assert sum(n for i, n in taken.items() if source[i] == s) == pytest.approx(t, rel=0.02)

    library = Tokenizer.from_file(bpe.default_path())
    want = Counter((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in got)
    assert Counter((r.doc_id, tuple(r.ids)) for r in steps["bpe encoding"](spark, mix, sf).collect()) == want


def test_repeated_and_odd_rows(spark, sf):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "A b c d e f g", "en", "t", 13), (None, "a b c d e f g", "en", "s", 1), (3, None, None, None, None), (4, "", "", "", 0), (1, "other text", "en", "s", 10)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, sf).collect()
        assert stage(spark, docs.limit(0), sf).collect() == []
        if name == "line dedup":
            assert Counter(r.text for r in out) == Counter(r[1] for r in rows)
        if name == "minhash near-dedup":
            assert Counter(r.doc_id for r in out) == {1: 2, None: 1, 3: 1, 4: 1}
        if name == "mixing sources":
            assert all(r.text for r in out)


def test_first_stage_with_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    select = dict(corpus_pipeline.STAGES)["quality classifier"]
    odd = [(None, None, None, None, None), (10**6, None, "en", "s", 0), (10**6 + 1, "", None, "s", 0), (10**6 + 2, " \n", "en", None, 2)]
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame(odd, docs.schema))
    once, both = (Counter((r.doc_id, r.text) for r in select(spark, d, sf).collect()) for d in (docs, twice))
    # Repeated rows don't change the model and stay as often as they are; rows without words go, whatever else they hold.
    assert both == {k: 2 * n for k, n in once.items()} and once
    extra = select(spark, docs.withColumn("kept", docs["n_chars"]).withColumn("p_good", docs["n_chars"]), sf)
    assert {r.doc_id for r in extra.collect()} == {i for i, _ in once} and extra.columns == [*docs.columns, "kept", "p_good"]
    assert select(spark, docs.limit(0), sf).collect() == []


def test_near_copies_from_80_percent(spark, sf):
    words = [f"w{k}" for k in range(104)]
    # The second text of each pair holds 90, 82 and 79 of the first one's 100 shingles.
    rows = [(10 * n + k, " ".join(f"{n}{w}" for w in words[: len(words) - k * cut]), "en", "s", 1) for n, cut in enumerate((10, 18, 21)) for k in range(2)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    out = dict(corpus_pipeline.STAGES)["minhash near-dedup"](spark, docs, sf)
    want = brute.near_duplicates([r[:2] for r in rows], 80)
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, (_, c) in want.items() if c == i) == [0, 10, 20, 21]


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids"]
