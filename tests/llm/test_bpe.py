import gc
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe, texts


@pytest.fixture(scope="module")
def both():
    path = bpe.default_path()
    v = bpe.Vocabulary(path)
    words = [" the", " and", "the", " cat", "\n", ".", " re"]
    lexicon = bpe.Lexicon(bpe.compile_lexicon({w.encode(): v.merge(w.encode()) for w in words}))
    return Tokenizer.from_file(path), bpe.Encoder(v, lexicon)


def same(both, text):
    library, enc = both
    ids = library.encode(text, add_special_tokens=False).ids
    got = enc.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert enc.decode(got) == library.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["", " ", "  ", "   ", "a  b", "a \n b", "\n \n", "x ", "it's we'll", " <|endoftext|> <|endoftext|>", "x" * 5000 + "ab" * 3000, "é漢😀 ٣", "end.\nStart  of", "   x"])
def test_cases(both, text):
    same(both, text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(list("ab  \n\t's1.é漢,|<\x1c\x85") + ["<|endoftext|>", " the", "'ll"]), max_size=25).map("".join))
def test_any_text(both, text):
    same(both, text)


def test_merge_many_equals_merge():
    v = bpe.Vocabulary(bpe.default_path())
    rng = random.Random(3)
    words = [bytes(rng.choice(b"theandrsio \xc3\xa9") for _ in range(rng.randint(0, 90))) for _ in range(3000)]
    assert [np.frombuffer(m, "<u4").tolist() for m in v.merge_many(words)] == [v.merge(w) for w in words]


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["tap", "taps", "top", "tops", "", "stop", "stops"])}
    block = bpe.compile_lexicon(words)
    lexicon = bpe.Lexicon(block)
    assert all(np.frombuffer(lexicon.find(w), "<u4").tolist() == ids for w, ids in words.items())
    assert lexicon.find(b"ta") is None and lexicon.find(b"tapsx") is None
    # Right languages of the seven words: distinct ones are the states.
    suffixes = {p: frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:k] for k in range(len(w) + 1))}
    assert len(lexicon.final) == len(set(suffixes.values()))


def test_operator(spark):
    texts = ["the cat", None, "", "the cat", "y" * 3000 + " and\n the", "<|endoftext|>"]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(None, "x", 1)], "doc_id long, text string, ids long")
    library = Tokenizer.from_file(bpe.default_path())
    rows = bpe.digests(docs).collect()
    for r in rows:
        text = "x" if r.doc_id is None else texts[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {**{k: t or "" for k, t in enumerate(texts)}, None: "x"}
    assert bpe.encode(docs.limit(0)).collect() == []


def test_workers_let_go_of_the_encoder(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(8)
    assert bpe.encode(docs).where("n_tokens > 0").count()

    def make():
        left = sum(isinstance(x, bpe.Encoder) for x in gc.get_objects())
        return lambda group: {"left": [left] * len(group)}

    # Workers outlive a query; another operator's tasks run in the same ones.
    assert {r["left"] for r in texts.map_texts(docs, make, "left int").select("left").distinct().collect()} == {0}


def test_a_worker_keeps_one_thing():
    made = []
    try:
        for key in ("a", "a", "b", "a"):
            texts.held(key, lambda: made.append(key) or key)
        texts.let_go("a")
        assert made == ["a", "b", "a"] and texts.held("a", lambda: "new") == "a"
        texts.let_go()
        assert texts.held("a", lambda: "new") == "new"
    finally:
        texts.let_go()
