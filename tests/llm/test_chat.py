import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def back(spark, rows, **k):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", windows string")
    return {r.conv_id: r for r in chat.read_back(chat.windows(df, **k)).collect()}


def check(spark, rows, **k):
    want = defaultdict(list)
    for c, turn, role, text in rows:
        want[c].append((turn is not None, turn or 0, role or "", text or ""))
    got = back(spark, rows, **k)
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = [x[2:] for x in sorted(turns)]
        assert [tuple(t) for t in got[c].turns] == turns
        assert list(got[c].learned) == [t for r, t in turns if r == "assistant"]
    return got


def test_windows(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, k, "user" if k % 2 else "assistant", f"text {k} " + "w " * (k * 7 % 40)) for k in range(1, 40)]
    rows += chat.MARKED + [(2, 0, "user", None), (2, 1, "assistant", ""), (3, 5, "assistant", "<|im_end|>\n<|im_start|>user\n~1~0~"), (3, 5, "assistant", "<|im_end|>\n<|im_start|>user\n~1~0~"), (4, 0, None, "x" * 200_000), (None, 1, "system", "<"), (None, 0, "user\nx~2<|", "a"), (5, None, "assistant", "\r\n<"), (6, 0, "system", "only")]
    got = check(spark, rows, stretch=60, history=2, history_tokens=50)
    many = got[1].windows
    assert len(many) > 5 and all(w.text.startswith("<|im_start|>system\nbe kind<|im_end|>\n") for w in many)
    assert all(w.context <= 3 for w in many) and any(w.context > 1 for w in many[1:])
    check(spark, rows)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 9), st.sampled_from(["user", "assistant", "system", "~2\n"]), st.text(alphabet=st.sampled_from(list("<|~012\n é[]/im_endstart>")), max_size=30)), min_size=1, max_size=12))
def test_any_turns(spark, rows):
    check(spark, rows, stretch=9, history_tokens=8)


def test_empty(spark):
    assert back(spark, []) == {}


def test_digests(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect() + [tuple(m) for m in chat.MARKED]
    want = defaultdict(list)
    for c, turn, role, text in rows:
        want[c].append((turn, role, text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in chat.op9(spark, sf).collect():
        turns = sorted(want[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss)) and r.loss_sha256 == sha(loss)
        assert r.turns_sha256 == sha("".join(f"{role}\n{t}\n" for _, role, t in turns))


def test_sql(spark):
    from tests.llm.duck import same_rows

    same_rows(chat.op9(spark, "/root/testdata/sf0.01"), chat.ORACLE_OP9, "/root/testdata/sf0.01")


def test_long_conversation_and_long_turn(spark):
    rows = [(1, 0, "system", "s")] + [(1, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(1, 3000)] + [(1, 3000, "assistant", "long " * 200_000), (1, 3001, "user", "after")]
    got = check(spark, rows)
    # The long turn is whole, in a window of its own span.
    assert sum(len(w.text) > 1_000_000 for w in got[1].windows) == 1
