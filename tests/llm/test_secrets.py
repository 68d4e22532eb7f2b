import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
SCANNER = secrets.Scanner()
BASE = secrets.Scanner(secrets.BASE)
#: What the rules beside the base find, each by Python's own matcher, with the group that must be so long.
MORE = [
    (r"-----BEGIN (?:[A-Z]+ )*(PRIVATE KEY-----)", 1, 0),
    (r"bearer +([A-Za-z0-9._~+/=-]+)", 20, re.I),
    (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)", 8, 0),
    (r"gh[pousr]_([A-Za-z0-9]+)", 36, 0),
    (r"xox[abprs]-([A-Za-z0-9-]+)", 10, 0),
    (r"AIza([A-Za-z0-9_-]+)", 35, 0),
    (r"[rs]k_(?:live|test)_([A-Za-z0-9]+)", 16, 0),
    (r"[a-z]+://[A-Za-z0-9._-]+:([A-Za-z0-9!$%&*+,.;=_~-]+@)", 5, 0),
]


def plain(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def plain_all(text):
    more = [(m.start(), 3 + k, m.end()) for k, (p, least, flags) in enumerate(MORE) for m in re.finditer(p, text, flags | re.A) if len(m[1]) >= least]
    return sorted(plain(text) + more)


CASES = ["", "token=abcdef", "TOKEN = 'abcdef'", "secret: token: abcdefgh", "token=token=abcdefgh", "token==abc", "apikey:\"x/y+z_1", "api__key=abcdef", "AKIA" + "Z9" * 8, "AKIAAKIA" + "B" * 12, "AKIA" + "B" * 15, "a" * 23, "é" + "a" * 24 + "漢" + "0" * 60, "passwordpassword=  abc.def", "password\"'=abcdef", "secret = token=abcdef", "xAPI_KEY : 'abcdef' passwd=1", "token=" + "f" * 30]


def test_cases():
    for text in CASES:
        for t in (text, "é " * 3 + text + " é", "z " * 1020 + text + " y" * 5000 + text):
            assert BASE.spans(t) == plain(t) and SCANNER.spans(t) == plain_all(t), text


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["token", "secret", "api", "_", "key", "=", ":", " ", "'", '"', "abcdef", "AKIA", "Z", "0123456789abcdef", "é", ".", "PassWd", "\n", "ABCDEFGHIJKLMNOP"]), max_size=14).map("".join))
def test_any_text(text):
    assert BASE.spans(text) == plain(text)
    assert SCANNER.spans(text) == plain_all(text)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["-----BEGIN ", "RSA ", "PRIVATE KEY-----", "Bearer ", "bearer", "eyJ", ".", "ghp_", "gho_", "xoxb-", "AIza", "sk_live_", "rk_test_", "://", "https", "user", ":", "@", "pass1!", "A1b2C3d4E5f6G7h8I9", "token=", "-", "_", "é", "\n", " "]), max_size=16).map("".join))
def test_any_text_with_more_rules(text):
    assert SCANNER.spans(text) == plain_all(text)


def test_each_rule_adds_spans():
    texts = ["-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "Authorization: Bearer " + "a.B" * 9, "eyJhbGci.eyJzdWIi.c2lnbmF0dXJl", "ghp_" + "aB3" * 12, "xoxb-1234567890-abc", "AIza" + "x" * 35, "sk_live_" + "Q" * 16, "postgres://bob:s3cret@host"]
    for t in texts:
        assert [k for _, k, _ in SCANNER.spans(t) if k > 2] and SCANNER.spans(t) == plain_all(t), t
    # One text, two kinds that overlap: both stay.
    assert [secrets.RULES[k].kind for _, k, _ in SCANNER.spans("token=ghp_" + "a" * 36)] == ["assign", "github", "hex"]


def test_automaton_is_minimal():
    table, accept = secrets.compile_trees([secrets.parse("(ab|cb)+d?")], anywhere=False)
    # Start, after a or c, after b, after d, and dead.
    assert len(table) == 5 and sorted(accept.tolist()) == [0, 0, 0, 1, 1]


def test_operator(spark):
    texts = CASES + [None, "x" * 300_000 + " token=abcdefg"]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(None, "token=abcdef", "")], "doc_id long, text string, spans string")
    for r in secrets.digests(docs).collect():
        text = "token=abcdef" if r.doc_id is None else texts[r.doc_id] or ""
        want = plain(text)
        joined = lambda spans: ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in spans)
        assert r.spans == joined(plain_all(text)) and r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in want) for x in range(3)]
    assert secrets.scan(docs.limit(0)).collect() == []
