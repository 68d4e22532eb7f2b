"""Secret scans by one deterministic automaton for all rules.

Each rule's regex is parsed to a syntax tree. From the trees, turned round, one nondeterministic automaton is made, with a
loop before it, and from that by subset construction and minimisation one deterministic automaton over bytes: reading a
text once from its end, its states say at which places a match of which rule starts. Reading goes by transition arrays,
stretch by stretch, in one pass over the bytes for all rules; only a stretch in which something starts is looked at place
by place. From a start a second automaton of all rules, made the same way, gives the longest end of each.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache, reduce
from itertools import accumulate
from operator import getitem

import numpy as np
from pyspark.sql import DataFrame

from millrace.llm.texts import map_texts


@dataclass(frozen=True)
class Rule:
    """Leftmost matches that don't overlap of `head` then `value`; only those whose value has `least` bytes are reported.

    A match takes as many bytes as it can; no value may begin with what `head` could still take. `fold`: the letters of
    `head` stand for either case (A-Z and a-z only).
    """

    kind: str
    head: str
    value: str
    least: int = 1
    fold: bool = False


#: The rules of the base scan, in the order of their kinds. Runs that must have a certain length say so in
#: the regex, which changes nothing as a run's first start always has its longest match.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6, True),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 16),
    Rule("hex", r"", r"[0-9a-f]{24,}"),
)
#: What is found beside: keys and tokens of well-known shapes, by their public formats.
MORE = (
    Rule("private_key", r"-----BEGIN\x20([A-Z]+\x20)*", r"PRIVATE\x20KEY-----"),
    Rule("bearer", r"bearer\x20+", r"[A-Za-z0-9._~+/=-]+", 20, True),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]+", 8),
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]+", 10),
    Rule("google", r"AIza", r"[A-Za-z0-9_-]+", 35),
    Rule("stripe", r"[rs]k_(live|test)_", r"[A-Za-z0-9]+", 16),
    Rule("url_login", r"[a-z]+://[A-Za-z0-9._-]+:", r"[A-Za-z0-9!$%&*+,.;=_~-]+@", 5),
)
#: All rules; base first, so that spans of one start stand in this order.
RULES = BASE + MORE
#: Bytes of a stretch.
STRETCH = 2_048


# --- regex to tree -----------------------------------------------------------------------------------------------------
# A tree is ("set", 256-bit mask), ("cat", trees), ("or", trees) or ("rep", tree, least, most or None).


def parse(pattern: str, fold: bool = False) -> tuple:
    """Tree of a regex of literals, classes, groups, ``|``, ``? * +``, ``{m,n}`` and ``\\xHH`` over ASCII."""
    at = 0

    def mask(codes) -> int:
        out = 0
        for c in codes:
            out |= 1 << c
            if fold and chr(c).isascii() and chr(c).isalpha():
                out |= 1 << (c ^ 32)
        return out

    def escaped() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        if c.isalnum():
            raise ValueError(f"unsupported escape \\{c}")
        return ord(c)

    def one() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "\\":
            return escaped()
        if ord(c) > 127:
            raise ValueError("rules are ASCII")
        return ord(c)

    def atom() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            if pattern.startswith("?:", at):
                at += 2
            tree = either()
            if at >= len(pattern):
                raise ValueError("group not closed")
            at += 1
            return tree
        if pattern[at] == "[":
            at += 1
            negate = pattern[at] == "^"
            at += negate
            codes: set[int] = set()
            while pattern[at] != "]":
                lo = one()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    codes.update(range(lo, one() + 1))
                else:
                    codes.add(lo)
            at += 1
            found = mask(codes)
            return ("set", (1 << 256) - 1 & ~found if negate else found)
        return ("set", mask([one()]))

    def sequence() -> tuple:
        nonlocal at
        items = []
        while at < len(pattern) and pattern[at] not in "|)":
            item = atom()
            while at < len(pattern) and pattern[at] in "?*+{":
                if pattern[at] == "{":
                    end = pattern.index("}", at)
                    lo, comma, hi = pattern[at + 1 : end].partition(",")
                    item = ("rep", item, int(lo), int(hi) if hi else None if comma else int(lo))
                    at = end + 1
                else:
                    item = ("rep", item, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[pattern[at]])
                    at += 1
            items.append(item)
        return ("cat", items)

    def either() -> tuple:
        nonlocal at
        options = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("or", options)

    tree = either()
    if at != len(pattern):
        raise ValueError(f"unexpected {pattern[at]!r} in {pattern!r}")
    return tree


def turned(tree: tuple) -> tuple:
    """Tree of the words read from their ends."""
    if tree[0] == "cat":
        return ("cat", [turned(x) for x in reversed(tree[1])])
    if tree[0] == "or":
        return ("or", [turned(x) for x in tree[1]])
    if tree[0] == "rep":
        return ("rep", turned(tree[1]), *tree[2:])
    return tree


# --- tree to automaton -------------------------------------------------------------------------------------------------


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[int, int]]] = []

    def state(self) -> int:
        self.empty.append([]), self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree: tuple, start: int) -> int:
        """End state of `tree` read from `start`."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for x in tree[1]:
                start = self.add(x, start)
            return start
        if kind == "or":
            end = self.state()
            for x in tree[1]:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.add(x, begin)].append(end)
            return end
        _, x, least, most = tree
        for _ in range(least):
            start = self.add(x, start)
        end = self.state()
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(x, loop)].append(loop)
            self.empty[loop].append(end)
        else:
            self.empty[start].append(end)
            for _ in range(most - least):
                start = self.add(x, start)
                self.empty[start].append(end)
        return end


def compile_trees(trees: list[tuple], anywhere: bool) -> tuple[np.ndarray, np.ndarray]:
    """Minimal transition array (states x 256) and, for each state, the bit set of trees that end there; state 0 starts.

    anywhere: a word may start at any place, not only the first.
    """
    nfa = _Nfa()
    root, ends = nfa.state(), {}
    for k, tree in enumerate(trees):
        begin = nfa.state()
        nfa.empty[root].append(begin)
        ends[nfa.add(tree, begin)] = k
    if anywhere:
        nfa.moves[root].append(((1 << 256) - 1, root))

    def closed(states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in out:
                    out.add(t), todo.append(t)
        return frozenset(out)

    # Bytes that no class tells apart are one symbol.
    masks = sorted({m for moves in nfa.moves for m, _ in moves})
    symbols: dict[tuple, list[int]] = {}
    for b in range(256):
        symbols.setdefault(tuple(m >> b & 1 for m in masks), []).append(b)
    kinds = list(symbols.values())
    first = closed([root])
    number, todo, table = {first: 0}, [first], []
    while todo:
        states = todo.pop(0)
        row = []
        for bytes_ in kinds:
            to = closed({t for s in states for m, t in nfa.moves[s] if m >> bytes_[0] & 1})
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        table.append(row)
    accept = np.array([sum(1 << k for k in {ends[s] for s in states if s in ends}) for states in number])
    table = np.array(table)
    # Minimisation: states fall into classes by what they accept, then by where their symbols lead, until nothing changes.
    group = np.unique(accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    order = {int(group[0]): 0}
    for g in group.tolist():
        order.setdefault(g, len(order))
    group = np.array([order[g] for g in group.tolist()])
    one = np.unique(group, return_index=True)[1]
    small = group[table[one]]
    wide = np.zeros((len(one), 256), dtype=np.int32)
    for k, bytes_ in enumerate(kinds):
        wide[:, bytes_] = small[:, [k]]
    return wide, accept[one]


def _rows(table: np.ndarray) -> list[list]:
    """Transition arrays whose entries are the arrays of the next states: reading a byte is one index."""
    rows: list[list] = [[] for _ in table]
    for row, to in zip(rows, table.tolist()):
        row.extend(rows[t] for t in to)
    return rows


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        whole = [("cat", [parse(r.head, r.fold), parse(r.value)]) for r in rules]
        self.table, self.accept = compile_trees([turned(t) for t in whole], anywhere=True)
        self.rows = _rows(self.table)
        self.number = {id(row): k for k, row in enumerate(self.rows)}
        # For the first look at a stretch, a state that accepts keeps to itself.
        stop = self.table.copy()
        hits = np.flatnonzero(self.accept)
        stop[hits] = hits[:, None]
        self.quick = _rows(stop)
        self.place = {id(row): k for k, row in enumerate(self.quick)}
        self.starts = {id(self.rows[s]): int(self.accept[s]) for s in hits.tolist()}
        self.whole, self.heads = (_forward(trees) for trees in (whole, [parse(r.head, r.fold) for r in rules]))

    def _ends(self, machine: tuple, data: bytes, at: int, kinds: int) -> list[int]:
        """Longest end of each rule whose match starts at `at`; -1 for those without."""
        rows, accept, dead = machine
        row = rows[0]
        ends = [at if accept[id(row)] >> k & 1 else -1 for k in range(len(self.rules))]
        for k in range(at, len(data)):
            row = row[data[k]]
            if hit := accept[id(row)]:
                for r in range(len(ends)):
                    if hit >> r & 1:
                        ends[r] = k + 1
            if not dead[id(row)] & kinds:
                break
        return ends

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, sorted."""
        data = (text or "").encode("utf-8", "surrogatepass")
        turned_data, n, starts = data[::-1], len(data), self.starts
        state, found = 0, []
        for at in range(0, n, STRETCH):
            part = turned_data[at : at + STRETCH]
            after = self.place[id(reduce(getitem, part, self.quick[state]))]
            if self.accept[after]:
                steps = list(accumulate(part, getitem, initial=self.rows[state]))
                found += [(n - at - k, starts[id(row)]) for k, row in enumerate(steps) if k and id(row) in starts]
                after = self.number[id(steps[-1])]
                # A stretch that begins in a state that accepts would keep to it.
                if self.accept[after]:
                    state = after
                    continue
            state = after
        if not found:
            return []
        ended, out = [0] * len(self.rules), []
        for start, kinds in reversed(found):
            live = sum(1 << k for k in range(len(self.rules)) if kinds >> k & 1 and start >= ended[k])
            if not live:
                continue
            ends, heads = self._ends(self.whole, data, start, live), self._ends(self.heads, data, start, live)
            for k, rule in enumerate(self.rules):
                if live >> k & 1:
                    ended[k] = ends[k]
                    if ends[k] - heads[k] >= rule.least:
                        out.append((start, k, ends[k]))
        if len(data) != len(text):
            # From bytes to code points: those before a place are the bytes that don't continue one.
            place = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            out = [(int(place[a]), k, int(place[b])) for a, k, b in out]
        return sorted(out)


def _forward(trees: list[tuple]) -> tuple[list, dict[int, int], dict[int, int]]:
    """Transition arrays of all trees read from one place; by array, which trees end there and which may still end later."""
    table, accept = compile_trees(trees, anywhere=False)
    live = accept.copy()
    while True:
        more = live | np.bitwise_or.reduce(live[table], axis=1)
        if np.array_equal(more, live):
            break
        live = more
    later = np.bitwise_or.reduce(live[table], axis=1)
    rows = _rows(table)
    return rows, {id(r): int(a) for r, a in zip(rows, accept)}, {id(r): int(x) for r, x in zip(rows, later)}


@cache
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)``: every document, with an array of ``(kind, start, end)`` in code points, end exclusive.

    Sorted by start, then by the rules' order. Null and empty texts have none; a null id stays null; repeated rows and
    texts of any length are scanned whole. Extra columns are left out; an empty table gives no rows.
    """

    def make():
        scanner = _scanner(rules)

        def run(texts: list[str]) -> dict:
            return {"spans": [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in scanner.spans(t)] for t in texts]}

        return run

    return map_texts(docs, make, "spans array<struct<kind:string,start:long,end:long>>", id_col=id_col, text_col=text_col)


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans as text, for every document; see `scan`."""
    base = {r.kind for r in BASE}

    def make():
        scanner = _scanner(rules)

        def run(texts: list[str]) -> dict:
            out: dict[str, list] = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
            for t in texts:
                found = [(rules[k].kind, a, b) for a, k, b in scanner.spans(t)]
                for kind in ("assign", "access", "hex"):
                    out[f"n_{kind}"].append(sum(x[0] == kind for x in found))
                joined = lambda some: ",".join(f"{kind}:{a}:{b}" for kind, a, b in some)
                out["base_sha256"].append(hashlib.sha256(joined(x for x in found if x[0] in base).encode()).hexdigest())
                out["spans"].append(joined(found))
            return out

        return run

    return map_texts(docs, make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", id_col=id_col, text_col=text_col)


def op5(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_pattern(rule: Rule) -> str:
    """The rule for DuckDB: its head and value as two groups, letters of either case written out."""
    out, k = "", 0
    while k < len(rule.head):
        c = rule.head[k]
        if c == "\\":
            out, k = out + rule.head[k : k + 4], k + 4
            continue
        out += f"[{c.lower()}{c.upper()}]" if rule.fold and c.isalpha() else "(?:" if c == "(" else c
        k += 1
    return f"({out})({rule.value})".replace("'", "''")


#: Matches and what stands between them, rule by rule; a match begins after all that comes before it.
_SQL_MATCHES = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_split_to_array(t, '{_sql_pattern(r)}') AS gaps, regexp_extract_all(t, '{_sql_pattern(r)}') AS found, regexp_extract_all(t, '{_sql_pattern(r)}', 2) AS val FROM d" for k, r in enumerate(RULES))
ORACLE_OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_SQL_MATCHES}),
u AS (SELECT doc_id, k, kind, least, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS f, unnest(val) AS v, unnest(gaps[:len(found)]) AS g FROM m WHERE len(found) > 0),
p AS (SELECT *, sum(length(g)) OVER w + sum(length(f)) OVER w - length(f) AS a FROM u WINDOW w AS (PARTITION BY doc_id, k ORDER BY i ROWS UNBOUNDED PRECEDING)),
q AS (SELECT doc_id, k, kind, a, kind || ':' || a::BIGINT || ':' || (a + length(f))::BIGINT AS span FROM p WHERE length(v) >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY a, k) FILTER (k < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM q GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
