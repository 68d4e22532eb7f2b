"""How alike two short strings are, by the published weighted ratio of fuzzy string matching, written out in plain Python.

ratio: twice the longest common subsequence by both lengths. The partial ratio takes the best stretch of the longer string
as long as the shorter one; token ratios compare sorted words, and common words against each string's own. The weighted
ratio takes the largest of them, scaled by how telling each is. Scores are whole numbers from 0 to 100.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.dictionaries import BRANDS

#: The least score that counts, and what a fuzzy match is worth.
LEAST, WORTH = 82, 0.95


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & places.get(c, 0)
        s = (s + u) | (s - u)
    return len(a) - (s & full).bit_count()


def _ratio(a: str, b: str) -> float:
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def _partial(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer one, also one that hangs over its ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    stretches = {b[max(0, k) : k + n] for k in range(1 - n, len(b))}
    best = max(_ratio(a, s) for s in stretches)
    if len(b) == n:
        best = max(best, max(_ratio(b, a[max(0, k) : k + n]) for k in range(1 - n, n)))
    return best


def _tokens(a: str, b: str, score) -> float:
    """The larger of sorted words compared, and of the common words compared with each string's common and own words."""
    x, y = a.split(), b.split()
    both = sorted({*x} & {*y})
    own, other = sorted({*x} - {*y}), sorted({*y} - {*x})
    out = score(" ".join(sorted(x)), " ".join(sorted(y)))
    if not x or not y:
        return out
    if both and not (own and other):
        return 100.0
    joined = " ".join(both)
    one, two = (" ".join(filter(None, [joined, " ".join(rest)])) for rest in (own, other))
    pairs = [(one, two)] + ([(joined, one), (joined, two)] if both else [])
    return max(out, *(score(*p) for p in pairs))


def _partial_tokens(a: str, b: str) -> float:
    x, y = a.split(), b.split()
    if {*x} & {*y}:
        return 100.0
    return _partial(" ".join(sorted(x)), " ".join(sorted(y)))


def _plain(s: str) -> str:
    return re.sub(r"[^\w]|_", " ", s.lower()).strip()


def weighted_ratio(a: str, b: str) -> int:
    a, b = _plain(a), _plain(b)
    if not a or not b:
        return 0
    by = max(len(a), len(b)) / min(len(a), len(b))
    best = _ratio(a, b)
    if by < 1.5:
        best = max(best, 0.95 * _tokens(a, b, _ratio))
    else:
        scale = 0.9 if by <= 8 else 0.6
        best = max(best, scale * _partial(a, b), 0.95 * scale * _partial_tokens(a, b))
    return round(best)


def best_entry(text: str | None, entries: dict[str, list[str]], least: int = LEAST) -> tuple[str | None, float]:
    """The entry whose name or alias is most like the text, the first of several, with its confidence; (None, 0) below `least`."""
    low, best, name = (text or "").lower(), 0, None
    for entry, aliases in entries.items():
        for a in (entry.lower(), *aliases):
            if (s := weighted_ratio(low, a)) > best:
                best, name = s, entry
    return (name, best / 100 * WORTH) if name is not None and best >= least else (None, 0.0)


def brand_fuzzy(text: Column, entries: dict[str, list[str]] = BRANDS) -> Column:
    """``struct(brand, confidence)``: by an alias that the text holds; for noisy readings without any, by the most alike. Only
    those reach Python."""
    exact = X.brand_with_confidence(text, entries)

    @F.pandas_udf("brand string, confidence double")
    def alike(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}
        for s in batches:
            out = []
            for x in s:
                if not x:
                    out.append((None, 0.0))
                    continue
                if x not in known:
                    if len(known) >= 50_000:
                        known.clear()
                    known[x] = best_entry(x, entries)
                out.append(known[x])
            yield pd.DataFrame(out, columns=["brand", "confidence"])

    rest = alike(F.when(exact["brand"].isNull(), text))
    return F.when(exact["brand"].isNotNull(), exact).otherwise(F.struct(rest["brand"].alias("brand"), F.coalesce(rest["confidence"], F.lit(0.0)).alias("confidence")))


def with_brand(rows: DataFrame, text: str, entries: dict[str, list[str]] = BRANDS) -> DataFrame:
    found = brand_fuzzy(F.col(text), entries)
    return rows.withColumn("__brand", found).withColumns({"brand": F.col("__brand.brand"), "brand_confidence": F.col("__brand.confidence")}).drop("__brand")
