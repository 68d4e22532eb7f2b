import random

import pytest

from millrace.functions import fuzzy


def common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(2))
        assert fuzzy._common(a, b) == common(a, b)


@pytest.mark.parametrize("a,b,want", [
    ("this is a test", "this is a test!", 100), ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 95), ("new york mets vs atlanta braves", "atlanta braves vs new york mets", 95),
    ("", "x", 0), ("!!", "x", 0), ("b0sch", "bosch", 80), ("boschh", "bosch", 91), ("abc", "xyz", 0), ("denso spark plug set of four", "denso", 90),
])
def test_published_cases(a, b, want):
    assert fuzzy.weighted_ratio(a, b) == want == fuzzy.weighted_ratio(b, a)


def test_noisy_readings(spark):
    rows = [("Bosch 0986",), ("castrool",), ("zzzz",), ("",), (None,), ("brembbo",)]
    got = {r.t: (r.brand, round(r.brand_confidence, 4)) for r in fuzzy.with_brand(spark.createDataFrame(rows, "t string"), "t").collect()}
    assert got["Bosch 0986"] == ("Bosch", 0.5) and got["castrool"] == ("Castrol", round(0.93 * 0.95, 4)) and got["brembbo"] == ("Brembo", round(0.92 * 0.95, 4))
    assert got["zzzz"] == got[""] == got[None] == (None, 0.0)
