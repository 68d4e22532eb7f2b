"""Plain versions of what the operators compute."""

import re
from collections import defaultdict


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def near_duplicates(rows, percent=85):
    """id -> (size of the set, component)."""
    sets, first, holders, union = {i: shingles(t) for i, t in rows}, {}, defaultdict(list), Union()
    for i in sorted(sets):
        if sets[i]:
            union.join(first.setdefault(sets[i], i), i)
    for r in first.values():
        shared = defaultdict(int)
        for x in sets[r]:
            for o in holders[x]:
                shared[o] += 1
            holders[x].append(r)
        for o, k in shared.items():
            if 100 * k >= percent * (len(sets[r]) + len(sets[o]) - k):
                union.join(r, o)
    return {i: (len(sets[i]), union.find(i)) for i in sets}
