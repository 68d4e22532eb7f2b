"""Bounded samples whose bound holds however many rows and partitions there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of the hash by which rows are told apart; their counts are all that reaches the driver.
PARTS = 4_096


def bounded(df: DataFrame, name: str, key: Column, most: int) -> DataFrame:
    """At most `most` rows of `df`, by a hash of name and key: whole parts of the hash, in order, as long as they fit.

    All rows, if they are no more than `most`. A part that alone is too large (a key that very many rows share) is passed
    over; if parts are too coarse, one of them is cut again. Reruns agree.
    """
    inside, chosen, held = F.lit(True), F.lit(False), 0
    for level in range(4):
        part = F.pmod(F.xxhash64(F.lit(f"{name} {level}"), key), F.lit(PARTS)).cast("int")
        counts = {r["part"]: r["n"] for r in df.where(inside).groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
        if not level and sum(counts.values()) <= most:
            return df
        taken = []
        for k in sorted(counts):
            if held + counts[k] <= most:
                held += counts[k]
                taken.append(k)
        chosen = chosen | (inside & part.isin(taken)) if taken else chosen
        rest = sorted(set(counts) - set(taken))
        if not rest or held >= most // 2:
            break
        inside = inside & (part == rest[len(rest) // 2])
    return df.where(chosen)
