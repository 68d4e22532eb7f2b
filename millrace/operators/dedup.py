"""Copies by hash: exact groups, near pairs by Hamming distance, greedy leaders, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.functions.vectors import hamming, mean_absolute_difference
from millrace.operators.components import connected_components
from millrace.storage import written


def exact_groups(rows: DataFrame, hash_col: str, source_col: str) -> DataFrame:
    """Hashes that several rows share, with their count and their sources, joined by ' + '."""
    return rows.groupBy(hash_col).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(source_col)), " + ").alias("sources")).where("n > 1")


def _neighbours(bits: int, radius: int) -> list[int]:
    """Numbers of `bits` bits with at most `radius` of them set."""
    return [sum(1 << k for k in some) for r in range(radius + 1) for some in combinations(range(bits), r)]


def near_pairs(rows: DataFrame, id_col: str, hash_col: str, most: int) -> DataFrame:
    """``(a, b, distance)``, a < b, of 64-bit hashes at most `most` bits apart; none is missed.

    Rows of equal hash are one class, classes are compared by `near_hashes`, and pairs of rows follow at the end.
    """
    named = rows.select(F.col(id_col).alias("i"), F.col(hash_col).alias("h")).where("h is not null")
    classes = named.select("h").distinct()
    met = near_hashes(classes, "h", most).toDF("h", "g").unionByName(classes.select("h", F.col("h").alias("g")))
    a, b = named.select(F.col("i").alias("x"), "h"), named.select(F.col("i").alias("y"), F.col("h").alias("g"))
    pairs = met.join(a, "h").join(b, "g").where("h <> g or x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), hamming(F.col("h"), F.col("g")).alias("distance"))


def near_hashes(classes: DataFrame, hash_col: str, most: int) -> DataFrame:
    """``(a, b)``, a < b, of distinct 64-bit hashes at most `most` bits apart; none is missed.

    The 64 bits are four bands of 16, each with a radius; the radii and one each add up to more than `most`, so two hashes
    at most `most` apart are within the radius in one band. So one side of an equi-join has each band with all its
    neighbours within that radius, the other its bands as they are, and the distance is looked at inside the join: up to
    distance 11 each hash has 548 keys at most, and a band of 16 bits tells hashes apart well. Beyond that most pairs of
    any hashes are candidates in some band; then hashes are compared block by block in one pass each, which takes the
    square of their number in time.
    """
    if most >= 64:
        raise ValueError("a distance of 64 bits makes every pair near")
    classes = classes.select(F.col(hash_col).alias("h")).where("h is not null")
    if most <= 11:
        # The last band has the least radius: hashes of fewer than 64 bits have the fewest values there.
        radii = [r for k in range(4) if (r := (max(most, 0) + 4 - k) // 4 - 1) >= 0]
        band = lambda k: F.shiftrightunsigned(F.col("h"), 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("int")
        bands = classes.select("h", F.posexplode(F.array(*[band(k) for k in range(len(radii))])).alias("k", "band"))
        near = F.get(F.array(*[F.array(*[F.lit(x) for x in _neighbours(16, r)]) for r in radii]), F.col("k"))
        wide = bands.select(F.col("h").alias("g"), "k", F.explode(F.transform(near, lambda x: F.col("band").bitwiseXOR(x))).alias("band"))
        # Spark takes `wide` for as small as `classes`, of which it is up to 548 times, and would broadcast it.
        met = bands.hint("merge").join(wide, ["k", "band"]).where((F.col("h") < F.col("g")) & (hamming(F.col("h"), F.col("g")) <= most)).select("h", "g").distinct()
    else:
        met = _blockwise(classes, most)
    return met.toDF("a", "b")


#: Hashes of a block.
BLOCK = 32_768


def _blockwise(classes: DataFrame, most: int) -> DataFrame:
    """Pairs (h, g), h < g, of distinct hashes, every block of them against every later one."""
    n = classes.count()
    blocks = max(1, -(-n // BLOCK))
    block = F.pmod(F.xxhash64("h"), F.lit(blocks))
    dealt = classes.withColumn("b", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = dealt.select("h", "b", F.least("b", "other").alias("x"), F.greatest("b", "other").alias("y"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        left, right = (np.sort(pdf["h"].to_numpy(np.int64)[pdf["b"].to_numpy() == k]) for k in (x, y))
        a, b = [], []
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            i, j = np.nonzero(np.bitwise_count(part.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :]) <= most)
            keep = part[i] < right[j] if x == y else part[i] != right[j]
            a.append(np.minimum(part[i], right[j])[keep]), b.append(np.maximum(part[i], right[j])[keep])
        return pd.DataFrame({"h": np.concatenate(a or [left]), "g": np.concatenate(b or [left])})

    return dealt.groupBy("x", "y").applyInPandas(compare, "h long, g long")


def groups(rows: DataFrame, id_col: str, pairs: DataFrame) -> DataFrame:
    """``(id, group)`` of all rows: the smallest id that pairs lead to."""
    found = connected_components(pairs, "a", "b")
    return rows.select(F.col(id_col).alias("id")).join(found, "id", "left").select("id", F.coalesce("component", "id").alias("group"))


def without_generic(pairs: DataFrame, part_of: DataFrame, most: int = 4) -> DataFrame:
    """Pairs of different parts, but for those of an image that is near more than `most` other parts. part_of: id, part."""
    p = pairs.join(part_of.select(F.col("id").alias("a"), F.col("part").alias("pa")), "a").join(part_of.select(F.col("id").alias("b"), F.col("part").alias("pb")), "b").where("pa <> pb")
    both = p.select(F.col("a").alias("id"), F.col("pb").alias("other")).unionByName(p.select(F.col("b").alias("id"), F.col("pa").alias("other")))
    generic = both.groupBy("id").agg(F.countDistinct("other").alias("n")).where(F.col("n") > most)
    return p.join(generic.select(F.col("id").alias("a")), "a", "left_anti").join(generic.select(F.col("id").alias("b")), "b", "left_anti")


def parts_by_image(images: DataFrame, part: str, hash_col: str, near: DataFrame, most: int = 4) -> DataFrame:
    """``(a, b)``: parts tied by equal or near hashes of their images, but for those of images that are near more than `most`
    other parts. The components are those of the pairs that `without_generic` leaves; images are never paired.

    near: a, b, the near pairs of the different hashes. An image has its own part among those that its hash is near, so all
    images of a hash are near equally many, and `most` + 2 parts of a hash tell whether those are too many. The parts of
    any other hash are one component, as are those of two hashes that are near.
    """
    some = images.select(F.col(part).alias("part"), F.col(hash_col).alias("h")).dropna().distinct()
    first = some.withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy("part"))).where(F.col("place") <= most + 2)
    hashes = written(first.groupBy("h").agg(F.array_sort(F.collect_list("part")).alias("parts")), "hash-parts")
    both = near.select(F.explode(F.array(F.struct(F.col("a").alias("h"), F.col("b").alias("g")), F.struct(F.col("b").alias("h"), F.col("a").alias("g")), F.struct(F.col("a").alias("h"), F.col("a").alias("g")), F.struct(F.col("b").alias("h"), F.col("b").alias("g")))).alias("x")).select("x.*")
    seen = both.distinct().join(hashes.select(F.col("h").alias("g"), "parts"), "g").select("h", F.explode("parts").alias("part")).distinct().groupBy("h").agg(F.count("*").alias("n"))
    fit = hashes.join(seen, "h", "left").where(F.coalesce("n", F.size("parts")) <= most + 1).select("h", "parts")
    heads = fit.select("h", F.col("parts")[0].alias("head"))
    own = fit.select(F.explode("parts").alias("a"), F.col("parts")[0].alias("b"))
    across = near.join(heads.toDF("a", "pa"), "a").join(heads.toDF("b", "pb"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    return own.unionByName(across).where("a <> b").distinct()


def leaders(rows: DataFrame, key: str, order: str, hash_col: str, most: int) -> DataFrame:
    """Greedy clusters within each key: a row joins the first leader within `most` bits, or leads. ``(key, order, leader)``.

    The result depends on the order, so a key's rows are read one after the other, sorted, and only its leaders are held:
    a task's memory follows the leaders of one key, not its rows. Keys are spread over the tasks.
    """
    schema = StructType([StructField(key, rows.schema[key].dataType), StructField(order, LongType()), StructField("leader", LongType())])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, lead, names, n = None, np.zeros(64, np.uint64), np.zeros(64, np.int64), 0
        for pdf in batches:
            hashes, orders, keys, out = pdf["h"].to_numpy(np.int64).view(np.uint64), pdf["o"].to_numpy(np.int64), pdf["k"].tolist(), []
            for k, o, h in zip(keys, orders.tolist(), hashes):
                if k != now:
                    now, n = k, 0
                near = np.flatnonzero(np.bitwise_count(lead[:n] ^ h) <= most)
                if len(near):
                    out.append(int(names[near[0]]))
                    continue
                if n == len(lead):
                    lead, names = np.resize(lead, 2 * n), np.resize(names, 2 * n)
                lead[n], names[n], n = h, o, n + 1
                out.append(o)
            yield pd.DataFrame({key: pdf["k"], order: orders, "leader": np.array(out, np.int64)})

    some = rows.where(F.col(hash_col).isNotNull()).select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), F.col(hash_col).cast("long").alias("h"))
    return some.repartition("k").sortWithinPartitions("k", "o").mapInPandas(read, schema)


def without_near(rows: DataFrame, against: DataFrame, key: str, hash_col: str, most: int) -> DataFrame:
    """`rows` but for those that have, among the rows of `against` with their key, one within `most` bits."""
    other = against.select(F.col(key).alias("__key"), F.col(hash_col).alias("__hash")).distinct()
    return rows.join(other, (F.col(key) == F.col("__key")) & (hamming(F.col(hash_col), F.col("__hash")) <= most), "left_anti")


def near_pairs_checked(rows: DataFrame, id_col: str, hash_col: str, content_col: str, most: int, tolerance: float = 10.0) -> DataFrame:
    """`near_pairs` whose contents (arrays of equal length) also differ by no more than `tolerance` on the mean; a negative
    tolerance leaves contents alone. Contents are looked up for the pairs alone."""
    pairs = near_pairs(rows, id_col, hash_col, most)
    if tolerance < 0:
        return pairs
    side = lambda end: rows.select(F.col(id_col).alias(end), F.col(content_col).alias(f"__{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(mean_absolute_difference(F.col("__a"), F.col("__b")) <= tolerance).select("a", "b", "distance")


def shown_by_several(rows: DataFrame, cluster: str, by: str, out: str) -> DataFrame:
    """`rows` with whether their cluster is seen under more than one value of `by`, anywhere."""
    several = rows.groupBy(cluster).agg(F.countDistinct(by).alias("__n")).where("__n > 1").select(cluster, F.lit(True).alias(out))
    return rows.join(several, cluster, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def primary(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """`rows` with ``is_primary``: the first of those with the same value."""
    return rows.withColumn("is_primary", F.row_number().over(Window.partitionBy(by).orderBy(*order)) == 1)
