"""Running sums over rows in the order of a hash, without bringing all rows, or all of a key, into one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a part that one task sorts, about, and copies of a row that one step makes.
PART_ROWS, COPIES = 65_536, 65_536


def row_hash(*columns: Column) -> Column:
    """32 hexadecimal digits that stand for a row; null counts as empty."""
    return F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def offsets(rows: DataFrame, by: list[str], key: str, weight: str, most: int, out: str) -> DataFrame:
    """`rows` with the sum of `weight` over the rows of the same `by` that come before, in the order of `key`, a `row_hash`.

    Rows are dealt to parts by the first digits of the key, as many as `most` rows in one `by` ask for; parts are summed up,
    and a part's rows run on from where the parts before it end. No task sees more than a part, and of all parts only their
    sums, 24 bytes for about PART_ROWS rows, meet in one. Keys are distinct within `by`.
    """
    digits = max(2, math.ceil(math.log(max(1, most / PART_ROWS), 16)))
    rows = rows.withColumn("__part", F.substring(key, 1, digits))
    sums = rows.groupBy(*by, "__part").agg(F.sum(weight).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    run = Window.partitionBy(*by, "__part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum(weight).over(run), F.lit(0)))
    return rows.join(starts, [*by, "__part"]).withColumn(out, F.col("__start") + F.col("__inside")).drop("__part", "__start", "__inside")


def copies(rows: DataFrame, many: str, out: str) -> DataFrame:
    """Each row as often as `many` says, with ``out`` from 0. A row with very many copies is made by many tasks."""
    few = rows.where(F.col(many) <= COPIES).withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1)))
    steps = rows.where(F.col(many) > COPIES).withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1, F.lit(COPIES).cast("long")))).repartition("__from", many)
    lots = steps.withColumn(out, F.explode(F.sequence("__from", F.least(F.col("__from") + COPIES, F.col(many)) - 1))).drop("__from")
    return few.unionByName(lots).drop(many)
