"""Small reports: means, deviations, counts and bests by group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_std(rows: DataFrame, by: str, value: str, mean: str = "mean", sd: str = "sd") -> DataFrame:
    """Mean, sample deviation and number of a value in each group: the points of a curve over seeds."""
    return rows.groupBy(by).agg(F.avg(value).alias(mean), F.stddev_samp(value).alias(sd), F.count("*").alias("n"))


def slices(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Number of rows and means of values in each group, and over all rows where `by` is null."""
    return rows.rollup(by).agg(F.count("*").alias("n"), *[F.avg(F.col(v).cast("double")).alias(v) for v in values])


def counts(rows: DataFrame, by: list[str], checks: dict[str, Column] | None = None, spans: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Rows of each group, those of them that checks hold for, and the least and largest value of columns, under two names."""
    out = [F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in (checks or {}).items()]]
    for column, (least, most) in (spans or {}).items():
        out += [F.min(column).alias(least), F.max(column).alias(most)]
    return rows.groupBy(*by).agg(*out)


def interval(rows: DataFrame, by: str, value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Two percentiles of a value in each group, linear between rows."""
    return rows.groupBy(by).agg(F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high"))


def best_of(rows: DataFrame, by: str, pick: str, *order: str, name: str = "best") -> DataFrame:
    """In each group the value of `pick` in the row with the largest `order`."""
    return rows.groupBy(by).agg(F.max_by(pick, F.struct(*order)).alias(name))


def together(first: DataFrame, by: str, *more: DataFrame) -> DataFrame:
    """Reports of one grouping side by side."""
    return reduce(lambda a, b: a.join(b, by), more, first)
