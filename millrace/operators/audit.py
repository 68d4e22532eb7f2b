"""Reports on folders of images, and the clean training set made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import dedup, splits

#: The shorter side that is flagged below, and the distance of near copies.
SHORT_EDGE, NEAR = 400, 6
#: Distinct hashes up to which near pairs are counted in a report.
NEAR_LIMIT = 6_000


def _bad(short_edge: int) -> tuple[Column, Column]:
    corrupt = F.col("phash").isNull()
    return corrupt, ~corrupt & (F.least("width", "height") < short_edge)


def by_source(images: DataFrame, short_edge: int = SHORT_EDGE) -> DataFrame:
    """``(source, n, corrupt, undersized)``; an image that couldn't be read has no hash."""
    corrupt, small = _bad(short_edge)
    return images.groupBy("source").agg(F.count("*").alias("n"), F.count_if(corrupt).alias("corrupt"), F.count_if(small).alias("undersized"))


def report(images: DataFrame, short_edge: int = SHORT_EDGE, near_limit: int | None = NEAR_LIMIT) -> DataFrame:
    """One row: images read, corrupt, undersized, distinct hashes, surplus copies, and near pairs of distinct hashes, null if
    there are more hashes than `near_limit` (None: counted however many there are). images: path, source, phash, width, height."""
    corrupt, small = _bad(short_edge)
    whole = images.agg(F.count("*").alias("n_scanned"), F.count_if(corrupt).alias("n_corrupt"), F.count_if(small).alias("n_undersized"))
    hashes = images.where("phash is not null").groupBy("phash").agg(F.count("*").alias("n"))
    copies = hashes.agg(F.count("*").alias("n_unique_phash"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_exact_duplicates"))
    if near_limit is None or hashes.count() <= near_limit:
        near = dedup.near_pairs(hashes, "phash", "phash", NEAR).agg(F.count("*").alias("near_pairs"))
    else:
        near = images.sparkSession.sql("SELECT CAST(NULL AS BIGINT) AS near_pairs")
    return whole.crossJoin(copies).crossJoin(near)


def copies(images: DataFrame) -> DataFrame:
    """Groups of equal hashes: how many copies, and their paths joined by ' | '."""
    return images.where("phash is not null").groupBy("phash").agg(F.count("*").alias("n_copies"), F.array_join(F.array_sort(F.collect_list("path")), " | ").alias("files")).where("n_copies > 1")


def kept_sources(images: DataFrame, keep: list[str], undersized: list[str] = [], least_side: int = 128) -> DataFrame:  # noqa: B006
    """Images of the sources to keep, but for those known as too small, with a shorter side of `least_side` at least."""
    return images.where(F.col("source").isin(keep) & ~F.col("source").isin(undersized) & (F.least("width", "height") >= least_side))


def part_folders(images: DataFrame, prefix: str = "KAGGLE50", names: list[str] = ["IMAGES"]) -> DataFrame:  # noqa: B006
    """Images of folders that are parts: not those with the prefix, nor those named."""
    return images.where(~F.startswith("part", F.lit(prefix)) & ~F.col("part").isin(names))


def parts_with_several(images: DataFrame, least: int = 2) -> DataFrame:
    return splits.large_types(images, "part", least)


def clean_manifest(images: DataFrame, seed: int = 42) -> DataFrame:
    """Every image with the ``split`` of its cluster of equal hashes, and whether it is the cluster's first copy.

    Clusters are dealt by their place in shuffled order, so a copy never lands in two splits.
    """
    clusters = splits.split_ranks(images.select("phash").distinct(), "phash", 0.8, 0.1, seed)
    return dedup.primary(images.join(clusters, "phash"), "phash", ["path"])


def class_distribution(lines: DataFrame) -> DataFrame:
    """``(class_id, n_files)``: files that have a class at all; lines: file, class_id."""
    return lines.select("file", "class_id").distinct().groupBy("class_id").agg(F.count("*").alias("n_files"))


def largest_groups(groups: DataFrame, group: str, k: int = 5) -> DataFrame:
    return groups.groupBy(group).agg(F.count("*").alias("size")).orderBy(F.desc("size"), group).limit(k)


def region_report(runs: DataFrame, sources: DataFrame, base: str = "full_image") -> DataFrame:
    """``(region, src, n, recall_1, map, detected_n, detected_recall_1, same_recall_1)``, src null for all queries.

    runs: region, image, recall_1, ap, detected; sources: image, src. The last two: recall over a region's queries with a
    box, and over the same queries in the run `base`.
    """
    q = runs.join(sources, "image", "left")
    same = runs.where(F.col("region") == base).select("image", F.col("recall_1").alias("base_recall_1"))
    q = q.join(same, "image", "left")
    seen = F.col("detected")
    mean = lambda c, when=None: F.avg((F.when(when, F.col(c)) if when is not None else F.col(c)).cast("double"))
    out = q.groupingSets([["region", "src"], ["region"]], "region", "src").agg(F.grouping("src").alias("whole"), F.count("*").alias("n"), mean("recall_1").alias("recall_1"), mean("ap").alias("map"), F.count_if(seen).alias("detected_n"), mean("recall_1", seen).alias("detected_recall_1"), mean("base_recall_1", seen).alias("same_recall_1"))
    return out.where("whole = 1 or src is not null").drop("whole")
