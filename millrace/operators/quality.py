"""Row checks that collect every error, and cleaning with one reason a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.dictionaries import BRANDS

#: The fields that a row must have, and, below, the words of the checks' messages.
REQUIRED = ("part_number_raw", "category", "name", "source_url", "source_site", "collected_by")


def _trimmed(c: str) -> Column:
    return X.stripped(F.col(c))


def validate(rows: DataFrame, categories: DataFrame | None = None, brands: dict[str, list[str]] = BRANDS) -> DataFrame:
    """`rows` (all strings) with ``errors`` (all of a row, in order), ``part_number``, ``brand_known`` and both flags.

    categories: ``label``; without any, categories aren't checked. A brand is needed but for distractors.
    """
    brand = X.first_entry(_trimmed("brand"), brands)
    distractor, verified = X.flag(F.col("is_distractor")), X.flag(F.col("verified"))
    number = X.part_number(F.col("part_number_raw"))
    checks = [F.when(_trimmed(c) == "", F.lit(f"missing required field '{c}'")) for c in REQUIRED]
    checks.append(F.when((_trimmed("part_number_raw") != "") & (number == ""), "part_number_raw normalises to empty string"))
    if categories is not None:
        # A taxonomy is a short list of labels.
        known = categories.select(F.col("label").alias("__label")).distinct()
        rows = rows.join(known, _trimmed("category") == known["__label"], "left")
        checks.append(F.when((_trimmed("category") != "") & F.col("__label").isNull(), F.concat(F.lit("category '"), _trimmed("category"), F.lit("' not in taxonomy"))))
    for c, value in (("is_distractor", distractor), ("verified", verified)):
        checks.append(F.when(value.isNull(), F.concat(F.lit(f"{c}='"), F.coalesce(F.col(c), F.lit("")), F.lit("' is not a valid boolean"))))
    checks.append(F.when((_trimmed("brand") != "") & brand.isNull(), F.concat(F.lit("brand '"), _trimmed("brand"), F.lit("' not in known brand list"))).when((_trimmed("brand") == "") & ~F.coalesce(distractor, F.lit(False)), "brand is required for non-distractor (D3) rows"))
    out = rows.withColumns({"errors": F.array_compact(F.array(*checks)), "part_number": number, "brand_known": F.coalesce(brand, F.lit("")), "distractor": F.coalesce(distractor, F.lit(False)), "checked": F.coalesce(verified, F.lit(False))})
    return out.drop("__label") if categories is not None else out


def foreign_keys(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows of `child` whose key is in no row of `parent`."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def first_reason(*reasons: tuple[str, Column]) -> Column:
    """Name of the first condition that holds; null if none does."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in reasons])


def vote(rows: DataFrame, key: str, value: str, order: str, least: str = "unknown") -> DataFrame:
    """Each key's most frequent value, `least` only if there is no other; of several the one that came first."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    pick = F.struct((F.col(value) == least).cast("int").alias("u"), (-F.col("n")).alias("n"), "first", F.col(value).alias("value"))
    return n.groupBy(key).agg(F.min(pick).alias("p")).select(key, F.col("p.value").alias(value), (-F.col("p.n")).alias("votes"))


def remap_labels(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """Label lines with their new class ids; classes that map to nothing or to a negative id go."""
    return lines.join(mapping, "class_id").where("new_id >= 0").drop("class_id").withColumnRenamed("new_id", "class_id")
