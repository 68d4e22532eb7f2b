"""What follows from the outputs of detectors and readers: tables of boxes and of text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.dictionaries import BRANDS, CLASS_KEYWORDS, PART_KEYWORDS, READER_BRANDS

#: What a box must have in confidence and in percent of the image, and a text line in confidence.
LEAST_CONFIDENCE, LEAST_AREA, LEAST_LINE = 0.5, 2.0, 0.5


def area_percent(bbox: Column, width: Column, height: Column) -> Column:
    return (bbox[2] - bbox[0]) * (bbox[3] - bbox[1]) / (width * height) * 100


def kept(boxes: DataFrame, confidence: float = LEAST_CONFIDENCE, area: float = LEAST_AREA) -> DataFrame:
    """Boxes (query_id, det, class_name, confidence, bbox, img_w, img_h) that are sure and large enough, with ``part_type``."""
    some = boxes.where((F.col("confidence") >= confidence) & (area_percent(F.col("bbox"), F.col("img_w"), F.col("img_h")) >= area))
    return some.withColumn("part_type", X.class_category(F.col("class_name"), CLASS_KEYWORDS))


def top(boxes: DataFrame, k: int = 5, **least: float) -> DataFrame:
    """The k surest of each query's kept boxes with their ``rank``; of equal ones the first."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "det"))
    return kept(boxes, **least).withColumn("rank", rank).where(F.col("rank") <= k)


def best(boxes: DataFrame, **least: float) -> DataFrame:
    """The surest kept box of each query that has one."""
    return top(boxes, 1, **least).drop("rank")


def detection_rate(queries: DataFrame, boxes: DataFrame, **least: float) -> DataFrame:
    """``(n_queries, detected, rate)``: queries with a kept box."""
    found = kept(boxes, **least).select("query_id").distinct().withColumn("hit", F.lit(1))
    joined = queries.select("query_id").join(found, "query_id", "left")
    return joined.agg(F.count("*").alias("n_queries"), F.count("hit").alias("detected"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("rate"))


def is_brand(text: Column, brands: list[str] | None = None) -> Column:
    """Whether the lower-case text has any of the reader's brands in it."""
    return X.any_of(text, READER_BRANDS if brands is None else brands)


def lines(raw: DataFrame, least: float = LEAST_LINE, brands: list[str] | None = None) -> DataFrame:
    """Lines (query_id, line, text, confidence) that are sure enough, stripped, with ``is_brand`` and ``rank``: the surest
    first, equal ones as they were read."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "line"))
    some = raw.where(F.col("confidence") >= least).withColumns({"is_brand": is_brand(F.col("text"), brands), "text": X.stripped(F.col("text"))})
    return some.withColumn("rank", rank)


def best_line(raw: DataFrame, least: float = LEAST_LINE, brands: list[str] | None = None) -> DataFrame:
    """One line a query: the first as read with a brand in it, as that brand in capitals; without any, the surest."""
    brand = X.first_of(F.col("text"), READER_BRANDS if brands is None else brands)
    some = raw.where(F.col("confidence") >= least).withColumn("brand", brand)
    order = [F.col("brand").isNull(), F.when(F.col("brand").isNull(), -F.col("confidence")), "line"]
    first = some.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where("r = 1")
    return first.select("query_id", F.coalesce(F.upper("brand"), X.stripped(F.col("text"))).alias("text"), "confidence", F.col("brand").isNotNull().alias("is_brand"))


def read(queries: DataFrame, boxes: DataFrame, raw_lines: DataFrame, brands: dict[str, list[str]] = BRANDS, keywords: dict[str, list[str]] = PART_KEYWORDS) -> DataFrame:
    """What each query is taken to ask for: ``query_id, detected, box, ocr_text, ocr_confidence, part_type, brand_name,
    part_number, confidence``.

    The part type is the best box's, or that of keywords in the text if there is none or it is unknown. The brand is the
    surest line with a brand in it, as it stands there; without one, the dictionary's match in all lines. The part number
    comes from all lines, normalised. confidence: the largest of the box's, the lines' and the brand's; 0 without a box
    and lines.
    """
    box = best(boxes).select("query_id", F.col("part_type").alias("box_type"), F.col("confidence").alias("box_confidence"), F.col("bbox").alias("box"))
    item = F.struct("rank", "text", "confidence", "is_brand")
    texts = lines(raw_lines).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("lines"))
    q = queries.select("query_id").join(box, "query_id", "left").join(texts, "query_id", "left")
    said = F.array_join(F.transform(F.filter("lines", lambda x: x["text"] != ""), lambda x: x["text"]), " ")
    q = q.withColumns({"ocr_text": F.nullif(said, F.lit("")), "ocr_confidence": F.coalesce(F.array_max(F.transform("lines", lambda x: x["confidence"])), F.lit(0.0)), "branded": F.get(F.filter("lines", lambda x: x["is_brand"]), F.lit(0))})
    known = F.when(F.col("box_type") != "unknown", F.col("box_type"))
    matched = X.brand_with_confidence(F.col("ocr_text"), brands)
    has_text, branded = F.col("ocr_text").isNotNull(), F.col("branded").isNotNull()
    # A struct's fields of a missing struct are null, which greatest passes over.
    q = q.withColumns({
        "part_type": F.coalesce(known, X.first_entry(F.col("ocr_text"), keywords), F.col("box_type")),
        "brand_name": F.when(has_text, F.when(branded, F.col("branded")["text"]).otherwise(matched["brand"])),
        "brand_confidence": F.when(has_text, F.when(branded, F.col("branded")["confidence"]).otherwise(matched["confidence"])),
        "part_number": F.when(has_text, X.part_number_or_null(X.find_part_number(F.col("ocr_text")))),
    })
    some = F.col("box_confidence").isNotNull() | F.col("lines").isNotNull()
    confidence = F.when(some, F.greatest(F.coalesce("box_confidence", F.lit(0.0)), "ocr_confidence", F.coalesce("brand_confidence", F.lit(0.0)))).otherwise(F.lit(0.0))
    return q.select("query_id", F.coalesce("box_confidence", F.lit(0.0)).alias("detected"), "box", "ocr_text", "ocr_confidence", "part_type", "brand_name", "part_number", confidence.alias("confidence"))
