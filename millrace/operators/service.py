"""The search service as one plan over a table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import catalogue, detections, fusion, retrieval

#: A source is asked for so many times the results that are returned.
OVER_FETCH = 2


def search(queries: DataFrame, boxes: DataFrame, lines: DataFrame, images: DataFrame, products: DataFrame, categories: DataFrame, top_k: int = 10, text_hits: DataFrame | None = None, others: bool = False) -> DataFrame:
    """``(query_id, part_type, brand_name, part_number, confidence, results, message)``, a row a query.

    queries: query_id, query (the picture's vector), warning (null, or what its checks found); boxes and lines: what detector
    and reader gave (see `detections`); images: point_id, product_id, embedding; products: product_id, name, category_id;
    categories: category_id, name; text_hits: query_id, product_id, score, hit_rank of a search by text, if there was one.

    Each query's picture, text and what is read from it (type, brand and number) search images, texts and products, each
    for twice `top_k` hits. A box below a confidence of 0.4 gives no type, an unknown type no filter. The three lists are
    fused with weights by the reading's confidence, and a message says what to think of the result.
    """
    asked = detections.read(queries, boxes, lines)
    asked = asked.withColumn("part_type", fusion.gate(F.col("detected"), F.col("part_type")))
    asked = catalogue.category_ids(asked, categories)
    k = OVER_FETCH * top_k
    columns = ["query_id", "source", "product_id", "score", "hit_rank"]
    image = retrieval.search(images, queries, k, others=others).join(images.select("point_id", "product_id"), "point_id").withColumn("source", F.lit("image"))
    rows = image.select(*columns).unionByName(catalogue.hits(products, asked, k).withColumn("source", F.lit("catalog")).select(*columns))
    if text_hits is not None:
        said = asked.where("ocr_text is not null").select("query_id")
        rows = rows.unionByName(text_hits.where(F.col("hit_rank") <= k).join(said, "query_id", "left_semi").withColumn("source", F.lit("text")).select(*columns))
    w = fusion.confidence_weights(F.col("ocr_confidence"))
    merged = fusion.merge(rows, asked.select("query_id", "confidence", *[w[x].alias(x) for x in ("alpha", "beta", "gamma")]), top_k)
    item = F.struct("rank", "product_id", F.round("score", 3).alias("score"), "match_type")
    lists = merged.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("results"))
    out = asked.join(queries.select("query_id", "warning"), "query_id").join(lists, "query_id", "left")
    results = F.coalesce("results", F.array().cast(lists.schema["results"].dataType))
    message = fusion.message(F.col("warning"), F.size(results), F.get(results, F.lit(0))["score"])
    return out.select("query_id", "part_type", "brand_name", "part_number", F.round("confidence", 3).alias("confidence"), results.alias("results"), message.alias("message"))
