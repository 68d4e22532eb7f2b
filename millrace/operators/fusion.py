"""Late fusion of image, text and catalogue hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order in which sources bring products in, for ties.
SOURCES = ("catalog", "image", "text")


def weights(confidence: Column, alpha: Column, beta: Column, gamma: Column) -> dict[str, Column]:
    """Weights of a query: its own if both first are given, else by the detector's confidence."""
    own, low = alpha.isNotNull() & beta.isNotNull(), confidence < 0.5
    return {
        "image": F.when(own, alpha).when(low, 0.7).otherwise(0.4),
        "text": F.when(own, beta).otherwise(0.2),
        "catalog": F.when(own, F.coalesce(gamma, F.greatest(F.lit(0.0), 1 - alpha - beta))).when(low, 0.3).otherwise(0.6),
    }


def confidence_weights(confidence: Column) -> Column:
    """Weights that the service gives by the confidence of what was read."""
    low = confidence < 0.5
    return F.struct(F.when(low, 0.75).otherwise(0.4).alias("alpha"), F.when(low, 0.0).otherwise(0.4).alias("beta"), F.when(low, 0.25).otherwise(0.2).alias("gamma"))


def gate(confidence: Column, value: Column) -> Column:
    """What was detected counts only from a confidence of 0.4."""
    return F.when(confidence >= 0.4, value)


def overall_confidence(*parts: Column) -> Column:
    return F.coalesce(F.greatest(*[F.coalesce(p, F.lit(0.0)) for p in parts]), F.lit(0.0))


#: What a response says, in the order in which it is looked at, and the scores below which.
QUALITY_WARNING = "Image quality warning: "
NO_PRODUCTS = "No matching products found. Try a clearer photo or different angle."
NO_MATCH, NO_MATCH_BELOW = "No confident match found. Please verify the product or try another photo.", 0.35
LOW_MATCH, LOW_MATCH_BELOW = "Low confidence match. Please verify the product or try another photo.", 0.6


def message(warning: Column, n_results: Column, top_score: Column) -> Column:
    """What a response says of its results, null if there is nothing to say. top_score: as it is returned, rounded."""
    return F.when(warning.isNotNull(), F.concat(F.lit(QUALITY_WARNING), warning)).when(n_results == 0, NO_PRODUCTS).when(top_score < NO_MATCH_BELOW, NO_MATCH).when(top_score < LOW_MATCH_BELOW, LOW_MATCH)


def merge(hits: DataFrame, queries: DataFrame, max_results: int = 20) -> DataFrame:
    """``(query_id, rank, product_id, score, match_type, confidence, image, text, catalog)``.

    hits: query_id, source, product_id, score, hit_rank; queries: query_id, confidence, alpha, beta, gamma. Of a source's
    hits of one product the last counts. Sources are counted by presence, the catalogue's only for products other than 0;
    hits without a product are skipped. Equal scores stand as the products came in: catalogue, image, text. One shuffle, by
    query and product.
    """
    s = F.col("source")
    rows = hits.where(F.col("product_id").isNotNull())
    first = F.coalesce(*[F.when(s == name, k) for k, name in enumerate(SOURCES)]) * F.lit(10**9) + F.col("hit_rank")
    last = lambda name: F.max_by(F.when(s == name, F.col("score")), F.when(s == name, F.col("hit_rank")))
    by = rows.groupBy("query_id", "product_id").agg(*[last(n).alias(n) for n in SOURCES], F.min(first).alias("came"))
    q = queries.select("query_id", "confidence", *[w.alias(f"w_{n}") for n, w in weights(*[F.col(c) for c in ("confidence", "alpha", "beta", "gamma")]).items()])
    by = by.join(q, "query_id")
    present = {"image": F.col("image").isNotNull(), "text": F.col("text").isNotNull(), "metadata": F.col("catalog").isNotNull() & (F.col("product_id") != 0)}
    count = sum(p.cast("int") for p in present.values())
    kind = F.when(count >= 2, "hybrid").when(present["image"], "image").when(present["text"], "text").when(present["metadata"], "metadata").otherwise("unknown")
    # Scores are ranked as they are; whoever shows them rounds.
    parts = [(F.coalesce(F.col(n), F.lit(0.0)) * F.col(f"w_{n}")).alias(n) for n in ("image", "text", "catalog")]
    out = by.select("query_id", "product_id", "confidence", "came", kind.alias("match_type"), *parts)
    out = out.withColumn("score", F.col("image") + F.col("text") + F.col("catalog"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "came"))
    return out.withColumn("rank", rank).where(F.col("rank") <= max_results).drop("came")


def diversify(merged: DataFrame, max_results: int = 10, threshold: float = 0.8) -> DataFrame:
    """Of each query's results in order, those well below the last one kept. The limit is looked at after a result is added,
    so one result asked for can give two. A fold over at most twice the results asked for."""
    items = F.array_sort(F.collect_list(F.struct("rank", "product_id", "score")))
    kept = merged.where(F.col("rank") <= 2 * max_results).groupBy("query_id").agg(items.alias("x"))
    one = F.element_at("x", 1)
    start = F.struct(F.array(one).alias("out"), one["score"].alias("last"), F.lit(False).alias("stop"))

    def step(a: Column, r: Column) -> Column:
        take = ~a["stop"] & ((a["last"] - r["score"]) > (1 - threshold) * a["last"])
        out = F.when(take, F.concat(a["out"], F.array(r))).otherwise(a["out"])
        return F.struct(out.alias("out"), F.when(take, r["score"]).otherwise(a["last"]).alias("last"), (a["stop"] | (F.size(out) >= max_results)).alias("stop"))

    folded = F.aggregate(F.slice("x", 2, 2 * max_results), start, step, lambda a: a["out"])
    return kept.select("query_id", F.posexplode(folded).alias("pos", "r")).select("query_id", (F.col("pos") + 1).alias("rank"), "r.product_id", "r.score")


def rerank(merged: DataFrame, type_weights: dict[str, float]) -> DataFrame:
    w = F.coalesce(*[F.when(F.col("match_type") == t, F.lit(x)) for t, x in type_weights.items()], F.lit(1.0))
    out = merged.withColumn("score", F.col("score") * w)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")))


def with_details(merged: DataFrame, products: DataFrame) -> DataFrame:
    return merged.withColumn("score", F.round("score", 3)).join(products, "product_id", "left")
