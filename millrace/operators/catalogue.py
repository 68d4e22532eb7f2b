"""Lookups and searches in the product table, and the checks that its tables' schema states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Products of a page.
PAGE = 20


def page(products: DataFrame, skip: int = 0, limit: int = PAGE) -> DataFrame:
    """A page of products in the order of their ids."""
    return products.orderBy("product_id").offset(skip).limit(limit)


def scored(products: DataFrame) -> DataFrame:
    """``score``: the product's own, if it has one, else 1."""
    own = F.col("score").cast("double") if "score" in products.columns else F.lit(None).cast("double")
    return products.withColumn("score", F.coalesce(own, F.lit(1.0)))


def matches(category_id: Column | None = None, brand: Column | None = None, name: Column | None = None) -> Column:
    """Whether a product has the category, and the brand and the name within its name, letters of either case alike; what is
    null or empty isn't asked for."""
    asked = F.lit(True)
    if category_id is not None:
        asked = asked & (category_id.isNull() | (F.col("category_id") == category_id))
    for part in (brand, name):
        if part is not None:
            asked = asked & (part.isNull() | (part == "") | F.contains(F.lower("name"), F.lower(part)))
    return asked


def search(products: DataFrame, category_id: int | None = None, brand: str | None = None, name: str | None = None, skip: int = 0, limit: int = PAGE) -> DataFrame:
    """A page of the products (product_id, name, category_id) that have all that is asked for, with their score."""
    lit = lambda x: None if x is None else F.lit(x)
    return scored(page(products.where(matches(lit(category_id), lit(brand), lit(name))), skip, limit))


def by_category(products: DataFrame, category_id: int, skip: int = 0, limit: int = PAGE) -> DataFrame:
    return search(products, category_id, skip=skip, limit=limit)


def get_products(products: DataFrame, ids: DataFrame) -> DataFrame:
    """Products with the given ids, each once; ids without a product are left out."""
    return products.join(ids.select("product_id").distinct(), "product_id", "left_semi")


def category_ids(names: DataFrame, categories: DataFrame, name_col: str = "part_type") -> DataFrame:
    """`names` with the ``category_id`` of the category of that name, letters of either case alike; null for unknown names and
    for an id of 0. Of categories that share a name the last by id counts."""
    known = categories.groupBy(F.lower("name").alias("__name")).agg(F.max("category_id").alias("category_id"))
    return names.join(known, F.lower(F.col(name_col)) == F.col("__name"), "left").drop("__name").withColumn("category_id", F.nullif("category_id", F.lit(0)))


def hits(products: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``(query_id, product_id, score, hit_rank)``: the first k products by id of what each query asks for.

    asked: query_id, category_id, brand_name, part_number, nulls where nothing is asked; a query that asks for nothing gets
    the first k of all. Queries that ask for the same are answered once. What asks for a category only meets that
    category's first k products. What asks for words meets the products of its category, if it has one, and all
    products otherwise, as words can stand anywhere in a name: that is as many comparisons as different questions times
    products, and k rows a question from each task.
    """
    first = lambda df, *by: df.withColumn("hit_rank", F.row_number().over(Window.partitionBy(*by).orderBy("product_id"))).where(F.col("hit_rank") <= k)
    keys = ["category_id", "brand_name", "part_number"]
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    asked = asked.select("query_id", "category_id", empty("brand_name").alias("brand_name"), empty("part_number").alias("part_number"))
    asked = asked.withColumn("question", F.xxhash64(F.coalesce(F.col("category_id").cast("string"), F.lit("-")), F.coalesce("brand_name", F.lit("\0")), F.lit("|"), F.coalesce("part_number", F.lit("\0"))))
    questions = asked.select("question", *keys).distinct()
    worded = F.col("brand_name").isNotNull() | F.col("part_number").isNotNull()
    p = scored(products).select("product_id", "score", "name", F.col("category_id").alias("of"))
    heads = first(p, "of").select("of", "product_id", "score", "hit_rank")
    by_category = questions.where(~worded & F.col("category_id").isNotNull()).join(heads, F.col("category_id") == F.col("of"))
    anything = questions.where(~worded & F.col("category_id").isNull()).join(p.orderBy("product_id").limit(k).withColumn("hit_rank", F.row_number().over(Window.orderBy("product_id"))))
    words = F.lit(True)
    for c in ("brand_name", "part_number"):
        words = words & (F.col(c).isNull() | F.contains(F.lower("name"), F.lower(c)))
    wordy = questions.where(worded)
    inside = wordy.where("category_id is not null").join(p, (F.col("category_id") == F.col("of")) & words)
    anywhere = wordy.where("category_id is null").join(p, words)
    found = first(inside.unionByName(anywhere), "question")
    columns = ["question", "product_id", "score", "hit_rank"]
    answers = by_category.select(*columns).unionByName(anything.select(*columns)).unionByName(found.select(*columns))
    return asked.select("query_id", "question").join(answers, "question").drop("question")


def with_images(products: DataFrame) -> DataFrame:
    """Products that have an image."""
    return products.where("image_url is not null and image_url != ''")


#: What the schema allows in a column.
ALLOWED = {
    "role": ("index", "query"),
    "image_source": ("catalog", "own_photo", "roboflow"),
    "shot_type": ("A", "B", "C"),
    "id_source": ("box", "stamped_on_part", "shop_told_me", "unknown"),
    "split": ("valid", "test"),
}
#: Columns that may be null all the same.
OPTIONAL = ("shot_type",)


def schema_faults(rows: DataFrame, required: list[str] | None = None, unique: list[str] | None = None) -> DataFrame:
    """``(fault, n)``: how often a column with a list of allowed values has another, a required one is null, a unique one
    repeats. One pass over `rows` for the first two."""
    checks = {f"{c} not allowed": ~F.coalesce(F.col(c).isin(*ALLOWED[c]), F.lit(c in OPTIONAL)) for c in rows.columns if c in ALLOWED}
    checks |= {f"{c} missing": F.col(c).isNull() for c in required or []}
    spark = rows.sparkSession
    out = spark.createDataFrame([], "fault string, n long")
    if checks:
        counted = rows.agg(*[F.count_if(x).alias(str(k)) for k, x in enumerate(checks.values())])
        pairs = F.array(*[F.struct(F.lit(name).alias("fault"), F.col(str(k)).alias("n")) for k, name in enumerate(checks)])
        out = counted.select(F.explode(pairs).alias("x")).select("x.fault", "x.n")
    for c in unique or []:
        again = rows.where(F.col(c).isNotNull()).groupBy(c).agg((F.count("*") - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
        out = out.unionByName(again.select(F.lit(f"{c} repeated").alias("fault"), "n"))
    return out


#: Paths that need no key.
OPEN_PATHS = ("/health", "/", "/docs", "/redoc", "/openapi.json")


def request_status(path: Column, key: Column, expected: str | None) -> Column:
    """401 for a path that needs a key and comes without the expected one, else 200; no key is expected if none is set."""
    return F.when(F.lit(bool(expected)) & ~path.isin(*OPEN_PATHS) & ~key.eqNullSafe(F.lit(expected)), 401).otherwise(200)
