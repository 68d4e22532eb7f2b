"""Building, cleaning and grouping parts from sellers' listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.dictionaries import LEAF_LABELS
from millrace.operators import dedup, quality, splits
from millrace.operators.components import connected_components
from millrace.storage import written

#: Categories in which a part near to the catalogue's can be unknown, and what stands for no number there.
NEAR_LABELS = ["braking", "engine and powertrain", "filters"]
NO_NUMBER = ["", "na", "none", "doesnotapply", "notapplicable", "unknown", "unbranded", "seedescription", "0"]
#: Marks of a hand check that exclude a part.
BAD_MARKS = ["n", "m", "?"]
#: Part numbers of motorcycles, and what is noted of them.
MOTORCYCLE = r"-(K03|KWB|K62|GFP|GF6)-"
MOTORCYCLE_NOTE = " | motorcycle part number (Honda pattern), out of scope for car garages: exclude from distractors"


def part_keys(items: DataFrame, long_number: int | None = None) -> DataFrame:
    """Items with a number, with ``part_id``: brand and number, so that brands that share a number stay apart. Numbers of
    `long_number` characters or more are one part whatever brand a seller typed, under the brand most items name.

    items: item_id, seq (their order), mpn, brand and any other columns.
    """
    some = items.where("mpn is not null and mpn != ''").withColumn("brand", F.coalesce(F.nullif("brand", F.lit("")), F.lit("unknown")))
    if long_number is not None:
        votes = quality.vote(some, "mpn", "brand", "seq").select("mpn", F.col("brand").alias("__voted"))
        some = some.join(votes, "mpn").withColumn("brand", F.when(F.length("mpn") >= long_number, F.col("__voted")).otherwise(F.col("brand"))).drop("__voted")
    return some.withColumn("part_id", F.concat("brand", F.lit("::"), "mpn"))


def gallery_sellers(rows: DataFrame, seed: int) -> DataFrame:
    """``(part_id, n_sellers, gallery_seller, n)``: of each part's sellers the one with most images, ties in shuffled order."""
    per = rows.groupBy("part_id", "seller").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), splits.shuffle_key(seed, "seller").alias("k"), "seller"))
    return per.groupBy("part_id").agg(F.count("*").alias("n_sellers"), best.alias("b")).select("part_id", "n_sellers", F.col("b.seller").alias("gallery_seller"), (-F.col("b.n")).alias("n"))


def build(items: DataFrame, images: DataFrame, min_sellers: int = 2, dup_dist: int = 6, least_side: int = 200, long_number: int | None = None, seed: int = 42, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(catalog, gallery, queries)`` from listings.

    items: item_id, seq, mpn, brand, seller, title, query, category; images: item_id, image, phash, side (the shorter one).
    Images too small are left out. A photo whose near copies two sellers show, anywhere, is a stock photo. Of each part
    with enough sellers, the one with most images gives the gallery (ties in shuffled order); the others' images are
    queries, but for stock photos, near copies of the part's gallery, and near copies of a query before. Parts without a
    query go. Copies are the components of near pairs, so the order of the images doesn't matter. near: a, b, the near
    pairs of all images' hashes, where they are known already.
    """
    keyed = part_keys(items, long_number)
    rows = keyed.join(images.where(F.col("side") >= least_side), "item_id").select("part_id", "brand", "mpn", "seller", "title", "query", "category", "seq", "item_id", "image", "phash")
    rows = written(rows, "listing-images")
    # Hashes are the nodes: equal ones are one photo.
    hashes = rows.select(F.col("phash").alias("id"), F.col("phash").alias("h")).distinct()
    if near is None:
        near = written(dedup.near_hashes(hashes, "h", dup_dist), "listing-pairs")
    else:
        near = near.join(hashes.select(F.col("id").alias("a")), "a", "left_semi").join(hashes.select(F.col("id").alias("b")), "b", "left_semi")
    clusters = dedup.groups(hashes, "id", near).select(F.col("id").alias("phash"), F.col("group").alias("cluster"))
    rows = written(dedup.shown_by_several(rows.join(clusters, "phash"), "cluster", "seller", "stock").drop("cluster"), "listing-rows")
    chosen = gallery_sellers(rows, seed).where(F.col("n_sellers") >= min_sellers).drop("n")
    rows = rows.join(chosen, "part_id")
    gallery = rows.where("seller = gallery_seller")
    others = rows.where("seller != gallery_seller and not stock")
    others = dedup.without_near(others, gallery.select("part_id", "phash"), "part_id", "phash", dup_dist)
    # One number an image, in the listings' order, for the greedy pass.
    order = Window.partitionBy("part_id").orderBy("seq", "image")
    others = written(others.withColumn("place", F.row_number().over(order).cast("long")), "listing-queries")
    first = dedup.leaders(others, "part_id", "place", "phash", dup_dist).where("place = leader").select("part_id", "place")
    queries = written(others.join(first, ["part_id", "place"], "left_semi"), "listing-kept")
    counts = queries.groupBy("part_id").agg(F.count("*").alias("n_query"))
    gallery = gallery.join(counts.select("part_id"), "part_id", "left_semi")
    head = F.min(F.struct("seq", "image", "brand", "mpn", "title", "query", "category", "n_sellers")).alias("x")
    catalog = gallery.groupBy("part_id").agg(head, F.count("*").alias("n_gallery")).join(counts, "part_id")
    catalog = catalog.select("part_id", "x.brand", "x.mpn", "x.title", F.col("x.query").alias("query_term"), "x.category", "x.n_sellers", "n_gallery", "n_query")
    seller = X.seller_hash(F.col("seller"), 10).alias("seller_hash")
    return catalog, gallery.select("part_id", "image", "item_id", seller, "phash", F.col("stock").cast("int").alias("stock")), queries.select("part_id", "image", "item_id", seller, "phash", "title")


def other_number(rows: DataFrame, key: list[str], title: str, own: str, numbers: DataFrame) -> DataFrame:
    """``(*key, other)``: the first number in a title that is another part's, for titles that don't hold their own number.

    own: a number as letters and digits; numbers: ``number`` of all parts. Tokens meet the numbers by an equi-join.
    """
    some = rows.where(~F.contains(X.letters_digits(F.col(title)), F.col(own)))
    tokens = some.select(*key, own, F.posexplode(X.title_tokens(F.col(title))).alias("__at", "number")).where((F.col("number") != F.col(own)) & F.col("number").rlike("[0-9]"))
    return tokens.join(numbers.select("number").distinct(), "number", "left_semi").groupBy(*key).agg(F.min(F.struct("__at", "number"))["number"].alias("other"))


def clean(catalog: DataFrame, gallery: DataFrame, queries: DataFrame, checked: DataFrame | None = None, labels: dict[str, str] = LEAF_LABELS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(parts, gallery, queries, dropped)``: what is fit to use, and for the rest the first reason against it.

    A part goes if its brand is unknown, if a hand check (mpn, mark) says so, if its number is junk, if its title names
    another part's number, if its category has no label, or if no gallery or query is left. A query goes if its title
    offers several numbers without naming its own, or names another part's.
    """
    spark = catalog.sparkSession
    c = catalog.withColumns({"own": X.letters_digits(F.col("mpn")), "leaf": F.element_at(F.split(F.coalesce("category", F.lit("")), r"\|"), -1), "label": X.leaf_label(F.col("category"), labels)})
    numbers = c.where(F.length("own") >= 4).select(F.col("own").alias("number")).distinct()
    if checked is None:
        checked = spark.createDataFrame([], "mpn string, mark string")
    marks = checked.where(F.col("mark").isin(BAD_MARKS)).groupBy(X.letters_digits(F.col("mpn")).alias("own")).agg(F.max("mark").alias("mark"))
    c = c.join(marks, "own", "left").join(other_number(c, ["part_id"], "title", "own", numbers), "part_id", "left")
    # The names of the reasons, here and below.
    reason = F.coalesce(
        F.when(F.col("brand") == "unknown", "unknown_brand"), F.when(F.col("mark").isNotNull(), F.concat(F.lit("hand_check_"), "mark")), F.when(X.junk_number(F.col("own")), "junk_mpn"),
        F.when(F.col("other").isNotNull(), F.concat(F.lit("gallery_title_names_"), "other")), F.when(F.col("label").isNull(), F.concat(F.lit("unmapped_category:"), "leaf")),
    )
    c = written(c.withColumn("reason", reason).drop("other", "mark"), "clean-parts")
    open_ = c.where("reason is null").select("part_id", "own", "label")
    q = queries.join(open_, "part_id")
    named = other_number(q, ["part_id", "image"], "title", "own", numbers)
    q = q.join(named, ["part_id", "image"], "left")
    q = q.withColumn("reason", F.when(X.joint_title(F.col("title"), F.col("label") == "lighting", F.col("own")), "multi_item_title").when(F.col("other").isNotNull(), "query_title_names_other_part"))
    q = written(q.drop("other"), "clean-queries")
    g = gallery.join(open_.select("part_id", "label"), "part_id")
    left = q.where("reason is null").groupBy("part_id").agg(F.count("*").alias("n_query"))
    held = g.groupBy("part_id").agg(F.count("*").alias("n_gallery"), F.count_if(F.col("stock").cast("string") == "1").alias("n_gallery_stock"))
    both = written(left.join(held, "part_id"), "clean-left")
    sellers = q.where("reason is null").select("part_id", "seller_hash").unionByName(g.select("part_id", "seller_hash")).groupBy("part_id").agg(F.countDistinct("seller_hash").alias("n_sellers"))
    kept = c.where("reason is null").drop("n_sellers", "n_gallery", "n_query").join(both, "part_id").join(sellers, "part_id")
    folder = X.file_safe(F.col("part_id")).alias("part_dir")
    parts = kept.select("part_id", folder, "brand", "mpn", "title", F.col("label").alias("category"), F.col("category").alias("listing_category"), "n_sellers", "n_gallery", "n_query", "n_gallery_stock", X.short_number(F.col("mpn")).alias("short_mpn"))
    ids = both.select("part_id")
    out_g = g.join(ids, "part_id", "left_semi").withColumnRenamed("label", "category").withColumn("part_dir", X.file_safe(F.col("part_id")))
    out_q = q.where("reason is null").join(ids, "part_id", "left_semi").drop("own", "reason").withColumnRenamed("label", "category").withColumn("part_dir", X.file_safe(F.col("part_id")))
    none = open_.join(ids, "part_id", "left_anti").select("part_id", F.lit("").alias("image"), F.lit("no_gallery_or_no_query_left").alias("reason"))
    dropped = c.where("reason is not null").select("part_id", F.lit("").alias("image"), "reason").unionByName(q.where("reason is not null").select("part_id", "image", "reason")).unionByName(none)
    return parts, out_g, out_q, dropped


def clean_report(parts: DataFrame, dropped: DataFrame) -> DataFrame:
    """``(what, name, n)``: parts, gallery and query images by category, short numbers kept, and drops by reason."""
    by = parts.groupBy("category").agg(F.count("*").alias("parts"), F.sum("n_gallery").alias("gallery"), F.sum("n_query").alias("queries"), F.sum("short_mpn").cast("long").alias("short"))
    rows = by.select(F.explode(F.array(*[F.struct(F.lit(x).alias("what"), F.col("category").alias("name"), F.col(x).alias("n")) for x in ("parts", "gallery", "queries", "short")])).alias("x")).select("x.*")
    reasons = dropped.groupBy(F.substring_index("reason", ":", 1).alias("name")).agg(F.count("*").alias("n"))
    return rows.unionByName(reasons.select(F.lit("dropped").alias("what"), "name", "n"))


def copy_paths(rows: DataFrame, root: str, kind: str) -> DataFrame:
    """``dst``: where an image goes in a tree of kind, category and part."""
    name = F.element_at(F.split("image", "/"), -1)
    return rows.withColumn("dst", F.concat_ws("/", F.lit(root), F.lit(kind), F.replace("category", F.lit(" "), F.lit("_")), "part_dir", name))


def near_unknowns(items: DataFrame, images: DataFrame, catalog: DataFrame, per_category: int = 20, most_images: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(chosen, skipped)``: listings of parts that the catalogue doesn't have, though it has their category.

    items: item_id, seq, mpn, brand, title, category, url; images: item_id, image; catalog: mpn, title. A number is
    skipped if the catalogue has it, if a number in its titles is one of the catalogue's, or if none of its listings has an
    image. Of a number's listings the one with most images (up to `most_images`; of several the first) stands for it.
    Of each category up to `per_category` drawn numbers, a row an image.
    """
    it = items.withColumns({"number": X.letters_digits(F.col("mpn")), "label": X.leaf_label(F.col("category"), LEAF_LABELS)})
    fit = ~F.col("number").isin(NO_NUMBER) & (F.length("number") >= 5) & (F.coalesce(F.nullif("brand", F.lit("")), F.lit("unknown")) != "unknown") & F.col("label").isin(NEAR_LABELS)
    it = it.where(fit)
    own = catalog.select(X.letters_digits(F.col("mpn")).alias("token"))
    known = catalog.select(F.explode(X.long_numbers(F.col("title"))).alias("token")).unionByName(own).distinct()
    tokens = it.select("number", F.explode(F.array_union(X.long_numbers(F.col("title")), F.array("number"))).alias("token")).distinct()
    same = tokens.join(known, "token", "left_semi").select("number").distinct().withColumn("same", F.lit(True))
    listed = own.select(F.col("token").alias("number")).distinct().withColumn("listed", F.lit(True))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("image"))
    shown = images.withColumn("place", place).where(F.col("place") <= most_images)
    counts = it.join(shown.groupBy("item_id").agg(F.count("*").alias("n_images")), "item_id", "left").withColumn("n_images", F.coalesce("n_images", F.lit(0)))
    best = F.min(F.struct((-F.col("n_images")).alias("n"), "seq", "item_id", "brand", "title", "label", "url")).alias("b")
    numbers = counts.groupBy("number").agg(best, F.count("*").alias("n_listings")).join(listed, "number", "left").join(same, "number", "left")
    # The names of the reasons.
    why = F.when(F.col("listed"), "in_catalogue").when(F.col("same"), "same_product_as_catalogue").when(F.col("b.n") == 0, "no_images")
    numbers = written(numbers.withColumn("why", why).select("number", "n_listings", "why", "b.item_id", "b.brand", "b.title", "b.label", "b.url"), "unknowns")
    chosen = splits.sample_each(numbers.where("why is null"), "label", "number", per_category, seed)
    part = F.concat("brand", F.lit("::"), "number")
    rows = chosen.join(shown.select("item_id", "image"), "item_id").select(part.alias("part_id"), "brand", F.col("number").alias("mpn"), "title", F.col("label").alias("category"), "image", "item_id", X.url_base(F.coalesce("url", F.lit(""))).alias("item_url"), F.lit("near_unknown").alias("kind"))
    return rows, numbers.where("why is not null").groupBy("why").agg(F.count("*").alias("n"))


def shared_by_few(owners: DataFrame, token: str, part: str, least: int = 2, most: int = 6) -> DataFrame:
    """``(a, b)``: parts that share a token which `least` to `most` parts have, each tied to the first of them."""
    o = owners.select(F.col(token).alias("token"), F.col(part).alias("part")).distinct()
    few = o.groupBy("token").agg(F.count("*").alias("n"), F.min("part").alias("head")).where(F.col("n").between(least, most))
    return o.join(few, "token").where("part != head").select(F.col("part").alias("a"), F.col("head").alias("b")).distinct()


def product_groups(parts: DataFrame, titles: DataFrame, items: DataFrame, images: DataFrame, dup_dist: int = 6, generic: int = 4, near: DataFrame | None = None) -> DataFrame:
    """``(part_id, group)``: parts that may be one product, by a long number in their titles, by a code of a seller's list, or by
    near copies among their images; images near to more than `generic` other parts are banners and don't count.

    parts: part_id, pos (their order), mpn, title; titles: part_id, title of queries; items: mpn, mpn_raw; images: image
    (a number), part_id, phash. A number that several parts have belongs to the last of them. near: a, b, the near pairs of
    all images' hashes, where they are known already.
    """
    own = parts.select("part_id", X.letters_digits(F.col("mpn")).alias("token")).where(F.length("token") >= 7)
    said = parts.select("part_id", "title").unionByName(titles.select("part_id", "title"))
    by_number = shared_by_few(said.select("part_id", F.explode(X.long_numbers(F.col("title"))).alias("token")).unionByName(own), "token", "part_id")
    last = parts.groupBy(X.letters_digits(F.col("mpn")).alias("number")).agg(F.max_by("part_id", "pos").alias("part_id"))
    coded = items.select(X.letters_digits(F.col("mpn")).alias("number"), F.explode(X.seller_codes(F.col("mpn_raw"))).alias("token")).join(last, "number")
    by_code = shared_by_few(coded, "token", "part_id")
    images = images.where("image is not null")
    if near is None:
        near = written(dedup.near_hashes(images.select("phash").distinct(), "phash", dup_dist), "group-pairs")
    by_image = dedup.parts_by_image(images, "part_id", "phash", near, generic)
    found = connected_components(by_number.unionByName(by_code).unionByName(by_image), "a", "b")
    return parts.select("part_id").join(found, parts["part_id"] == found["id"], "left").select("part_id", F.coalesce("component", "part_id").alias("group"))


def equivalences(names: DataFrame, name: str = "name", shapes: str = X.CODE_SHAPES) -> DataFrame:
    """Names that hold two codes or more: the codes as part numbers, and whether to look at them."""
    codes = X.split_codes(F.col(name), shapes)
    members = F.transform(codes, X.part_number)
    return names.where(F.size(codes) >= 2).select(name, members.alias("members"), F.lit("folder_name").alias("evidence"), X.needs_check(members).alias("needs_check"), F.lit(False).alias("reviewed"))


def project_rows(images: DataFrame, site: str, collected_by: str, base_url: str) -> DataFrame:
    """A catalogue row for each part of each project; images: project, part, path. Folders of one name are one part."""
    by = images.groupBy("project", "part").agg(F.count("*").alias("n"))
    # The words of the note.
    note = F.concat(F.lit("auto-imported from "), "project", F.lit(", "), F.col("n").cast("string"), F.lit(" image(s), is_distractor candidate -- verify part number before indexing"), motorcycle_note(F.col("part")))
    return by.select(F.col("part").alias("part_number_raw"), F.lit("").alias("brand"), F.lit("").alias("category"), F.concat("project", F.lit(" part "), "part").alias("name"), F.lit("").alias("oem_number"), F.concat(F.lit(base_url.rstrip("/") + "/"), "project").alias("source_url"), F.lit(site).alias("source_site"), F.lit(collected_by).alias("collected_by"), note.alias("notes"))


def motorcycle_note(part: Column) -> Column:
    return F.when(part.rlike(MOTORCYCLE), MOTORCYCLE_NOTE).otherwise("")


#: Keys under which a stream's items have their manufacturer's number, in order, sizes of a picture, and what is
#: said of a number's evidence.
NUMBER_KEYS = ["Manufacturer Part Number", "manufacturer_part_number", "mpn", "MPN", "Part Number"]
PICTURE_KEYS = ["hi_res", "large", "thumb"]
REAL_NUMBER, OWN_ID = "has_real_mpn", "asin_only_no_verified_part_number"


def stream_items(items: DataFrame, n: int, numbered_only: bool = False) -> DataFrame:
    """Up to `n` items with a picture: their number (else their own id), brand, name and the first picture's largest url.

    items: id, title, store, details (a map), images (an array of maps). Spark stops reading once there are enough.
    """
    number = X.stripped(X.first_aspect(F.col("details"), NUMBER_KEYS))
    urls = F.filter(F.transform("images", lambda m: F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in PICTURE_KEYS])), lambda u: u.isNotNull())
    out = items.withColumns({"mpn": number, "image_url": F.get(urls, F.lit(0))}).where("image_url is not null")
    out = out.where("mpn != ''") if numbered_only else out
    raw = F.coalesce(F.nullif("mpn", F.lit("")), "id")
    return out.limit(n).select(raw.alias("part_number_raw"), X.stripped(F.col("store")).alias("brand"), F.substring(X.stripped(F.col("title")), 1, 120).alias("name"), F.when(F.col("mpn") != "", REAL_NUMBER).otherwise(OWN_ID).alias("evidence"), "image_url", X.slug(raw).alias("slug"))
