"""Splits that keep groups whole. Shuffles follow from a hash of seed and id, so reruns and engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.components import connected_components
from millrace.operators.ordering import offsets


def shuffle_key(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *cols))


def pack_ratios(groups: DataFrame, key: str, group: str, size: str, ratios: tuple[float, float] = (0.7, 0.15), seed: int = 0) -> DataFrame:
    """Groups of each key, in shuffled order, to train, val and test: a part ends once the rows before reach its share."""
    order = Window.partitionBy(key).orderBy(shuffle_key(seed, group), group)
    done = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(size).over(Window.partitionBy(key))
    return groups.withColumn("partition", F.when(done < ratios[0] * total, "train").when(done < (ratios[0] + ratios[1]) * total, "val").otherwise("test"))


def split_types(rows: DataFrame, key: str, item: str, share: float = 0.2, most_queries: int = 20, seed: int = 0) -> DataFrame:
    """Each key's items to train, gallery and query: at least 4 for evaluation, half of those queries up to a limit."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(shuffle_key(seed, item), item))
    n = F.count("*").over(Window.partitionBy(key))
    n_eval = F.least(n, F.greatest(F.lit(4), F.bround(n * F.lit(share)).cast("long")))
    n_query = F.least(F.lit(most_queries), F.floor(n_eval / 2))
    return rows.withColumn("side", F.when(rank <= n_query, "query").when(rank <= n_eval, "gallery").otherwise("train"))


def shuffled_rank(rows: DataFrame, name: str, seed: int, out: str = "rank") -> DataFrame:
    """`rows` with their place, from 1, in shuffled order; `name` names a row. No task sees all rows."""
    n = rows.count()
    keyed = rows.withColumn("__key", shuffle_key(seed, name)).withColumn("__one", F.lit(1))
    return offsets(keyed, [], "__key", "__one", n, "__before").withColumn(out, (F.col("__before") + 1).cast("long")).drop("__key", "__one", "__before")


def split_groups(groups: DataFrame, group: str, valid: float, unknown: int, seed: int = 0) -> DataFrame:
    """Groups to far (the first `unknown`), valid (a share of the rest, one at least) and train, in shuffled order."""
    n = groups.count()
    n_valid = max(1, round((n - unknown) * valid))
    ranked = shuffled_rank(groups, group, seed, "__r")
    return ranked.withColumn("side", F.when(F.col("__r") <= unknown, "far").when(F.col("__r") <= unknown + n_valid, "valid").otherwise("train")).drop("__r")


def split_ranks(rows: DataFrame, name: str, train: float = 0.8, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """Rows to train, valid and test by their place in shuffled order: so many whole rows of the first two, and the rest."""
    n = rows.count()
    n_train, n_valid = int(n * train), int(n * valid)
    ranked = shuffled_rank(rows, name, seed, "__r")
    return ranked.withColumn("split", F.when(F.col("__r") <= n_train, "train").when(F.col("__r") <= n_train + n_valid, "valid").otherwise("test")).drop("__r")


def carve(rows: DataFrame, key: str, item: str, share: float = 0.1, least: int = 4, seed: int = 42) -> DataFrame:
    """Of each key's items a share, `least` at least, set apart: half of it queries, rounded down, the rest gallery."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(shuffle_key(seed, item), item))
    n = F.count("*").over(Window.partitionBy(key))
    n_eval = F.least(n, F.greatest(F.lit(least), F.bround(n * F.lit(share)).cast("long")))
    return rows.withColumn("side", F.when(rank <= F.floor(n_eval / 2), "query").when(rank <= n_eval, "gallery").otherwise("train"))


def one_query_each(rows: DataFrame, key: str, item: str, seed: int = 42) -> DataFrame:
    """One drawn item of each key as its query, the others as gallery."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(shuffle_key(seed, item), item))
    return rows.withColumn("side", F.when(rank == 1, "query").otherwise("gallery"))


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def sample_each(rows: DataFrame, key: str, item: str, most: int, seed: int = 42) -> DataFrame:
    """Up to `most` drawn rows of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(shuffle_key(seed, item), item))).where(F.col("__r") <= most).drop("__r")


def numbered_files(rows: DataFrame, key: str, path: str) -> DataFrame:
    """``file``: the place of a path among its key's, with its extension in lower case."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(path))
    return rows.withColumn("file", F.concat(place.cast("string"), F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))))


def one_label_clusters(rows: DataFrame, cluster: str, label: str, order: list[Column]) -> DataFrame:
    """The best row of each cluster, by `order`; clusters with more than one label go entirely."""
    labels = rows.groupBy(cluster).agg(F.countDistinct(label).alias("__labels")).where("__labels = 1").select(cluster)
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(*order))
    return rows.join(labels, cluster, "left_semi").withColumn("__r", rank).where("__r = 1").drop("__r")


def large_types(rows: DataFrame, label: str, least: int) -> DataFrame:
    """Rows of labels that have at least so many rows."""
    return rows.join(rows.groupBy(label).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(label), label, "left_semi")


def heldout_types(rows: DataFrame, label: str, sample: int | None = None, fixed: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Labels held out of training: a list that must be there, or so many drawn ones."""
    types = rows.select(label).distinct()
    if fixed is not None:
        wanted = rows.sparkSession.createDataFrame([(x,) for x in fixed], f"{label} string")
        if missing := [r[0] for r in wanted.join(types, label, "left_anti").collect()]:
            raise ValueError(f"held-out types without rows: {missing}")
        return wanted
    return types.orderBy(shuffle_key(seed, label), label).limit(sample or 0)


def photo_sides(rows: DataFrame, photo: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Photos that go to evaluation: a share of all, in shuffled order, so that the crops of one photo stay on one side."""
    photos = rows.where(F.col(photo).isNotNull() & (F.col(photo) != "")).select(photo).distinct()
    n = photos.count()
    return shuffled_rank(photos, photo, seed, "__r").where(F.col("__r") <= round(n * share)).drop("__r")


def heldout_groups(rows: DataFrame, group: str, part: str, category: str, heldout: list[str]) -> DataFrame:
    """``(group, category, held, members, spans)``: a group with any member of a held-out category is held out as a whole, under
    the first of these by name; else it has its commonest category, of several the first by name. spans: more than one."""
    n = rows.groupBy(group, category).agg(F.count(part).alias("__n"))
    held = F.col(category).isin(heldout)
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(category).alias("c")))["c"]
    by = n.groupBy(group).agg(F.min(F.when(held, F.col(category))).alias("__held"), best.alias("__common"), F.sum("__n").alias("members"), (F.count("*") > 1).alias("spans"))
    return by.select(group, F.coalesce("__held", "__common").alias("category"), F.col("__held").isNotNull().alias("held"), "members", "spans")


def pack_heldout(groups: DataFrame, ratios: tuple[float, float] = (0.6, 0.2), seed: int = 42) -> DataFrame:
    """`heldout_groups` with their ``partition``: held out, or train, val and test by running size in each category."""
    packed = pack_ratios(groups, "category", "grp", "members", ratios, seed)
    return packed.withColumn("partition", F.when(F.col("held"), "heldout").otherwise(F.col("partition")))


def part_groups(images: DataFrame, part: str, cluster: str) -> DataFrame:
    """``(part, group)``: parts that share a cluster of images, directly or through others, are one group, named by its least
    part. A cluster ties all its parts to its least one."""
    named = images.select(part).distinct()
    least = images.groupBy(cluster).agg(F.min(part).alias("__least"))
    edges = images.join(least, cluster).select(F.col(part).alias("a"), F.col("__least").alias("b")).distinct()
    found = connected_components(edges, "a", "b")
    return named.join(found, named[part] == found["id"], "left").select(part, F.coalesce("component", part).alias("group"))


def cap_side(rows: DataFrame, key: str, item: str, reserved: Column, cap: int, seed: int = 0) -> DataFrame:
    """At most `cap` rows of each key: the reserved ones give way first, but keep a third of the cap if there are as many."""
    w = Window.partitionBy(key)
    r = rows.withColumn("__s", reserved.cast("int"))
    kept, n = F.sum("__s").over(w), F.count("*").over(w)
    rest = n - kept
    keep_rest = F.least(rest, F.greatest(cap - F.least(kept, F.lit(cap // 3)), cap - kept))
    rank = F.row_number().over(Window.partitionBy(key, "__s").orderBy(shuffle_key(seed, item), item))
    r = r.withColumns({"__rank": rank, "__rest": keep_rest})
    return r.where(F.when(F.col("__s") == 1, F.col("__rank") <= F.greatest(F.lit(0), cap - F.col("__rest"))).otherwise(F.col("__rank") <= F.col("__rest"))).drop("__s", "__rank", "__rest")


def leakage(sides: DataFrame, item: str, side: str, group: str, heldout: Column, synthetic: Column) -> DataFrame:
    """``(check, ok)``: no item on two sides, no group in train and evaluation, nothing held out in train, nothing synthetic in evaluation."""
    train = F.col(side) == "train"
    items = sides.groupBy(item).agg(F.countDistinct(side).alias("n")).agg((F.coalesce(F.max("n"), F.lit(0)) <= 1).alias("ok"))
    groups = sides.where(F.col(group).isNotNull()).groupBy(group).agg(F.max(train.cast("int")).alias("t"), F.max((~train).cast("int")).alias("e")).agg((F.coalesce(F.max(F.col("t") + F.col("e")), F.lit(0)) < 2).alias("ok"))
    held = sides.agg((F.coalesce(F.max((train & heldout).cast("int")), F.lit(0)) == 0).alias("ok"))
    made = sides.agg((F.coalesce(F.max((~train & synthetic).cast("int")), F.lit(0)) == 0).alias("ok"))
    out = None
    for name, df in (("items", items), ("groups", groups), ("heldout", held), ("synthetic", made)):
        df = df.select(F.lit(name).alias("check"), "ok")
        out = df if out is None else out.unionByName(df)
    return out
