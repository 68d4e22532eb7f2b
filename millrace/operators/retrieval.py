"""Vector search over a catalogue table, index maintenance, and evaluation of ranked hits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.storage import written


#: Queries of a block, which every task holds, and points of a step.
BLOCK, STEP = 8_192, 2_048


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors; null and zero vectors, and those of another length than the longest, as zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    long = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    dim = int(long.max(initial=0))
    whole = long == dim
    v = np.zeros((len(column), dim))
    flat = column.filter(pa.array(whole)) if not whole.all() else column
    v[whole] = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    n = np.sqrt((v * v).sum(axis=1))[:, None]
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _query_blocks(queries: DataFrame) -> Iterator[tuple[pa.Table, bool]]:
    """Queries (query_id, query) in blocks of bounded size, and whether there are several: one at a time reaches the driver."""
    mine = queries.select("query_id", "query")
    some = mine.limit(BLOCK + 1).toArrow()
    if some.num_rows <= BLOCK:
        if some.num_rows:
            yield some, False
        return
    # Blocks by a hash, so a little over half full on the mean: none exceeds what a task can hold.
    blocks = -(-2 * queries.count() // BLOCK)
    for k in range(blocks):
        yield mine.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).toArrow(), True


def _each_block(queries: DataFrame, run, empty: DataFrame) -> DataFrame:
    """``run(block)`` for every block of queries; several are written one by one, so that no more than one is held."""
    out = None
    for block, several in _query_blocks(queries):
        found = written(run(block), "hits") if several else run(block)
        out = found if out is None else out.unionByName(found)
    return empty if out is None else out


class _Best:
    """The k best points of each query so far: larger cosine first, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.cos, self.ids = k, np.full((queries, 0), -np.inf), np.zeros((queries, 0), np.int64)

    def add(self, rows: np.ndarray, cos: np.ndarray, ids: np.ndarray) -> None:
        """rows: queries; cos: a row for each of them, a column for each of `ids`, or -inf where they don't meet."""
        width = min(self.k, self.cos.shape[1] + cos.shape[1])
        if self.cos.shape[1] < width:
            pad = ((0, 0), (0, width - self.cos.shape[1]))
            self.cos, self.ids = np.pad(self.cos, pad, constant_values=-np.inf), np.pad(self.ids, pad, constant_values=np.iinfo(np.int64).max)
        all_cos = np.hstack([self.cos[rows], cos])
        all_ids = np.hstack([self.ids[rows], np.broadcast_to(ids, cos.shape)])
        # Of equal cosines the smaller ids stay, also at the cut.
        order = np.lexsort((all_ids, -all_cos), axis=1)[:, : self.cos.shape[1]]
        self.cos[rows], self.ids[rows] = np.take_along_axis(all_cos, order, 1), np.take_along_axis(all_ids, order, 1)

    def rows(self, query_ids: np.ndarray) -> pa.RecordBatch:
        q, c = np.nonzero(np.isfinite(self.cos))
        return pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(self.ids[q, c]), pa.array(self.cos[q, c])], schema=_HITS)


_HITS = pa.schema([("query_id", pa.int64()), ("point_id", pa.int64()), ("cos", pa.float64())])
_HITS_DDL = "query_id long, point_id long, cos double"


def _ranked(hits: DataFrame, k: int, metric: str) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("cos"), "point_id")
    out = hits.withColumn("hit_rank", F.row_number().over(best)).where(F.col("hit_rank") <= k)
    return out.select("query_id", "hit_rank", "point_id", V.score(F.col("cos"), metric).alias("score"))


def _points(catalogue: DataFrame, where: Column | None) -> DataFrame:
    return (catalogue if where is None else catalogue.where(where)).select(F.col("point_id").cast("long").alias("point_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def search(catalogue: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", where: Column | None = None, others: bool = False) -> DataFrame:
    """``(query_id, hit_rank, point_id, score)`` of each query's k best points by exact score, ties to the smaller id.

    catalogue: point_id, embedding; queries: query_id, query. `where` filters points before they are scored; `others`: a
    point doesn't meet the query of its own id. Points are scanned once for each block of BLOCK queries, which every task
    holds: a batch of points and the block are one matrix product, and k rows a query and task are all that is shuffled.
    Scores are ranked as they are, not rounded. A query without points has no rows; see `search_batch`.
    """
    points = _points(catalogue, where)
    V.score(F.lit(0.0), metric)

    def run(block: pa.Table) -> DataFrame:
        sent = points.sparkSession.sparkContext.broadcast((block.column("query_id").to_numpy(), _unit(block.column("query"))))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = sent.value
            best, every = _Best(len(qid), k), np.arange(len(qid))
            for batch in batches:
                for at in range(0, len(batch), STEP):
                    part = batch.slice(at, STEP)
                    ids, v = part.column(0).to_numpy(), _unit(part.column(1))
                    cos = q @ v.T if v.shape[1] == q.shape[1] else np.zeros((len(q), len(v)))
                    if others:
                        cos[qid[:, None] == ids[None, :]] = -np.inf
                    # Most points are beaten by what is held already.
                    least = best.cos[:, -1] if best.cos.shape[1] == k else np.full(len(qid), -np.inf)
                    rows = every[(cos >= least[:, None]).any(axis=1)]
                    if len(rows):
                        some = np.flatnonzero((cos[rows] >= least[rows, None]).any(axis=0))
                        best.add(rows, cos[np.ix_(rows, some)], ids[some])
            yield best.rows(qid)

        return points.mapInArrow(task, _HITS_DDL)

    return _ranked(_each_block(queries, run, points.sparkSession.createDataFrame([], _HITS_DDL)), k, metric)


def search_cells(catalogue: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", cells: int = 64, share: float = 0.5, sample: int = 16_384, others: bool = False) -> DataFrame:
    """Approximate `search`: points fall into cells around centroids of a bounded sample, and a query meets those in the
    cells nearest to it, a `share` of all cells. Cells are found in the scan, so there is no index to keep. At the default
    share the tests hold its recall of the exact ten over 0.9 on vectors without any clusters, its worst case.
    """
    spark = catalogue.sparkSession
    points = _points(catalogue, None)
    # At most `sample` vectors.
    seen = points.where(F.pmod(F.xxhash64(F.lit("cells"), "point_id"), F.greatest(F.lit(1), F.ceil(F.lit(points.count() / sample))).cast("long")) == 0).limit(sample).toArrow()
    centres = _centres(_unit(seen.column("embedding")), cells)

    def run(block: pa.Table) -> DataFrame:
        q = _unit(block.column("query"))
        near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, : max(1, round(share * len(centres)))] if len(centres) and q.shape[1] == centres.shape[1] else np.zeros((len(q), 1), int)
        sent = spark.sparkContext.broadcast((block.column("query_id").to_numpy(), q, centres, [np.flatnonzero((near == c).any(axis=1)) for c in range(max(1, len(centres)))]))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q, centres, asks = sent.value
            best = _Best(len(qid), k)
            for batch in batches:
                ids, v = batch.column(0).to_numpy(), _unit(batch.column(1))
                if v.shape[1] != q.shape[1] or not len(centres):
                    continue
                cell = (v @ centres.T).argmax(axis=1)
                for c in np.unique(cell).tolist():
                    rows, mine = asks[c], np.flatnonzero(cell == c)
                    if len(rows):
                        cos = q[rows] @ v[mine].T
                        if others:
                            cos[qid[rows][:, None] == ids[mine][None, :]] = -np.inf
                        best.add(rows, cos, ids[mine])
            yield best.rows(qid)

        return points.mapInArrow(task, _HITS_DDL)

    return _ranked(_each_block(queries, run, spark.createDataFrame([], _HITS_DDL)), k, metric)


def _centres(v: np.ndarray, many: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors, by repeated means."""
    v = np.unique(v, axis=0)
    centres = v[np.random.default_rng(0).permutation(len(v))[:many]]
    for _ in range(rounds if len(v) else 0):
        near = (v @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, v)
        n = np.sqrt((sums * sums).sum(axis=1))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1e-300), centres)
    return centres


def search_batch(catalogue: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", where: Column | None = None, others: bool = False) -> DataFrame:
    """``(query_id, hits)``: one row a query, its hits in order; an empty list where nothing is found or stored."""
    found = search(catalogue, queries, k, metric, where, others)
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("hit_rank", "point_id", "score"))).alias("hits"))
    none = F.array().cast("array<struct<hit_rank:int,point_id:bigint,score:double>>")
    return queries.select("query_id").join(lists, "query_id", "left").select("query_id", F.coalesce("hits", none).alias("hits"))


def search_with_payload(catalogue: DataFrame, queries: DataFrame, k: int, payload: list[str], others: bool = False) -> DataFrame:
    """Hits with their similarity and the payload of their points, which is read for the hits alone."""
    hits = search(catalogue, queries, k, others=others).withColumnRenamed("score", "similarity")
    return hits.join(catalogue.select("point_id", *payload), "point_id").select("query_id", "hit_rank", "point_id", "similarity", *payload)


def rank_truth(catalogue: DataFrame, queries: DataFrame, others: bool = False) -> DataFrame:
    """``(query_id, part_id, top1, rank)``: where each query's true part stands if all points are ranked and a part stands
    where its best point stands; null if the part has no point.

    catalogue: point_id, embedding, part_id; queries: query_id, query, part_id. A task returns each query's best point of
    each part it has met, these are put together by partial aggregation, and the rank is the count of parts that are better:
    no point is ranked, so no query's points are ever sorted.
    """
    points = catalogue.select(F.col("point_id").cast("long").alias("point_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("part_id").cast("long").alias("part_id"))
    ddl = "query_id long, part long, cos double, point long"

    def run(block: pa.Table) -> DataFrame:
        sent = points.sparkSession.sparkContext.broadcast((block.column("query_id").to_numpy(), _unit(block.column("query"))))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = sent.value
            for batch in batches:
                ids, v, part = batch.column(0).to_numpy(), _unit(batch.column(1)), batch.column(2).to_numpy()
                order = np.lexsort((ids, part))
                ids, v, part = ids[order], v[order], part[order]
                starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, int)
                for at in range(0, len(qid) if len(part) else 0, 512):
                    cos = v @ q[at : at + 512].T
                    if others:
                        cos[ids[:, None] == qid[None, at : at + 512]] = -np.inf
                    top = np.maximum.reduceat(cos, starts, axis=0)
                    width = np.diff(np.append(starts, len(part)))
                    first = np.minimum.reduceat(np.where(cos == np.repeat(top, width, axis=0), np.arange(len(part))[:, None], len(part)), starts, axis=0)
                    p, c = np.nonzero(np.isfinite(top))
                    yield pa.RecordBatch.from_arrays([pa.array(qid[at + c]), pa.array(part[starts[p]]), pa.array(top[p, c]), pa.array(ids[first[p, c]])], names=["query_id", "part", "cos", "point"])

        return points.mapInArrow(task, ddl)

    spark = points.sparkSession
    best = _each_block(queries.select("query_id", "query"), run, spark.createDataFrame([], ddl))
    best = best.groupBy("query_id", "part").agg(F.max(F.struct(F.col("cos"), (-F.col("point")).alias("before"))).alias("best"))
    truth = best.join(queries.select("query_id", F.col("part_id").alias("part")), ["query_id", "part"]).select("query_id", F.col("best").alias("own"))
    ranks = best.join(truth, "query_id", "left").groupBy("query_id").agg(F.max_by("part", "best").alias("top1"), F.max("own").alias("own"), F.count_if(F.col("best") > F.col("own")).alias("better"))
    ranks = ranks.select("query_id", "top1", F.when(F.col("own").isNotNull(), F.col("better") + 1).cast("int").alias("rank"))
    return queries.select("query_id", "part_id").join(ranks, "query_id", "left").select("query_id", "part_id", "top1", "rank")


def stats(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("total_vectors"), F.countDistinct("product_id").alias("n_products")).withColumn("status", F.when(F.col("total_vectors") == 0, "empty").otherwise("ready"))


def append_points(points: DataFrame, path: str, dedupe: bool = False) -> None:
    """Add points under fresh ids; points of a product that is there already are added again unless `dedupe`."""
    spark = points.sparkSession
    if dedupe:
        try:
            points = points.join(spark.read.parquet(path).select("product_id").distinct(), "product_id", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    points.withColumn("point_id", F.expr("uuid()")).write.mode("append").parquet(path)


def remove_product(points: DataFrame, products: DataFrame) -> DataFrame:
    return points.join(products.select("product_id").distinct(), "product_id", "left_anti")


def norm_faults(points: DataFrame, dim: int, tolerance: float = 1e-3) -> DataFrame:
    v = F.col("embedding")
    return points.where((F.size(v) != dim) | (F.abs(V.norm(v) - 1) > tolerance))


def create_index(spark: SparkSession, path: str, dim: int, clear: bool = False) -> DataFrame:
    """The points stored at `path`, an empty table of them made first if there is none, or if `clear`."""
    schema = "point_id string, product_id long, embedding array<float>, payload map<string,string>"
    empty = spark.createDataFrame([], schema)
    try:
        empty.write.mode("overwrite" if clear else "errorifexists").parquet(path)
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    found = spark.read.schema(schema).parquet(path)
    if not found.where(F.size("embedding") != dim).isEmpty():
        raise ValueError(f"{path} holds vectors of another length than {dim}")
    return found


def count_points(points: DataFrame, **equal) -> int:
    """Points, or those whose fields have the given values."""
    for name, value in equal.items():
        points = points.where(F.col(name).eqNullSafe(F.lit(value)))
    return points.count()


def delete_product(images: DataFrame, texts: DataFrame, product_id: int) -> tuple[DataFrame, DataFrame, int]:
    """Both indexes without a product, and 200, or 404 if neither had it."""
    one = images.sparkSession.createDataFrame([(product_id,)], "product_id long")
    found = not images.where(F.col("product_id") == product_id).isEmpty() or not texts.where(F.col("product_id") == product_id).isEmpty()
    return remove_product(images, one), remove_product(texts, one), 200 if found else 404


def index_product(spark: SparkSession, path: str, product_id: int, embedding: list[float], category: str | None = None) -> None:
    """Add one product's vector, with its category if it has one."""
    row = [(product_id, [float(x) for x in embedding], {"category": category} if category else None)]
    append_points(spark.createDataFrame(row, "product_id long, embedding array<float>, payload map<string,string>"), path)


def rebuild(products: DataFrame, vectors: DataFrame, path: str) -> tuple[int, int]:
    """Write the index anew from all products with an image: how many have a vector now, and how many have none.

    products: product_id, image_url, category_name; vectors: product_id, embedding, null where a picture couldn't be read.
    """
    shown = products.where("image_url is not null and image_url != ''").join(vectors, "product_id", "left")
    payload = F.when(F.col("category_name").isNotNull(), F.create_map(F.lit("category"), "category_name"))
    good = shown.where("embedding is not null").select(F.expr("uuid()").alias("point_id"), F.col("product_id").cast("long").alias("product_id"), F.col("embedding").cast("array<float>").alias("embedding"), payload.alias("payload"))
    good.write.mode("overwrite").parquet(path)
    indexed = products.sparkSession.read.parquet(path).count()
    return indexed, shown.count() - indexed


def mock_points(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """Points with random unit vectors, for trials."""
    v = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), k.cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**31 - 1)
    points = spark.range(n).select(F.col("id").cast("string").alias("point_id"), F.col("id").alias("product_id"), v.alias("v"))
    return points.select("point_id", "product_id", V.normalised(F.col("v")).cast("array<float>").alias("embedding"))


def dual_index(products: DataFrame, images: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points of the image and of the text index, both only for products with an image url and a vector.

    products: product_id, image_url; images and texts: product_id, embedding, made elsewhere from pictures and from texts.
    """
    shown = products.where("image_url is not null and image_url != ''").select("product_id")
    with_image = images.join(shown, "product_id", "left_semi")
    return with_image, texts.join(with_image.select("product_id").distinct(), "product_id", "left_semi")


#: Lengths of the vectors that image models give, and of any other.
MODEL_DIMENSIONS = {
    "openai/clip-vit-base-patch32": 512,
    "openai/clip-vit-base-patch16": 512,
    "openai/clip-vit-large-patch14": 768,
    "openai/clip-vit-large-patch14-336": 768,
}
OTHER_DIMENSION = 768


def model_dimension(name: Column) -> Column:
    return F.coalesce(*[F.when(name == model, F.lit(dim)) for model, dim in MODEL_DIMENSIONS.items()], F.lit(OTHER_DIMENSION))


def pool_hits(hits: DataFrame) -> DataFrame:
    """Hits of images to ranks of parts: a part stands where its best image stands."""
    pooled = hits.groupBy("query_id", "part_id").agg(F.min("hit_rank").alias("first"))
    return pooled.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).drop("first")


def score_ranks(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """``rank`` with average precision and recall at each k; a part that isn't ranked has 0 and 0."""
    return ranks.select("query_id", "part_id", "top1", "rank", F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("ap"), *[F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0)).alias(f"recall_{k}") for k in ks])


def score_queries(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """The same from a list of ranked parts."""
    top = ranked.where("rank = 1").select("query_id", F.col("part_id").alias("top1"))
    return score_ranks(truth.join(ranked, ["query_id", "part_id"], "left").join(top, "query_id", "left"), ks)


#: Hexadecimal digits of a draw, and the chance that a row is drawn at most so many times, of one expected, in its units.
_DRAW = 12
_DRAWN = [math.floor(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 16**_DRAW) for k in range(13)]


def bootstrap(values: DataFrame, resamples: int, seed: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """``(mean, ci_low, ci_high)`` by resampling; values: ``(i, value)``, i naming a row. Draws follow from md5, so reruns agree.

    How often a row is in a resample is drawn for the row alone (a Poisson number of mean one), so resamples are sums that
    tasks make for their own rows: a sum and a weight a resample are all that is shuffled. A resample is the mean over the
    rows drawn; one that draws none, as a table of very few rows can have, is left out.
    """
    draw = lambda r: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), r.cast("string"), F.col("i").cast("string"))), 1, _DRAW), 16, 10).cast("long")
    rows = values.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("u", draw(F.col("r")))
    rows = rows.withColumn("w", sum((F.col("u") >= t).cast("int") for t in _DRAWN))
    means = rows.groupBy("r").agg((F.sum(F.col("w") * F.col("value")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    ends = means.agg(F.round(F.percentile("m", F.lit(low)), 6).alias("ci_low"), F.round(F.percentile("m", F.lit(high)), 6).alias("ci_high"))
    return values.agg(F.round(F.avg("value"), 6).alias("mean")).crossJoin(ends)
