"""Nearest vectors by an inverted multi-index.

Two codebooks, one for each half of the vectors, are fitted to a bounded sample; their sizes follow the table's, so that
cells hold about as many vectors at any size. Every vector falls into the cell of its two centroids. A query visits cells in falling order of the two inner products' sum, which a heap yields pair by pair (or a sort, if
it visits many), until the cells hold enough vectors, and the visited entries are ranked again by exact inner product. The sum
of the last cell stands for all that are visited: that number travels with a query, not the cells. How many are enough is measured:
the exact neighbours of some audited queries are found by brute force, and the reach is set to where their cells stand.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.sampling import bounded
from millrace.llm.vectors import BLOCK_ROWS, matrix, narrow, pack, probe, unpack, usable
from millrace.storage import written

#: Neighbours of a query, every how many-th id is a query.
NEAREST, EVERY = 20, 20
#: Centroids of a half at least and at most, vectors of the sample for each of them at most, and rounds of fitting.
LEAST_CENTROIDS, CENTROIDS, SAMPLE, ROUNDS = 8, 1_024, 64, 12
#: Vectors that a cell holds, about, while there are fewer centroids than the most.
CELL_ROWS = 16
#: Audited queries at most, and the share of their neighbours that the visited cells must hold.
AUDITED, WANTED = 96, 0.97
#: Vectors of a shard of entries, about, and shards at least; queries whose cells are ranked together.
SHARD_ROWS, LEAST_SHARDS, GROUP = 65_536, 3, 32
#: One in how many entries a query must visit for its cells to be sorted at once.
SORTED = 16


def centroids(n: int) -> int:
    """How many each half gets for a table of n vectors."""
    return max(LEAST_CENTROIDS, min(CENTROIDS, math.isqrt(n // CELL_ROWS)))


def fit(half: np.ndarray, seed: int, many: int = 32) -> np.ndarray:
    """At most `many` centroids of one half by k-means from spread-out starts; as many as there are distinct rows, if fewer."""
    rng = np.random.default_rng(seed)
    half = np.unique(half, axis=0)
    centres = np.empty((min(many, len(half)), half.shape[1]))
    centres[0] = half[int(rng.integers(len(half)))]
    gap = ((half - centres[0]) ** 2).sum(axis=1)
    for k in range(1, len(centres)):
        total = gap.sum()
        centres[k] = half[int(rng.choice(len(half), p=gap / total)) if total > 0 else int(rng.integers(len(half)))]
        gap = np.minimum(gap, ((half - centres[k]) ** 2).sum(axis=1))
    for _ in range(ROUNDS):
        near = assign(half, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, half)
        count = np.bincount(near, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def assign(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row."""
    return ((centres**2).sum(axis=1)[None, :] - 2 * half @ centres.T).argmin(axis=1)


def traverse(first: np.ndarray, second: np.ndarray, many: np.ndarray, enough: int) -> list[int]:
    """Cells in falling order of ``first[i] + second[j]`` until they hold `enough` entries; ``many[i * len(second) + j]``.

    The pairs of both sorted lists are met by a heap: (a, b) brings in (a, b + 1), and (a + 1, 0) if b is 0.
    """
    p, q = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y, p, q, width = first[p].tolist(), second[q].tolist(), p.tolist(), q.tolist(), len(second)
    heap, out, held = [(-(x[0] + y[0]), 0, 0)], [], 0
    while heap and held < enough:
        _, a, b = heapq.heappop(heap)
        cell = p[a] * width + q[b]
        if many[cell]:
            out.append(cell)
            held += int(many[cell])
        if b + 1 < width:
            heapq.heappush(heap, (-(x[a] + y[b + 1]), a, b + 1))
        if not b and a + 1 < len(x):
            heapq.heappush(heap, (-(x[a + 1] + y[0]), a + 1, 0))
    return out


def last_sum(first: np.ndarray, second: np.ndarray, many: np.ndarray, enough: int) -> float:
    """``first[i] + second[j]`` of the last cell that `traverse` visits; below all if it visits every cell."""
    total = int(many.sum())
    if enough >= total:
        return -math.inf
    if enough * SORTED < total:
        i, j = divmod(traverse(first, second, many, enough)[-1], len(second))
        return float(first[i] + second[j])
    cells = np.flatnonzero(many)
    sums = first[cells // len(second)] + second[cells % len(second)]
    order = np.argsort(-sums)
    return float(sums[order[np.searchsorted(np.cumsum(many[cells][order]), enough)]])


def _top(scores: np.ndarray, at: np.ndarray, ids: np.ndarray, v: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the entries `at` by exact inner product, ties to smaller ids. scores: their products up to rounding."""
    if len(at) > k:
        # All that could be among the best, whatever the rounding.
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = at[scores >= least - 1e-9 * max(1.0, abs(float(least)))]
    exact = (v[at] * q).sum(axis=1)
    order = np.lexsort((ids[at], -exact))[:k]
    return at[order], exact[order]


def _halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (v.shape[-1] + 1) // 2
    return v[..., :cut], v[..., cut:]


def _books(rows: DataFrame, n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Codebooks of each dimension, fitted in one task to a sample of at most SAMPLE vectors a centroid."""
    many = centroids(n)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        v = matrix(pdf["v"])
        v = v[np.lexsort(v.T[::-1])]
        one, two = _halves(v)
        books = pack(one=fit(one, 1, many), two=fit(two, 2, many) if two.shape[1] else np.zeros((1, 0)))
        return pd.DataFrame({"dim": [int(v.shape[1])], "books": [books]})

    sample = bounded(rows, "sample", F.xxhash64("id", "v"), SAMPLE * many).select("dim", "v")
    books = {r.dim: unpack(r.books) for r in sample.groupBy("dim").applyInPandas(fitted, "dim int, books binary").collect()}
    books = {dim: (b["one"], b["two"]) for dim, b in books.items()}
    for (dim,) in rows.select("dim").distinct().collect():
        # A dimension so rare that the sample has none: one cell.
        books.setdefault(dim, tuple(np.zeros((1, x.shape[-1])) for x in _halves(np.zeros(dim))))
    return books


def _entries(books: dict[int, tuple[np.ndarray, np.ndarray]]):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        v, dim = matrix(pdf["v"]), int(pdf["dim"].iloc[0])
        one, two = books[dim]
        first, second = _halves(v)
        cell = assign(first, one) * len(two) + assign(second, two)
        row, ids = pdf["row"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64)
        order = np.lexsort((row, ids, cell))
        cells, start, many = np.unique(cell[order], return_index=True, return_counts=True)
        blob = pack(v=narrow(v[order]), ids=ids[order], rows=row[order], cells=cells, first=np.append(start, len(v)))
        return pd.DataFrame({"dim": [dim], "shard": [int(pdf["shard"].iloc[0])], "blob": [blob], "cells": [cells.astype(np.int64)], "many": [many.astype(np.int64)]})

    return build


def _visits(queries: DataFrame, books: dict, counts: dict, enough: dict[int, int]) -> DataFrame:
    """`queries` with ``least``, the sum of the last cell that each visits, found once for all shards."""
    sent = queries.sparkSession.sparkContext.broadcast((books, counts, enough))  # at most CENTROIDS ** 2 counts a dimension

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books, counts, enough = sent.value
        for pdf in batches:
            least = []
            for q in pdf["v"]:
                q = np.asarray(q, dtype=np.float64)
                (a, b), (one, two) = _halves(q), books[len(q)]
                least.append(last_sum(one @ a, two @ b, counts[len(q)], enough[len(q)]))
            yield pdf.assign(least=least)

    return queries.mapInPandas(run, "row long, id long, v array<double>, dim int, least double")


def _ask(k: int, books: dict):
    def ask(index: dict[str, np.ndarray], queries: pd.DataFrame) -> pd.DataFrame:
        v, ids, rows, cells, first = (index[x] for x in ("v", "ids", "rows", "cells", "first"))
        v, long = v.astype(np.float64), np.diff(first)
        q, own, least = matrix(queries["v"]), queries["row"].to_numpy(np.int64), queries["least"].to_numpy(np.float64)
        (one, two), (a, b) = books[q.shape[1]], _halves(q)
        i, j = cells // len(two), cells % len(two)
        near, scores, of = [], [], []
        for lo in range(0, len(q), GROUP):
            some = q[lo : lo + GROUP]
            x, y = a[lo : lo + GROUP] @ one.T, b[lo : lo + GROUP] @ two.T
            # Sums come out a little different here, so a tie with the last cell is visited too.
            slack = 1e-12 * (np.abs(x).max(axis=1) + np.abs(y).max(axis=1))
            visited = x[:, i] + y[:, j] >= (least[lo : lo + GROUP] - slack)[:, None]
            # The cells that any of these queries visits, as one product; each query ranks its own.
            met = visited.any(axis=0)
            entries = np.flatnonzero(np.repeat(met, long))
            product = some @ v[entries].T
            for n in range(len(some)):
                mine = np.repeat(visited[n, met], long[met]) & (rows[entries] != own[lo + n])
                best, score = _top(product[n, mine], entries[mine], ids, v, some[n], k)
                near.append(ids[best]), scores.append(score), of.append(np.full(len(best), lo + n))
        of = np.concatenate(of)
        return pd.DataFrame({"row": own[of], "query_id": queries["id"].to_numpy(np.int64)[of], "vec_id": np.concatenate(near), "score": np.concatenate(scores)})

    return ask


def _exactly(k: int):
    """Brute force for the audit, with the cell of each neighbour."""

    def ask(index: dict[str, np.ndarray], queries: pd.DataFrame) -> pd.DataFrame:
        v, ids, rows, cells, first = (index[x] for x in ("v", "ids", "rows", "cells", "first"))
        v, out = v.astype(np.float64), []
        for q, own in zip(matrix(queries["v"]), queries["row"]):
            at = np.flatnonzero(rows != own)
            best, score = _top((v @ q)[at], at, ids, v, q, k)
            cell = cells[np.searchsorted(first, best, side="right") - 1]
            out.append(pd.DataFrame({"row": own, "vec_id": ids[best], "score": score, "cell": cell}))
        return pd.concat(out)

    return ask


def _reach(audit: list, vectors: dict[int, np.ndarray], books, counts: dict[int, np.ndarray], k: int) -> dict[int, int]:
    """For each dimension, entries to visit so that enough of the audited neighbours' cells come up."""
    found: dict[int, list[float]] = {}
    for own, q in vectors.items():
        dim = len(q)
        (a, b), (one, two) = _halves(q), books[dim]
        cells = np.flatnonzero(counts[dim])
        x, y = one @ a, two @ b
        cells = cells[np.argsort(-(x[cells // len(two)] + y[cells % len(two)]), kind="stable")]
        before = np.concatenate([[0], np.cumsum(counts[dim][cells])[:-1]])
        stands = dict(zip(cells.tolist(), before.tolist()))
        found.setdefault(dim, []).extend(stands[r.cell] + 1 for r in audit if r.row == own)
    total = {dim: int(c.sum()) for dim, c in counts.items()}
    return {dim: min(total[dim], int(np.quantile(found[dim], WANTED, method="higher")) + k) if found.get(dim) else total[dim] for dim in counts}


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by `every`, the `k` rows of largest inner
    product that the index finds, itself left out, ties to the smaller id; all rows if there are fewer.

    score is the inner product of the vectors as they are, in double precision. Vectors that are null, empty, all zero or
    have a null or non-finite component, and rows without an id, take no part; vectors are compared with those of their
    length. Rows that repeat an id are rows of their own: each is a candidate, and each a query, if its id is one, that may
    find the others. Extra columns are left out; a table without queries gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = written(rows.where(usable("v") & F.col("id").isNotNull()).select(F.monotonically_increasing_id().alias("row"), "id", "v", F.size("v").alias("dim")), "entries")
    n = rows.count()
    books = _books(rows, n)
    shards = max(LEAST_SHARDS, -(-n // SHARD_ROWS))
    shard = F.pmod(F.xxhash64(F.lit("entry"), "row"), F.lit(shards)).cast("int")
    index = written(rows.withColumn("shard", shard).groupBy("dim", "shard").applyInPandas(_entries(books), "dim int, shard int, blob binary, cells array<long>, many array<long>"), "multi-index")
    # Counts of the cells that hold something: at most centroids squared numbers a dimension, added up over the shards.
    cells = index.select("dim", F.explode(F.arrays_zip("cells", "many")).alias("c")).groupBy("dim", F.col("c.cells").alias("cell")).agg(F.sum("c.many").alias("many")).toArrow()
    counts = {dim: np.zeros(len(one) * len(two), dtype=np.int64) for dim, (one, two) in books.items()}
    dims, places, many = (cells.column(x).to_numpy() for x in ("dim", "cell", "many"))
    for dim in counts:
        counts[dim][places[dims == dim]] = many[dims == dim]
    queries = rows.where(F.col("id") % every == 0)
    entries = index.select("dim", "shard", "blob")
    audited = written(bounded(queries, "audit", F.xxhash64("id", "v"), AUDITED), "audited")
    exact = probe(entries, audited, "row", shards, 1, _exactly(k), "row long, vec_id long, score double, cell long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    # At most AUDITED queries with k neighbours each.
    audit = exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).collect()
    enough = _reach(audit, {r.row: np.array(r.v) for r in audited.collect()}, books, counts, k)
    blocks = max(1, -(-(n // every) // BLOCK_ROWS))
    found = probe(entries, _visits(queries, books, counts, enough), "row", shards, blocks, _ask(k, books), "row long, query_id long, vec_id long, score double")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
