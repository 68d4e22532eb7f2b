"""What the two vector operators share: usable vectors, and probing an index in (shard, query block) pieces."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block of queries that one task holds.
BLOCK_ROWS = 16_384


def usable(v: str) -> Column:
    """True for arrays of finite numbers that aren't all zero."""
    x = F.col(v).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.coalesce((F.size(x) > 0) & ~bad & F.exists(x, lambda c: c != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """Rows of equal length as a float64 matrix."""
    return np.array([np.asarray(x, dtype=np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one, scaled by their largest component first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    v /= np.linalg.norm(v, axis=1)[:, None]
    return v


def narrow(v: np.ndarray) -> np.ndarray:
    """`v` in single precision, if that holds every number as it is."""
    with np.errstate(over="ignore"):
        short = v.astype(np.float32)
    return short if np.array_equal(short, v) else v


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def probe(index: DataFrame, queries: DataFrame, id_col: str, shards: int, blocks: int, fn, schema: str) -> DataFrame:
    """Run ``fn(blob, queries) -> pandas`` for every (shard, block of queries).

    index: ``dim, shard, blob``, a row a shard. Queries (with ``dim`` and `id_col`) are dealt to `blocks` by a hash of their
    id and copied once to each shard of their dimension, so every piece has about as many rows whatever the data; a task
    holds one shard's index and one block. A piece without an index gives nothing.
    """
    import pandas as pd

    def piece(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return empty
        return fn(unpack(left["blob"].iloc[0]), right)

    empty = pd.DataFrame({name.split()[0]: pd.Series(dtype="float64" if name.split()[1] == "double" else "int64") for name in schema.split(", ")})
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    block = F.pmod(F.xxhash64(F.lit("block"), id_col), F.lit(blocks)).cast("int")
    right = queries.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ("dim", "shard", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(piece, schema)
