"""Running Python over whole texts, Arrow batch by batch, with ids carried through unchanged."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` and nothing else, so that other columns are neither read nor can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def groups(texts: pa.Array, size: int) -> Iterator[tuple[int, list[str]]]:
    """Texts in their order, in groups of about `size` bytes, with the place of each group's first; null counts as empty.

    Only one group at a time is turned into Python's strings, however large the Arrow batch is.
    """
    at, ends = 0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = min(len(texts), int(np.searchsorted(ends, before + size)) + 1)
        yield at, [t or "" for t in texts.slice(at, to - at).to_pylist()]
        at = to


#: What this worker keeps between tasks, one thing at most: workers outlive an operator, and what each one left would add up.
_HELD: dict = {}


def held(key: Hashable, make: Callable[[], object]) -> object:
    """What ``make()`` gave for `key`; a worker keeps it until a task asks for another or lets go of it."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go(key: Hashable = None) -> None:
    """Drop what this worker keeps, unless it is kept for `key`."""
    if _HELD and key not in _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], dict]], schema: str, size: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", keep: Hashable = None) -> DataFrame:
    """Rows ``(doc_id, *schema)``: ``make()`` is called once a task and gives a function of a group of texts to columns.

    keep: the key of what ``make()`` asks `held` for.

    Spark bounds Arrow batches by bytes (64 MB unless set otherwise), and groups are bounded here, so a task's memory doesn't
    follow the length of the texts but for a single very long one.
    """
    struct = StructType.fromDDL(f"doc_id long, {schema}")
    arrow = to_arrow_schema(struct)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keep)
        work = make()
        for batch in batches:
            ids = batch.column(0)
            for at, group in groups(batch.column(1), size):
                columns = work(group)
                arrays = [pa.array(columns[f.name], f.type) for f in arrow if f.name != "doc_id"]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(group)), *arrays], schema=arrow)

    return source(docs, id_col, text_col).mapInArrow(run, struct)


def filter_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]], text_col: str = "text", size: int = 4_000_000) -> DataFrame:
    """Rows of `docs`, with all their columns, for which the function that ``make()`` gives says so of their text."""
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        work = make()
        for batch in batches:
            for at, group in groups(batch.column(place), size):
                yield batch.slice(at, len(group)).filter(pa.array(work(group), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
