"""Rate limit by key: at most so many accepted requests in a sliding window; rejected ones don't count."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


def accepted(requests: DataFrame, key: str, time: str, order: str, limit: int, seconds: float) -> DataFrame:
    """Batch form: ``(key, order, accepted)``. A key's requests are read in time, and only its accepted times in the window
    are held, never more than the limit, so a key that makes up much of the table takes time but no memory."""
    span = int(seconds * 1_000_000)
    schema = StructType([StructField(key, requests.schema[key].dataType), StructField(order, LongType()), StructField("accepted", BooleanType())])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, deque()
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"].tolist(), pdf["t"].tolist()):
                if k != now:
                    now, held = k, deque()
                while held and held[0] <= t - span:
                    held.popleft()
                out.append(len(held) < limit)
                if out[-1]:
                    held.append(t)
            yield pd.DataFrame({key: pdf["k"], order: pdf["o"], "accepted": out})

    rows = requests.where(F.col(time).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(order).cast("long").alias("o"))
    return rows.repartition("k").sortWithinPartitions("k", "t", "o").mapInPandas(decide, schema)


def accepted_stream(requests: DataFrame, key: str, time: str, order: str, limit: int, seconds: float) -> DataFrame:
    """Streaming form: the accepted times of a key are its state, never more than the limit; within a batch by time."""

    def decide(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["t", "o"])
        out = []
        for t, o in zip(rows["t"].tolist(), rows["o"].tolist()):
            held = [x for x in held if x > t - int(seconds * 1_000_000)]
            out.append((keys[0], o, len(held) < limit))
            if out[-1][2]:
                held.append(t)
        state.update((held,))
        yield pd.DataFrame(out, columns=["key", "o", "accepted"])

    rows = requests.where(F.col(time).isNotNull()).select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(order).cast("long").alias("o"))
    return rows.groupBy("key").applyInPandasWithState(decide, "key string, o long, accepted boolean", "held array<long>", "append", GroupStateTimeout.NoTimeout)
