"""Shards by a Feistel permutation of global row numbers. DataFrame operations only.

Rows are numbered by the order of a hash of their id and text; a Feistel network over a x b >= n places, walked again while it
leaves the n rows, permutes the numbers. The permuted number modulo the shards is the shard, its quotient the slot: both
can be computed for any row number without looking at the others, counts differ by one at most, and slots have no gap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import copies, offsets, row_hash
from millrace.storage import written

#: Shards, rounds of the network, and what a row has besides its text's bytes.
SHARDS, ROUNDS, ROW_BYTES = 40, 8, 16
#: A prime below 2**31, so that products of two rests fit a 64-bit number.
_PRIME = 2_147_483_629


def _round_keys(seed: int) -> list[tuple[int, int]]:
    keys, x = [], seed + 1
    for _ in range(ROUNDS):
        pair = []
        for _ in range(2):
            x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
            pair.append((x >> 33) % (_PRIME - 1) + 1)
        keys.append(tuple(pair))
    return keys


def sides(n: int) -> tuple[int, int]:
    """The two halves' ranges: about the square root of n each, with a product of at least n."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def walks(n: int) -> int:
    """Times the network is applied at most: enough for every row, but for a chance below 1e-12 in all."""
    a, b = sides(n)
    out = a * b - n
    if not out:
        return 1
    share, k = out / (a * b), 1
    while k <= out and n * share**k > 1e-12:
        k += 1
    return k


def permute(number: int, n: int, seed: int = 0) -> int:
    """The place of row `number` of n: plain numbers, as `permuted` has it for columns."""
    a, b = sides(n)
    while True:
        left, right = number // b, number % b
        for k, (x, y) in enumerate(_round_keys(seed)):
            if k % 2:
                right = (right + _scramble(left, x, y)) % b
            else:
                left = (left + _scramble(right, x, y)) % a
        number = left * b + right
        if number < n:
            return number


def _scramble(v: int, x: int, y: int) -> int:
    t = (v * x + y) % _PRIME
    t = (t * t + x) % _PRIME
    return (t * y + v) % _PRIME


def permuted(df: DataFrame, number: str, n: int, out: str, seed: int = 0) -> DataFrame:
    """`df` with the permuted number. Each round is a projection of its own; only rows outside walk on."""
    a, b = sides(n)

    def network(v: Column) -> Column:
        # For the few rows that walk: the same rounds folded over an array.
        keys = F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y"), F.lit(k % 2).alias("odd")) for k, (x, y) in enumerate(_round_keys(seed))])
        start = F.struct(F.floor(v / b).cast("long").alias("l"), F.pmod(v, F.lit(b)).cast("long").alias("r"))

        def step(s: Column, k: Column) -> Column:
            odd = k["odd"] == 1
            other = F.when(odd, s["l"]).otherwise(s["r"])
            t = _mix(other, k["x"], k["y"])
            return F.struct(F.when(odd, s["l"]).otherwise(F.pmod(s["l"] + t, F.lit(a))).alias("l"), F.when(odd, F.pmod(s["r"] + t, F.lit(b))).otherwise(s["r"]).alias("r"))

        return F.aggregate(keys, start, step, lambda s: s["l"] * b + s["r"])

    df = df.withColumn("__l", F.expr(f"{number} div {b}")).withColumn("__r", F.pmod(F.col(number), F.lit(b)))
    for k, (x, y) in enumerate(_round_keys(seed)):
        if k % 2:
            df = df.withColumn("__r", F.pmod(F.col("__r") + _mix(F.col("__l"), F.lit(x), F.lit(y)), F.lit(b)))
        else:
            df = df.withColumn("__l", F.pmod(F.col("__l") + _mix(F.col("__r"), F.lit(x), F.lit(y)), F.lit(a)))
    df = df.withColumn("__p", F.col("__l") * b + F.col("__r"))
    for _ in range(walks(n) - 1):
        df = df.withColumn("__p", F.when(F.col("__p") >= n, network(F.col("__p"))).otherwise(F.col("__p")))
    inside = F.when(F.col("__p") < n, F.col("__p")).otherwise(F.raise_error(F.lit("the walk did not come back")).cast("long"))
    return df.withColumn(out, inside).drop("__l", "__r", "__p")


def _mix(v: Column, x: Column, y: Column) -> Column:
    prime = F.lit(_PRIME)
    t = (v * x + y) % prime
    t = (t * t + x) % prime
    return (t * y + v) % prime


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for every row: a shuffle of all rows that reruns give again.

    size: the text's UTF-8 bytes and 16 more; text_crc32: of those bytes, unsigned. Null texts count as empty. Shards
    differ by one row at most; slots of a shard go from 0 without a gap. Rows without an id stand as those with an empty
    one; rows of equal id and text are told apart by nothing, so they are counted, their places are the same set in every
    run, and a row that makes up much of the table is written out by many tasks. Equal texts may be dealt to different
    shards, as equal counts ask. Extra columns are left out; an empty table gives no rows. Texts are read once and not
    shuffled: only ids, sizes, checksums and hashes are.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    identity = F.col(id_col).cast("long")
    rows = docs.select(identity.alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), row_hash(identity, F.md5(text)).alias("h"))
    # Rows of equal id and text are one line with a count.
    lines = written(rows.groupBy("h", "doc_id", "size", "text_crc32").agg(F.count("*").alias("many")), "lines")
    found = lines.agg(F.count("*").alias("lines"), F.sum("many").alias("n")).first()
    n = found.n or 0
    numbers = written(offsets(lines, [], "h", "many", found.lines, "first").drop("h"), "numbers")
    out = permuted(copies(numbers, "many", "copy").withColumn("number", F.col("first") + F.col("copy")), "number", n, "place", seed)
    return out.select("doc_id", "size", "text_crc32", (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"))


def op8(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _oracle() -> str:
    """Numbers by the same hash, the network written out round by round, the walk as a recursion, and the checksum bit by bit."""
    scramble = "((((({o} * {x} + {y}) % {p}) * (({o} * {x} + {y}) % {p}) + {x}) % {p}) * {y} + {o}) % {p}"

    def network(source: str, v: str) -> str:
        sql = f"SELECT * EXCLUDE ({v}), {v} // b AS l, {v} % b AS r FROM {source}"
        for k, (x, y) in enumerate(_round_keys(0)):
            t = scramble.format(o="l" if k % 2 else "r", x=x, y=y, p=_PRIME)
            sql = f"SELECT * REPLACE ((r + {t}) % b AS r) FROM ({sql})" if k % 2 else f"SELECT * REPLACE ((l + {t}) % a AS l) FROM ({sql})"
        return f"SELECT * EXCLUDE (l, r), l * b + r AS v FROM ({sql})"

    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
z AS (SELECT list(CASE WHEN c8 & 1 = 1 THEN xor(c8 >> 1, 3988292384) ELSE c8 >> 1 END ORDER BY i) AS zs FROM (SELECT i, {_steps(7)} AS c8 FROM range(256) r(i))),
h AS (SELECT doc_id, octet_length(encode(t))::BIGINT + 16 AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(t)) AS h, hex(encode(t)) AS x FROM d),
c AS (SELECT doc_id, size, h, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)), lambda s, v: xor(s >> 8, zs[xor(s & 255, v) + 1]))) AS text_crc32 FROM h, z),
m AS (SELECT *, row_number() OVER (ORDER BY h, doc_id NULLS FIRST) - 1 AS v, count(*) OVER () AS n FROM c),
s AS (SELECT *, floor(sqrt(greatest(n - 1, 0)))::BIGINT + 1 AS a FROM m),
s2 AS (SELECT *, greatest(1, (n + a - 1) // a) AS b FROM s),
w AS ({network("s2", "v")} UNION ALL {network("(SELECT * FROM w WHERE v >= n)", "v")})
SELECT doc_id, size, text_crc32, 'rows' AS law, (v % {SHARDS})::INT AS shard, v // {SHARDS} AS slot, NULL::INT AS grown_shard FROM w WHERE v < n
"""


def _steps(k: int) -> str:
    """SQL of `k` steps of the checksum's table (reflected polynomial 0xEDB88320) for the number i."""
    return "i::BIGINT" if not k else f"(CASE WHEN ({_steps(k - 1)}) & 1 = 1 THEN xor(({_steps(k - 1)}) >> 1, 3988292384) ELSE ({_steps(k - 1)}) >> 1 END)"


ORACLE_OP8 = _oracle()
