"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash and stand end to end as one run of words, cut into blocks of equal size.
Slot k of the mix goes to the source in whose part of the cumulative weights the point frac(k * golden ratio) falls, so
that every stretch of the mix holds the sources in their proportions. A source's slots are ranked; the r-th takes its
block r, beginning again after the last. What a document gives is the sum over its pieces in the blocks that are taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordering import copies, offsets, row_hash
from millrace.storage import written

#: Weights of the sources in their order, again and again, and how often a source may be repeated at most.
WEIGHTS, MOST = (1.0, 2.0, 3.0), 3
#: Blocks that the whole mix aims at, and the largest block; larger inputs get more blocks.
BLOCKS, LARGEST_BLOCK = 2**17, 65_536
#: Slots of a part of the schedule, within which a source's slots are ranked.
PART_SLOTS = 4_096
GOLDEN = (math.sqrt(5) - 1) / 2
#: Golden-ratio points are computed in whole numbers, exact for any slot: multiples of this modulo 2**40.
_STEP, _BITS = int(GOLDEN * 2**40) | 1, 40


def word_count(text: str) -> Column:
    """Runs of other than space and the characters 9 to 13; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill_targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the sum of sizes by weight; none above `most` times its size, the excess shared again by weight."""
    total, capped = float(sum(sizes)), [False] * len(sizes)
    while True:
        rest = total - sum(most * s for s, c in zip(sizes, capped) if c)
        open_ = sum(w for w, c in zip(weights, capped) if not c)
        targets = [most * s if c else rest * w / open_ for s, w, c in zip(sizes, weights, capped)]
        over = [not c and t > most * s for s, t, c in zip(sizes, targets, capped)]
        if not any(over):
            return [float(t) for t in targets]
        capped = [c or o for c, o in zip(capped, over)]


def _plan(sources: DataFrame) -> list[dict]:
    """One dict a source, in their order: the table has a row a source, which the driver can hold."""
    rows = sorted(sources.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in rows]
    targets = fill_targets(sizes, [WEIGHTS[k % len(WEIGHTS)] for k in range(len(rows))]) if sum(sizes) else [0.0] * len(rows)
    block = min(LARGEST_BLOCK, max(1, math.ceil(sum(sizes) / BLOCKS)))
    plan = []
    for k, (r, target) in enumerate(zip(rows, targets)):
        blocks = math.ceil(r["size"] / block)
        plan.append({"no": k, "source": r["source"], "docs": r["docs"], "size": r["size"], "target": target, "blocks": blocks, "slots": target / (r["size"] / blocks) if blocks else 0.0})
    return plan


#: Bits of a point that name its cell: points find their source by an equal cell first.
_CELL = 16


def _schedule(spark, plan: list[dict]) -> DataFrame:
    """Rows ``(slot, no, turn)``: the mix's slots with their source and the slot's rank among the source's."""
    weights = [p["slots"] for p in plan]
    count, total = round(sum(weights)), sum(weights)
    slots = spark.range(count).withColumnRenamed("id", "slot") if count else spark.range(0).withColumnRenamed("id", "slot")
    # (slot * step) mod 2**40, in halves so that no product overflows.
    half = F.pmod(F.col("slot"), F.lit(2**_BITS))
    low, high = half.bitwiseAND(F.lit(2**20 - 1)), F.shiftright(half, 20)
    point = F.pmod(low * _STEP + F.shiftleft(F.pmod(high * F.lit(_STEP & (2**20 - 1)), F.lit(2**20)), 20), F.lit(2**_BITS))
    # Each source has the points from lo to below hi; the last with slots takes what rounding leaves.
    parts = spark.createDataFrame(_bounds(plan), "no int, lo long, hi long").where("lo < hi")
    shift = _BITS - _CELL
    parts = parts.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))))
    slots = slots.withColumn("point", point).withColumn("cell", F.shiftright("point", shift)).join(parts, "cell").where("point >= lo and point < hi")
    slots = slots.select("slot", "no", F.floor(F.col("slot") / PART_SLOTS).alias("part"))
    before = Window.partitionBy("no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.groupBy("no", "part").agg(F.count("*").alias("many")).withColumn("start", F.coalesce(F.sum("many").over(before), F.lit(0))).drop("many")
    rank = F.row_number().over(Window.partitionBy("no", "part").orderBy("slot")) - 1
    return slots.withColumn("rank", rank).join(starts, ["no", "part"]).select("slot", "no", (F.col("start") + F.col("rank")).alias("turn"))


def _bounds(plan: list[dict]) -> list[tuple[int, int, int]]:
    """``(no, lo, hi)``: the stretch of points of each source, by the cumulative weights."""
    total, at, out = sum(p["slots"] for p in plan), 0.0, []
    last = max((p["no"] for p in plan if p["slots"] > 0), default=None)
    for p in plan:
        lo = math.floor(at / total * 2**_BITS) if total else 0
        at += p["slots"]
        hi = 2**_BITS if p["no"] == last else math.floor(at / total * 2**_BITS) if total else 0
        out.append((p["no"], lo, hi if last is not None and p["no"] <= last else lo))
    return out


def _laid(rows: DataFrame, plan: list[dict]) -> DataFrame:
    """Rows with ``offset``: the words of the same source's documents before it, in the order of their hash."""
    lines = written(offsets(rows.withColumn("words", F.col("size") * F.col("many")), ["no"], "h", "words", max((p["docs"] for p in plan), default=0), "first").drop("words"), "lines")
    return copies(lines, "many", "copy").withColumn("offset", F.col("first") + F.col("copy") * F.col("size")).drop("first", "copy")


def _identity(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> Column:
    """Hash of a row's id, text and source: rows of one are told apart by nothing."""
    source = F.col(source_col).cast("string")
    return row_hash(F.col(id_col).cast("long"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.when(source.isNotNull(), F.concat(F.lit("s"), source)))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, list[dict]]:
    """A line for each row of id, text and source, with its words and how ``many`` there are, and its source's figures."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"), _identity(docs, id_col, text_col, source_col).alias("h"))
    rows = rows.select("h", "doc_id", "source", word_count("text").alias("size")).groupBy("h", "doc_id", "source", "size").agg(F.count("*").alias("many"))
    rows = written(rows, "sizes")
    plan = _plan(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("size"), F.count("*").alias("docs")))
    schema = "no int, source string, source_size long, target double, blocks long"
    table = spark.createDataFrame([(p["no"], p["source"], p["size"], p["target"], p["blocks"]) for p in plan], schema)
    # One row a source; whether that is few enough to broadcast is Spark's to see.
    return rows.join(table, rows["source"].eqNullSafe(table["source"])).drop(table["source"]), plan


def _pieces(rows: DataFrame) -> DataFrame:
    """Rows ``(no, offset, block, begin, end)``, one for each block that the row at `offset` has words in; words of the source.

    Block b holds the words from floor(b * size / blocks) of its source, so blocks differ by one word at most.
    """
    first, last = F.expr("(offset * blocks) div source_size"), F.expr("((offset + size - 1) * blocks) div source_size")
    some = rows.where("size > 0").select("doc_id", "no", "offset", "size", "source_size", "blocks", first.alias("lo"), last.alias("hi"))
    # The bounds are rounded down, so the blocks beside are looked at too.
    some = some.withColumn("block", F.explode(F.sequence(F.greatest(F.col("lo") - 1, F.lit(0)), F.least(F.col("hi") + 1, F.col("blocks") - 1))))
    begin = F.greatest(F.col("offset"), F.expr("(block * source_size) div blocks"))
    end = F.least(F.col("offset") + F.col("size"), F.expr("((block + 1) * source_size) div blocks"))
    return some.select("doc_id", "no", "offset", "block", begin.alias("begin"), end.alias("end")).where("begin < end")


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows ``(slot, no, epoch, block, doc_id, begin, end)`` give words ``[begin, end)`` of a document.

    Ordered by slot, then by doc_id, this is the mixed corpus; reruns agree.
    """
    rows, plan = _sized(docs, id_col, text_col, source_col)
    pieces = _pieces(_laid(rows, plan))
    turns = _turns(docs.sparkSession, plan)
    inside = [(F.col(x) - F.col("offset")).alias(x) for x in ("begin", "end")]
    return turns.join(pieces, ["no", "block"]).select("slot", "no", "epoch", "block", "doc_id", *inside)


def _turns(spark, plan: list[dict]) -> DataFrame:
    """The schedule's slots with the block that each takes and how often that block came before."""
    turns = _schedule(spark, plan)
    blocks = spark.createDataFrame([(p["no"], p["blocks"]) for p in plan], "no int, blocks long")
    turns = turns.join(blocks, "no").where(f"turn < {MOST} * blocks")
    return turns.select("slot", "no", F.expr("turn % blocks").alias("block"), F.expr("turn div blocks").alias("epoch"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of `docs`.

    Sources stand by code point, null last, with weights 1, 2, 3, 1, ...; together they share all words, none above three
    times its own. taken: the row's words that the mix takes, repeats counted; at most three times its size, and none for
    null and empty texts. Rows of equal id, text and source are told apart by nothing: they are counted first and laid side
    by side, so what they take together is what counts. Extra columns are left out. An empty table gives no rows; if no row
    has words, every target is 0. The figures of each source, a row a source, are planned on the driver.
    """
    rows, plan = _sized(docs, id_col, text_col, source_col)
    rows = written(_laid(rows, plan), "laid")
    times = _turns(docs.sparkSession, plan).groupBy("no", "block").agg(F.count("*").alias("times"))
    given = _pieces(rows).join(times, ["no", "block"]).groupBy("no", "offset").agg(F.sum(F.expr("times * (end - begin)")).alias("taken"))
    # A source's rows with words begin at different places, so source and place name a row.
    out = rows.withColumn("at", F.when(F.col("size") > 0, F.col("offset"))).join(given.withColumnRenamed("offset", "at"), ["no", "at"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, all columns, as often as the mix takes them: whole, but for the one row of a source in which its
    last block ends, which comes once up to the end of its last word taken, as it stands in the text.

    Of rows with equal id, text and source, one stands for all. Rows without words are in no block, so not in the mix. Texts
    are moved once, to meet their copies. Columns of `docs` may have any names.
    """
    rows, plan = _sized(docs, id_col, text_col, source_col)
    rows = written(_laid(rows, plan), "laid")
    turns = _turns(docs.sparkSession, plan).select("no", "block", "epoch")
    taken = _pieces(rows).join(turns, ["no", "block"]).groupBy("no", "offset", "epoch").agg(F.sum(F.expr("end - begin")).cast("int").alias("words"))
    # Rows told apart by nothing are counted, so that none meets its text more than a few times.
    taken = taken.join(rows.where("size > 0").select("no", "offset", "h", "size"), ["no", "offset"]).groupBy("h", "words", "size").agg(F.count("*").alias("many"))
    base = docs.select(F.struct(*docs.columns).alias("row"), _identity(docs, id_col, text_col, source_col).alias("h")).dropDuplicates(["h"])
    text = F.col("row")[text_col].cast("string")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1), F.col("words")), "")
    out = base.join(taken, "h").withColumn("row", F.col("row").withField(text_col, F.when(F.col("words") < F.col("size"), cut).otherwise(text)))
    return copies(out.select("row", "many"), "many", "copy").select("row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' || coalesce('s' || source, '')) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source IS NULL, source) AS no FROM d GROUP BY source),
l AS (SELECT list(size ORDER BY no) AS s, list(((no - 1) % 3 + 1)::DOUBLE ORDER BY no) AS w, sum(size)::DOUBLE AS total FROM s0),
f(c, t, last) AS (SELECT list_transform(s, lambda x: false), list_transform(s, lambda x: -1.0::DOUBLE), false FROM l
  UNION ALL SELECT list_transform(range(1, len(c) + 1), lambda i: c[i] OR n[i] > {MOST} * s[i]), n, coalesce(list_bool_or(list_transform(range(1, len(c) + 1), lambda i: NOT c[i] AND n[i] > {MOST} * s[i])), false) = false
    FROM (SELECT c, s, list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] THEN {MOST}.0 * s[i] ELSE rest * w[i] / open END) AS n
      FROM (SELECT c, s, w, total - coalesce(list_sum(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] THEN {MOST}.0::DOUBLE * s[i] ELSE 0 END)), 0) AS rest,
        list_sum(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] THEN 0 ELSE w[i] END)) AS open FROM f, l WHERE NOT last))),
s1 AS (SELECT s0.*, t[no] AS target, least({LARGEST_BLOCK}, greatest(1, ceil(total / {BLOCKS})))::BIGINT AS block FROM s0, l, f WHERE last),
s2 AS (SELECT *, ceil(size / block)::BIGINT AS blocks FROM s1),
s3 AS (SELECT *, CASE WHEN blocks > 0 THEN target / (size / blocks::DOUBLE) ELSE 0 END AS slots FROM s2),
s4 AS (SELECT *, sum(slots) OVER (ORDER BY no ROWS UNBOUNDED PRECEDING) AS upto, sum(slots) OVER () AS whole, max(CASE WHEN slots > 0 THEN no END) OVER () AS final FROM s3),
s5 AS (SELECT *, floor((upto - slots) / whole * {2**_BITS})::BIGINT AS lo, CASE WHEN no = final THEN {2**_BITS} ELSE floor(upto / whole * {2**_BITS})::BIGINT END AS hi FROM s4),
p AS (SELECT slot, (slot * {_STEP}) % {2**_BITS} AS point FROM range((SELECT round(max(whole))::BIGINT FROM s5)) r(slot)),
u AS (SELECT no, blocks, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS turn FROM p JOIN s5 ON point >= lo AND point < hi),
v AS (SELECT no, turn % blocks AS block, count(*) AS times FROM u WHERE turn < {MOST} * blocks GROUP BY 1, 2),
x AS (SELECT row_number() OVER () AS id, doc_id, d.size, s5.size AS source_size, target, no, blocks, sum(d.size) OVER (PARTITION BY no ORDER BY h ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS o FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
y AS (SELECT id, size, o, no, source_size, blocks, unnest(range(greatest(o * blocks // source_size - 1, 0), least((o + size - 1) * blocks // source_size + 1, blocks - 1) + 1)) AS block FROM x WHERE size > 0),
z AS (SELECT id, sum(times * greatest(0, least(o + size, (block + 1) * source_size // blocks) - greatest(o, block * source_size // blocks))) AS taken FROM y JOIN v USING (no, block) GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM x LEFT JOIN z USING (id)
"""
