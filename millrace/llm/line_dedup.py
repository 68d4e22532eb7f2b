"""Lines that many documents share are dropped from all but one of them. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import written

#: A key's least code points, and the least documents that hold it.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: What is stripped from both ends of a line.
BLANK = "\t\n\x0b\x0c\r "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The id that a row without one counts as: below any other.
_NO_ID = -(2**63)


def _key(line: Column) -> Column:
    stripped = F.btrim(line, F.lit(BLANK))
    # Of plain ASCII, lower() changes A-Z alone, and is quicker.
    return F.when(F.octet_length(stripped) == F.char_length(stripped), F.lower(stripped)).otherwise(F.translate(stripped, _UPPER, _LOWER))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Every row of `docs`, all its columns, with ``n_lines`` (before), ``n_dropped`` and ``kept_text``.

    A text is split at \\n (null counts as empty: one empty line). A line's key is the line stripped of spaces and the
    characters 9 to 13 at both ends, A-Z lower-cased. Lines whose key has `least_chars` code points and is held by
    `least_docs` documents are dropped, except in the document with the largest id that holds it. Rows with the same id
    are one document; rows without an id together count as one below all others. Columns of `docs` with the three names are
    replaced. An empty table gives no rows.

    Only hashes, places and ids of long lines are shuffled to count them, combined by document first, so a common line is
    spread out by document. What is dropped comes back as places by document and the text is moved once, to meet them.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    base = docs.select(*names, F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    base = base.withColumn("__digest", F.xxhash64("__text"))
    lines = base.select("__id", "__digest", F.posexplode(F.split("__text", "\n", -1)).alias("__at", "__line"))
    lines = lines.withColumn("__key", _key(F.col("__line"))).where(F.char_length("__key") >= least_chars)
    # 128 bits stand for a key.
    lines = lines.select("__id", "__digest", "__at", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(1), "__key").alias("__h2"))
    held = lines.select("__h1", "__h2", "__id").distinct()
    common = held.groupBy("__h1", "__h2").agg(F.count("*").alias("__docs"), F.max("__id").alias("__last")).where(F.col("__docs") >= least_docs)
    # Written, so that the join knows its size, and can split a line that very many documents hold.
    common = written(common.select("__h1", "__h2", "__last"), "lines")
    dropped = lines.join(common, ["__h1", "__h2"]).where(F.col("__id") != F.col("__last"))
    places = dropped.groupBy("__id", "__digest").agg(F.collect_set("__at").alias("__out"))
    met = base.join(places, ["__id", "__digest"], "left")
    split = F.split("__text", "\n", -1)

    def without(t: Column) -> Column:
        # The places that stay come from two sets, so a text takes time in proportion to its lines.
        places = F.array_except(F.sequence(F.lit(0), F.size(t["lines"]) - 1), t["out"])
        return F.array_join(F.transform(places, lambda i: F.get(t["lines"], i)), "\n")

    # A struct in an array of one, so that the text is split once and not for every place.
    rest = F.transform(F.array(F.struct(split.alias("lines"), F.col("__out").alias("out"))), without)[0]
    kept = F.when(F.col("__out").isNull(), F.col("__text")).otherwise(rest)
    return met.select(*names, F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("__out"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def op6(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(split(text, chr(10))) AS line, unnest(generate_series(1, len(split(text, chr(10))))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.last AS dropped FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
