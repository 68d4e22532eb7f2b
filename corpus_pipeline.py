"""A training corpus in five stages: select by quality, drop common lines, drop near copies, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run`` writes every stage as
Parquet to the shared folder and reads it again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, line_dedup, minhash, mixing, quality
from millrace.storage import written


def _with_text(docs: DataFrame, like: DataFrame) -> DataFrame:
    """`docs` with the columns of `like`, n_chars counted anew."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted to rated ones, puts in the best grade; the others go."""
    ratings = quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.select(docs, quality.train(docs, ratings))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share stay in the last of them only; no document goes, though it may end up empty."""
    out = line_dedup.dedup_lines(docs).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
    return _with_text(out, docs)


#: Two documents are near copies from this similarity of their five-word shingles, in percent; op4 has its own.
NEAR = 80


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, and of rows that repeat an id and text one."""
    found = written(minhash.near_duplicates(docs, percent=NEAR).where("doc_id is not null").select("doc_id", "kept"), "near")
    again = found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    gone = found.where("not kept").select("doc_id").unionByName(again).distinct()
    once = docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return _with_text(mixing.mixed_documents(docs), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every document of the mix."""
    return bpe.encode(docs)


STAGES = [("quality classifier", select_quality), ("line dedup", drop_lines), ("minhash near-dedup", drop_copies), ("mixing sources", mix_sources), ("bpe encoding", encode)]

#: SQL can't express the classifier; the tests hold every stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
