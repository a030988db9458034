"""The corpus pipeline: language ID, exact and near de-duplication, mixing, encoding.

Every stage works on all rows its predecessor kept. All but the last return the columns of
``documents``; the last returns one row per document copy with its token ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.llm import exact_dedup, language_id, mixing, near_dedup, sentencepiece_fst
from lumenmill.llm.common import prepare, stage, table


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language classifier rejects (no letter, or far from every
    language); lang stays as it is."""
    prepare(spark)
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, one row with the smallest doc_id stays."""
    prepare(spark)
    decided = exact_dedup.exact_dedup(docs).select(F.col("doc_id").alias("_id"), "kept", F.col("text_sha256").alias("_sha"))
    decided = stage(decided, "exact-decisions")
    keyed = docs.withColumn("_text", F.sha2(exact_dedup.normalised(F.col("text")), 256))
    here = _same("doc_id", "_id") & (F.col("_text") == F.col("_sha"))
    left = keyed.join(decided.filter("not kept").select("_id", "_sha"), here, "left_anti")
    repeats = decided.filter("kept").groupBy("_id", "_sha").count().filter("count > 1").select("_id", "_sha")
    if not repeats.isEmpty():
        again = left.join(repeats, here, "left_semi").dropDuplicates(["doc_id", "_text"])
        left = left.join(repeats, here, "left_anti").unionByName(again)
    return left.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays. Rows that doc_id
    can't single out are documents of their own, and come after those it can."""
    prepare(spark)
    odd = docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").select(F.col("doc_id").alias("_id"))
    if odd.isEmpty():
        return _without_near(docs, "doc_id")
    most = docs.agg(F.max("doc_id")).first()[0] or 0
    fresh = F.greatest(F.lit(most), F.lit(0)) + 1 + F.monotonically_increasing_id()
    marked = docs.join(odd, _same("doc_id", "_id"), "left").select(*docs.columns, F.when(F.col("_id").isNotNull() | F.col("doc_id").isNull(), fresh).otherwise(F.col("doc_id")).alias("_row"))
    return _without_near(stage(marked, "near-rows"), "_row").select(*docs.columns)


def _without_near(docs: DataFrame, key: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("doc_id"), "text")
    dropped = near_dedup.near_dedup(rows).filter("not kept").select(F.col("doc_id").alias("_dropped"))
    return docs.join(dropped, docs[key] == F.col("_dropped"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document by its Poisson draw for its source's target weight."""
    prepare(spark)
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document copy."""
    prepare(spark)
    return sentencepiece_fst.encode(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The encoding stage cannot be put in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None
