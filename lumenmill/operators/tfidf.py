"""TF-IDF in the long form, as SQL: smooth idf ln((1+n)/(1+df))+1, L2 norm per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenmill.functions import fixed
from lumenmill.operators.tokens import exploded


def term_counts(df: DataFrame) -> DataFrame:
    """(record_id, token, tf) of (record_id, tokens)."""
    return exploded(df, "record_id").groupBy("record_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))


def tfidf(df: DataFrame, min_df: int = 5, max_df: float = 0.95, max_features: int | None = 50_000, sublinear: bool = False) -> DataFrame:
    """(record_id, token, tf, df, tfidf). Empty documents count in n. With max_features the
    tokens with the largest corpus count stay, ties by token."""
    counts = term_counts(df)
    n = df.agg(F.count(F.lit(1)).alias("n"))
    terms = document_frequencies(counts).crossJoin(F.broadcast(n)).filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n")))
    if max_features:
        terms = terms.orderBy(F.desc("ctf"), "token").limit(max_features)
    idf = F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0
    tf = (F.log(F.col("tf").cast("double")) + 1.0) if sublinear else F.col("tf").cast("double")
    raw = counts.join(terms.select("token", "df", idf.alias("idf")), "token").withColumn("w", tf * F.col("idf"))
    norms = raw.groupBy("record_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "record_id").select("record_id", "token", "tf", "df", (F.col("w") / F.col("norm")).alias("tfidf"))


def vocabulary(weights: DataFrame) -> DataFrame:
    """(token, idx): column numbers in order of token."""
    return weights.select("token").distinct().withColumn("idx", F.row_number().over(Window.orderBy("token")) - 1)


def top_terms(weights: DataFrame, k: int = 20) -> DataFrame:
    """(record_id, rank, token, score): each document's heaviest terms, eight places."""
    rank = F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("tfidf"), "token"))
    return weights.withColumn("rank", rank).filter(F.col("rank") <= k).select("record_id", "rank", "token", F.round("tfidf", 8).alias("score"))


def keyword_arrays(top: DataFrame) -> DataFrame:
    """(record_id, keywords array<struct<token, score>>) in order of rank."""
    packed = F.sort_array(F.collect_list(F.struct("rank", "token", "score")))
    return top.groupBy("record_id").agg(F.transform(packed, lambda s: F.struct(s["token"].alias("token"), s["score"].alias("score"))).alias("keywords"))


def first_keywords(keywords: DataFrame, k: int = 5) -> DataFrame:
    return keywords.select("record_id", F.array_join(F.transform(F.slice("keywords", 1, k), lambda s: s["token"]), " / ").alias("top_keywords"))


def global_terms(weights: DataFrame, documents: int | DataFrame, k: int | None = None) -> DataFrame:
    """(rank, token, score): mean weight over all documents."""
    n = documents.count() if isinstance(documents, DataFrame) else documents
    means = weights.groupBy("token").agg((F.sum("tfidf") / n).alias("mean"))
    if k:
        means = means.orderBy(F.desc("mean"), "token").limit(k)
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "token"))).select("rank", "token", F.round("mean", 8).alias("score"))


def placeholder_ranks(terms: DataFrame) -> DataFrame:
    """(token, rank, score) of every placeholder in global_terms; null and 0 for those not there."""
    every = terms.sparkSession.createDataFrame([(p,) for p in fixed.PLACEHOLDERS], "token string")
    return every.join(terms, "token", "left").select("token", "rank", F.coalesce("score", F.lit(0.0)).alias("score"))


def shape(weights: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: rows, columns, non-zeros, density."""
    cells = weights.agg(F.count(F.lit(1)).alias("nnz"), F.count_distinct("token").alias("n_features"))
    both = documents.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(cells)
    return both.withColumn("density", F.round(F.col("nnz") / F.greatest(F.col("n_docs") * F.col("n_features"), F.lit(1)), 8))
