"""Clustering for comparison: SVD, k-means over several seeds, silhouette, agreement metrics."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenmill.functions import fixed
from lumenmill.operators.tfidf import first_keywords

def sparse_rows(weights: DataFrame, index: DataFrame) -> DataFrame:
    """(record_id, features) from the long form and (token, idx)."""
    size = index.count()
    cells = weights.join(index, "token").groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("idx", "tfidf"))).alias("cells"))
    pack = F.udf(lambda idx, weights: SparseVector(size, idx, weights), VectorUDT())
    return cells.select("record_id", pack("cells.idx", "cells.tfidf").alias("features"))


def reduce_dimensions(rows: DataFrame, components: int) -> DataFrame:
    """Truncated SVD without centring, then unit length: (record_id, features). The solver multiplies
    by the matrix hundreds of times, so its rows are kept as the JVM has them: Python makes them once."""
    numbered = rows.rdd.zipWithIndex().persist(StorageLevel.MEMORY_AND_DISK)
    matrix = IndexedRowMatrix(numbered.map(lambda r: IndexedRow(r[1], OldVectors.fromML(r[0]["features"]))))
    matrix._java_matrix_wrapper._java_model.rows().persist(rows.sparkSession._jvm.org.apache.spark.storage.StorageLevel.MEMORY_AND_DISK())
    k = max(1, min(components, matrix.numCols() - 1, matrix.numRows()))
    svd = matrix.computeSVD(k, computeU=True)
    s = svd.s.toArray()
    scaled = svd.U.rows.map(lambda r: (int(r.index), [float(a) for a in r.vector.toArray() * s]))
    spark = rows.sparkSession
    ids = spark.createDataFrame(numbered.map(lambda r: (r[1], r[0]["record_id"])), f"i long, record_id {dict(rows.dtypes)['record_id']}")
    out = spark.createDataFrame(scaled, "i long, v array<double>").join(ids, "i").select("record_id", array_to_vector("v").alias("raw"))
    return Normalizer(inputCol="raw", outputCol="features", p=2.0).transform(out).select("record_id", "features")


def kmeans(rows: DataFrame, k: int, seeds: int = 10, max_iter: int = 300, seed: int = 42) -> tuple[DataFrame, KMeansModel]:
    """The run with the least cost of several seeds: (record_id, features, cluster_id)."""
    rows = rows.persist()
    models = [KMeans(k=k, seed=seed + i, maxIter=max_iter, predictionCol="cluster_id").fit(rows) for i in range(seeds)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    return model.transform(rows), model


def silhouette(clustered: DataFrame) -> float:
    return ClusteringEvaluator(predictionCol="cluster_id", featuresCol="features").evaluate(clustered)


def scan_k(rows: DataFrame, ks: list[int], seeds: int = 3, max_iter: int = 100) -> DataFrame:
    """k, inertia, silhouette of each k."""
    found = []
    for k in ks:
        clustered, model = kmeans(rows, k, seeds, max_iter)
        found.append((k, float(model.summary.trainingCost), float(silhouette(clustered))))
    return rows.sparkSession.createDataFrame(found, "k int, inertia double, silhouette double")


def pick_k(scan: DataFrame) -> int:
    return scan.orderBy(F.desc("silhouette"), "k").first()["k"]


def with_empty(clustered: DataFrame, everyone: DataFrame) -> DataFrame:
    """(record_id, cluster_id), -1 for documents without tokens."""
    return everyone.select("record_id").join(clustered.select("record_id", "cluster_id"), "record_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))


def cluster_keywords(weights: DataFrame, labels: DataFrame, k: int = 20) -> DataFrame:
    """(cluster_id, rank, token, score): mean weight over a cluster's members, positive only."""
    sizes = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    sums = weights.join(labels, "record_id").groupBy("cluster_id", "token").agg(F.sum("tfidf").alias("s"))
    means = sums.join(F.broadcast(sizes), "cluster_id").withColumn("mean", F.col("s") / F.col("size")).filter("mean > 0")
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("mean"), "token"))
    return means.withColumn("rank", rank).filter(F.col("rank") <= k).select("cluster_id", "rank", "token", F.round("mean", 8).alias("score"))


def suggest_names(keywords: DataFrame) -> DataFrame:
    """(cluster_id, cluster_name) by the first twelve words."""
    words = keywords.filter("rank <= 12").groupBy("cluster_id").agg(F.collect_list("token").alias("words"))
    name = F.lit(fixed.CLUSTER_UNNAMED)
    for label, signs in reversed(fixed.CLUSTER_NAMES.items()):
        name = F.when(F.arrays_overlap("words", F.array(*[F.lit(s) for s in signs])), label).otherwise(name)
    return words.select("cluster_id", name.alias("cluster_name"))


def nearest_samples(clustered: DataFrame, model: KMeansModel, k: int = 10) -> DataFrame:
    """(cluster_id, rank, record_id, distance): members nearest to their centre."""
    centres = clustered.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster_id int, centre array<double>")
    joined = clustered.join(F.broadcast(centres), "cluster_id").withColumn("v", vector_to_array("features"))
    squares = F.aggregate(F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)
    near = joined.withColumn("distance", F.round(F.sqrt(squares), 6))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("distance", "record_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("cluster_id", "rank", "record_id", "distance")


def describe_samples(samples: DataFrame, texts: DataFrame, keywords: DataFrame, k: int = 5) -> DataFrame:
    """Nearest samples with their text and their top keywords joined by ' / '. texts: record_id,
    text; keywords as tfidf.keyword_arrays makes them. Rows without either keep blanks."""
    tops = first_keywords(keywords, k)
    out = samples.join(texts.select("record_id", "text"), "record_id", "left").join(tops, "record_id", "left")
    return out.select("cluster_id", "rank", "record_id", "distance", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("top_keywords", F.lit("")).alias("top_keywords"))


def contingency(pairs: DataFrame) -> DataFrame:
    """(cluster_id, category, count) of rows with both."""
    return pairs.groupBy("cluster_id", "category").agg(F.count(F.lit(1)).alias("count"))


def top_categories(table: DataFrame, k: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("count"), "category"))
    return table.withColumn("rank", rank).filter(F.col("rank") <= k)


def purity(table: DataFrame) -> DataFrame:
    """category, total, main_cluster, purity (three places), spread (clusters that hold any of it),
    verdict."""
    total = F.sum("count").over(Window.partitionBy("category"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("count"), "cluster_id"))
    ranked = table.filter("count > 0").withColumn("total", total).withColumn("rank", rank)
    out = ranked.groupBy("category").agg(
        F.max("total").alias("total"), F.max(F.when(F.col("rank") == 1, F.col("cluster_id"))).alias("main_cluster"), F.round(F.max(F.col("count") / F.col("total")), 3).alias("purity"),
        F.count_distinct("cluster_id").alias("spread"),
    )
    verdict = F.when((F.col("purity") >= 0.6) & (F.col("spread") <= 2), "aligned").when(F.col("purity") >= 0.4, "partial").otherwise("scattered")
    return out.withColumn("verdict", verdict)


def agreement(table: DataFrame) -> DataFrame:
    """One row: ari, nmi (arithmetic mean of entropies), six places."""
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    rows = table.groupBy("cluster_id").agg(F.sum("count").alias("a"))
    columns = table.groupBy("category").agg(F.sum("count").alias("b"))
    n = table.agg(F.sum("count").alias("n"))
    cells = table.join(F.broadcast(rows), "cluster_id").join(F.broadcast(columns), "category").crossJoin(F.broadcast(n))
    mutual = F.sum(F.col("count") / F.col("n") * F.log(F.col("count") * F.col("n") / (F.col("a") * F.col("b"))))
    c = cells.agg(F.sum(pairs("count")).alias("sij"), mutual.alias("mi"), F.max("n").alias("n"))
    entropy = lambda x: -F.sum(F.col(x) / F.col("n") * F.log(F.col(x) / F.col("n")))
    r = rows.crossJoin(F.broadcast(n)).agg(F.sum(pairs("a")).alias("si"), entropy("a").alias("hi"))
    k = columns.crossJoin(F.broadcast(n)).agg(F.sum(pairs("b")).alias("sj"), entropy("b").alias("hj"))
    one = c.crossJoin(r).crossJoin(k)
    expected = F.col("si") * F.col("sj") / (F.col("n") * (F.col("n") - 1) / 2.0)
    bound = (F.col("si") + F.col("sj")) / 2.0
    ari = F.when(bound == expected, 1.0).otherwise((F.col("sij") - expected) / (bound - expected))
    nmi = F.when(F.col("hi") + F.col("hj") == 0, 1.0).otherwise(2.0 * F.col("mi") / (F.col("hi") + F.col("hj")))
    return one.select(F.round(ari, 6).alias("ari"), F.round(nmi, 6).alias("nmi"))


def size_share(labels: DataFrame) -> DataFrame:
    """One row: the largest cluster's share of all rows."""
    return labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("largest"), F.round(F.max("c") / F.sum("c"), 6).alias("share"))
