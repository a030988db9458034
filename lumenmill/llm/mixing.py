"""Mixing sources to target weights by Poisson replication.

Source s with n_s rows is to have the share w_s of T rows: its rows repeat at the mean rate
r_s = w_s * T / n_s. Each row's number of copies is Poisson with that mean: a uniform number
from a seeded hash of its id is put through the inverse distribution, so a run can be repeated
and no row depends on another. Rows are exploded by their count and shuffled globally: every
copy has a hash key of its own, partitions are hash-dealt by it and sorted inside.

Target weights are given by source, or taken as n_s ** ALPHA / sum (ALPHA below 1 lifts small
sources). Only DataFrame functions run. Counting is one small aggregation; the distribution's
values are worked out once for each source and joined by source (AQE may split the join).

Defined results: a null source is a source of its own; rates above MOST are refused (the
table of the distribution would be too long); a null id draws as the empty text; rows repeated with
their id draw alike; a source absent from given weights has weight 0; an empty table stays so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.llm.common import parts, prepare, stage, table

ALPHA = 0.7
SEED = 20
MOST = 20_000
DIGITS = 13  # hex digits of a hash that make a uniform number


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, alpha: float = ALPHA, total: float = 1.0) -> DataFrame:
    """One row per source: source, n, rate; total is T as a multiple of the rows there are."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow("n", F.lit(alpha)))
    else:
        given = F.create_map(*[F.lit(v) for item in weights.items() for v in item]) if weights else F.lit(None)
        weighed = counts.withColumn("weight", F.coalesce(given[F.col("source")] if weights else F.lit(0.0), F.lit(0.0)))
    rows, weight = weighed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    rate = F.round(F.col("weight") / float(weight) * float(rows) * float(total) / F.col("n"), 9) if weight else F.lit(0.0)
    rated = weighed.select("source", "n", rate.alias("rate"))
    return rated.withColumn("rate", F.when(F.col("rate") <= MOST, F.col("rate")).otherwise(F.raise_error(F.lit(f"a repetition rate is above {MOST}"))))


def _with_steps(rates: DataFrame) -> DataFrame:
    """Adds cdf: P(X <= k) for k = 0, 1, ... far beyond any draw."""
    last = (F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    first = F.sequence(F.lit(0), last)
    # logarithms of k!, then of the probabilities: they don't vanish however large the rate
    logs = F.aggregate(F.slice(first, 2, F.size(first)), F.array(F.lit(0.0)), lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + F.log(k.cast("double")))))
    chance = F.zip_with(first, logs, lambda k, g: F.when(F.col("rate") == 0, (k == 0).cast("double")).otherwise(F.exp(k * F.log(F.col("rate")) - F.col("rate") - g)))
    sums = F.aggregate(chance, F.array(F.lit(0.0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p)))
    return rates.withColumn("cdf", F.slice(sums, 2, F.size(sums) - 1))


def _uniform(id_col: str, seed: int):
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, alpha: float = ALPHA, total: float = 1.0, seed: int = SEED) -> DataFrame:
    """docs' rows, each as often as it was drawn, in global random order: all columns of docs,
    then _copy (from 1), _rate and _key (the place in the shuffle); a column of docs by one of
    these names stands instead of it."""
    rates = stage(source_rates(docs, source_col, weights, alpha, total), "mixing-rates")
    steps = _with_steps(rates).select(F.col("source").alias("_source"), F.col("rate").alias("_rate"), F.col("cdf").alias("_cdf"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    doc_id, source = f"_row.`{id_col}`", F.col(f"_row.`{source_col}`")
    draws = F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))
    drawn = rows.join(steps, source.eqNullSafe(F.col("_source"))).withColumn("_u", _uniform(doc_id, seed)).withColumn("_n", draws).filter("_n > 0")
    copies = drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    keyed = copies.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}/"), text, F.lit("/"), F.col("_copy").cast("string"))))
    shuffled = keyed.repartition(parts(docs.sparkSession), "_key").sortWithinPartitions("_key")
    return shuffled.select("_row.*", *[c for c in ("_copy", "_rate", "_key") if c not in docs.columns])


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("_copy").alias("copy"), F.round("_rate", 6).alias("rate"), F.col("_key").alias("shuffle_key"), "text")


QUERIES = {"op2_poisson_mixing": op2_poisson_mixing}

ORACLES = {
    "op2_poisson_mixing": r"""
WITH c AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), r AS (
  SELECT source, round(pow(n, 0.7) / (SELECT sum(pow(n, 0.7)) FROM c) * (SELECT sum(n) FROM c) / n, 9)::DOUBLE AS rate FROM c
), k AS (
  SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM r, range(0, 100) AS t(k)
), cdf AS (
  SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k
), u AS (
  SELECT doc_id, source, text, ('0x' || md5('20:' || coalesce(doc_id::VARCHAR, ''))[1:13])::BIGINT / pow(16, 13) AS u FROM documents
), n AS (
  SELECT doc_id, u.source, text, rate, count(*) FILTER (cdf <= u) AS n FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source GROUP BY ALL
)
SELECT doc_id, source, copy::INTEGER AS copy, round(rate, 6) AS rate, md5('20/' || coalesce(doc_id::VARCHAR, '') || '/' || copy) AS shuffle_key, text
FROM n, unnest(range(1, n.n + 1)) AS x(copy)
"""
}
