"""Joins of messages and labels, summaries, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenmill.functions.fixed import UNCLASSIFIED
from lumenmill.functions.text import is_missing


def attach_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """record_id, category, cluster_id, then df's other columns; UNCLASSIFIED and null where a
    row has no label. Old category and cluster_id columns of df go."""
    rest = [c for c in df.columns if c not in ("record_id", "category", "cluster_id")]
    joined = df.select("record_id", *rest).join(labels.select("record_id", "category", "cluster_id"), "record_id", "left")
    return joined.select("record_id", F.coalesce("category", F.lit(UNCLASSIFIED)).alias("category"), "cluster_id", *rest)


def missing_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels, "record_id", "left_anti").select("record_id")


def subset(df: DataFrame, labels: DataFrame, categories: list[str]) -> DataFrame:
    """Rows of df labelled with one of the categories, label columns attached."""
    wanted = labels.filter(F.col("category").isin(categories)).select("record_id", "category", "cluster_id")
    return df.drop("category", "cluster_id").join(wanted, "record_id")


def order_for_export(df: DataFrame, order: list[str]) -> DataFrame:
    """By the categories' order, unknown ones last, then record_id as text."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)])[F.col("category")], F.lit(len(order)))
    return df.orderBy(rank, F.col("record_id").cast("string"))


def summary(labels: DataFrame, order: list[str]) -> DataFrame:
    """rank, cluster_id, category, count, pct by the fixed order, other categories after it by
    name, then a total row."""
    counted = labels.groupBy("category").agg(F.count(F.lit(1)).alias("count"), F.min("cluster_id").alias("cluster_id"))
    known = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)])[F.col("category")]
    total = counted.agg(F.sum("count").alias("all"))
    ranked = counted.crossJoin(F.broadcast(total)).withColumn("rank", F.row_number().over(Window.orderBy(F.coalesce(known, F.lit(len(order))), "category")))
    rows = ranked.select("rank", "cluster_id", "category", "count", F.round(F.lit(100.0) * F.col("count") / F.col("all"), 2).alias("pct"))
    last = total.select(F.lit(None).cast("int").alias("rank"), F.lit(None).cast(dict(rows.dtypes)["cluster_id"]).alias("cluster_id"), F.lit("total").alias("category"), F.coalesce("all", F.lit(0)).alias("count"), F.lit(100.0).alias("pct"))
    return rows.unionByName(last)


def first_samples(df: DataFrame, k: int = 10, text: str = "text") -> DataFrame:
    """The first k records of each category with a preview of 200 characters."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy("record_id"))
    cut = F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("..."))).otherwise(F.col(text))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k).select("category", "rank", "record_id", cut.alias("preview"))


def markdown(rows: DataFrame, title: str) -> str:
    """A result as a Markdown table, all its rows; they stream through the driver."""
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.toLocalIterator()]]) + "\n"


def length_stats(c: Column, df: DataFrame) -> DataFrame:
    """One row: n, min, p50, p90, p99, max, avg of lengths; percentiles take the row at
    round-half-even(p (n - 1))."""
    lengths = df.select(F.length(c).alias("len"))
    counted = lengths.groupBy("len").agg(F.count(F.lit(1)).alias("c"))
    upto = counted.withColumn("upto", F.sum("c").over(Window.orderBy("len")))
    one = lengths.agg(F.count("len").alias("n"), F.min("len").alias("min"), F.max("len").alias("max"), F.round(F.avg("len"), 4).alias("avg"))
    both = upto.crossJoin(F.broadcast(one))
    at = lambda p: F.min(F.when(F.col("upto") >= F.bround(F.lit(p) * (F.col("n") - 1)) + 1, F.col("len")))
    return both.groupBy("n", "min", "max", "avg").agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))


def field_presence(df: DataFrame) -> DataFrame:
    """field, present, missing, missing_rate of each column: null and blank are missing."""
    flat = F.array(*[F.struct(F.lit(c).alias("field"), is_missing(F.col(c)).alias("gone")) for c in df.columns])
    rows = df.select(F.explode(flat).alias("f")).select("f.field", "f.gone")
    return rows.groupBy("field").agg(F.count_if(~F.col("gone")).alias("present"), F.count_if("gone").alias("missing"), F.round(F.avg(F.col("gone").cast("double")), 6).alias("missing_rate"))


def json_field_stats(df: DataFrame, column: str) -> DataFrame:
    """field, kind, present, filled, present_rate: how many of the rows with an object have the key,
    with a value of which type (int, float, bool, text, list, object, null), and not blank."""
    obj = F.try_parse_json(F.col(column))
    rows = df.select(obj.alias("o")).filter(F.schema_of_variant("o").startswith("OBJECT"))
    flat = rows.select(F.expr("o"), F.explode(F.expr("cast(o as map<string, variant>)")).alias("field", "value"))
    seen = F.schema_of_variant("value")
    kind = F.when(seen == "VOID", "null").when(seen == "STRING", "text").when(seen == "BOOLEAN", "bool").when(seen.isin("BIGINT", "INT"), "int").when(seen.startswith("ARRAY"), "list").when(seen.startswith("OBJECT"), "object").otherwise("float")
    blank = (seen == "VOID") | ((seen == "STRING") & is_missing(F.expr("try_variant_get(value, '$', 'string')")))
    counted = flat.groupBy("field", kind.alias("kind")).agg(F.count(F.lit(1)).alias("present"), F.count_if(~blank).alias("filled"))
    return counted.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))).select("field", "kind", "present", "filled", F.round(F.col("present") / F.col("n"), 6).alias("present_rate"))
