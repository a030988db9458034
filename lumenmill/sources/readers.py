"""Readers: raw logs, JSON lines, labels, configuration."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenmill.functions import fixed
from lumenmill.functions.udfs import clean_value, clean_values, parse_timestamp

RAW_FIELDS = ["@timestamp", *fixed.PAYLOAD_FIELDS, "fromname", *[f for f in fixed.DROPPED_FIELDS if f != "timestamp"]]


def raw_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id TAB json``, cut at the first tab: record_id, fields (map of raw JSON values),
    bad (no JSON object, or no tab). Blank lines go; bytes that are no UTF-8 are replaced."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parts = lines.select(F.substring_index("value", "\t", 1).alias("record_id"), F.when(F.instr("value", "\t") > 0, F.expr("substring(value, instr(value, '\t') + 1)")).otherwise("").alias("json"))
    fields = F.from_json("json", "map<string,string>", {"mode": "PERMISSIVE"})
    return parts.withColumn("fields", fields).withColumn("bad", F.col("fields").isNull() | ~F.trim("json").startswith("{"))


def cleaned(log: DataFrame) -> DataFrame:
    """record_id, timestamp, the known fields, and `more`: the fields of other names as a map. Text is
    cleaned; values that are no text stay as their JSON."""
    good = log.filter(~F.col("bad")).withColumn("_o", F.try_parse_json("json"))
    good = good.withColumn("_text", F.map_filter(F.expr("cast(_o as map<string, variant>)"), lambda k, v: F.schema_of_variant(v) == "STRING"))
    known = [f for f in RAW_FIELDS if f != "@timestamp"]
    is_text = lambda f: F.map_contains_key("_text", f)
    columns = [F.when(is_text(f), clean_value(F.col("fields")[f])).otherwise(F.col("fields")[f]).alias(f) for f in known]
    others = F.map_filter("fields", lambda k, v: ~k.isin([*known, "@timestamp"]))
    names = F.map_keys(others)
    clean = F.map_from_arrays(names, clean_values(F.map_values(others), F.transform(names, lambda k: F.map_contains_key("_text", k))))
    return good.select("record_id", parse_timestamp(F.col("fields")["@timestamp"]).alias("timestamp"), *columns, clean.alias("more"))


def drop_fields(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    return df.drop(*(fixed.DROPPED_FIELDS if fields is None else fields))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None, strict: bool = True) -> DataFrame:
    """One object a line; blank lines are skipped; with strict a malformed line is an error."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by an order column, key as text, null as ''."""
    keyed = df.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit("")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return keyed.withColumn("_n", rank).filter("_n = 1").drop("_n")


def labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """Label file with header, a byte order mark allowed; cluster_id is a number if all are, else
    text as it stands."""
    df = spark.read.csv(path, header=True)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    if "cluster_id" not in df.columns:
        return df
    odd = df.filter(~F.coalesce("cluster_id", F.lit("0")).rlike(r"^-*\d+$"))
    return df.withColumn("cluster_id", F.col("cluster_id").try_cast("int")) if odd.isEmpty() else df


def labels(spark: SparkSession, folder: str, variant: str = "") -> DataFrame:
    """labels[_variant].jsonl of a folder, else .csv, else an error."""
    base = f"{folder.rstrip('/')}/labels{'_' + variant if variant else ''}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for suffix, read in ((".jsonl", json_lines), (".csv", labels_csv)):
        path = fs_path(base + suffix)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return read(spark, base + suffix)
    raise FileNotFoundError(f"{base}.jsonl or .csv")


def _config(path: str):
    with open(path, encoding="utf-8-sig") as f:
        return json.load(f)


def remove_list(path: str) -> list[str]:
    got = _config(path)
    if not isinstance(got, list) or not all(isinstance(x, str) for x in got):
        raise ValueError(f"{path}: a list of strings is wanted")
    return got


def char_map(path: str) -> dict[str, str]:
    got = {k: v for k, v in _config(path).items() if not k.startswith("_")}
    if any(len(k) != 1 for k in got):
        raise ValueError(f"{path}: keys must be single characters")
    return got


def phrase_map(path: str) -> dict[str, str]:
    return {k: v for k, v in _config(path).get("patterns", {}).items() if k and isinstance(v, str) and v}


def whitelist(path: str) -> set[str]:
    got = _config(path)
    items = got.get("patterns", []) if isinstance(got, dict) else got
    return {"".join(c.upper() if c.isascii() else c for c in w) for w in items if w}


def stop_words(path: str | None = None) -> list[str]:
    """The built-in list with that of a file: a JSON list or a word a line."""
    if path is None:
        return list(fixed.STOPWORDS)
    if path.endswith(".json"):
        more = _config(path)
    else:
        with open(path, encoding="utf-8") as f:
            more = [line.strip() for line in f if line.strip()]
    return [*fixed.STOPWORDS, *more]


def taxonomy(path: str) -> dict:
    return _config(path)


def settings(path: str, env: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=value lines; what the environment has already wins."""
    env = dict(os.environ) if env is None else dict(env)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, sep, value = line.strip().partition("=")
                if sep and not key.startswith("#"):
                    env.setdefault(key.strip(), value.strip().strip("\"'"))
    return env


def weights(spark: SparkSession, path: str) -> DataFrame:
    """The long TF-IDF matrix, as sinks.writers.table wrote it."""
    return spark.read.parquet(path)
