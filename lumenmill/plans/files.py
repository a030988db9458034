"""Queries that write files to the shared folder and read them again: readers, writers, configuration."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import functions as F

from lumenmill.functions import fixed, text
from lumenmill.operators import export, rules, tfidf, tokens
from lumenmill.plans.classify import _labels
from lumenmill.plans.corpus import REC, _documents, _record_labels, _weights, tfidf_sql
from lumenmill.plans.tables import LABELS, TOK, VOCABULARY, hit_sql, names, q, read, token_table
from lumenmill.sinks import writers
from lumenmill.sources import readers
from lumenmill.streaming import messages


def folder(spark) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, else in the warehouse;
    with a local master, where there is no other machine, a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.gettempdir() if re.match(r"local(\[|$)", spark.sparkContext.master) else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/lumenmill-files/{uuid.uuid4().hex}"


def _json_lines(s, d):
    at = f"{folder(s)}/documents"
    writers.json_lines(read(s, d, "documents"), at)
    return readers.json_lines(s, at, "doc_id long, text string, lang string, source string, n_chars long").select("doc_id", F.sha2("text", 256).alias("sha"), "lang", "source", "n_chars")


def _strict_lines(s, d):
    at = f"{folder(s)}/events"
    writers.json_lines(read(s, d, "events").select("event_id", "event_type", "value", "props"), at)
    return readers.json_lines(s, at, "event_id long, event_type string, value double, props string", strict=True)


def _csv(s, d):
    """A label file in one piece, with its byte order mark, found by its variant."""
    at = folder(s)
    writers.csv_file(_record_labels(s, d).select("record_id", "cluster_id", "category"), f"{at}/labels_v2.csv")
    return readers.labels(s, at, "v2").select(F.col("record_id").cast("long").alias("record_id"), "cluster_id", "category")


def _csv_text(s, d):
    """Cluster ids that are no numbers stay as they are."""
    at = f"{folder(s)}/labels.csv"
    writers.csv_parts(_record_labels(s, d).select("record_id", F.concat(F.lit("c"), "cluster_id").alias("cluster_id")), at)
    return readers.labels_csv(s, at).select(F.col("record_id").cast("long").alias("record_id"), "cluster_id")


def _raw(s, d):
    """Documents as a raw log with odd lines among them: what is read, cleaned and dropped."""
    at = f"{folder(s)}/raw.log"
    docs = read(s, d, "documents")
    obj = F.to_json(F.struct(F.concat(F.lit("&amp; "), "lang").alias("subject"), F.col("source").alias("content"), F.col("n_chars").alias("size"), F.lit("2020-01-01T00:00:00Z").alias("@timestamp"), F.concat(F.lit(" x  "), "lang").alias("own"), F.col("doc_id").alias("number")))
    line = F.when(F.col("doc_id") % 10 == 3, F.concat(F.col("doc_id").cast("string"), F.lit("\tnot json"))).when(F.col("doc_id") % 10 == 7, F.col("doc_id").cast("string")).otherwise(F.concat_ws("\t", F.col("doc_id").cast("string"), obj))
    docs.select(line.alias("value")).write.mode("overwrite").text(at)
    log = readers.raw_log(s, at)
    good = readers.drop_fields(readers.cleaned(log), ["size"])
    return good.select(F.col("record_id").cast("long").alias("record_id"), "timestamp", "subject", "content", F.col("more")["own"].alias("own"), F.col("more")["number"].alias("number"))


def _raw_counts(s, d):
    at = f"{folder(s)}/raw.log"
    docs = read(s, d, "documents")
    line = F.when(F.col("doc_id") % 10 == 3, F.concat(F.col("doc_id").cast("string"), F.lit("\tnot json"))).when(F.col("doc_id") % 10 == 7, F.lit("  ")).otherwise(F.concat_ws("\t", F.col("doc_id").cast("string"), F.to_json(F.struct("lang"))))
    docs.select(line.alias("value")).write.mode("overwrite").text(at)
    return readers.raw_log(s, at).agg(F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("bad"), F.count_if(F.col("fields")["lang"].isNotNull()).alias("good"))


def _last_wins(s, d):
    e = read(s, d, "events")
    return readers.last_wins(e.select("user_id", "event_type", "value", "event_id"), "user_id", "event_id")


def _configured(s, d):
    """Stop words and a taxonomy from files, over all documents."""
    local = tempfile.mkdtemp(prefix="lumenmill-")
    taxonomy = {"_note": "x", "categories": {c: {"zh": [], "en": [w.upper() for w in words], "pinyin": []} for c, words in VOCABULARY.items()}}
    for name, value in (("stop.json", ["les", "que"]), ("taxonomy.json", taxonomy)):
        with open(f"{local}/{name}", "w", encoding="utf-8") as f:
            json.dump(value, f)
    words = rules.flatten(readers.taxonomy(f"{local}/taxonomy.json"))
    docs = read(s, d, "documents").select(F.col("doc_id").alias("record_id"), tokens.tokens(F.col("text"), readers.stop_words(f"{local}/stop.json")).alias("tokens"))
    return docs.select("record_id", F.size("tokens").alias("n"), *[F.size(rules.hits(F.col("tokens"), words[c])).alias(f"hits{i}") for i, c in enumerate(VOCABULARY)])


def _matrix(s, d):
    at = f"{folder(s)}/weights"
    writers.table(_weights(s, d)[0], at)
    return readers.weights(s, at).select("record_id", "token", "tf", "df", F.round("tfidf", 6).alias("tfidf"))


def _features(s, d):
    at = f"{folder(s)}/features"
    writers.json_lines(tfidf.vocabulary(_weights(s, d)[0]), at)
    return readers.json_lines(s, at, "token string, idx int")


def _lines(spark, path):
    return spark.read.text(path).filter("value <> ''")


def _report(s, d):
    at = f"{folder(s)}/report.md"
    writers.report({"labels": rules.distribution(_record_labels(s, d)), "lengths": export.length_stats(F.col("text"), read(s, d, "documents")).select("n", "min", "max")}, at)
    return _lines(s, at).select(F.col("value").alias("line"))


def _long_report(s, d):
    """A report of a row for each document: no row is cut."""
    at = f"{folder(s)}/report.md"
    writers.report({"documents": read(s, d, "documents").select("doc_id", "lang")}, at)
    return _lines(s, at).filter("value like '| %' and value not like '%doc_id%'").select(F.trim(F.split("value", r"\|")[1]).cast("long").alias("doc_id"))


def _outputs(s, d):
    """All files of a labelling; the submission is read back beside the labels."""
    at, labels = folder(s), _labels(s, d)
    words = rules.top_hit_words(labels).select("cluster_id", "category", "rank", "token", "count") if "cluster_id" in rules.top_hit_words(labels).columns else rules.top_hit_words(labels)
    writers.scheme_outputs(labels, words, export.first_samples(labels), at, "v1")
    submitted = readers.labels_csv(s, f"{at}/submit_v1.csv").select(F.col("record_id").cast("long").alias("record_id"), F.col("cluster_id").alias("submitted"))
    return readers.labels(s, at, "v1").select(F.col("record_id").cast("long").alias("record_id"), F.col("cluster_id").cast("int").alias("cluster_id"), "category").join(submitted, "record_id")


def _ordered(s, d):
    """The export's order as lines of one file: line, record_id."""
    at = f"{folder(s)}/export.csv"
    labelled = export.attach_labels(_documents(s, d), _record_labels(s, d))
    writers.csv_file(export.order_for_export(labelled, [fixed.ADS, fixed.ADULT]).select("record_id"), at)
    lines = s.read.csv(at, header=True).coalesce(1).select(F.monotonically_increasing_id().alias("line"), "*")
    return lines.toDF("line", "record_id").select("line", F.col("record_id").cast("long").alias("record_id"))


def _metrics(s, d):
    at = f"{folder(s)}/metrics.json"
    row = rules.distribution(_record_labels(s, d)).orderBy("category").collect()
    writers.metrics(s, {r["category"]: r["count"] for r in row}, at, {"total": sum(r["count"] for r in row)})
    got = s.read.text(at, wholetext=True).select(F.from_json("value", "map<string,long>").alias("m"))
    return got.select(F.explode("m").alias("name", "value"))


def _sheet(s, d):
    rows = read(s, d, "documents").select("doc_id", text.sheet_cell(F.concat("lang", F.lit("\u0001\u0007"), F.substring("source", 1, 3))).alias("cell"), F.array("lang", "source").alias("list"))
    at = f"{folder(s)}/cells"
    writers.csv_parts(writers.cells(rows), at)
    return s.read.option("escape", chr(92)).csv(at, header=True).select(F.col("doc_id").cast("long").alias("doc_id"), "cell", "list")


def _projected(s, d):
    """Documents with a joined text beside all fields, and alone."""
    docs = read(s, d, "documents")
    joined = text.join_fields(F.col("lang"), F.col("source"), sep="/")
    kept = docs.withColumn("joined", joined).drop("text")
    return kept.join(docs.select("doc_id", joined.alias("alone")), "doc_id")


def _stream(s, d):
    """Documents as a stream of messages, labelled by the functions of the batch: the rows come from
    a folder of files, batch by batch, and go to another."""
    at = folder(s)
    docs = read(s, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.lit("").alias("from"), F.col("text").alias("content"), F.lit("2020-01-01T00:00:00Z").alias("timestamp"))
    writers.json_lines(docs, f"{at}/in")
    query = messages.start(messages.labelled(messages.read(s, f"{at}/in", 3), VOCABULARY, rules.SCHEME1), f"{at}/out", f"{at}/checkpoint")
    query.processAllAvailable()
    query.stop()
    return s.read.schema("record_id string, category string, cluster_id int").json(f"{at}/out").select(F.col("record_id").cast("long").alias("record_id"), "category", "cluster_id")


QUERIES = {
    "file_json_lines": _json_lines, "file_strict_lines": _strict_lines, "file_labels_csv": _csv, "file_labels_text": _csv_text, "file_raw_log": _raw, "file_raw_counts": _raw_counts, "file_last_wins": _last_wins,
    "file_configuration": _configured, "file_matrix": _matrix, "file_features": _features, "file_report": _report, "file_report_rows": _long_report, "file_outputs": _outputs, "file_metrics": _metrics, "file_ordered": _ordered, "file_sheet": _sheet,
    "projected_fields": _projected, "stream_labels": _stream,
}

_stops = names(["les", "que"])
_label_lines = f"SELECT '| ' || category || ' | ' || count || ' | ' || pct || ' |' FROM (SELECT category, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM rec GROUP BY category)"
ORACLES = {
    "file_json_lines": "SELECT doc_id, sha256(text) AS sha, lang, source, n_chars FROM documents",
    "file_strict_lines": "SELECT event_id, event_type, value, props FROM events",
    "file_labels_csv": f"WITH {REC} SELECT record_id, cluster_id, category FROM rec",
    "file_labels_text": f"WITH {REC} SELECT record_id, 'c' || cluster_id AS cluster_id FROM rec",
    "file_raw_log": "SELECT doc_id AS record_id, '2020-01-01T00:00:00+00:00' AS timestamp, '& ' || lang AS subject, source AS content, 'x ' || lang AS own, doc_id::VARCHAR AS number FROM documents WHERE doc_id % 10 NOT IN (3, 7)",
    "file_raw_counts": "SELECT count(*) FILTER (doc_id % 10 <> 7) AS lines, count(*) FILTER (doc_id % 10 = 3) AS bad, count(*) FILTER (doc_id % 10 NOT IN (3, 7) AND lang IS NOT NULL) AS good FROM documents",
    "file_last_wins": "SELECT coalesce(user_id::VARCHAR, '') AS user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY coalesce(user_id::VARCHAR, '') ORDER BY event_id DESC) = 1",
    "file_configuration": f"WITH {TOK}, t AS (SELECT record_id, list_filter(tokens, lambda t: NOT list_contains({_stops}, t)) AS tokens FROM tok) SELECT record_id, len(tokens)::INTEGER AS n, " + ", ".join(f"len({hit_sql(c)})::INTEGER AS hits{i}" for i, c in enumerate(VOCABULARY)) + " FROM t",
    "file_matrix": f"{tfidf_sql()} SELECT record_id, token, tf, df, round(tfidf, 6) AS tfidf FROM v",
    "file_features": f"{tfidf_sql()} SELECT token, (row_number() OVER (ORDER BY token) - 1)::INTEGER AS idx FROM (SELECT DISTINCT token FROM v)",
    "file_report": f"WITH {REC} SELECT unnest(['# labels', '| category | count | pct |', '|---|---|---|', '# lengths', '| n | min | max |', '|---|---|---|']) AS line UNION ALL {_label_lines} UNION ALL SELECT '| ' || count(*) || ' | ' || min(length(text)) || ' | ' || max(length(text)) || ' |' FROM documents",
    "file_report_rows": "SELECT doc_id FROM documents",
    "file_outputs": f"{LABELS} SELECT record_id, cluster_id, category, cluster_id AS submitted FROM lab",
    "file_ordered": f"WITH {REC} SELECT row_number() OVER (ORDER BY CASE category WHEN {q(fixed.ADS)} THEN 0 WHEN {q(fixed.ADULT)} THEN 1 ELSE 2 END, doc_id::VARCHAR) - 1 AS line, doc_id AS record_id FROM documents LEFT JOIN rec ON doc_id = record_id",
    "file_metrics": f"WITH {REC} SELECT category AS name, count(*) AS value FROM rec GROUP BY category UNION ALL SELECT 'total', count(*) FROM rec",
    "file_sheet": """SELECT doc_id, lang || substring(source, 1, 3) AS cell, '["' || lang || '","' || source || '"]' AS list FROM documents""",
    "projected_fields": "SELECT doc_id, lang, source, n_chars, lang || '/' || source AS joined, lang || '/' || source AS alone FROM documents",
}
