"""Queries of fields, masking, exports, TF-IDF, clustering and vocabulary iteration."""

from __future__ import annotations

from functools import partial

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenmill.functions import fixed, text, udfs
from lumenmill.functions.fixed import EMPTY, UNCLASSIFIED
from lumenmill.operators import cluster, export, rules, structural, tfidf, tokens, vocab
from lumenmill.operators.rules import SCHEME1
from lumenmill.plans.classify import _labels
from lumenmill.plans.tables import LABELS, TOK, VOCABULARY, names, q, read, token_table

# Inline messages for rules that no test table triggers; the same text is valid in both engines.
INLINE = """(VALUES
 (1, 'Re: Fwd：报价', '加 微 信 13812345678 谈', '0.02;x;0.92;'), (2, 'FW: 回复: hello', 'QQ:1275411573 或 a.b@mail.example.com', ';;'), (3, 'plain', '每人 3980 元/天 起', '1.5'), (4, '转发：转发： x', 'see http://a.example/x and 010-12345678', NULL),
 (5, '', '我 们 好 a 好', '0.5;0.25'), (6, 'Few words', '(021) 021 87654321 www.shop.example/p', 'bad'), (7, 'fyi : 票', '加[WECHAT]号[URL]ab12', '0.1;-3')) AS m(id, subject, content, rep)"""
PAIRS = "(VALUES ('a.example.com', 'mail.example.com'), ('example.com', 'example.com'), ('com', 'com'), ('com', 'example.com'), ('a.b', 'c.b'), ('', 'x.y'), ('x.co.uk', 'y.co.uk')) AS p(a, b)"
LINKS = "(VALUES (1, 'http://bank.example/LOGIN?x'), (2, 'https://a.example/news'), (3, 'x index.php?email=1'), (4, 'AUTHor'), (5, ''), (6, NULL)) AS u(id, url)"
WORDS = "(VALUES (1, 1, 'ADS', 'en', 'license'), (1, 2, 'ADS', 'en', 'offer'), (2, 1, 'ADS', 'en', 'license'), (2, 2, 'PHISH', 'en', 'que'), (2, 3, 'ADS', 'zh', ' '), (3, 1, 'ADS', 'en', 'sale'), (3, 2, 'PHISH', 'en', 'que')) AS w(batch, pos, category, lang, word)"
#: Reviews of all documents, valid in both engines: some keep a row unclassified, some don't know whether it is short.
REVIEWS = f"(SELECT doc_id AS record_id, CASE WHEN source = 'src1' THEN 'ADS' WHEN source = 'src2' THEN '{UNCLASSIFIED}' ELSE '{fixed.KEEP_UNCLASSIFIED}' END AS suggested_category, concat(lang, ' ', source) AS words, CASE WHEN lang = 'de' THEN 'because' END AS reason, CASE WHEN lang <> 'es' THEN length(text) < 400 END AS short_content FROM documents) AS r"
#: An audit of dropped letters over all documents.
AUDIT = "(SELECT doc_id AS record_id, lang AS left, source AS letters, substring(text, 1, 3) AS right FROM documents) AS a"
PROPOSAL = [(fixed.ADS, "en", "license"), (fixed.ADS, "en", "reserved"), (fixed.PHISH, "en", "que"), (fixed.PHISH, "en", "nosuchword"), (fixed.ACADEMIC1, "en", "les des"), (fixed.GAMBLING, "en", "atat")]
ORDER = [*SCHEME1.ids, UNCLASSIFIED, EMPTY]
#: The reference's scan of K.
KS = [8, 10, 12, 15, 18, 20, 25, 30]
CLUSTER_PARAMS = {"min_df": 5, "max_df": 0.25, "sublinear": True}


def inline(spark, values):
    return spark.sql(f"SELECT * FROM {values}")


def _record_labels(spark, sf):
    """The labels table as categories of documents."""
    category = F.when(F.col("toxic") == 1, fixed.ADULT).when(F.col("quality") == 0, fixed.ADS).otherwise(fixed.ACADEMIC1)
    return read(spark, sf, "labels").select(F.col("doc_id").alias("record_id"), category.alias("category"), rules.category_id(category, SCHEME1).alias("cluster_id"))


REC = f"""rec AS (SELECT doc_id AS record_id, CASE WHEN toxic = 1 THEN {q(fixed.ADULT)} WHEN quality = 0 THEN {q(fixed.ADS)} ELSE {q(fixed.ACADEMIC1)} END AS category, (CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 4 END)::INTEGER AS cluster_id FROM labels)"""


def _documents(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), "lang", "source", "text")


def _weights(spark, sf, **kw):
    df = token_table(spark, sf).select("record_id", "tokens")
    if kw:
        df = df.withColumn("tokens", tokens.without(F.col("tokens"), [*fixed.STOPWORDS, *fixed.CLUSTER_STOPWORDS]))
    return tfidf.tfidf(df, **kw), df


def tfidf_sql(min_df: int = 5, max_df: float = 0.95, features: int = 50_000, sublinear: bool = False, drop: list[str] | None = None) -> str:
    tok = f"list_filter(tokens, lambda t: NOT list_contains({names(drop)}, t))" if drop else "tokens"
    tf = "1 + ln(tf)" if sublinear else "tf"
    return f"""WITH {TOK}, e AS (SELECT record_id, unnest({tok}) AS token FROM tok), tc AS (SELECT record_id, token, count(*) AS tf FROM e GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
 d AS (SELECT token, count(*) AS df, sum(tf) AS ctf FROM tc GROUP BY token), k AS (SELECT token, df, n FROM d, n WHERE df >= {min_df} AND df <= {max_df} * n ORDER BY ctf DESC, token LIMIT {features}),
 w AS (SELECT record_id, token, tf, df, ({tf}) * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tc JOIN k USING (token)), r AS (SELECT record_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY record_id), v AS (SELECT record_id, token, tf, df, w / norm AS tfidf FROM w JOIN r USING (record_id))"""


def _rounded(weights):
    return weights.select("record_id", "token", "tf", "df", F.round("tfidf", 6).alias("tfidf"))


def _bucketed(spark, sf):
    """A clustering without chance: embeddings by the position of their largest component."""
    e = read(spark, sf, "embeddings").filter("embedding is not null")
    return e.select((F.array_position("embedding", F.array_max("embedding")) % 5).cast("int").alias("cluster_id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"))


TABLE = "t AS (SELECT (list_position(embedding, list_max(embedding)) % 5)::INTEGER AS cluster_id, 'c' || label AS category, count(*) AS count FROM embeddings WHERE embedding IS NOT NULL GROUP BY ALL)"


def _vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("record_id"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))


def _kmeans(spark, sf):
    clustered, _ = cluster.kmeans(_vectors(spark, sf), 6)
    return cluster.with_empty(clustered, _vectors(spark, sf))


def _kmeans_samples(spark, sf):
    return cluster.nearest_samples(*cluster.kmeans(_vectors(spark, sf), 6), 10)


def _kmeans_metrics(spark, sf):
    scan = cluster.scan_k(_vectors(spark, sf), KS)
    return scan.withColumn("picked", F.col("k") == cluster.pick_k(scan))


def _svd_kmeans(spark, sf):
    weights, _ = _weights(spark, sf, **CLUSTER_PARAMS, max_features=50_000)
    weights = weights.select("record_id", "token", "tfidf").persist()
    rows = cluster.sparse_rows(weights, tfidf.vocabulary(weights))
    clustered, _ = cluster.kmeans(cluster.reduce_dimensions(rows, 100), 5)
    return cluster.suggest_names(cluster.cluster_keywords(weights, clustered.select("record_id", "cluster_id")))


def _cluster_keywords(spark, sf):
    weights, df = _weights(spark, sf)
    return cluster.cluster_keywords(weights, read(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), F.col("lang").alias("cluster_id")), 20)


def _validate(spark, sf):
    proposal = spark.createDataFrame(PROPOSAL, "category string, lang string, word string")
    labels = _record_labels(spark, sf)
    df = token_table(spark, sf).select("record_id", "tokens").join(labels.select("record_id", F.col("category").alias("label")), "record_id", "left").withColumn("label", F.coalesce("label", F.lit(UNCLASSIFIED)))
    return vocab.validate(proposal, df, rules.vocabulary_frame(spark, VOCABULARY))


def _normalised(spark, sf):
    d = _documents(spark, sf)
    return d.withColumn("n", udfs.normalise(F.col("text"))).select("record_id", F.col("n.text").alias("text"), F.to_json("n.counters").alias("counters"), F.size("n.audit").alias("audited"))


def _over(spark, sf, values):
    read(spark, sf, "documents").createOrReplaceTempView("documents")
    return inline(spark, values)


def _reviews(spark, sf):
    out = vocab.enforce_policy(_over(spark, sf, REVIEWS).withColumn("suggested_keywords", F.split("words", " ")))
    return out.select("record_id", "suggested_category", "downgraded", "reason", F.array_join("suggested_keywords", " ").alias("words"))


def _audit(spark, sf):
    out = vocab.audit_summary(_over(spark, sf, AUDIT))
    return out.select("letters", "count", F.array_join("neighbours", ",").alias("neighbours"), F.array_join("samples", "|").alias("samples"))


def _selected(spark, sf):
    """Every row of the review classes, and what a draw takes of them and of a boundary class."""
    rows = _labels_for(spark, sf)
    drawn = vocab.select_samples(rows, [fixed.ADS, UNCLASSIFIED], 7, [fixed.PHISH, UNCLASSIFIED], 3)
    whole = vocab.select_samples(rows, [UNCLASSIFIED], 0, full=True)
    return drawn.unionByName(whole.withColumn("reviewed", F.concat("reviewed", F.lit(" all")))).groupBy("reviewed").agg(F.count(F.lit(1)).alias("count"))


def _lang_labels(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), F.col("lang").alias("cluster_id"))


def _described(spark, sf):
    """The first documents of each language as samples, with text and top keywords."""
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("record_id"))
    samples = _lang_labels(spark, sf).withColumn("rank", rank).filter("rank <= 10").withColumn("distance", F.lit(0.0))
    weights = _weights(spark, sf)[0].withColumn("tfidf", F.round("tfidf", 6))
    return cluster.describe_samples(samples, _documents(spark, sf), tfidf.keyword_arrays(tfidf.top_terms(weights, 20)))


def _pages_clean(spark, sf):
    """Entities, width and white space of every page's text, and the time of every event as text."""
    p = read(spark, sf, "pages")
    return p.select("page_id", udfs.clean_value(F.col("html")).alias("clean"))


def _event_times(spark, sf):
    e = read(spark, sf, "events")
    return e.select("event_id", udfs.parse_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("iso"), udfs.parse_timestamp(F.col("event_type")).alias("none"))


def _host_pairs(spark, sf):
    hosts = read(spark, sf, "pages").select("page_id", structural.url_hosts(F.col("url")).alias("hosts"))
    return hosts.select("page_id", F.array_join("hosts", ",").alias("hosts"), F.coalesce(structural.same_registrable(F.col("hosts")[0], F.lit("www.example.com")), F.lit(False)).alias("same"))


def _json_stats(spark, sf):
    return export.json_field_stats(read(spark, sf, "events"), "props")


def _labels_for(spark, sf):
    return _labels(spark, sf).select("record_id", "category", "cluster_id")


def _batches(spark, sf):
    """The review sample, every row that the rules leave unclassified, in batches of 7."""
    picked = vocab.select_samples(_labels_for(spark, sf), [UNCLASSIFIED], 0, full=True).select("record_id")
    return vocab.assign_batches(picked, 7)


def _names_sql() -> str:
    cases = " ".join(f"WHEN list_has_any(words, {names(w)}) THEN {q(n)}" for n, w in fixed.CLUSTER_NAMES.items())
    return f"""{tfidf_sql()}, z AS (SELECT lang AS cluster_id, count(*) AS size FROM documents GROUP BY lang), m AS (SELECT lang AS cluster_id, CASE token WHEN 'que' THEN 'login' WHEN 'und' THEN 'journal' ELSE token END AS token, sum(tfidf) AS s FROM v JOIN documents ON doc_id = record_id GROUP BY ALL),
 x AS (SELECT cluster_id, token, s / size AS mean FROM m JOIN z USING (cluster_id)), kk AS (SELECT cluster_id, token FROM x QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY mean DESC, token) <= 12), ww AS (SELECT cluster_id, list(token) AS words FROM kk GROUP BY cluster_id) SELECT cluster_id, CASE {cases} ELSE {q(fixed.CLUSTER_UNNAMED)} END AS cluster_name FROM ww"""


_m = partial(inline, values=INLINE)
QUERIES = {
    "field_presence": lambda s, d: export.field_presence(read(s, d, "documents")),
    "json_field_stats": _json_stats,
    "concat_fields": lambda s, d: read(s, d, "documents").select("doc_id", text.join_fields(F.col("lang"), F.lit("  "), F.col("source"), F.lit(None).cast("string"), F.col("text"), sep=" | ").alias("joined")),
    "payload_rows": lambda s, d: _m(s).select("id", text.has_payload(F.col("subject"), F.col("rep")).alias("payload")),
    "preview": lambda s, d: read(s, d, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"), text.truncate(F.col("text"), 80).alias("short")),
    "sheet_cells": lambda s, d: read(s, d, "documents").select("doc_id", F.length(text.sheet_cell(F.col("text"))).alias("cell")),
    "text_length_stats": lambda s, d: export.length_stats(F.col("text"), read(s, d, "documents")),
    "mask_email": lambda s, d: read(s, d, "documents").select("doc_id", F.sha2(text.mask_email(F.col("text")), 256).alias("masked_sha")),
    "placeholder_counts": lambda s, d: read(s, d, "documents").agg(F.sum(text.placeholder_count(text.mask_email(F.col("text")), "EMAIL")).alias("emails"), F.count_if(text.mask_email(F.col("text")) != F.col("text")).alias("rows")),
    "keep_charset": lambda s, d: read(s, d, "documents").select("doc_id", F.sha2(text.keep_charset(F.col("text")), 256).alias("kept_sha")),
    "mask_contacts": lambda s, d: _m(s).select("id", text.mask_contacts(F.col("content")).alias("masked")),
    "subject_prefix": lambda s, d: _m(s).select("id", text.strip_subject_prefix(F.col("subject")).alias("bare")),
    "zh_space_merge": lambda s, d: _m(s).select("id", text.merge_zh(F.col("content")).alias("merged")),
    "reputation_max": lambda s, d: _m(s).select("id", structural.reputation_max(F.col("rep")).alias("reputation")),
    "suspicious_url": lambda s, d: inline(s, LINKS).select("id", structural.url_suspicious(F.col("url")).alias("suspicious")),
    "registrable_pairs": lambda s, d: inline(s, PAIRS).select("a", "b", structural.same_registrable(F.col("a"), F.col("b")).alias("same")),
    "url_hosts": _host_pairs,
    "lang_detect": lambda s, d: read(s, d, "documents").groupBy(structural.language(F.col("text")).alias("detected"), "lang").agg(F.count(F.lit(1)).alias("count")),
    "label_distribution": lambda s, d: rules.distribution(_record_labels(s, d)),
    "export_join": lambda s, d: export.attach_labels(_documents(s, d), _record_labels(s, d)),
    "residual_export": lambda s, d: export.subset(_documents(s, d), _record_labels(s, d), [fixed.ADULT, fixed.ADS]),
    "missing_labels_anti": lambda s, d: export.missing_labels(_documents(s, d), _record_labels(s, d)),
    "summary_with_total": lambda s, d: export.summary(_labels_for(s, d), ORDER),
    "first_samples": lambda s, d: export.first_samples(export.attach_labels(_documents(s, d), _labels_for(s, d))),
    "doc_freq": lambda s, d: tfidf.document_frequencies(tfidf.term_counts(token_table(s, d))),
    "tfidf_weights": lambda s, d: _rounded(_weights(s, d)[0]),
    "tfidf_cluster_weights": lambda s, d: _rounded(_weights(s, d, **CLUSTER_PARAMS)[0]),
    "tfidf_top_terms": lambda s, d: tfidf.top_terms(_weights(s, d)[0].withColumn("tfidf", F.round("tfidf", 6)), 10),
    "global_top_terms": lambda s, d: (lambda w: tfidf.global_terms(w[0], w[1], 30).select("token", F.round("score", 6).alias("score")))(_weights(s, d)),
    "matrix_shape": lambda s, d: tfidf.shape(*_weights(s, d)),
    "cluster_keywords": lambda s, d: _cluster_keywords(s, d).select("cluster_id", "token", F.round("score", 6).alias("score")),
    "contingency": lambda s, d: cluster.contingency(_bucketed(s, d)),
    "contingency_top": lambda s, d: cluster.top_categories(cluster.contingency(_bucketed(s, d))),
    "purity_spread": lambda s, d: cluster.purity(cluster.contingency(_bucketed(s, d))),
    "ari_nmi": lambda s, d: cluster.agreement(cluster.contingency(_bucketed(s, d))),
    "cluster_share": lambda s, d: cluster.size_share(_bucketed(s, d)),
    "kmeans_labels": _kmeans,
    "kmeans_nearest_samples": _kmeans_samples,
    "kmeans_scan": _kmeans_metrics,
    "svd_cluster_names": _svd_kmeans,
    "sample_per_category": lambda s, d: vocab.sample_per_category(_record_labels(s, d), 5),
    "review_rows": lambda s, d: vocab.review_rows(export.attach_labels(token_table(s, d).select("record_id", "tokens", "text"), _record_labels(s, d))).select("record_id", "current_category", "token_count", "short_content", F.size("tokens").alias("shown")),
    "batch_assign": _batches,
    "policy": _reviews,
    "select_samples": _selected,
    "described_samples": _described,
    "cluster_names": lambda s, d: cluster.suggest_names(cluster.cluster_keywords(_weights(s, d)[0].withColumn("token", F.when(F.col("token") == "que", "login").when(F.col("token") == "und", "journal").otherwise(F.col("token"))), _lang_labels(s, d))),
    "placeholder_ranks": lambda s, d: (lambda w: tfidf.placeholder_ranks(tfidf.global_terms(w[0], w[1])).select("token", "rank", F.round("score", 6).alias("score")))(_weights(s, d)),
    "keyword_lists": lambda s, d: tfidf.first_keywords(tfidf.keyword_arrays(tfidf.top_terms(_weights(s, d)[0].withColumn("tfidf", F.round("tfidf", 6)), 20))),
    "completed_batches": lambda s, d: vocab.completed_batches(read(s, d, "events").select((F.col("event_id") % 97).alias("batch"), F.col("event_type").alias("response"), F.col("event_id").alias("line"))),
    "reject_merge": lambda s, d: vocab.merge_rejects(read(s, d, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("pos"), F.col("props").alias("item"))),
    "event_times": _event_times,
    "mask_contacts_documents": lambda s, d: read(s, d, "documents").select("doc_id", F.sha2(text.mask_contacts(F.col("text")), 256).alias("masked_sha")),
    "subject_prefix_documents": lambda s, d: read(s, d, "documents").select("doc_id", F.sha2(text.strip_subject_prefix(F.concat(F.lit("Re: "), F.col("text"))), 256).alias("bare_sha")),
    "proposal_merge": lambda s, d: vocab.merge_proposals(inline(s, WORDS)),
    "proposal_validate": _validate,
    "normalise_full": _normalised,
    "audit_summary": _audit,
    "clean_pages": _pages_clean,
}

_prop = "(VALUES " + ", ".join(f"({q(c)}, {q(g)}, {q(w)})" for c, g, w in PROPOSAL) + ") AS p(category, lang, word)"
_known = "(VALUES " + ", ".join(f"({q(c)}, {q(w)})" for c, ws in VOCABULARY.items() for w in dict.fromkeys(ws)) + ") AS k(category, word)"
_rank = "CASE category " + " ".join(f"WHEN {q(c)} THEN {i}" for i, c in enumerate(ORDER)) + f" ELSE {len(ORDER)} END"
_present = " UNION ALL ".join(f"SELECT '{c}' AS field, {c} IS NULL OR trim({c}::VARCHAR, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' AS gone FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars"))
_ws = r"'[\s\x0B\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'"
_percentile = lambda p: f"(SELECT len FROM o, s WHERE r = round_even({p} * (n - 1), 0) + 1)"
_digits = r"(^|[^0-9])(1[3-9][0-9][\s-]?[0-9]{4}[\s-]?[0-9]{4}|0[0-9]{2,3}[\s-]?[0-9]{7,8})($|[^0-9])"
ORACLES = {
    "field_presence": f"WITH f AS ({_present}) SELECT field, count(*) FILTER (NOT gone) AS present, count(*) FILTER (gone) AS missing, round(avg(gone::INT), 6) AS missing_rate FROM f GROUP BY field",
    "json_field_stats": "WITH e AS (SELECT unnest(json_keys(props)) AS field, props FROM events), v AS (SELECT field, json_type(props, '$.' || field) AS t, json_extract_string(props, '$.' || field) AS value FROM e) SELECT field, CASE t WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'bool' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' ELSE 'float' END AS kind, count(*) AS present, count(*) FILTER (t <> 'NULL' AND trim(value) <> '') AS filled, round(count(*) / (SELECT count(*) FROM events WHERE json_type(props) = 'OBJECT'), 6) AS present_rate FROM v GROUP BY ALL",
    "concat_fields": f"SELECT doc_id, concat_ws(' | ', nullif(trim(lang), ''), nullif(trim(source), ''), nullif(regexp_replace(text, {_ws[:-2] + '+$' + chr(39)}, ''), '')) AS joined FROM documents",
    "payload_rows": f"SELECT id, coalesce(trim(subject) <> '', false) OR coalesce(trim(rep) <> '', false) AS payload FROM {INLINE}",
    "preview": f"WITH f AS (SELECT doc_id, text, trim(regexp_replace(text, {_ws}, ' ', 'g')) AS flat FROM documents) SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS preview, CASE WHEN length(flat) > 80 THEN flat[1:77] || '...' ELSE flat END AS short FROM f",
    "sheet_cells": r"WITH f AS (SELECT doc_id, length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS n FROM documents) SELECT doc_id, (CASE WHEN n > 32767 THEN 32767 ELSE n END)::INTEGER AS cell FROM f",
    "text_length_stats": f"WITH l AS (SELECT length(text) AS len FROM documents WHERE text IS NOT NULL), o AS (SELECT len, row_number() OVER (ORDER BY len) AS r FROM l), s AS (SELECT count(*) AS n, min(len)::INTEGER AS min, max(len)::INTEGER AS max, round(avg(len), 4) AS avg FROM l) SELECT n, min, max, avg, {_percentile(0.5)}::INTEGER AS p50, {_percentile(0.9)}::INTEGER AS p90, {_percentile(0.99)}::INTEGER AS p99 FROM s",
    "mask_email": f"SELECT doc_id, sha256(regexp_replace(text, {q(fixed.EMAIL)}, '[EMAIL]', 'g')) AS masked_sha FROM documents",
    "placeholder_counts": f"SELECT sum(len(regexp_extract_all(text, {q(fixed.EMAIL)})))::BIGINT AS emails, count(*) FILTER (regexp_matches(text, {q(fixed.EMAIL)})) AS rows FROM documents",
    "keep_charset": f"SELECT doc_id, sha256(array_to_string(regexp_extract_all(text, {q(fixed.KEEP)}), ' ')) AS kept_sha FROM documents",
    "zh_space_merge": f"SELECT id, regexp_replace(regexp_replace(content, '([一-鿿])\\s+([一-鿿])', '\\1\\2', 'g'), '([一-鿿])\\s+([一-鿿])', '\\1\\2', 'g') AS merged FROM {INLINE}",
    "subject_prefix": f"SELECT id, trim(regexp_replace(subject, '(?i)^(?:(?:Re|Fwd?|FYI|答复|回复|转发)\\s*[:：]\\s*)+', '')) AS bare FROM {INLINE}",
    "mask_contacts": f"SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?i)https?://[^\\s一-鿿]+|www[.][A-Za-z0-9.-]+(?:/[^\\s一-鿿]*)?', '[URL]', 'g'), {q(fixed.EMAIL)}, '[EMAIL]', 'g'), {q(fixed.QQ)}, '[QQ]', 'g'), {q(fixed.WECHAT)}, '[WECHAT]', 'g'), '{_digits}', '\\1[PHONE]\\3', 'g'), {q(fixed.MONEY)}, '[MONEY]', 'g') AS masked FROM {INLINE}",
    "reputation_max": f"SELECT id, greatest(0.0, coalesce(list_max(list_transform(string_split(rep, ';'), lambda p: try_cast(trim(p) AS DOUBLE))), 0.0))::DOUBLE AS reputation FROM {INLINE}",
    "suspicious_url": f"SELECT id, len(list_filter({names(fixed.SUSPICIOUS_URL_PARTS)}, lambda p: contains(lower(coalesce(url, '')), p))) > 0 AS suspicious FROM {LINKS}",
    "registrable_pairs": f"SELECT a, b, a <> '' AND b <> '' AND (a = b OR (contains(a, '.') AND contains(b, '.') AND string_split(a, '.')[-2:] = string_split(b, '.')[-2:])) AS same FROM {PAIRS}",
    "url_hosts": r"WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '(?i)https?://([^/\s:]+)', 1)), '^[w.]+', '') AS hosts FROM pages) SELECT page_id, hosts, hosts = 'www.example.com' OR (contains(hosts, '.') AND string_split(hosts, '.')[-2:] = ['example', 'com']) AS same FROM h",
    "lang_detect": "WITH c AS (SELECT lang, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS z FROM documents) SELECT CASE WHEN a + z = 0 THEN 'unknown' WHEN z >= 0.5 * (a + z) THEN 'zh' WHEN z <= 0.15 * (a + z) THEN 'en' ELSE 'mixed' END AS detected, lang, count(*) AS count FROM c GROUP BY ALL",
    "label_distribution": f"WITH {REC} SELECT category, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM rec GROUP BY category",
    "export_join": f"WITH {REC} SELECT doc_id AS record_id, coalesce(category, {q(UNCLASSIFIED)}) AS category, cluster_id, lang, source, text FROM documents LEFT JOIN rec ON doc_id = record_id",
    "residual_export": f"WITH {REC} SELECT record_id, lang, source, text, category, cluster_id FROM documents JOIN rec ON doc_id = record_id WHERE category IN ({q(fixed.ADULT)}, {q(fixed.ADS)})",
    "missing_labels_anti": f"WITH {REC} SELECT doc_id AS record_id FROM documents WHERE doc_id NOT IN (SELECT record_id FROM rec)",
    "summary_with_total": f"{LABELS}, c AS (SELECT category, count(*) AS count, min(cluster_id) AS cluster_id FROM lab GROUP BY category) SELECT row_number() OVER (ORDER BY {_rank}, category)::INTEGER AS rank, cluster_id, category, count, round(100.0 * count / (SELECT sum(count) FROM c), 2) AS pct FROM c UNION ALL SELECT NULL, NULL, 'total', sum(count)::BIGINT, 100.0 FROM c",
    "first_samples": f"{LABELS} SELECT category, row_number() OVER (PARTITION BY category ORDER BY record_id)::INTEGER AS rank, record_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS preview FROM lab QUALIFY rank <= 10",
    "doc_freq": f"WITH {TOK}, e AS (SELECT record_id, unnest(tokens) AS token FROM tok), tc AS (SELECT record_id, token, count(*) AS tf FROM e GROUP BY ALL) SELECT token, count(*) AS df, sum(tf)::BIGINT AS ctf FROM tc GROUP BY token",
    "tfidf_weights": f"{tfidf_sql()} SELECT record_id, token, tf, df, round(tfidf, 6) AS tfidf FROM v",
    "tfidf_cluster_weights": f"{tfidf_sql(5, 0.25, 50_000, True, [*fixed.STOPWORDS, *fixed.CLUSTER_STOPWORDS])} SELECT record_id, token, tf, df, round(tfidf, 6) AS tfidf FROM v",
    "tfidf_top_terms": f"{tfidf_sql()}, r6 AS (SELECT record_id, token, round(tfidf, 6) AS score FROM v) SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, token)::INTEGER AS rank, token, score FROM r6 QUALIFY rank <= 10",
    "global_top_terms": f"{tfidf_sql()}, m AS (SELECT token, sum(tfidf) / (SELECT n FROM n) AS mean FROM v GROUP BY token ORDER BY mean DESC, token LIMIT 30) SELECT token, round(round(mean, 8), 6) AS score FROM m",
    "placeholder_ranks": f"{tfidf_sql()}, m AS (SELECT token, sum(tfidf) / (SELECT n FROM n) AS mean FROM v GROUP BY token), g AS (SELECT token, row_number() OVER (ORDER BY mean DESC, token)::INTEGER AS rank, round(round(mean, 8), 6) AS score FROM m) SELECT p.token, rank, coalesce(score, 0.0) AS score FROM (SELECT unnest({names(fixed.PLACEHOLDERS)}) AS token) p LEFT JOIN g USING (token)",
    "keyword_lists": f"{tfidf_sql()}, r6 AS (SELECT record_id, token, round(tfidf, 6) AS score FROM v), k5 AS (SELECT record_id, token, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, token) AS rank FROM r6 QUALIFY rank <= 5) SELECT record_id, string_agg(token, ' / ' ORDER BY rank) AS top_keywords FROM k5 GROUP BY record_id",
    "described_samples": f"{tfidf_sql()}, r6 AS (SELECT record_id, token, round(tfidf, 6) AS score FROM v), k5 AS (SELECT record_id, token, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, token) AS rank FROM r6 QUALIFY rank <= 5), t AS (SELECT record_id, string_agg(token, ' / ' ORDER BY rank) AS top_keywords FROM k5 GROUP BY record_id), s AS (SELECT doc_id AS record_id, lang AS cluster_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INTEGER AS rank FROM documents QUALIFY rank <= 10) SELECT cluster_id, rank, record_id, 0.0::DOUBLE AS distance, coalesce(text, '') AS text, coalesce(top_keywords, '') AS top_keywords FROM s LEFT JOIN t USING (record_id)",
    "cluster_names": _names_sql(),
    "matrix_shape": f"{tfidf_sql()} SELECT (SELECT n FROM n) AS n_docs, count(*) AS nnz, count(DISTINCT token) AS n_features, round(count(*) / greatest((SELECT n FROM n) * count(DISTINCT token), 1), 8) AS density FROM v",
    "cluster_keywords": f"{tfidf_sql()}, z AS (SELECT lang AS cluster_id, count(*) AS size FROM documents GROUP BY lang), m AS (SELECT lang AS cluster_id, token, sum(tfidf) AS s FROM v JOIN documents ON doc_id = record_id GROUP BY ALL), x AS (SELECT cluster_id, token, s / size AS mean FROM m JOIN z USING (cluster_id)) SELECT cluster_id, token, round(round(mean, 8), 6) AS score FROM x QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY mean DESC, token) <= 20",
    "contingency": f"WITH {TABLE} SELECT * FROM t",
    "contingency_top": f"WITH {TABLE} SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY count DESC, category)::INTEGER AS rank FROM t QUALIFY rank <= 3",
    "purity_spread": f"WITH {TABLE}, r AS (SELECT *, sum(count) OVER (PARTITION BY category) AS total, row_number() OVER (PARTITION BY category ORDER BY count DESC, cluster_id) AS rank FROM t), p AS (SELECT category, max(total)::BIGINT AS total, max(cluster_id) FILTER (rank = 1) AS main_cluster, round(max(count / total), 3) AS purity, count(DISTINCT cluster_id) AS spread FROM r GROUP BY category) SELECT *, CASE WHEN purity >= 0.6 AND spread <= 2 THEN 'aligned' WHEN purity >= 0.4 THEN 'partial' ELSE 'scattered' END AS verdict FROM p",
    "ari_nmi": f"""WITH {TABLE}, a AS (SELECT cluster_id, sum(count)::DOUBLE AS a FROM t GROUP BY 1), b AS (SELECT category, sum(count)::DOUBLE AS b FROM t GROUP BY 1), n AS (SELECT sum(count)::DOUBLE AS n FROM t),
 c AS (SELECT sum(count * (count - 1) / 2.0) AS sij, sum(count / n * ln(count * n / (a * b))) AS mi FROM t JOIN a USING (cluster_id) JOIN b USING (category), n), i AS (SELECT sum(a * (a - 1) / 2) AS si, -sum(a / n * ln(a / n)) AS hi FROM a, n), j AS (SELECT sum(b * (b - 1) / 2) AS sj, -sum(b / n * ln(b / n)) AS hj FROM b, n)
 SELECT round((sij - si * sj / (n * (n - 1) / 2)) / ((si + sj) / 2 - si * sj / (n * (n - 1) / 2)), 6) AS ari, round(2 * mi / (hi + hj), 6) AS nmi FROM c, i, j, n""",
    "cluster_share": f"WITH {TABLE}, s AS (SELECT cluster_id, sum(count) AS c FROM t GROUP BY 1) SELECT max(c)::BIGINT AS largest, round(max(c) / sum(c), 6) AS share FROM s",
    "review_rows": f"WITH {TOK}, {REC} SELECT tok.record_id, coalesce(category, {q(UNCLASSIFIED)}) AS current_category, len(tokens)::INTEGER AS token_count, CASE WHEN len(tokens) <= 8 THEN true WHEN len(tokens) > 12 THEN false ELSE len(list_filter(tokens, lambda t: NOT list_contains({names(fixed.PLACEHOLDERS)}, t))) <= 3 END AS short_content, least(len(tokens), 60)::INTEGER AS shown FROM tok LEFT JOIN rec USING (record_id)",
    "batch_assign": f"{LABELS} SELECT record_id, floor((row_number() OVER (ORDER BY record_id) - 1) / 7)::INTEGER AS batch FROM lab WHERE category = {q(UNCLASSIFIED)}",
    "policy": f"WITH f AS (SELECT *, suggested_category = {q(fixed.KEEP_UNCLASSIFIED)} AND NOT coalesce(short_content, false) AS downgraded FROM {REVIEWS}) SELECT record_id, CASE WHEN downgraded THEN {q(UNCLASSIFIED)} ELSE suggested_category END AS suggested_category, downgraded, CASE WHEN downgraded THEN trim(coalesce(reason, '') || ' ' || {q(fixed.KEEP_WITHDRAWN)}) ELSE reason END AS reason, CASE WHEN downgraded THEN '' ELSE words END AS words FROM f",
    "select_samples": f"{LABELS}, c AS (SELECT category, count(*) AS n FROM lab GROUP BY category) SELECT category AS reviewed, least(n, 7)::BIGINT AS count FROM c WHERE category IN ({q(fixed.ADS)}, {q(UNCLASSIFIED)}) UNION ALL SELECT category || {q(fixed.BOUNDARY_MARK)}, least(n, 3)::BIGINT FROM c WHERE category = {q(fixed.PHISH)} UNION ALL SELECT category || ' all', n::BIGINT FROM c WHERE category = {q(UNCLASSIFIED)}",
    "completed_batches": "SELECT event_id % 97 AS batch, event_type AS response FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 97 ORDER BY event_id DESC) = 1",
    "reject_merge": "SELECT replace(props, ' ', '') AS item, user_id AS batch, event_id AS pos FROM events QUALIFY row_number() OVER (PARTITION BY replace(props, ' ', '') ORDER BY user_id, event_id) = 1",
    "event_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, NULL::VARCHAR AS none FROM events",
    "audit_summary": f"WITH a AS (SELECT * FROM {AUDIT}), o AS (SELECT letters, count(*) AS count FROM a GROUP BY letters HAVING count(*) >= 10), n AS (SELECT letters, substring(\"right\", 1, 1) AS next, count(*) AS c FROM a GROUP BY ALL), t AS (SELECT letters, string_agg(next || ':' || c, ',' ORDER BY r) AS neighbours FROM (SELECT *, row_number() OVER (PARTITION BY letters ORDER BY c DESC, next) AS r FROM n) WHERE r <= 5 AND next <> '' GROUP BY letters), s AS (SELECT letters, string_agg(\"left\" || '<' || letters || '>' || \"right\", '|' ORDER BY r) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY letters ORDER BY record_id, \"left\", \"right\") AS r FROM a) WHERE r <= 3 GROUP BY letters) SELECT letters, count, neighbours, samples FROM o LEFT JOIN t USING (letters) LEFT JOIN s USING (letters)",
    "mask_contacts_documents": f"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)https?://[^\\s一-鿿]+|www[.][A-Za-z0-9.-]+(?:/[^\\s一-鿿]*)?', '[URL]', 'g'), {q(fixed.EMAIL)}, '[EMAIL]', 'g'), {q(fixed.QQ)}, '[QQ]', 'g'), {q(fixed.WECHAT)}, '[WECHAT]', 'g'), '{_digits}', '\\1[PHONE]\\3', 'g'), {q(fixed.MONEY)}, '[MONEY]', 'g')) AS masked_sha FROM documents",
    "subject_prefix_documents": "SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '(?i)^\\s*(?:(?:Re|Fwd?|FYI|答复|回复|转发)\\s*[:：]\\s*)*', ''), '\\s+$', '')) AS bare_sha FROM documents",
    "proposal_merge": f"WITH f AS (SELECT batch, pos, category, lang, trim(word) AS word FROM {WORDS} WHERE trim(word) <> '' QUALIFY row_number() OVER (PARTITION BY category, lang, word ORDER BY batch, pos) = 1) SELECT category, lang, word, row_number() OVER (PARTITION BY category, lang ORDER BY batch, pos)::INTEGER AS position FROM f",
    "proposal_validate": f"""WITH {TOK}, {REC}, x AS (SELECT tokens, coalesce(category, {q(UNCLASSIFIED)}) AS label FROM tok LEFT JOIN rec USING (record_id)), h AS (SELECT p.category, p.lang, p.word, label FROM {_prop} LEFT JOIN x ON list_has_all(tokens, string_split(word, ' '))),
 s AS (SELECT category, lang, word, count(label) AS corpus_hits, count(*) FILTER (label NOT IN ({q(UNCLASSIFIED)}, {q(EMPTY)}) AND label <> category) AS false_positive_hits FROM h GROUP BY ALL)
 SELECT s.*, k.word IS NOT NULL AS already_in_taxonomy, corpus_hits >= 3 AND false_positive_hits <= greatest(1.0, 0.15 * corpus_hits) AS recommend FROM s LEFT JOIN {_known} ON k.category = s.category AND k.word = s.word""",
}
