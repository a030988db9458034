"""The driver tables as messages, and the SQL pieces that say the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.functions import fixed
from lumenmill.functions.fixed import ACADEMIC1, ACADEMIC2, ADS, ADULT, COMMERCIAL, GAMBLING, INVOICE, PHISH
from lumenmill.operators.rules import SCHEME1, Scheme
from lumenmill.operators.structural import structural_features
from lumenmill.operators.tokens import tokens

#: A vocabulary whose words occur in the test tables; real ones come from configuration.
VOCABULARY = {
    ADULT: ["scum", "loser", "worthless idiot"],
    ADS: ["license", "rights reserved", "copyright", "license"],
    PHISH: ["que", "und", "ation"],
    GAMBLING: ["les des", "pour dans"],
    ACADEMIC1: ["einer", "als", "mente"],
}


#: For the second scheme.
VOCABULARY2 = {
    ADULT: ["scum", "loser", "worthless idiot", "que"],
    INVOICE: ["license", "rights reserved"],
    COMMERCIAL: ["les des", "pour dans"],
    PHISH: ["que", "und", "ation", "les"],
    ACADEMIC2: ["einer", "als", "mente"],
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer partitions than the cluster has cores (a small file is one) is dealt
    out, others stay as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wanted = spark.sparkContext.defaultParallelism
    return df.repartition(wanted) if name == "documents" and df.rdd.getNumPartitions() < wanted else df


def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, tokens, lang, source, text of all documents."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), tokens(F.col("text")).alias("tokens"), "lang", "source", "text")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a message; its page (same number), if any, gives the link."""
    d = read(spark, sf_dir, "documents")
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("page_url"))
    j = d.join(p, "doc_id", "left")
    domain = F.concat(F.col("source"), F.lit(".example.com"))
    shown = F.when(F.col("lang") == "es", F.concat(F.lit("mail."), F.col("source"), F.lit(".example.org"))).otherwise(F.concat(F.lit("mail."), domain))
    return j.select(
        F.col("doc_id").alias("record_id"), F.concat(F.lit('"'), shown, F.lit('" <a@'), domain, F.lit(">")).alias("from"), F.lit("").alias("sender"), F.col("source").alias("fromname"),
        F.when(F.col("source") == "src3", F.concat("page_url", F.lit("/login"))).otherwise(F.col("page_url")).alias("url"), F.lit(None).cast("string").alias("htmlurl"), F.when(F.col("lang") == "de", "a.doc").otherwise(" ").alias("attach"),
        F.concat(F.lit("0.02;x;0."), F.substring(F.col("n_chars").cast("string"), 1, 3)).alias("domainrep"), F.lit("").alias("subject"), F.col("text").alias("content"),
    )


def scored_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens beside structural columns: what the classifier takes."""
    keep = {"tokens": tokens(F.col("content")), "source": F.col("fromname"), "text": F.col("content")}
    return structural_features(messages(spark, sf_dir), keep).withColumn("record_id", F.col("record_id").cast("long"))


# ---- SQL for DuckDB ----


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


KEPT = f"(list_contains({names(fixed.PLACEHOLDERS)}, t) OR (NOT list_contains({names(fixed.STOPWORDS)}, t) AND length(t) > 1 AND regexp_matches(t, '[一-鿿]|^[A-Za-z]+$')))"
TOK = rf"""tok AS (
  SELECT doc_id AS record_id, lang, source, text, list_filter(list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), {q(fixed.EMAIL)}, '[EMAIL]', 'g'), {q(fixed.KEEP)}),
    lambda t: CASE WHEN regexp_full_match(t, '[A-Za-z]+') THEN lower(t) ELSE t END), lambda t: {KEPT}) AS tokens FROM documents
)"""
MSG = r"""msg AS (
  SELECT doc_id AS record_id, source || '.example.com' AS sender_domain, CASE WHEN lang = 'es' THEN 'mail.' || source || '.example.org' ELSE 'mail.' || source || '.example.com' END AS display_name,
    CASE WHEN source = 'src3' THEN url || '/login' ELSE url END AS url, lang = 'de' AS has_attach, greatest(0.02, ('0.' || substring(n_chars::VARCHAR, 1, 3))::DOUBLE) AS domainrep_max, text
  FROM documents LEFT JOIN pages ON doc_id = page_id
)"""
STRUCT = rf"""st0 AS (
  SELECT *, list_filter([regexp_replace(lower(regexp_extract(coalesce(url, ''), '(?i)https?://([^/\s:]+)', 1)), '^[w.]+', '')], lambda h: h <> '') AS url_domains,
    length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(coalesce(text, ''), '[^一-鿿]', '', 'g')) AS zh FROM msg
), st AS (
  SELECT record_id, sender_domain, display_name, display_name AS display_domain, display_name LIKE '%.org' AS display_domain_mismatch, len(url_domains)::INTEGER AS url_count, url_domains,
    len(url_domains) > 0 AND regexp_extract(url_domains[1], '([^.]*\.[^.]*)$', 1) <> 'example.com' AS url_sender_mismatch,
    regexp_matches(lower(coalesce(url, '')), {q('|'.join(p.replace('.', chr(92) + '.').replace('?', chr(92) + '?') for p in fixed.SUSPICIOUS_URL_PARTS))}) AS url_suspicious, domainrep_max, has_attach,
    CASE WHEN letters + zh = 0 THEN 'unknown' WHEN zh >= 0.5 * (letters + zh) THEN 'zh' WHEN zh <= 0.15 * (letters + zh) THEN 'en' ELSE 'mixed' END AS lang FROM st0
)"""


def hit_sql(category: str, vocabulary: dict[str, list[str]] | None = None) -> str:
    """The list of the category's words that hit."""
    words = names((vocabulary or VOCABULARY)[category])
    return f"list_filter({words}, lambda w: list_has_all(tokens, string_split(w, ' ')))"


def score_sql(scheme: Scheme = SCHEME1, weight: float | None = None, name: str = "sc", vocabulary: dict[str, list[str]] | None = None) -> str:
    """CTE with hits h0.., the five flags and scores s0.. of the scheme's categories in order."""
    weight = scheme.phish_weight if weight is None else weight
    cats = list(scheme.ids)
    vocabulary = vocabulary or VOCABULARY
    hit = ", ".join(f"{hit_sql(c, vocabulary) if c in vocabulary else '[]::VARCHAR[]'} AS h{i}" for i, c in enumerate(cats))
    p = cats.index(PHISH)
    bait = names(fixed.DATING_BAIT)
    scores = ", ".join(f"strong + CASE WHEN combo_kw THEN 0.5 ELSE 0 END AS raw{i}" if i == p else f"len(h{i})::DOUBLE AS s{i}" for i, c in enumerate(cats))
    return f"""{name}0 AS (
  SELECT tok.record_id, tokens, text, st.lang, coalesce(display_domain_mismatch, false) AS strong_mismatch, coalesce(url_suspicious, false) AS strong_susp, coalesce(url_sender_mismatch, false) AS away, {hit} FROM tok LEFT JOIN st USING (record_id)
), {name}1 AS (
  SELECT *, {weight} * len(h{p}) AS kw, (lang IN ('en', 'mixed') AND (len(list_intersect(tokens, {bait})) >= 2 OR (len(list_intersect(tokens, {bait})) >= 1 AND len(tokens) <= 12))) AS bait FROM {name}0
), {name}2 AS (
  SELECT *, away AND kw >= 0.5 AS combo_kw, away AND kw < 0.5 AND len(tokens) <= 8 AS combo_short, away AND kw < 0.5 AND len(tokens) > 8 AND coalesce(bait, false) AS combo_dating,
    kw + CASE WHEN strong_mismatch THEN 2.0 ELSE 0 END + CASE WHEN strong_susp THEN 2.0 ELSE 0 END AS strong FROM {name}1
), {name}3 AS (
  SELECT *, {scores} FROM {name}2
), {name} AS (
  SELECT *, CASE WHEN combo_short OR combo_dating THEN greatest(raw{p}, 1.0) ELSE raw{p} END::DOUBLE AS s{p} FROM {name}3
)"""


def best_sql(scheme: Scheme, least: float, priority: dict[str, int] | None = None) -> str:
    """The winning category or null."""
    priority = priority or scheme.priority
    cats = list(scheme.ids)
    top = "greatest(" + ", ".join(f"s{i}" for i in range(len(cats))) + ")"
    cases = " ".join(f"WHEN s{cats.index(c)} = {top} THEN {q(c)}" for c, _ in sorted(priority.items(), key=lambda x: x[1]))
    return f"(CASE WHEN {top} < {least} THEN NULL {cases} END)"


def label_sql(scheme: Scheme = SCHEME1, weight: float | None = None, priority: dict[str, int] | None = None, name: str = "lab", source: str = "sc") -> str:
    ids = " ".join(f"WHEN {q(c)} THEN {i}" for c, i in {**scheme.ids, fixed.UNCLASSIFIED: fixed.UNCLASSIFIED_ID, fixed.EMPTY: fixed.EMPTY_ID}.items())
    return f"""{name}0 AS (
  SELECT *, CASE WHEN len(tokens) = 0 THEN {q(fixed.EMPTY)} ELSE coalesce({best_sql(scheme, 1.0, priority)}, {q(fixed.UNCLASSIFIED)}) END AS category FROM {source}
), {name} AS (
  SELECT *, (CASE category {ids} END)::INTEGER AS cluster_id FROM {name}0
)"""


BASE = f"WITH {TOK}, {MSG}, {STRUCT}"
LABELS = f"{BASE}, {score_sql()}, {label_sql()}"
COMBOS = "strong_mismatch, strong_susp, combo_kw, combo_short, combo_dating"
