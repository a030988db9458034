"""Vocabulary iteration without the model call: samples, batches, policy, merge, validation."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenmill.functions.fixed import BOUNDARY_MARK, EMPTY, KEEP_UNCLASSIFIED, KEEP_WITHDRAWN, UNCLASSIFIED
from lumenmill.operators.rules import keyword_hits
from lumenmill.operators.tokens import is_short, top_tokens


def sample_per_category(df: DataFrame, n: int, seed: int = 42, category: str = "category") -> DataFrame:
    """At most n rows of each category, drawn by a seeded hash of record_id."""
    drawn = F.row_number().over(Window.partitionBy(category).orderBy(F.xxhash64(F.col("record_id").cast("string"), F.lit(seed)), "record_id"))
    return df.withColumn("_draw", drawn).filter(F.col("_draw") <= n).drop("_draw")


def review_categories(categories: list[str], found_prefix: str = "新类") -> list[str]:
    """Discovered classes if there are any, else what was left over."""
    found = [c for c in categories if c.startswith(found_prefix)]
    return found or [c for c in categories if c == UNCLASSIFIED]


def select_samples(df: DataFrame, categories: list[str], n: int, boundary: list[str] = (), boundary_n: int = 0, full: bool = False, seed: int = 42) -> DataFrame:
    """Rows to review, with `reviewed`: at most n of each category, and of each boundary class that
    is none of them at most boundary_n, marked as such; with full all rows of the categories."""
    if full:
        return df.filter(F.col("category").isin(categories)).withColumn("reviewed", F.col("category"))
    others = [c for c in boundary if c not in categories] if boundary_n > 0 else []
    wanted = {**dict.fromkeys(categories, n), **dict.fromkeys(others, boundary_n)}
    limit = F.create_map(*[F.lit(x) for item in wanted.items() for x in item])[F.col("category")]
    drawn = F.row_number().over(Window.partitionBy("category").orderBy(F.xxhash64(F.col("record_id").cast("string"), F.lit(seed)), "record_id"))
    picked = df.filter(F.col("category").isin(list(wanted))).withColumn("_draw", drawn).filter(F.col("_draw") <= limit).drop("_draw")
    mark = F.when(F.col("category").isin(others), F.concat("category", F.lit(BOUNDARY_MARK))) if others else F.lit(None).cast("string")
    return picked.withColumn("reviewed", F.coalesce(mark, F.col("category")))


def review_rows(df: DataFrame) -> DataFrame:
    """Review samples: record_id, current_category, token_count, short_content, text_preview,
    tokens (60 at most). df: record_id, category, tokens, text."""
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))
    cut = F.when(F.length(flat) > 400, F.concat(F.substring(flat, 1, 397), F.lit("..."))).otherwise(flat)
    return df.select("record_id", F.col("category").alias("current_category"), F.size("tokens").alias("token_count"), is_short(F.col("tokens")).alias("short_content"), cut.alias("text_preview"), F.slice("tokens", 1, 60).alias("tokens"))


def assign_batches(df: DataFrame, size: int, order: str = "record_id") -> DataFrame:
    """Adds batch: rows of the (small) review sample in order, by size."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size).cast("int"))


def completed_batches(lines: DataFrame) -> DataFrame:
    """(batch, response) of logged answers (batch, response, line): the last line of a batch wins."""
    rank = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("line")))
    return lines.withColumn("_n", rank).filter("_n = 1").select("batch", "response")


def pending_batches(batches: DataFrame, done: DataFrame) -> DataFrame:
    """Batches without a completed answer."""
    return batches.join(done.select("batch").distinct(), "batch", "left_anti")


def effective_timeout(base: int, full: bool, batch_size: int) -> int:
    """Seconds to wait for an answer: in full mode 12 for each row of a batch, 300 at least."""
    return max(base, 300, batch_size * 12) if full else base


def api_settings(env: dict[str, str]) -> dict:
    """What a caller of an external model needs, from KEY=value settings; an error without a key."""
    key = env.get("OPENAI_API_KEY", "").strip()
    if not key:
        raise ValueError("OPENAI_API_KEY is not set")
    numbers = {name: int(env.get(variable, default)) for name, variable, default in (("timeout", "LLM_TIMEOUT", "600"), ("retries", "LLM_RETRIES", "3"))}
    return {"key": key, "base_url": env.get("OPENAI_BASE_URL", "https://api.openai.com/v1").strip(), "model": env.get("LLM_MODEL", "gpt-4o-mini").strip(), **numbers}


def progress(done: int, total: int, width: int = 30) -> str:
    """One line: a bar, the numbers and the share."""
    share = done / total if total else 1.0
    full = int(width * share)
    return f"[{'#' * full}{'-' * (width - full)}] {done}/{total} {share:.1%}"


def prompt(rows: list[dict], categories: list[str], vocabulary: dict[str, list[str]], shown: int = 60) -> str:
    """What a reviewer, human or model, is asked about a batch: the classes with their words so far,
    the answer's form, and the samples."""
    form = {"summary": "", "sample_reviews": [{"record_id": "", "current_category": "", "suggested_category": "", "confidence": 0.0, "reason": "", "suggested_keywords": []}], "add_keywords": {c: {"zh": [], "en": [], "pinyin": []} for c in categories}, "reject_keywords": [], "new_category_candidates": []}
    words = {c: w[:shown] for c, w in vocabulary.items()}
    return json.dumps({"categories": categories, "keep_unclassified": KEEP_UNCLASSIFIED, "vocabulary": words, "vocabulary_sizes": {c: len(w) for c, w in vocabulary.items()}, "answer": form, "samples": rows}, ensure_ascii=False)


def ask(call, text: str, tries: int = 3, wait=time.sleep) -> str:
    """Calls a user-given function; only a timeout is tried again, after min(60, 10 n) seconds."""
    for n in range(1, tries + 1):
        try:
            return call(text)
        except TimeoutError:
            if n == tries:
                raise
            wait(min(60, 10 * n))
    raise ValueError("tries must be positive")


def enforce_policy(reviews: DataFrame) -> DataFrame:
    """"Keep unclassified" is for short samples only; elsewhere, and where it isn't known, it becomes
    plainly unclassified, its keywords go and the reason says so. reviews: record_id,
    suggested_category, suggested_keywords, reason, short_content. Adds downgraded."""
    refused = F.coalesce(F.col("suggested_category") == KEEP_UNCLASSIFIED, F.lit(False)) & ~F.coalesce("short_content", F.lit(False))
    out = reviews.withColumn("downgraded", refused)
    out = out.withColumn("suggested_category", F.when(F.col("downgraded"), UNCLASSIFIED).otherwise(F.col("suggested_category")))
    out = out.withColumn("reason", F.when(F.col("downgraded"), F.trim(F.concat(F.coalesce("reason", F.lit("")), F.lit(" " + KEEP_WITHDRAWN)))).otherwise(F.col("reason")))
    return out.withColumn("suggested_keywords", F.when(F.col("downgraded"), F.array().cast("array<string>")).otherwise(F.col("suggested_keywords")))


def merge_proposals(words: DataFrame) -> DataFrame:
    """(category, lang, word, position): each word once, where it came first. words: batch, pos,
    category, lang, word."""
    first = F.row_number().over(Window.partitionBy("category", "lang", "word").orderBy("batch", "pos"))
    bare = words.withColumn("word", F.trim("word"))
    kept = bare.filter("word <> ''").withColumn("_n", first).filter("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy("category", "lang").orderBy("batch", "pos"))
    return kept.withColumn("position", place).select("category", "lang", "word", "position")


def merge_rejects(items: DataFrame) -> DataFrame:
    """(item, position): rejected words or new classes (batch, pos, item as JSON), each once where it
    came first; objects are equal whatever the order of their keys."""
    canonical = F.to_json(F.parse_json("item"))
    first = F.row_number().over(Window.partitionBy("_key").orderBy("batch", "pos"))
    kept = items.withColumn("_key", canonical).withColumn("_n", first).filter("_n = 1")
    return kept.select(F.col("_key").alias("item"), "batch", "pos")


def merge_summaries(batches: DataFrame) -> str:
    """The summaries of (batch, summary) in order, one a line; the answers of a run are few."""
    rows = batches.filter("summary <> ''").orderBy("batch").collect()
    return "\n".join(f"{r['batch']}: {r['summary']}" for r in rows)


def validate(proposal: DataFrame, df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Adds corpus_hits, false_positive_hits (rows of another settled category),
    already_in_taxonomy and recommend. proposal: category, lang, word; df: record_id, tokens,
    label; vocabulary as rules.vocabulary_frame makes it."""
    words = proposal.select("word").distinct().select(F.lit("w").alias("category"), F.xxhash64("word").cast("string").alias("k"), "word", F.split("word", " ").alias("parts"))
    ranked = words.withColumn("word_pos", F.row_number().over(Window.orderBy("word"))).select("category", "word_pos", "word", "parts")
    found = keyword_hits(df, ranked).join(df.select("record_id", "label"), "record_id").groupBy("word", "label").agg(F.count(F.lit(1)).alias("c"))
    settled = ~F.col("label").isin(UNCLASSIFIED, EMPTY)
    joined = proposal.join(found, "word", "left")
    sums = joined.groupBy("category", "lang", "word").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("corpus_hits"), F.coalesce(F.sum(F.when(settled & (F.col("label") != F.col("category")), F.col("c"))), F.lit(0)).alias("false_positive_hits"))
    known = vocabulary.select("category", "word").distinct().withColumn("already_in_taxonomy", F.lit(True))
    out = sums.join(F.broadcast(known), ["category", "word"], "left").withColumn("already_in_taxonomy", F.coalesce("already_in_taxonomy", F.lit(False)))
    enough = (F.col("corpus_hits") >= 3) & (F.col("false_positive_hits") <= F.greatest(F.lit(1.0), 0.15 * F.col("corpus_hits")))
    return out.withColumn("recommend", enough).select("category", "lang", "word", "corpus_hits", "false_positive_hits", "already_in_taxonomy", "recommend")


def apply_proposal(taxonomy: dict, validated: list[dict], stamp: str) -> dict:
    """A new taxonomy with the recommended words that it lacks, and a note of when."""
    out = json.loads(json.dumps(taxonomy))
    groups = out.get("categories", out)
    for row in validated:
        if row["recommend"] and not row["already_in_taxonomy"]:
            words = groups.setdefault(row["category"], {}).setdefault(row["lang"], [])
            if row["word"] not in words:
                words.append(row["word"])
    out["_updated"] = stamp
    return out


def batch_tokens(df: DataFrame, k: int = 25) -> DataFrame:
    return top_tokens(df, "batch", k)


def category_tokens(df: DataFrame, k: int = 25) -> DataFrame:
    return top_tokens(df, "category", k)


def audit_summary(audit: DataFrame, least: int = 10, order: str = "record_id") -> DataFrame:
    """letters, count, top right neighbours and first samples of the dropped single letters that
    occur `least` times or more. audit: record_id, left, letters, right."""
    often = audit.groupBy("letters").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= least)
    near = audit.groupBy("letters", F.substring("right", 1, 1).alias("next")).agg(F.count(F.lit(1)).alias("c"))
    rank = F.row_number().over(Window.partitionBy("letters").orderBy(F.desc("c"), "next"))
    top = near.withColumn("r", rank).filter("r <= 5 and next <> ''").groupBy("letters").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "next", "c"))), lambda s: F.concat(s["next"], F.lit(":"), s["c"].cast("string"))).alias("neighbours"))
    place = F.row_number().over(Window.partitionBy("letters").orderBy(order, "left", "right"))
    samples = audit.withColumn("r", place).filter("r <= 3").groupBy("letters").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", F.concat("left", F.lit("<"), "letters", F.lit(">"), "right").alias("s")))), lambda s: s["s"]).alias("samples"))
    return often.join(top, "letters", "left").join(samples, "letters", "left")
