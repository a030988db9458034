"""Tokens: segmentation, normalisation, filters, and counts over them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import lumenmill
from lumenmill.functions import fixed
from lumenmill.functions.text import keep_charset, mask_email

cloudpickle.register_pickle_by_value(lumenmill)


class LongestMatch:
    """A segmenter without a library: letter runs are words; Chinese runs are cut by longest
    match from the left over a lexicon, single characters otherwise."""

    def __init__(self, lexicon):
        self.words = {w for w in lexicon if re.fullmatch("[一-鿿]+", w)}
        self.longest = max(map(len, self.words), default=1)

    def __call__(self, text: str) -> list[str]:
        out = []
        for run in re.findall(r"[A-Za-z]+|[一-鿿]+|[^\sA-Za-z一-鿿]+", text):
            if not "一" <= run[0] <= "鿿":
                out.append(run)
                continue
            at = 0
            while at < len(run):
                to = next((j for j in range(min(len(run), at + self.longest), at + 1, -1) if run[at:j] in self.words), at + 1)
                out.append(run[at:to])
                at = to
        return out


def default_lexicon() -> list[str]:
    lists = [*fixed.THEMES.values(), *fixed.RESIDUAL_TYPES.values(), *fixed.RESIDUAL_BUCKETS.values(), *fixed.FALLBACK.values(), list(fixed.PHRASES.values()), fixed.STOPWORDS]
    return sorted({w for words in lists for w in words})


def best_segmenter():
    """The jieba library where it is installed, else longest match."""
    try:
        import jieba
    except ImportError:
        return LongestMatch(default_lexicon())
    return jieba.lcut


def segmented(segmenter=None):
    """Column function: text to tokens with placeholders kept whole (Arrow)."""
    cut = segmenter or best_segmenter()
    hole = re.compile(f"({fixed.PLACEHOLDER})")

    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda text: [t for part in hole.split(text or "") if part for t in ([part] if hole.fullmatch(part) else cut(part))])

    return F.pandas_udf(run, "array<string>")


def runs(c: Column) -> Column:
    """Native tokens: placeholders, Chinese runs, letter runs."""
    return F.filter(F.split(keep_charset(mask_email(F.coalesce(c, F.lit("")))), " "), lambda t: t != "")


def normal(t: Column) -> Column:
    return F.when(t.rlike("^[A-Za-z]+$"), F.lower(t)).otherwise(F.trim(t))


def is_placeholder(t: Column) -> Column:
    return t.isin(fixed.PLACEHOLDERS)


def kept(t: Column, stopwords: list[str] | None = None) -> Column:
    """Placeholders always; else no stop word, two characters at least, Chinese or letters."""
    words = fixed.STOPWORDS if stopwords is None else stopwords
    return is_placeholder(t) | (~t.isin(words) & (F.length(t) > 1) & t.rlike("[一-鿿]|^[A-Za-z]+$") & ~t.rlike("^[0-9]+$"))


def tokens(c: Column, stopwords: list[str] | None = None) -> Column:
    """Native tokens, normalised and filtered. Runs are placeholders, Chinese or letters, so what
    normal() and kept() ask of each token is known."""
    words = fixed.STOPWORDS if stopwords is None else stopwords
    found = F.regexp_extract_all(mask_email(F.coalesce(c, F.lit(""))), F.lit(f"({fixed.KEEP})"), F.lit(1))
    low = F.transform(found, lambda t: F.when(t.startswith("["), t).otherwise(F.lower(t)))
    return F.filter(low, lambda t: (F.length(t) > 1) & ~t.isin(words))


def exploded(df: DataFrame, *columns: str) -> DataFrame:
    """The columns with each token. Null filters after an outer explode: a plain one would make the
    optimiser compute the tokens twice, once to see that there are any."""
    return df.select(*columns, F.explode_outer("tokens").alias("token")).filter("token is not null")


def without(tokens: Column, words: list[str]) -> Column:
    """Tokens but the given words; repeats stay."""
    return F.filter(tokens, lambda t: ~t.isin(words))


def lower_ascii(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike(r"^[\x00-\x7F]*$"), F.lower(t)).otherwise(t))


def has_placeholder(tokens: Column) -> Column:
    return F.exists(tokens, lambda t: t.startswith("[") & t.endswith("]"))


def is_short(tokens: Column) -> Column:
    """Up to 8 tokens; up to 12 if at most 3 are no placeholders."""
    words = F.size(F.filter(tokens, lambda t: ~is_placeholder(t)))
    return F.when(F.size(tokens) <= 8, True).when(F.size(tokens) > 12, False).otherwise(words <= 3)


def length_bucket(n: Column) -> Column:
    return F.when(n <= 5, "<=5").when(n <= 10, "6-10").when(n <= 30, "11-30").when(n <= 999, ">30")


def token_stats(df: DataFrame) -> DataFrame:
    """One row over (record_id, tokens): records, tokens, empties, each placeholder's count."""

    def times(placeholder: str) -> Column:
        return F.sum(F.size(F.filter("tokens", lambda t: t == placeholder))).alias(placeholder.strip("[]").lower())

    each = [times(p) for p in fixed.PLACEHOLDERS]
    return df.agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("tokens")).alias("tokens"), F.count_if(F.size("tokens") == 0).alias("empty"), *each)


def top_tokens(df: DataFrame, group: str, k: int, placeholders: bool = False) -> DataFrame:
    """(group, rank, token, count) of the k commonest tokens of each group; ties by token."""
    flat = exploded(df, group)
    flat = flat if placeholders else flat.filter(~is_placeholder(F.col("token")))
    counted = flat.groupBy(group, "token").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("count"), "token"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= k).select(group, "rank", "token", "count")
