"""Theme profiles, their roll-ups, four exclusive classes, and types of what rules left over."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmill.functions import fixed
from lumenmill.operators.tokens import has_placeholder


def theme_scores(blob: Column, themes: dict[str, list[str]] | None = None) -> Column:
    """Map theme -> number of its words in the blob. Words of letters and digits count at word
    borders and are looked for by one pattern for all themes; other words count anywhere, those with
    Chinese characters only where the blob has any."""
    themes = fixed.THEMES if themes is None else themes
    plain = sorted({w for words in themes.values() for w in words if re.fullmatch("[a-z0-9]+", w)})
    said = F.array_distinct(F.regexp_extract_all(blob, F.lit(rf"(?U)\b({'|'.join(plain)})\b"), F.lit(1))) if plain else F.array().cast("array<string>")
    pairs = []
    for theme, words in themes.items():
        own = [w for w in words if w in plain]
        total = F.size(F.array_intersect(said, F.array(*[F.lit(w) for w in own]))) if own else F.lit(0)
        for chinese in (True, False):
            rest = [w for w in words if w not in plain and bool(re.search("[一-鿿]", w)) == chinese]
            inside = sum((blob.contains(w).cast("int") for w in rest), F.lit(0))
            total += F.when(blob.rlike("[一-鿿]"), inside).otherwise(0) if chinese and rest else inside if rest else F.lit(0)
        pairs += [F.lit(theme), total]
    return F.create_map(*pairs)


def best_theme(scores: Column, order: list[str] | None = None) -> Column:
    """The theme with most hits, ties by order; null without a hit."""
    order = order or ["porn_media", "porn_dating", "health_pharma", "gambling", "phish_account", "phish_scam", "invoice", "academic", "commercial"]
    ranked = F.array_max(F.array(*[F.struct(F.element_at(scores, t).alias("s"), F.lit(-i).alias("p"), F.lit(t).alias("t")) for i, t in enumerate(order)]))
    return F.when(ranked["s"] > 0, ranked["t"])


def text_and_tokens(text: Column, tokens: Column) -> Column:
    """What themes are looked for in."""
    return F.lower(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.array_join(tokens, " ")))


def profile(df: DataFrame) -> DataFrame:
    """df (record_id, blob, tokens, suspicious): adds theme_hits, theme and four_class. The blob is
    the text and the tokens, lower case."""
    out = df.withColumn("theme_hits", theme_scores(F.col("blob")))
    found = best_theme(F.col("theme_hits"))
    blank = (F.trim("blob") == "") & (F.size("tokens") == 0)
    theme = F.when(blank, "__empty__").otherwise(F.coalesce(found, F.when(F.col("suspicious"), "phish_account"), F.lit("__none__")))
    four_order = list(fixed.FOUR_CLASSES)
    of = F.create_map(*[F.lit(x) for item in fixed.FOUR_CLASSES.items() for x in item])
    rest = F.when(F.col("suspicious"), "网络钓鱼与诈骗").when(F.col("blob").rlike("[一-鿿]"), "商业·学术·博彩营销").otherwise("网络钓鱼与诈骗")
    four = F.when(blank, "空样本").otherwise(F.coalesce(of[best_theme(F.col("theme_hits"), four_order)], rest))
    return out.withColumn("theme", theme).withColumn("four_class", four)


def multi_label(profiled: DataFrame) -> DataFrame:
    """theme, rows, hits: rows with any word of the theme (a row may count for several)."""
    flat = profiled.select(F.explode("theme_hits").alias("theme", "n")).filter("n > 0")
    return flat.groupBy("theme").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("hits"))


def roll_ups(profiled: DataFrame) -> DataFrame:
    """grouping, macro, count for the three candidate groupings; (none) for themes outside."""
    rows = [(g, m, t) for g, macros in fixed.ROLL_UPS.items() for m, themes in macros.items() for t in themes]
    mapping = profiled.sparkSession.createDataFrame(rows, "grouping string, macro string, theme string")
    groups = profiled.sparkSession.createDataFrame([(g,) for g in fixed.ROLL_UPS], "grouping string")
    counted = profiled.groupBy("theme").agg(F.count(F.lit(1)).alias("c"))
    full = counted.crossJoin(F.broadcast(groups)).join(F.broadcast(mapping), ["grouping", "theme"], "left")
    return full.groupBy("grouping", F.coalesce("macro", F.lit("(none)")).alias("macro")).agg(F.sum("c").alias("count"))


def says_any(tokens: Column, words: list[str]) -> Column:
    """A word among the tokens or anywhere in them joined by spaces."""
    joined = F.array_join(tokens, " ")
    any_inside = joined.rlike("|".join(map(re.escape, words)))
    return any_inside | F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


def residual_type(tokens: Column, lang: Column, link_signal: Column) -> Column:
    """One of fourteen types, by order."""
    n, other = F.size(tokens), fixed.RESIDUAL_OTHER
    out = F.when(n <= 5, other[0]).when((n <= 10) & has_placeholder(tokens), other[1])
    for name, words in fixed.RESIDUAL_TYPES.items():
        out = out.when(says_any(tokens, words), name)
    return out.when(link_signal, other[2]).when((lang == "en") & (n <= 20), other[3]).when((lang == "zh") & (n <= 15), other[4]).otherwise(other[5])


def residual_buckets(df: DataFrame) -> DataFrame:
    """bucket, count over (tokens); buckets overlap."""
    flags = F.array(*[F.struct(F.lit(b).alias("bucket"), says_any(F.col("tokens"), w).alias("yes")) for b, w in fixed.RESIDUAL_BUCKETS.items()])
    flat = df.select(F.explode(flags).alias("b")).select("b.bucket", "b.yes")
    return flat.groupBy("bucket").agg(F.count_if("yes").alias("count"))
