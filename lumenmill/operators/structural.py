"""Structural signals of a message: sender, display name, link hosts, reputation, language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmill.functions import fixed
from lumenmill.functions.text import strip


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), pattern, group)


def address_domain(c: Column) -> Column:
    """Domain of the address in angle brackets, else of the first address; '' if none."""
    angle = _first(c, fixed.ADDRESS_IN_ANGLES)
    return F.lower(_first(F.when(angle != "", angle).otherwise(c), fixed.ADDRESS_DOMAIN))


def sender_domain(sender: Column, from_: Column) -> Column:
    return F.coalesce(F.nullif(address_domain(sender), F.lit("")), address_domain(from_))


def display_name(from_: Column, fromname: Column) -> Column:
    """The from field without addresses and quotes, else the name field treated likewise."""

    def bare(c: Column) -> Column:
        return strip(F.regexp_replace(strip(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", "")), '^"+|"+$', ""))

    return F.coalesce(F.nullif(bare(from_), F.lit("")), bare(fromname))


def domain_in_text(c: Column) -> Column:
    """The first domain of three labels or more, lower case; '' if none."""
    return F.lower(_first(c, "(?U)" + fixed.DOMAIN))


def url_hosts(c: Column) -> Column:
    """Hosts of http(s) links, lower case, without any leading run of w and dots, each once."""
    hosts = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(fixed.URL_HOST), F.lit(1))
    return F.array_distinct(F.filter(F.transform(hosts, lambda h: F.regexp_replace(F.lower(h), "^[w.]+", "")), lambda h: h != ""))


def url_suspicious(c: Column) -> Column:
    parts = "|".join(p.replace(".", r"\.").replace("?", r"\?") for p in fixed.SUSPICIOUS_URL_PARTS)
    return F.lower(F.coalesce(c, F.lit(""))).rlike(parts)


def reputation_max(c: Column) -> Column:
    """Largest of the numbers between semicolons, 0 at least, half-even to four places."""
    values = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda p: F.trim(p).try_cast("double"))
    return F.bround(F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.filter(values, lambda v: v.isNotNull())), F.lit(0.0))), 4)


def language(c: Column) -> Column:
    """zh, en, mixed or unknown by the share of Chinese among Chinese and ASCII letters."""
    zh = F.regexp_count(F.coalesce(c, F.lit("")), F.lit("[一-鿿]"))
    total = zh + F.regexp_count(F.coalesce(c, F.lit("")), F.lit("[A-Za-z]"))
    share = zh / F.when(total > 0, total)
    return F.when(share >= 0.5, "zh").when(share <= 0.15, "en").when(share.isNotNull(), "mixed").otherwise("unknown")


def same_registrable(a: Column, b: Column) -> Column:
    """Equal, or two labels at least in both and the last two equal."""
    labels = (F.size(F.split(a, r"\.")) >= 2) & (F.size(F.split(b, r"\.")) >= 2)
    return (a != "") & (b != "") & ((a == b) | (labels & (F.substring_index(a, ".", -2) == F.substring_index(b, ".", -2))))


def structural_features(df: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """The twelve columns; df has record_id, from, sender, fromname, url, htmlurl, attach,
    domainrep, subject, content (null counts as empty). keep: further columns of df's rows."""
    keep = keep or {}
    out = df.select(
        *[c.alias(name) for name, c in keep.items()],
        F.coalesce(F.col("record_id").cast("string"), F.lit("")).alias("record_id"),
        sender_domain(F.col("sender"), F.col("from")).alias("sender_domain"),
        display_name(F.col("from"), F.col("fromname")).alias("display_name"),
        F.when(F.size(url_hosts(F.col("url"))) > 0, url_hosts(F.col("url"))).otherwise(url_hosts(F.col("htmlurl"))).alias("url_domains"),
        (url_suspicious(F.col("url")) | url_suspicious(F.col("htmlurl"))).alias("url_suspicious"),
        reputation_max(F.col("domainrep")).alias("domainrep_max"),
        (strip(F.coalesce("attach", F.lit(""))) != "").alias("has_attach"),
        language(F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("content", F.lit("")))).alias("lang"),
    )
    out = out.withColumn("display_domain", domain_in_text(F.col("display_name"))).withColumn("url_count", F.size("url_domains"))
    claims = (F.col("display_domain") != "") & (F.col("sender_domain") != "") & ~same_registrable(F.col("display_domain"), F.col("sender_domain"))
    strange = (F.col("sender_domain") != "") & (F.col("url_count") > 0) & ~F.exists("url_domains", lambda d: same_registrable(d, F.col("sender_domain")))
    return out.withColumn("display_domain_mismatch", claims).withColumn("url_sender_mismatch", strange).select(
        "record_id", "sender_domain", "display_name", "display_domain", "display_domain_mismatch", "url_count", "url_domains", "url_sender_mismatch", "url_suspicious", "domainrep_max", "has_attach", "lang", *keep
    )


def structural_counters(features: DataFrame) -> DataFrame:
    """One row: how many records carry each signal, and the language histogram."""
    flags = ["display_domain_mismatch", "url_sender_mismatch", "url_suspicious", "has_attach"]
    sums = [F.count_if(F.col(c)).alias(c) for c in flags] + [F.count_if(F.col("lang") == v).alias(f"lang_{v}") for v in ("zh", "en", "mixed", "unknown")]
    return features.agg(F.count(F.lit(1)).alias("records"), *sums, F.count_if(F.col("url_count") > 0).alias("with_url"), F.count_if(F.col("domainrep_max") > 0).alias("with_reputation"))
