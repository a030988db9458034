"""Column expressions for text: presence, masking, charset, previews, JSON fences.

Java's ``\\s`` and ``\\d`` are ASCII; where the semantics are Unicode, patterns carry ``(?U)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenmill.functions import fixed

ZH = r"[一-鿿]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_missing(c: Column) -> Column:
    """Null, empty or only white space; numbers and false are present."""
    return c.isNull() | (strip(c.cast("string")) == "")


def has_payload(*columns: Column) -> Column:
    return reduce(lambda a, b: a | b, [~is_missing(c) for c in columns])


def join_fields(*columns: Column, sep: str = " ") -> Column:
    """Stripped, non-empty fields in order, joined."""
    return F.concat_ws(sep, *[F.when(~is_missing(c), strip(c)) for c in columns])


def preview(c: Column, limit: int = 200) -> Column:
    """The first characters, with ... if there are more."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def truncate(c: Column, limit: int) -> Column:
    """White space collapsed and stripped; beyond limit cut to limit with the dots."""
    flat = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def sheet_cell(c: Column, most: int = 32767) -> Column:
    """Characters that XML forbids go; longer cells are cut and marked."""
    clean = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most - 10), F.lit("...[TRUNC]"))).otherwise(clean)


def strip_subject_prefix(c: Column) -> Column:
    return strip(F.regexp_replace(c, "(?iU)" + fixed.SUBJECT_PREFIX, ""))


def map_variants(c: Column) -> Column:
    return F.translate(c, "".join(fixed.VARIANT_CHARS), "".join(fixed.VARIANT_CHARS.values()))


def mask_url(c: Column) -> Column:
    return F.regexp_replace(c, "(?i)" + fixed.URL, "[URL]")


def mask_email(c: Column) -> Column:
    return F.regexp_replace(c, fixed.EMAIL, "[EMAIL]")


def mask_qq(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + fixed.QQ, "[QQ]")


def mask_wechat(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + fixed.WECHAT, "[WECHAT]")


def mask_phone(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + fixed.PHONE, "[PHONE]")


def mask_money(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + fixed.MONEY, "[MONEY]")


def mask_contacts(c: Column) -> Column:
    """All placeholders, specific ones first."""
    return mask_money(mask_phone(mask_wechat(mask_qq(mask_email(mask_url(c))))))


def keep_charset(c: Column) -> Column:
    """Placeholders, Chinese runs and letter runs, joined by a space."""
    return F.array_join(F.regexp_extract_all(c, F.lit(f"({fixed.KEEP})"), F.lit(1)), " ")


def merge_zh(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + fixed.ZH_SPACE, "")


def normalise_native(c: Column) -> Column:
    """The steps of the full normaliser that need no UDF."""
    return merge_zh(keep_charset(mask_contacts(map_variants(c))))


def placeholder_count(c: Column, name: str) -> Column:
    return F.regexp_count(c, F.lit(r"\[" + name + r"\]"))


def strip_json_fence(c: Column) -> Column:
    """JSON out of a fenced answer: the fence goes, then what is outside the braces."""
    bare = F.regexp_replace(strip(c), r"(?s)^```(?:json)?\s*|\s*```$", "")
    return F.regexp_extract(bare, r"(?s)(\{.*\})", 1)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.lit(100.0) * part / whole, digits)
