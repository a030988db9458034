"""The weighted keyword-rule classifier: hits, scores, structural bonuses, labels, fallback."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenmill.functions import fixed
from lumenmill.functions.fixed import ACADEMIC1, ACADEMIC2, ADS, ADULT, COMMERCIAL, EMPTY, EMPTY_ID, GAMBLING, INVOICE, PHISH, UNCLASSIFIED, UNCLASSIFIED_ID
from lumenmill.operators.tokens import exploded, lower_ascii

COMBOS = ["strong_mismatch", "strong_susp", "combo_kw", "combo_short", "combo_dating"]


@dataclass(frozen=True)
class Scheme:
    """Categories with ids; priorities (smaller wins ties) of the rule and of the force pass."""

    name: str
    ids: dict[str, int]
    priority: dict[str, int]
    force_priority: dict[str, int]
    phish_weight: float = 0.5
    profile: dict[str, str | None] = field(default_factory=dict)


SCHEME1 = Scheme(
    "semantic",
    {ADULT: 0, ADS: 1, PHISH: 2, GAMBLING: 3, ACADEMIC1: 4},
    {ADULT: 0, PHISH: 1, GAMBLING: 2, ACADEMIC1: 3, ADS: 4},
    {ADULT: 0, PHISH: 1, GAMBLING: 2, ACADEMIC1: 3, ADS: 4},
    0.5,
    {"invoice": ADS, "ads": ADS, "academic": ACADEMIC1, "gambling": GAMBLING},
)
SCHEME2 = Scheme(
    "balanced",
    {ADULT: 0, INVOICE: 1, COMMERCIAL: 2, PHISH: 3, ACADEMIC2: 4},
    {PHISH: 0, ADULT: 1, INVOICE: 2, ACADEMIC2: 3, COMMERCIAL: 4},
    {ADULT: 0, PHISH: 1, INVOICE: 2, ACADEMIC2: 3, COMMERCIAL: 4},
    1.0,
    {"invoice": INVOICE, "ads": COMMERCIAL, "academic": ACADEMIC2, "gambling": None},
)


def flatten(taxonomy: dict) -> dict[str, list[str]]:
    """Category -> words in order; a word listed twice stays twice; keys with _ are notes."""
    out = {}
    for category, groups in taxonomy.get("categories", taxonomy).items():
        if not category.startswith("_"):
            words = [(key, w.strip()) for key in ("zh", "en", "pinyin") for w in groups.get(key, [])]
            out[category] = [w if key == "zh" else w.lower() for key, w in words if w]
    return out


def vocabulary_frame(spark, vocabulary: dict[str, list[str]]) -> DataFrame:
    """(category, word_pos, word, parts): the vocabulary as a table; its size is the
    configuration's, not the data's."""
    rows = [(c, i, w, w.split()) for c, words in vocabulary.items() for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "category string, word_pos int, word string, parts array<string>")


def keyword_hits(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(record_id, category, word_pos, word) of df (record_id, tokens): a word hits if all its
    parts are among the tokens. Exploded distinct tokens meet the broadcast word parts, so the
    cost follows tokens, not tokens times words."""
    parts = vocabulary.select("category", "word_pos", "word", F.size("parts").alias("need"), F.explode(F.array_distinct("parts")).alias("token"))
    flat = exploded(df.withColumn("tokens", F.array_distinct("tokens")), "record_id")
    met = flat.join(F.broadcast(parts), "token")
    found = met.groupBy("record_id", "category", "word_pos", "word", "need").agg(F.count(F.lit(1)).alias("have"))
    need = vocabulary.select("category", "word_pos", F.size(F.array_distinct("parts")).alias("distinct_need"))
    return found.join(F.broadcast(need), ["category", "word_pos"]).filter("have = distinct_need").select("record_id", "category", "word_pos", "word")


def hits(tokens: Column, words: list[str]) -> Column:
    """The words that hit, in order, as an array: no shuffle. For row-wise scoring."""
    if not words:
        return F.array().cast("array<string>")
    single = F.array(*[F.lit(w) for w in words])
    return F.filter(single, lambda w: F.forall(F.split(w, " "), lambda p: F.array_contains(tokens, p)))


def is_dating_bait(tokens: Column, lang: Column) -> Column:
    found = F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in fixed.DATING_BAIT])))
    return lang.isin("en", "mixed") & ((found >= 2) | ((found >= 1) & (F.size(tokens) <= 12)))


def score(df: DataFrame, vocabulary: dict[str, list[str]], scheme: Scheme, phish_weight: float | None = None) -> DataFrame:
    """Adds hits (map category -> words), scores (map category -> double) and the combo flags.
    df: record_id, tokens, display_domain_mismatch, url_suspicious, url_sender_mismatch, lang
    (nulls: no structural row)."""
    weight = scheme.phish_weight if phish_weight is None else phish_weight
    tokens, yes = F.col("tokens"), lambda c: F.coalesce(F.col(c), F.lit(False))
    out = df.withColumn("hits", F.create_map(*[x for c in scheme.ids for x in (F.lit(c), hits(tokens, vocabulary.get(c, [])))]))
    keywords = F.size(F.element_at("hits", PHISH)) * F.lit(float(weight))
    out = out.withColumn("_kw", keywords)
    mismatch, short, bait = yes("url_sender_mismatch"), F.size(tokens) <= 8, F.coalesce(is_dating_bait(tokens, F.col("lang")), F.lit(False))
    out = out.withColumn("strong_mismatch", yes("display_domain_mismatch")).withColumn("strong_susp", yes("url_suspicious"))
    out = out.withColumn("combo_kw", mismatch & (F.col("_kw") >= 0.5)).withColumn("combo_short", mismatch & (F.col("_kw") < 0.5) & short)
    out = out.withColumn("combo_dating", mismatch & (F.col("_kw") < 0.5) & ~short & bait)
    strong = F.col("_kw") + F.col("strong_mismatch").cast("int") * 2.0 + F.col("strong_susp").cast("int") * 2.0
    phish = F.when(F.col("combo_kw"), strong + 0.5).when(F.col("combo_short") | F.col("combo_dating"), F.greatest(strong, F.lit(1.0))).otherwise(strong)
    scores = [x for c in scheme.ids for x in (F.lit(c), phish if c == PHISH else F.size(F.element_at("hits", c)).cast("double"))]
    return out.withColumn("scores", F.create_map(*scores)).drop("_kw")


def best(scores: Column, priority: dict[str, int], least: float) -> Column:
    """The category with the largest score, ties by priority; null below the least score."""
    ranked = F.array_max(F.array(*[F.struct(F.element_at(scores, c).alias("s"), F.lit(-p).alias("p"), F.lit(c).alias("c")) for c, p in priority.items()]))
    return F.when(ranked["s"] >= least, ranked["c"])


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later filters leave where it is: as the one element of an exploded array.
    A filter on a plain expression is moved below it, and the whole expression is computed twice."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def category_id(category: Column, scheme: Scheme) -> Column:
    ids = {**scheme.ids, UNCLASSIFIED: UNCLASSIFIED_ID, EMPTY: EMPTY_ID}
    return F.create_map(*[F.lit(x) for item in ids.items() for x in item])[category]


def classify(df: DataFrame, vocabulary: dict[str, list[str]], scheme: Scheme, phish_weight: float | None = None, least: float = 1.0) -> DataFrame:
    """The rule pass: score()'s columns with category and cluster_id."""
    out = score(df, vocabulary, scheme, phish_weight)
    label = F.when(F.size("tokens") == 0, EMPTY).otherwise(F.coalesce(best(F.col("scores"), scheme.priority, least), F.lit(UNCLASSIFIED)))
    return settled(out, "category", label).withColumn("cluster_id", category_id(F.col("category"), scheme))


def distribution(labels: DataFrame) -> DataFrame:
    """category, count, pct of all rows (two places)."""
    counted = labels.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # over a row for each category
    return counted.select("category", "count", F.round(F.lit(100.0) * F.col("count") / total, 2).alias("pct"))


def top_hit_words(labels: DataFrame, k: int = 20) -> DataFrame:
    """category, rank, token, count: the words that won their rows' categories."""
    flat = labels.filter(~F.col("category").isin(EMPTY, UNCLASSIFIED)).select("category", F.explode(F.element_at("hits", F.col("category"))).alias("token"))
    counted = flat.groupBy("category", "token").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("count"), "token"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= k)


def signal_counts(labels: DataFrame) -> DataFrame:
    """One row: the combo flags among phishing winners."""
    return labels.filter(F.col("category") == PHISH).agg(*[F.count_if(F.col(c)).alias(c) for c in COMBOS])


def near_misses(df: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """category, count of rows with exactly one hit there."""
    one = [F.struct(F.lit(c).alias("category"), F.size(hits(F.col("tokens"), words)).alias("n")) for c, words in vocabulary.items()]
    flat = df.select(F.explode(F.array(*one)).alias("h")).select("h.category", "h.n").filter("n = 1")
    return flat.groupBy("category").agg(F.count(F.lit(1)).alias("count"))


def what_if(df: DataFrame, vocabulary: dict[str, list[str]], scheme: Scheme, configs: list[tuple[str, float, dict[str, int]]]) -> DataFrame:
    """config, category, count under several phishing weights and priorities: scored once at half
    weight; only the share of the words changes with the weight, that of the structure stays."""
    out = score(df, vocabulary, scheme, 0.5)
    n = F.size(F.element_at("hits", PHISH))
    labels = []
    for name, weight, priority in configs:
        at = {c: F.element_at("scores", PHISH) - 0.5 * n + weight * n if c == PHISH else F.element_at("scores", c) for c in scheme.ids}
        top = F.array_max(F.array(*[F.struct(at[c].alias("s"), F.lit(-p).alias("p"), F.lit(c).alias("c")) for c, p in priority.items()]))
        label = F.when(F.size("tokens") == 0, EMPTY).when(top["s"] >= 1.0, top["c"]).otherwise(UNCLASSIFIED)
        labels.append(F.struct(F.lit(name).alias("config"), label.alias("category")))
    return out.select(F.explode(F.array(*labels)).alias("x")).groupBy("x.config", "x.category").agg(F.count(F.lit(1)).alias("count"))


def _evidence(labels: DataFrame, vocabulary: dict[str, list[str]], scheme: Scheme) -> DataFrame:
    """labels (classify's columns) scored at half weight, with number_of words by category, and
    whether structure speaks."""
    known = [c for c in labels.columns if c not in ("hits", "scores", *COMBOS)]
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = score(labels.select(*known), vocabulary, scheme, 0.5)
    return out.withColumn("structure", yes("display_domain_mismatch") | yes("url_suspicious") | yes("url_sender_mismatch"))


def contamination(labels: DataFrame, vocabulary: dict[str, list[str]], scheme: Scheme) -> DataFrame:
    """One row of diagnostics on the adult and phishing sets. labels also has text."""
    adult, phish = F.col("category") == ADULT, F.col("category") == PHISH
    n, s = (lambda c: F.size(F.element_at("hits", c))), (lambda c: F.element_at("scores", c))
    english = ~F.coalesce("text", F.lit("")).rlike("[一-鿿]")
    linked = F.exists("tokens", lambda t: F.lower(t) == "[url]")
    helped = reduce(lambda a, b: a | b, [F.col(c) for c in COMBOS])
    tie = (F.abs(s(ADULT) - s(PHISH)) < 1e-9) & (s(PHISH) > 0)
    return _evidence(labels, vocabulary, scheme).agg(
        F.count_if(adult).alias("adult"), F.count_if(adult & (n(PHISH) > 0)).alias("adult_with_phish_words"), F.count_if(adult & F.col("structure")).alias("adult_with_structure"),
        F.count_if(adult & tie).alias("adult_tie_over_phish"), F.count_if(adult & (n(ADULT) <= 1)).alias("adult_one_word"), F.count_if(adult & english & linked & (F.size("tokens") <= 12)).alias("adult_english_bait"),
        F.count_if(phish).alias("phish"), F.count_if(phish & helped).alias("phish_helped_by_structure"), F.count_if(phish & ~helped).alias("phish_words_only"),
    )


def noise_words(labels: DataFrame, vocabulary: dict[str, list[str]], scheme: Scheme, k: int = 30) -> DataFrame:
    """rank, word, count: the only adult word of adult rows that structure calls phishing."""
    some = _evidence(labels.filter(F.col("category") == ADULT), vocabulary, scheme)
    only = F.when((F.size(F.element_at("hits", ADULT)) == 1) & F.col("structure"), F.element_at("hits", ADULT)[0])
    one = settled(some, "word", only).filter("word is not null").select("word")
    counted = one.groupBy("word").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "word").limit(k)
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "word"))).select("rank", "word", "count")


def stolen_phishing(labels: DataFrame, vocabulary: dict[str, list[str]], scheme: Scheme, k: int = 3) -> DataFrame:
    """category, count, examples (the first k records): rows with two phishing words or more, as many
    as of any category, that another label won."""
    some = _evidence(labels, vocabulary, scheme)
    n = {c: F.size(F.element_at("hits", c)) for c in scheme.ids}
    lost = settled(some, "_lost", (n[PHISH] >= 2) & (n[PHISH] == F.greatest(*n.values())) & (F.col("category") != PHISH)).filter("_lost")
    place = F.row_number().over(Window.partitionBy("category").orderBy("record_id"))
    ranked = lost.select("category", "record_id", place.alias("r"))
    first = F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= k, F.struct("r", F.col("record_id").cast("string").alias("id"))))), lambda x: x["id"])
    return ranked.groupBy("category").agg(F.count(F.lit(1)).alias("count"), F.array_join(first, ",").alias("examples"))


def _said(blob: Column, tokens: Column, words: list[str]) -> Column:
    """Any of the words as a token or anywhere in the blob."""
    pattern = "|".join(w.replace(".", r"\.") for w in words)
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words])) | blob.rlike(pattern)


def text_blob(subject: Column, content: Column, fromname: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (subject, content, fromname)]))


def fallback_rules(scheme: Scheme, blob: Column, tokens: Column, lang: Column) -> list[tuple[Column, str, str]]:
    """The cascade as data: (condition, category, method), the first that holds wins."""
    words, p = fixed.FALLBACK, scheme.profile
    said = lambda name: _said(blob, tokens, words[name])
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    lang = F.coalesce(lang, F.lit("unknown"))
    size, western = F.size(tokens), lang.isin("en", "mixed")
    linked = F.array_contains(tokens, "[url]") & western
    bait = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in fixed.DATING_BAIT]))
    text_only = _said(blob, tokens, ["text"]) & (F.size(F.array_distinct(tokens)) <= 8)
    rules = [
        (said("gambling"), p["gambling"], "heuristic_gambling"),
        (said("invoice"), p["invoice"], "heuristic_invoice"),
        (said("invoice_short") | text_only, p["invoice"], "heuristic_invoice_short"),
        (said("adult_zh"), ADULT, "heuristic_porn_zh"),
        (linked & (bait | said("greetings")), ADULT, "heuristic_dating_url"),
        (linked, ADULT, "heuristic_url_en"),
        (said("drugs") | (said("drugs_short") & said("drugs_context")), ADULT, "heuristic_ed_spam"),
        (said("phish_zh"), PHISH, "heuristic_phish_zh"),
        (said("phish_en"), PHISH, "heuristic_phish_en"),
        (yes("url_sender_mismatch") & (size <= 15), PHISH, "heuristic_url_mismatch_short"),
        (yes("display_domain_mismatch") | yes("url_suspicious"), PHISH, "heuristic_struct_phish"),
        (said("academic_zh"), p["academic"], "heuristic_academic"),
        (said("academic_en"), p["academic"], "heuristic_academic_en"),
        (said("ads_zh"), p["ads"], "heuristic_ads_zh"),
        (said("ads_en"), p["ads"], "heuristic_ads_en"),
        ((lang == "zh") | F.exists(tokens, lambda t: t.rlike("[一-鿿]")), p["ads"], "heuristic_default_zh"),
        (size <= 6, PHISH, "heuristic_default_short"),
        (western, ADULT, "heuristic_default_en"),
        (F.lit(True), p["ads"], "heuristic_default"),
    ]
    return [r for r in rules if r[1] is not None]


def force_audit(forced: DataFrame) -> DataFrame:
    """The rows that force() gave a category: record_id, previous_category, category, cluster_id,
    method, token_count, text_preview (200 characters)."""
    some = forced.filter("method is not null")
    return some.select("record_id", F.col("category").alias("previous_category"), F.col("forced_category").alias("category"), F.col("forced_id").alias("cluster_id"), "method", F.size("tokens").alias("token_count"), F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("text_preview"))


def force(df: DataFrame, vocabulary: dict[str, list[str]], scheme: Scheme) -> DataFrame:
    """df with blob and a category column: rows labelled UNCLASSIFIED get a category by the rules
    at half the threshold, then by any score, then by the cascade; the others stay. Adds
    forced_category and method (null where nothing was forced)."""
    known = [c for c in df.columns if c not in ("hits", "scores", *COMBOS)]
    base = df.select(*known).withColumn("tokens", lower_ascii(F.col("tokens")))
    scored = score(base, vocabulary, scheme, 0.5)
    rules = fallback_rules(scheme, F.col("blob"), F.col("tokens"), F.col("lang"))
    steps = [(best(F.col("scores"), scheme.force_priority, 1.0), "rule_min1"), (best(F.col("scores"), scheme.force_priority, 0.5), "rule_any"), (best(F.col("scores"), scheme.force_priority, 1e-12), "rule_weak")]
    choice = F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("category"), F.lit(m).alias("method"))) for c, m in steps], *[F.when(cond, F.struct(F.lit(c).alias("category"), F.lit(m).alias("method"))) for cond, c, m in rules])
    out = settled(scored, "_choice", F.when(F.col("category") == UNCLASSIFIED, choice))
    out = out.withColumn("forced_category", F.coalesce(F.col("_choice.category"), F.col("category"))).withColumn("method", F.col("_choice.method")).drop("_choice")
    return out.withColumn("forced_id", category_id(F.col("forced_category"), scheme))
