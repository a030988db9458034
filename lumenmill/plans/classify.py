"""Queries of tokens, structure, rules, fallback and themes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenmill.functions import fixed, text
from lumenmill.functions.fixed import PHISH, UNCLASSIFIED
from lumenmill.operators import rules, structural, themes, tokens
from lumenmill.operators.rules import SCHEME1, SCHEME2
from lumenmill.plans.tables import BASE, COMBOS, KEPT, LABELS, MSG, STRUCT, TOK, VOCABULARY, VOCABULARY2, best_sql, hit_sql, label_sql, messages, names, q, read, score_sql, scored_input, token_table

CATS = list(SCHEME1.ids)
CATS2 = list(SCHEME2.ids)
#: The five settings of the diagnostics: words at half weight, three quarters and whole, with the
#: force pass's priority, then with phishing first.
CONFIGS = [("0.5, adult first", 0.5, SCHEME2.force_priority), ("0.75, adult first", 0.75, SCHEME2.force_priority), ("1.0, adult first", 1.0, SCHEME2.force_priority), ("0.75, phishing first", 0.75, SCHEME2.priority), ("1.0, phishing first", 1.0, SCHEME2.priority)]


def _labels(spark, sf):
    return rules.classify(scored_input(spark, sf), VOCABULARY, SCHEME1)


def _labels2(spark, sf):
    return rules.classify(scored_input(spark, sf), VOCABULARY2, SCHEME2)


def _forced(spark, sf):
    labels = _labels(spark, sf).withColumn("blob", rules.text_blob(F.lit(""), F.col("text"), F.col("source")))
    return rules.force(labels, VOCABULARY, SCHEME1)


def _profiled(spark, sf):
    df = scored_input(spark, sf).withColumn("blob", themes.text_and_tokens(F.col("text"), F.col("tokens")))
    return themes.profile(df.withColumn("suspicious", F.coalesce("display_domain_mismatch", F.lit(False)) | F.coalesce("url_suspicious", F.lit(False)) | F.coalesce("url_sender_mismatch", F.lit(False))))


def _flat(tokens_column="tokens"):
    return F.array_join(tokens_column, " ").alias("tokens")


def _force_sql() -> str:
    """The forced labels: rules at 1.0, 0.5, any; then the cascade."""
    w, p = fixed.FALLBACK, SCHEME1.profile
    said = lambda name: f"(list_has_any(tokens, {names(w[name])}) OR regexp_matches(blob, {q('|'.join(x.replace('.', chr(92) + '.') for x in w[name]))}))"
    linked = "(list_contains(tokens, '[url]') AND lang IN ('en', 'mixed'))"
    zh = "len(list_filter(tokens, lambda t: regexp_matches(t, '[一-鿿]'))) > 0"
    rules_ = [
        (said("gambling"), p["gambling"], "heuristic_gambling"), (said("invoice"), p["invoice"], "heuristic_invoice"),
        (f"{said('invoice_short')} OR ((list_contains(tokens, 'text') OR contains(blob, 'text')) AND len(list_distinct(tokens)) <= 8)", p["invoice"], "heuristic_invoice_short"),
        (said("adult_zh"), fixed.ADULT, "heuristic_porn_zh"), (f"{linked} AND (list_has_any(tokens, {names(fixed.DATING_BAIT)}) OR {said('greetings')})", fixed.ADULT, "heuristic_dating_url"), (linked, fixed.ADULT, "heuristic_url_en"),
        (f"{said('drugs')} OR ({said('drugs_short')} AND {said('drugs_context')})", fixed.ADULT, "heuristic_ed_spam"), (said("phish_zh"), PHISH, "heuristic_phish_zh"), (said("phish_en"), PHISH, "heuristic_phish_en"),
        ("away AND len(tokens) <= 15", PHISH, "heuristic_url_mismatch_short"), ("strong_mismatch OR strong_susp", PHISH, "heuristic_struct_phish"), (said("academic_zh"), p["academic"], "heuristic_academic"),
        (said("academic_en"), p["academic"], "heuristic_academic_en"), (said("ads_zh"), p["ads"], "heuristic_ads_zh"), (said("ads_en"), p["ads"], "heuristic_ads_en"), (f"coalesce(lang, '') = 'zh' OR {zh}", p["ads"], "heuristic_default_zh"),
        ("len(tokens) <= 6", PHISH, "heuristic_default_short"), ("lang IN ('en', 'mixed')", fixed.ADULT, "heuristic_default_en"), ("true", p["ads"], "heuristic_default"),
    ]
    best = [(best_sql(SCHEME1, least, SCHEME1.force_priority), method) for least, method in ((1.0, "rule_min1"), (0.5, "rule_any"), (1e-12, "rule_weak"))]
    category = " ".join([f"WHEN {b} IS NOT NULL THEN {b}" for b, _ in best] + [f"WHEN {c} THEN {q(cat)}" for c, cat, _ in rules_])
    method = " ".join([f"WHEN {b} IS NOT NULL THEN {q(m)}" for b, m in best] + [f"WHEN {c} THEN {q(m)}" for c, _, m in rules_])
    return f"""{LABELS}, blobbed AS (SELECT *, lower(' ' || coalesce(text, '') || ' ' || coalesce(source, '')) AS blob FROM (SELECT lab.*, d.source FROM lab JOIN documents d ON d.doc_id = lab.record_id)), forced AS (
  SELECT record_id, category AS previous_category, CASE WHEN category <> {q(UNCLASSIFIED)} THEN category ELSE CASE {category} END END AS forced_category,
    CASE WHEN category = {q(UNCLASSIFIED)} THEN CASE {method} END END AS method FROM blobbed
)"""


def _theme_sql() -> str:
    def count(words):
        parts = [f"(CASE WHEN list_contains(runs, {q(w)}) THEN 1 ELSE 0 END)" if w.isascii() and w.isalnum() else f"(CASE WHEN contains(blob, {q(w)}) THEN 1 ELSE 0 END)" for w in words]
        return " + ".join(parts)

    order = ["porn_media", "porn_dating", "health_pharma", "gambling", "phish_account", "phish_scam", "invoice", "academic", "commercial"]
    top = "greatest(" + ", ".join(order) + ")"
    best = "CASE WHEN " + top + " = 0 THEN NULL " + " ".join(f"WHEN {t} = {top} THEN '{t}'" for t in order) + " END"
    four = "CASE WHEN " + top + " = 0 THEN NULL " + " ".join(f"WHEN {t} = {top} THEN {q(c)}" for t, c in fixed.FOUR_CLASSES.items()) + " END"
    return f"""{BASE}, b AS (
  SELECT tok.record_id, tokens, lower(coalesce(text, '') || ' ' || array_to_string(tokens, ' ')) AS blob, regexp_extract_all(lower(coalesce(text, '') || ' ' || array_to_string(tokens, ' ')), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS runs, coalesce(display_domain_mismatch, false) OR coalesce(url_suspicious, false) OR coalesce(url_sender_mismatch, false) AS suspicious FROM tok LEFT JOIN st USING (record_id)
), th AS (SELECT *, {", ".join(f"{count(w)} AS {t}" for t, w in fixed.THEMES.items())} FROM b), pr AS (
  SELECT *, CASE WHEN trim(blob) = '' AND len(tokens) = 0 THEN '__empty__' ELSE coalesce({best}, CASE WHEN suspicious THEN 'phish_account' END, '__none__') END AS theme,
    CASE WHEN trim(blob) = '' AND len(tokens) = 0 THEN '空样本' ELSE coalesce({four}, CASE WHEN NOT suspicious AND regexp_matches(blob, '[一-鿿]') THEN '商业·学术·博彩营销' ELSE '网络钓鱼与诈骗' END) END AS four_class FROM th
)"""


def _residual_sql() -> str:
    other = fixed.RESIDUAL_OTHER
    any_ = lambda words: f"(regexp_matches(array_to_string(tokens, ' '), {q('|'.join(words))}) OR list_has_any(tokens, {names(words)}))"
    cases = [f"WHEN len(tokens) <= 5 THEN {q(other[0])}", f"WHEN len(tokens) <= 10 AND len(list_filter(tokens, lambda t: t[1] = '[' AND t[-1] = ']')) > 0 THEN {q(other[1])}"]
    cases += [f"WHEN {any_(w)} THEN {q(n)}" for n, w in fixed.RESIDUAL_TYPES.items()]
    cases += [f"WHEN away OR strong_susp THEN {q(other[2])}", f"WHEN lang = 'en' AND len(tokens) <= 20 THEN {q(other[3])}", f"WHEN lang = 'zh' AND len(tokens) <= 15 THEN {q(other[4])}", f"ELSE {q(other[5])}"]
    return f"{LABELS} SELECT CASE {' '.join(cases)} END AS residual_type, count(*) AS count FROM lab WHERE category = {q(UNCLASSIFIED)} GROUP BY 1"


def _residual(spark, sf):
    rest = _labels(spark, sf).filter(F.col("category") == UNCLASSIFIED)
    kind = themes.residual_type(F.col("tokens"), F.col("lang"), F.coalesce("url_sender_mismatch", F.lit(False)) | F.coalesce("url_suspicious", F.lit(False)))
    return rest.groupBy(kind.alias("residual_type")).agg(F.count(F.lit(1)).alias("count"))


LABELS2 = f"{BASE}, {score_sql(SCHEME2, None, 'sc', VOCABULARY2)}, {label_sql(SCHEME2)}"
#: The labels with hits and scores at half weight.
EVIDENCE = f"{LABELS2}, {score_sql(SCHEME2, 0.5, 'ev', VOCABULARY2)}, e AS (SELECT ev.*, lab.category, strong_mismatch OR strong_susp OR away AS structure FROM ev JOIN (SELECT record_id, category FROM lab) AS lab USING (record_id))"


def _what_if_sql() -> str:
    p, selects = CATS2.index(PHISH), []
    for name, weight, priority in CONFIGS:
        at = {c: f"(s{i} - 0.5 * len(h{i}) + {weight} * len(h{i}))" if i == p else f"s{i}" for i, c in enumerate(CATS2)}
        top = "greatest(" + ", ".join(at.values()) + ")"
        cases = " ".join(f"WHEN {at[c]} = {top} THEN {q(c)}" for c, _ in sorted(priority.items(), key=lambda x: x[1]))
        selects.append(f"SELECT {q(name)} AS config, CASE WHEN len(tokens) = 0 THEN {q(fixed.EMPTY)} WHEN {top} < 1 THEN {q(UNCLASSIFIED)} {cases} END AS category FROM ev")
    return f"{BASE}, {score_sql(SCHEME2, 0.5, 'ev', VOCABULARY2)}, x AS ({' UNION ALL '.join(selects)}) SELECT config, category, count(*) AS count FROM x GROUP BY ALL"


def _contamination_sql() -> str:
    a, p = CATS2.index(fixed.ADULT), CATS2.index(PHISH)
    adult, phish = f"category = {q(fixed.ADULT)}", f"category = {q(PHISH)}"
    helped = "(strong_mismatch OR strong_susp OR combo_kw OR combo_short OR combo_dating)"
    columns = {
        "adult": adult, "adult_with_phish_words": f"{adult} AND len(h{p}) > 0", "adult_with_structure": f"{adult} AND structure", "adult_tie_over_phish": f"{adult} AND abs(s{a} - s{p}) < 1e-9 AND s{p} > 0", "adult_one_word": f"{adult} AND len(h{a}) <= 1",
        "adult_english_bait": f"{adult} AND NOT regexp_matches(coalesce(text, ''), '[一-鿿]') AND len(list_filter(tokens, lambda t: lower(t) = '[url]')) > 0 AND len(tokens) <= 12", "phish": phish, "phish_helped_by_structure": f"{phish} AND {helped}", "phish_words_only": f"{phish} AND NOT {helped}",
    }
    return f"{EVIDENCE} SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in columns.items()) + " FROM e"


def _top_hits_sql(k: int = 20) -> str:
    flat = " UNION ALL ".join(f"SELECT category, unnest(h{i}) AS token FROM lab WHERE category = {q(c)}" for i, c in enumerate(CATS))
    return f"{LABELS}, f AS ({flat}), c AS (SELECT category, token, count(*) AS count FROM f GROUP BY ALL) SELECT category, token, count, row_number() OVER (PARTITION BY category ORDER BY count DESC, token)::INTEGER AS rank FROM c QUALIFY rank <= {k}"


def _segmented(spark, sf):
    """Tokens of the segmenter that needs no library, placeholders kept whole, then normalised and
    filtered as the native ones are."""
    docs = read(spark, sf, "documents")
    cut = tokens.segmented(tokens.LongestMatch(tokens.default_lexicon()))
    raw = docs.select(F.col("doc_id").alias("record_id"), cut(text.mask_email(F.col("text"))).alias("raw"))
    return raw.select("record_id", F.size("raw").alias("n"), F.array_join(F.filter(F.transform("raw", lambda t: tokens.normal(t)), lambda t: tokens.kept(t)), " ").alias("tokens"))


QUERIES = {
    "segmented_tokens": _segmented,
    "token_filter": lambda s, d: token_table(s, d).select("record_id", _flat()),
    "token_stats": lambda s, d: tokens.token_stats(token_table(s, d)),
    "token_buckets": lambda s, d: token_table(s, d).groupBy(tokens.length_bucket(F.size("tokens")).alias("bucket")).agg(F.count(F.lit(1)).alias("count")),
    "short_content": lambda s, d: token_table(s, d).groupBy("source").agg(F.count_if(tokens.is_short(F.col("tokens"))).alias("short"), F.count_if(tokens.has_placeholder(F.col("tokens"))).alias("with_placeholder")),
    "top_tokens_by_source": lambda s, d: tokens.top_tokens(token_table(s, d), "source", 25),
    "structural_features": lambda s, d: structural.structural_features(messages(s, d)).withColumn("url_domains", F.array_join("url_domains", ",")),
    "structural_counters": lambda s, d: structural.structural_counters(structural.structural_features(messages(s, d))),
    "keyword_hits": lambda s, d: rules.keyword_hits(token_table(s, d), rules.vocabulary_frame(s, VOCABULARY)),
    "rule_scores": lambda s, d: rules.score(scored_input(s, d), VOCABULARY, SCHEME1).select("record_id", *[F.element_at("scores", c).alias(f"s{i}") for i, c in enumerate(CATS)], *rules.COMBOS),
    "rule_labels": lambda s, d: _labels(s, d).select("record_id", "category", "cluster_id"),
    "rule_labels_balanced": lambda s, d: _labels2(s, d).select("record_id", "category", "cluster_id"),
    "rule_category_distribution": lambda s, d: rules.distribution(_labels(s, d)),
    "top_hit_words": lambda s, d: rules.top_hit_words(_labels(s, d)).select("category", "token", "count", "rank"),
    "signal_counts": lambda s, d: rules.signal_counts(_labels(s, d)),
    "near_misses": lambda s, d: rules.near_misses(token_table(s, d), VOCABULARY),
    "weight_what_if": lambda s, d: rules.what_if(scored_input(s, d), VOCABULARY2, SCHEME2, CONFIGS),
    "contamination": lambda s, d: rules.contamination(_labels2(s, d), VOCABULARY2, SCHEME2),
    "noise_words": lambda s, d: rules.noise_words(_labels2(s, d), VOCABULARY2, SCHEME2),
    "stolen_phishing": lambda s, d: rules.stolen_phishing(rules.classify(scored_input(s, d), VOCABULARY2, SCHEME2, 0.5), VOCABULARY2, SCHEME2),
    "force_audit": lambda s, d: rules.force_audit(_forced(s, d)),
    "taxonomy_words": lambda s, d: rules.vocabulary_frame(s, VOCABULARY).select("category", "word").distinct().join(rules.keyword_hits(token_table(s, d), rules.vocabulary_frame(s, VOCABULARY)).groupBy("category", "word").agg(F.count_distinct("record_id").alias("rows")), ["category", "word"], "left").fillna(0),
    "force_labels": lambda s, d: _forced(s, d).select("record_id", F.col("category").alias("previous_category"), "forced_category", "method"),
    "force_method_stats": lambda s, d: _forced(s, d).filter("method is not null").groupBy("method", "forced_category").agg(F.count(F.lit(1)).alias("count")),
    "theme_multi_label": lambda s, d: themes.multi_label(_profiled(s, d)),
    "theme_best": lambda s, d: _profiled(s, d).groupBy("theme").agg(F.count(F.lit(1)).alias("count")),
    "theme_four_classes": lambda s, d: _profiled(s, d).groupBy("four_class").agg(F.count(F.lit(1)).alias("count")),
    "theme_roll_ups": lambda s, d: themes.roll_ups(_profiled(s, d)),
    "residual_types": _residual,
    "residual_buckets": lambda s, d: themes.residual_buckets(token_table(s, d)),
}

_h = [hit_sql(c) for c in CATS]
_p, _a = CATS.index(PHISH), CATS.index(fixed.ADULT)
_roll = "(VALUES " + ", ".join(f"({q(g)}, {q(m)}, {q(t)})" for g, ms in fixed.ROLL_UPS.items() for m, ts in ms.items() for t in ts) + ") AS r(grouping, macro, theme)"
_words = "(VALUES " + ", ".join(f"({q(c)}, {i}, {q(w)})" for c, ws in VOCABULARY.items() for i, w in enumerate(ws)) + ") AS v(category, word_pos, word)"
_cut = rf"regexp_extract_all(regexp_replace(coalesce(text, ''), {q(fixed.EMAIL)}, '[EMAIL]', 'g'), '{fixed.PLACEHOLDER}|[A-Za-z]+|[一-鿿]+|[^\s\x0B\x85\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}A-Za-z一-鿿\[]+|\[')"
ORACLES = {
    "segmented_tokens": f"WITH r AS (SELECT doc_id AS record_id, {_cut} AS raw FROM documents) SELECT record_id, len(list_filter(raw, lambda t: true))::INTEGER AS n, array_to_string(list_filter(list_transform(raw, lambda t: CASE WHEN regexp_full_match(t, '[A-Za-z]+') THEN lower(t) ELSE t END), lambda t: {KEPT}), ' ') AS tokens FROM r",
    "token_filter": f"WITH {TOK} SELECT record_id, array_to_string(tokens, ' ') AS tokens FROM tok",
    "token_stats": f"WITH {TOK} SELECT count(*) AS records, sum(len(tokens))::BIGINT AS tokens, count(*) FILTER (len(tokens) = 0) AS empty, " + ", ".join(f"sum(len(list_filter(tokens, lambda t: t = {q(x)})))::BIGINT AS {x.strip('[]').lower()}" for x in fixed.PLACEHOLDERS) + " FROM tok",
    "token_buckets": f"WITH {TOK} SELECT CASE WHEN len(tokens) <= 5 THEN '<=5' WHEN len(tokens) <= 10 THEN '6-10' WHEN len(tokens) <= 30 THEN '11-30' WHEN len(tokens) <= 999 THEN '>30' END AS bucket, count(*) AS count FROM tok GROUP BY 1",
    "short_content": f"WITH {TOK} SELECT source, count(*) FILTER (CASE WHEN len(tokens) <= 8 THEN true WHEN len(tokens) > 12 THEN false ELSE len(list_filter(tokens, lambda t: NOT list_contains({names(fixed.PLACEHOLDERS)}, t))) <= 3 END) AS short, count(*) FILTER (len(list_filter(tokens, lambda t: t[1] = '[' AND t[-1] = ']')) > 0) AS with_placeholder FROM tok GROUP BY source",
    "top_tokens_by_source": f"WITH {TOK}, f AS (SELECT source, unnest(tokens) AS token FROM tok), c AS (SELECT source, token, count(*) AS count FROM f WHERE NOT list_contains({names(fixed.PLACEHOLDERS)}, token) GROUP BY ALL) SELECT source, row_number() OVER (PARTITION BY source ORDER BY count DESC, token)::INTEGER AS rank, token, count FROM c QUALIFY rank <= 25",
    "structural_features": f"WITH {MSG}, {STRUCT} SELECT record_id::VARCHAR AS record_id, sender_domain, display_name, display_domain, display_domain_mismatch, url_count, array_to_string(url_domains, ',') AS url_domains, url_sender_mismatch, url_suspicious, domainrep_max, has_attach, lang FROM st",
    "structural_counters": f"WITH {MSG}, {STRUCT} SELECT count(*) AS records, " + ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in ("display_domain_mismatch", "url_sender_mismatch", "url_suspicious", "has_attach")) + ", " + ", ".join(f"count(*) FILTER (lang = '{v}') AS lang_{v}" for v in ("zh", "en", "mixed", "unknown")) + ", count(*) FILTER (url_count > 0) AS with_url, count(*) FILTER (domainrep_max > 0) AS with_reputation FROM st",
    "keyword_hits": f"WITH {TOK} SELECT record_id, category, word_pos, word FROM tok JOIN {_words} ON list_has_all(tokens, string_split(word, ' '))",
    "rule_scores": f"{BASE}, {score_sql()} SELECT record_id, {', '.join(f's{i}' for i in range(5))}, {COMBOS} FROM sc",
    "rule_labels": f"{LABELS} SELECT record_id, category, cluster_id FROM lab",
    "rule_labels_balanced": f"{LABELS2} SELECT record_id, category, cluster_id FROM lab",
    "rule_category_distribution": f"{LABELS} SELECT category, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM lab GROUP BY category",
    "top_hit_words": _top_hits_sql(),
    "signal_counts": f"{LABELS} SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in rules.COMBOS) + f" FROM lab WHERE category = {q(PHISH)}",
    "near_misses": f"WITH {TOK}, n AS (" + " UNION ALL ".join(f"SELECT {q(c)} AS category FROM tok WHERE len({hit_sql(c)}) = 1" for c in CATS) + ") SELECT category, count(*) AS count FROM n GROUP BY category",
    "weight_what_if": _what_if_sql(),
    "contamination": _contamination_sql(),
    "noise_words": f"{EVIDENCE}, w AS (SELECT h{CATS2.index(fixed.ADULT)}[1] AS word FROM e WHERE category = {q(fixed.ADULT)} AND len(h{CATS2.index(fixed.ADULT)}) = 1 AND structure) SELECT row_number() OVER (ORDER BY count(*) DESC, word)::INTEGER AS rank, word, count(*) AS count FROM w GROUP BY word QUALIFY rank <= 30",
    "stolen_phishing": f"{BASE}, {score_sql(SCHEME2, 0.5, 'ev', VOCABULARY2)}, {label_sql(SCHEME2, 0.5, None, 'lab', 'ev')}, l AS (SELECT category, record_id, row_number() OVER (PARTITION BY category ORDER BY record_id) AS r FROM lab WHERE category <> {q(PHISH)} AND len(h{CATS2.index(PHISH)}) >= 2 AND len(h{CATS2.index(PHISH)}) = greatest({', '.join(f'len(h{i})' for i in range(len(CATS2)))})) SELECT category, count(*) AS count, string_agg(record_id::VARCHAR, ',' ORDER BY r) FILTER (r <= 3) AS examples FROM l GROUP BY category",
    "force_audit": f"{_force_sql()} SELECT record_id, previous_category, forced_category AS category, (CASE forced_category {' '.join(f'WHEN {q(c)} THEN {i}' for c, i in SCHEME1.ids.items())} END)::INTEGER AS cluster_id, method, token_count, text_preview FROM forced JOIN (SELECT record_id, len(tokens)::INTEGER AS token_count, coalesce(text, '')[1:200] AS text_preview FROM tok) USING (record_id) WHERE method IS NOT NULL",
    "taxonomy_words": f"WITH {TOK}, v AS (SELECT DISTINCT category, word FROM {_words}) SELECT category, word, count(record_id) AS rows FROM v LEFT JOIN tok ON list_has_all(tokens, string_split(word, ' ')) GROUP BY ALL",
    "force_labels": f"{_force_sql()} SELECT * FROM forced",
    "force_method_stats": f"{_force_sql()} SELECT method, forced_category, count(*) AS count FROM forced WHERE method IS NOT NULL GROUP BY ALL",
    "theme_multi_label": f"{_theme_sql()}, f AS (" + " UNION ALL ".join(f"SELECT '{t}' AS theme, {t} AS n FROM pr" for t in fixed.THEMES) + ") SELECT theme, count(*) AS rows, sum(n)::BIGINT AS hits FROM f WHERE n > 0 GROUP BY theme",
    "theme_best": f"{_theme_sql()} SELECT theme, count(*) AS count FROM pr GROUP BY theme",
    "theme_four_classes": f"{_theme_sql()} SELECT four_class, count(*) AS count FROM pr GROUP BY four_class",
    "theme_roll_ups": f"{_theme_sql()}, c AS (SELECT theme, count(*) AS n FROM pr GROUP BY theme), g AS (SELECT DISTINCT grouping FROM {_roll}) SELECT g.grouping, coalesce(r.macro, '(none)') AS macro, sum(n)::BIGINT AS count FROM c CROSS JOIN g LEFT JOIN {_roll} ON r.grouping = g.grouping AND r.theme = c.theme GROUP BY ALL",
    "residual_types": _residual_sql(),
    "residual_buckets": f"WITH {TOK} " + " UNION ALL ".join(f"SELECT {q(b)} AS bucket, count(*) FILTER (regexp_matches(array_to_string(tokens, ' '), {q('|'.join(w))})) AS count FROM tok" for b, w in fixed.RESIDUAL_BUCKETS.items()),
}
