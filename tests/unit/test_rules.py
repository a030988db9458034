"""Scores, labels, fallback, themes and residual types on literal rows."""

import pytest
from pyspark.sql import functions as F

from lumenmill.functions.fixed import ADULT, COMMERCIAL, EMPTY, INVOICE, PHISH, UNCLASSIFIED
from lumenmill.operators import rules, themes, tokens
from lumenmill.operators.rules import SCHEME1, SCHEME2

VOCABULARY = {ADULT: ["aa", "bb cc"], PHISH: ["pp", "qq"]}
SCHEMA = "record_id int, tokens array<string>, display_domain_mismatch boolean, url_suspicious boolean, url_sender_mismatch boolean, lang string"


def label(spark, rows, scheme=SCHEME1, weight=None):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    got = rules.classify(df, VOCABULARY, scheme, weight).orderBy("record_id").collect()
    return [(r.category, r.scores[PHISH]) for r in got]


def test_bonuses_and_ties(spark):
    long9 = [f"t{i}" for i in range(9)]
    got = label(
        spark,
        [
            (["pp"], False, False, True, "zh"), (["x"] * 8, False, False, True, "zh"), (long9, False, False, True, "zh"), ([], None, None, None, None), (["aa", "pp", "qq"], None, None, None, None), (["cc", "z", "bb"], None, None, None, None),
            ([*long9, "visit"], False, False, True, "en"), (["x"], True, True, False, "en"),
        ],
    )
    assert got == [(PHISH, 1.0), (PHISH, 1.0), (UNCLASSIFIED, 0.0), (EMPTY, 0.0), (ADULT, 1.0), (ADULT, 0.0), (PHISH, 1.0), (PHISH, 4.0)]
    assert label(spark, [(["aa", "pp"], None, None, None, None)], SCHEME2)[0][0] == PHISH


def test_force(spark):
    rows = [(["pp"], ""), (["text"], "some text"), (["x"], "增值税"), (["[url]"], "hello man"), (["[url]"], "zzz"), ([f"t{i}" for i in range(20)], "plain"), (["y"], "erectile"), (["n"], "qqq")]
    df = spark.createDataFrame([(i, t, False, False, False, "en", b, UNCLASSIFIED) for i, (t, b) in enumerate(rows)], SCHEMA + ", blob string, category string")
    got = [(r.forced_category, r.method) for r in rules.force(df, VOCABULARY, SCHEME2).orderBy("record_id").collect()]
    assert got == [
        (PHISH, "rule_any"), (INVOICE, "heuristic_invoice_short"), (INVOICE, "heuristic_invoice"), (ADULT, "heuristic_dating_url"), (ADULT, "heuristic_url_en"), (ADULT, "heuristic_default_en"), (ADULT, "heuristic_ed_spam"), (PHISH, "heuristic_default_short"),
    ]
    kept = rules.force(df.withColumn("category", F.lit(COMMERCIAL)), VOCABULARY, SCHEME2).select("forced_category", "method").distinct().collect()
    assert [tuple(r) for r in kept] == [(COMMERCIAL, None)]


def test_flatten_keeps_repeats():
    assert rules.flatten({"_note": 1, "categories": {"A": {"zh": ["票"], "en": ["X", "x", " "]}, "_b": {}}}) == {"A": ["票", "x", "x"]}


def test_hits_agree(spark):
    df = spark.createDataFrame([(1, ["bb", "cc", "aa"]), (2, ["bb"]), (3, [])], "record_id int, tokens array<string>")
    joined = rules.keyword_hits(df, rules.vocabulary_frame(spark, VOCABULARY)).select("record_id", "word").collect()
    assert sorted(map(tuple, joined)) == [(1, "aa"), (1, "bb cc")]
    assert df.select(rules.hits(F.col("tokens"), VOCABULARY[ADULT])).first()[0] == ["aa", "bb cc"]


def test_themes_and_residue(spark):
    df = spark.createDataFrame([("casino poker 发票", ["a"], False), ("x", ["a"], True), ("x", ["a"], False), (" ", [], False), ("发票 开票 sex", ["a"], False)], "blob string, tokens array<string>, suspicious boolean")
    got = [(r.theme, r.four_class) for r in themes.profile(df).collect()]
    assert [g[0] for g in got] == ["gambling", "phish_account", "__none__", "__empty__", "invoice"] and got[4][1] == "财税发票" and got[3][1] == "空样本"
    kinds = spark.createDataFrame([(["a"], "en", False), (["[URL]"] * 6, "en", False), (["x"] * 11 + ["产品"], "zh", False), (["x"] * 12, "en", True), (["x"] * 12, "en", False), (["票"] * 12, "zh", False), (["x"] * 30, "en", False)], "t array<string>, l string, s boolean")
    got = [r[0] for r in kinds.select(themes.residual_type(F.col("t"), F.col("l"), F.col("s"))).collect()]
    assert got == ["极短/仅URL电话姓名", "短文本+URL/电话", "B2B/产品/零售营销", "可疑链接但无语义词", "英文日常体/泛词邮件", "中文短碎片/变体spam", "其他长文未命中"]


def test_short_and_segmenter(spark):
    df = spark.createDataFrame([(["a"] * 8,), (["a"] * 13,), (["[URL]"] * 7 + ["a"] * 3,), (["a"] * 10,)], "t array<string>")
    assert [r[0] for r in df.select(tokens.is_short(F.col("t"))).collect()] == [True, False, True, False]
    cut = tokens.LongestMatch(["增值税发票", "发票", "开"])
    assert cut("开增值税发票x发票") == ["开", "增值税发票", "x", "发票"]
    df = spark.createDataFrame([("加[URL]发票 abc",), (None,)], "t string")
    assert [r[0] for r in df.select(tokens.segmented(cut)("t")).collect()] == [["加", "[URL]", "发票", "abc"], []]


@pytest.mark.parametrize("hits, wrong, wanted", [(21, 10, False), (3, 0, True), (1, 0, False), (20, 3, True), (3, 1, True)])
def test_recommend_formula(spark, hits, wrong, wanted):
    from lumenmill.operators import vocab

    rows = [(i, ["w"], PHISH if i < wrong else ADULT) for i in range(hits)]
    df = spark.createDataFrame(rows, "record_id int, tokens array<string>, label string")
    proposal = spark.createDataFrame([(ADULT, "en", "w")], "category string, lang string, word string")
    got = vocab.validate(proposal, df, rules.vocabulary_frame(spark, VOCABULARY)).first()
    assert (got.corpus_hits, got.false_positive_hits, got.recommend) == (hits, wrong, wanted)
