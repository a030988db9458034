"""Golden cases of the cleaning and normalising rules."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenmill.functions import fixed, text, udfs
from lumenmill.operators import structural, vocab

STEP = udfs.Normaliser()


def test_clean_value():
    assert udfs.clean_text("ＱＱ：１２３　①㎡") == "QQ:123 1m2"
    assert udfs.clean_text(' "a &amp; b\n c" ') == "a & b c"
    assert udfs.clean_text('"') == '"'


@pytest.mark.parametrize(
    "given_, wanted",
    [("2020-01-01T00:00:00Z", "2020-01-01T00:00:00+00:00"), ("20200101", "2020-01-01T00:00:00"), (" 2020-01-01 00:00:00+0800 ", "2020-01-01T00:00:00+08:00"), ("yesterday", None), (None, None)],
)
def test_timestamps(given_, wanted):
    assert udfs.iso_text(given_) == wanted


@pytest.mark.parametrize(
    "given_, wanted",
    [
        ("加微信号 we chat WECHAT wechat", "加 [WECHAT] [WECHAT] WECHAT [WECHAT]"),
        ("S C I paper I a m b [URL] Q Q Q", "SCI paper IAMB [URL] QQQ"),
        ("SC I 论文", "SCI 论文"),
        ("增值 w 发票", "增值发票"),
        ("买 A 股票", "买 A 股票"),
        ("蕟/漂", "发票"),
        ("加威信", "加 [WECHAT]"),
        ("http://x.cn/dating-site/a1.", "[URL] dating site"),
        ("咑电话 13812345678 繒値", "打电话 [PHONE] 增値"),
    ],
)
def test_normalise(given_, wanted):
    assert STEP(given_)["text"] == wanted


def test_subject_and_audit():
    assert STEP("Re: Fwd：报价", True)["text"] == "报价"
    assert STEP("Re: ", True)["text"] == ""
    out = STEP("增值 w 发票 买 A 股票")
    assert out["audit"] == [{"left": "增值", "letters": "w", "right": "发票买 A 股票"}]
    assert out["counters"]["LETTER_DROPPED"] == 1 and out["counters"]["LETTER_KEPT"] == 1
    assert STEP(None) is None and STEP("")["text"] == ""


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 微信票发加威Q1元.@/:-www", max_size=40))
def test_alphabet(value):
    import re

    left = re.sub(fixed.PLACEHOLDER, "", STEP(value)["text"])
    assert re.fullmatch("[A-Za-z一-鿿 ]*", left)


def test_native_steps(spark):
    df = spark.createDataFrame([("我 们 好 a 好", "see http://a.com/x?e=a@b.com, www.x.cn/路 end"), ("x", "QQ：12345 010-12345678 188圆")], "a string, b string")
    rows = df.select(text.merge_zh(F.col("a")), text.mask_contacts(F.col("b"))).collect()
    assert rows[0][0] == "我们好 a 好" and rows[0][1] == "see [URL] [URL]路 end"
    assert rows[1][1] == "[QQ] [PHONE] [MONEY]"
    assert df.select(text.keep_charset(F.lit("加[WECHAT]号[URL]ab12"))).first()[0] == "加 [WECHAT] 号 [URL] ab"
    assert df.select(text.strip_subject_prefix(F.lit("Re: Fwd：报价"))).first()[0] == "报价"
    assert df.select(text.strip_json_fence(F.lit('```json\n{"a": 1}\n```'))).first()[0] == '{"a": 1}'


def test_structural(spark):
    one = spark.range(1)
    first = lambda c: one.select(c).first()[0]
    assert first(structural.domain_in_text(F.lit("paypal.com"))) == "" and first(structural.domain_in_text(F.lit("x mail.PayPal.com y"))) == "mail.paypal.com"
    assert first(structural.url_hosts(F.lit("http://www.web.com/a https://w3.org:80 HTTP://www.web.com"))) == ["eb.com", "3.org"]
    assert first(structural.reputation_max(F.lit("0.02;x;0.92;"))) == 0.92 and first(structural.reputation_max(F.lit(None).cast("string"))) == 0.0
    assert first(structural.language(F.lit("你好 ab"))) == "zh" and first(structural.language(F.lit("你 abc"))) == "mixed" and first(structural.language(F.lit("12"))) == "unknown"
    row = {"record_id": "1", "from": '"PayPal mail.paypal.com" <a@evil.example.org>', "sender": None, "fromname": "x", "url": "http://www.a.example.net/login", "htmlurl": None, "attach": " ", "domainrep": "0.123456", "subject": None, "content": "hi"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{c}` string" for c in row))
    got = structural.structural_features(df).first()
    assert (got.sender_domain, got.display_domain, got.display_domain_mismatch, got.url_sender_mismatch, got.url_suspicious, got.has_attach) == ("evil.example.org", "mail.paypal.com", True, True, True, False)


def test_apply_and_ask():
    out = vocab.apply_proposal({"categories": {"A": {"en": ["x"]}}}, [{"recommend": True, "already_in_taxonomy": False, "category": "A", "lang": "en", "word": "y"}, {"recommend": False, "already_in_taxonomy": False, "category": "A", "lang": "en", "word": "z"}], "now")
    assert out["categories"]["A"]["en"] == ["x", "y"] and out["_updated"] == "now"
    waits, answers = [], [TimeoutError(), "ok"]

    def call(_):
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert vocab.ask(call, "q", wait=waits.append) == "ok" and waits == [10]
