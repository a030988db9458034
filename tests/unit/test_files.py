"""Readers, writers, streaming."""

import json

from lumenmill.operators.rules import SCHEME1
from lumenmill.sinks import writers
from lumenmill.sources import readers
from lumenmill.streaming import messages


def test_raw_log(spark, tmp_path):
    log = tmp_path / "raw.log"
    log.write_text('1\t{"subject": " Ａ &amp; b ", "@timestamp": "2020-01-01T00:00:00Z", "size": 3}\n\n2\tnot json\n3 no tab\n4\t{"subject": "x\\ty"}\n', encoding="utf-8")
    df = readers.raw_log(spark, str(log))
    assert sorted((r.record_id.split()[0], r.bad) for r in df.collect()) == [("1", False), ("2", True), ("3", True), ("4", False)]
    got = {r.record_id: r for r in readers.cleaned(df).collect()}
    assert got["1"].subject == "A & b" and got["1"].timestamp == "2020-01-01T00:00:00+00:00" and got["1"].size == "3" and got["4"].timestamp is None
    assert "size" not in readers.drop_fields(readers.cleaned(df)).columns


def test_writers_and_labels(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x,y"), ("b", None, None)], "record_id string, cluster_id int, category string")
    writers.csv_file(df, str(tmp_path / "labels.csv"))
    assert (tmp_path / "labels.csv").read_bytes()[:3] == b"\xef\xbb\xbf"
    back = {r.record_id: r for r in readers.labels(spark, str(tmp_path)).collect()}
    assert back["a"].cluster_id == 1 and back["a"].category == "x,y" and back["b"].cluster_id is None
    writers.json_lines(df, str(tmp_path / "labels.jsonl"))
    rows = [json.loads(x) for p in (tmp_path / "labels.jsonl").glob("part-*") for x in p.read_text().splitlines()]
    assert {"record_id": "b", "cluster_id": None, "category": None} in rows
    assert readers.labels(spark, str(tmp_path)).count() == 2
    writers.sheet(df.withColumnRenamed("category", "text"), str(tmp_path / "s.xlsx"))
    assert list(tmp_path.glob("s.*"))
    assert writers.prefixed("a/b.csv", "p", "v") == "a/p_b_v.csv" and writers.prefixed("b", "p") == "p_b"
    writers.report({"T": df}, str(tmp_path / "r.md"))
    assert "| a | 1 | x,y |" in (tmp_path / "r.md").read_text()


def test_last_wins_and_config(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 3)], "record_id int, v string, seq int")
    assert sorted((r.record_id, r.v) for r in readers.last_wins(df, "record_id", "seq").collect()) == [("", "c"), ("1", "b")]
    (tmp_path / "env").write_text("A=1\n# x\nB='2'\n")
    assert readers.settings(str(tmp_path / "env"), {"A": "0"}) == {"A": "0", "B": "2"}
    (tmp_path / "s.txt").write_text("foo\n")
    assert "foo" in readers.stop_words(str(tmp_path / "s.txt")) and "the" in readers.stop_words()


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"record_id": str(i), "content": "aa bb" if i % 2 else "", "from": "a@x.example.com", "timestamp": "2020-01-01T00:00:00Z"} for i in range(6)]
    (source / "a.json").write_text("\n".join(map(json.dumps, rows)))
    vocabulary = {c: ["aa"] if i == 0 else [] for i, c in enumerate(SCHEME1.ids)}
    stream = messages.labelled(messages.read(spark, str(source)), vocabulary, SCHEME1)
    seen = []
    query = messages.start(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda df, n: seen.append(df.count()))
    query.processAllAvailable()
    query.stop()
    assert sum(seen) == 6
    got = {r.record_id: r.category for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got["1"] == next(iter(SCHEME1.ids)) and got["0"] == "空样本"
    counted = messages.counts_by_window(messages.labelled(messages.read(spark, str(source)), vocabulary, SCHEME1))
    query = counted.writeStream.format("memory").queryName("counted").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("counted").agg({"count": "sum"}).first()[0] == 6


def test_settings_of_a_caller():
    import pytest

    from lumenmill.operators import vocab

    with pytest.raises(ValueError):
        vocab.api_settings({})
    assert vocab.api_settings({"OPENAI_API_KEY": " k ", "LLM_TIMEOUT": "30"}) == {"key": "k", "base_url": "https://api.openai.com/v1", "model": "gpt-4o-mini", "timeout": 30, "retries": 3}
    assert vocab.effective_timeout(120, False, 50) == 120 and vocab.effective_timeout(120, True, 50) == 600 and vocab.effective_timeout(120, True, 5) == 300
    assert vocab.progress(1, 4, 8) == "[##------] 1/4 25.0%" and vocab.progress(0, 0, 2) == "[##] 0/0 100.0%"


def test_unknown_fields_and_values_of_other_types(spark, tmp_path):
    log = tmp_path / "raw.log"
    log.write_text('1\t{"own": " &lt;a&gt; ", "n": [1, " x "], "subject": {"a": " &lt; "}, "content": "&lt;"}\n', encoding="utf-8")
    row = readers.cleaned(readers.raw_log(spark, str(log))).first()
    assert row.more["own"] == "<a>" and "&lt;" in row.subject and row.content == "<" and '" x "' in row.more["n"]


def test_summaries_in_order(spark):
    from lumenmill.operators import vocab

    rows = spark.createDataFrame([(2, "b"), (1, "a"), (3, "")], "batch int, summary string")
    assert vocab.merge_summaries(rows) == "1: a\n2: b"
