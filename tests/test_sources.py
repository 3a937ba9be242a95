from __future__ import annotations

import datetime as dt

import pytest

from lodestar.sources import exports as x
from lodestar.sources import sinks


def test_query_page_export(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Top queries;Page;Clicks;Impressions;CTR;Position\nc++;https://X.test/A/;3;1,200;3,75%;4,5\nbad;https://x.test/b;1,234;10;4;1\none;https://x.test/c;1;1;1;1\n', encoding="utf-8")
    rows = {r["query"]: r for r in x.read_export(spark, str(tmp_path / "a.csv"), "search_query_page").collect()}
    assert set(rows) == {"c++", "one"}  # clicks with a comma can't be read
    assert (rows["c++"]["impressions"], rows["c++"]["ctr"], rows["c++"]["position"]) == (1200, 0.0375, 4.5) and rows["one"]["ctr"] == 1.0


def test_parsers(spark):
    df = spark.createDataFrame([("1.234,56", "2025-01"), ("1,234.56", "2025-01-15"), ("€ 12,5", "13/02/2025"), ("12.5", "02/13/2025"), ("", "Jan 2025"), ("x", "January 2025"), ("3", "nonsense")], "m string, d string")
    got = df.select(x.money(df.m).alias("m"), x.count_without_marks(df.m).alias("t"), x.month(df.d).alias("d")).collect()
    assert [r["m"] for r in got] == [1234.56, 1234.56, 12.5, 12.5, None, None, 3.0]
    assert got[3]["t"] == 125
    assert [r["d"] for r in got] == ["2025-01", "2025-01", "2025-02", "2025-02", "2025-01", "2025-01", None]


def test_alias_priority_and_missing_columns(spark):
    df = spark.createDataFrame([("a", "b", "Hyperlink")], "to string, source string, `Link Type` string")
    assert x.column_map(df.columns, x.SPECS["inlinks"]) == {"source": "source", "destination": "to", "type": "Link Type"}
    with pytest.raises(ValueError, match="keyword"):
        x.normalize(df, "rankings")


def test_health_scan(spark):
    df = spark.createDataFrame([("u", "200", "text/html; charset=utf-8", "12"), ("v", "301", "text/html", "1"), ("w", "200", "", "x")], "Address string, `Status Code` string, `Content Type` string, `Word Count` string")
    assert [(r["address"], r["word_count"]) for r in x.crawl_pages(df).collect()] == [("u", 12)]
    assert x.crawl_pages(df.drop("Content Type", "Status Code")).count() == 3


def test_sniff():
    assert x.sniff("a;b,c;d\n1;2;3\n4;5;6") == ";" and x.sniff("a\tb\n1\t2") == "\t" and x.sniff("a,b\n1,2") == ","


def test_envelopes(spark):
    serp = '{"tasks": [{"result": [{"keyword": "k", "items": [{"type": "organic", "rank_group": 1, "url": "u", "title": "t"}, {"type": "people_also_ask"}]}]}]}'
    words = '{"tasks": [{"result": [{"items": [{"keyword_data": {"keyword": "a", "keyword_info": {"search_volume": null}}}, {"keyword_data": {"keyword": "b", "keyword_info": {"search_volume": 7}}}]}]}]}'
    cdx = '[["timestamp", "original", "statuscode", "mimetype", "digest"], ["20240102030405", "https://x", "200", "text/html", "D"]]'
    df = spark.createDataFrame([(serp, words, cdx)], "s string, w string, c string")
    assert [(r["keyword"], r["type"]) for r in x.serp_envelope(df, "s").collect()] == [("k", "organic"), ("k", "people_also_ask")]
    assert [r["keyword"] for r in x.keyword_envelope(df, "w").collect()] == ["b", "a"]
    assert x.snapshots(df, "c").first()["original"] == "https://x"


def test_text_folder(spark, tmp_path):
    (tmp_path / "a%2Fb.txt").write_text("one two three\nfour")
    (tmp_path / "c.txt").write_text("one")
    assert [(r["url"], r["word_count"]) for r in x.text_folder(spark, str(tmp_path), 3).collect()] == [("a/b", 4)]


def test_vectors_of_one_length(spark):
    df = spark.createDataFrame([("u", "[1, 2]"), ("v", "[]"), ("w", "no")], "Address string, Embeddings string")
    out = x.normalize(df, "embeddings")
    assert [r["url"] for r in out.collect()] == ["u"]
    with pytest.raises(ValueError):
        x.check_dimensions(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<float>"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1, [1, 2])], "n string, w int, xs array<int>")
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first()["xs"] == "[1,2]" and spark.read.json(str(tmp_path / "j")).first()["w"] == 1
    assert "| a\\|b | 1 |" in sinks.markdown(df.drop("xs"), "T")
    graph = sinks.gexf(spark.createDataFrame([("a", 2)], "node string, degree int"), spark.createDataFrame([("a", "b", 3)], "src string, dst string, weight int"))
    assert 'source="a" target="b" weight="3"' in graph


def test_streams(spark, tmp_path):
    from lodestar.streaming import trends

    rows = [(dt.datetime(2024, 1, d, 12), 1, "click", 1.0) for d in (1, 1, 2, 9)]
    spark.createDataFrame(rows, "ts timestamp, user_id bigint, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user_id bigint, event_type string, value double").parquet(str(tmp_path / "in"))
    q = trends.daily_trend(stream).writeStream.outputMode("append").format("memory").queryName("trend").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {str(r["day"]): r["events"] for r in spark.table("trend").collect()}
    assert got == {"2024-01-01": 2, "2024-01-02": 1}
