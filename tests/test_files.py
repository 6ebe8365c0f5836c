"""Readers and sinks on small files."""

import gzip
import json

from pyspark.sql import functions as F

from tidemark.sources import files as f


def test_facts_and_filings(spark, tmp_path):
    row = {"start": "2020-01-01", "end": "2020-12-31", "val": 5.0, "form": "10-K", "filed": "2021-02-01"}
    later = {**row, "val": 6.0, "filed": "2022-02-01", "start": None}
    (tmp_path / "a.json").write_text(json.dumps({"cik": 7, "entityName": "x", "facts": {"us-gaap": {"Revenues": {"units": {"USD": [row, later]}}}}}))
    (tmp_path / "bad.json").write_text("[1")
    got = f.company_facts(spark, str(tmp_path / "*.json"))
    assert sorted((r["tag"], r["val"], r["ord"], r["start"] is None) for r in got.collect()) == [("Revenues", 5.0, 0, False), ("Revenues", 6.0, 1, True)]
    assert f.company_facts(spark, str(tmp_path / "a.json"), "2021-06-30").count() == 1
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "s.json").write_text(json.dumps({"cik": "7", "name": "x", "sic": "1", "filings": {"recent": {"accessionNumber": ["a", "b", "c"], "filingDate": ["2022-01-01", "2021-01-01", "2020-01-01"], "form": ["10-K", "8-K", "10-K"], "primaryDocument": ["p", "q", "r"]}}}))
    rows = f.submissions(spark, str(tmp_path / "s"))
    assert [r["accession"] for r in f.filings(rows, ["10-K"], limit=1).collect()] == ["a"]
    assert [r["accession"] for r in f.filings(rows, ["10-K"], until="2021-12-31").collect()] == ["c"]


def test_prices_scores_and_panels(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "abc.csv").write_text("﻿Date,Close\n2020-01-02,1.5\n2020-01-03,\n")
    assert [tuple(r) for r in f.prices_by_file(spark, str(tmp_path / "p")).select("symbol", "close").collect()] == [("ABC", 1.5)]
    with gzip.open(tmp_path / "long.csv.gz", "wt") as g:
        g.write("ticker,date,close\nabc,2020-01-02,1.5\nxyz,2020-01-02,2\n")
    assert f.prices_long(spark, str(tmp_path / "long.csv.gz"), ["XYZ"]).count() == 1
    assert f.price_source(spark, "long", str(tmp_path / "long.csv.gz")).count() == 2
    (tmp_path / "scores.csv").write_text("ticker,as_of,x\nabc,2020-01-31,2.5\nabc,2020-02-29,\nabc,2020-03-31,oops\n")
    assert [r["score"] for r in f.scores_file(spark, str(tmp_path / "scores.csv"), "x", negate=True).collect()] == [-2.5]
    (tmp_path / "panel.csv").write_text("ticker,as_of,growth,odd\nabc,2020-01-31,0.5,9\n")
    r = f.panel_file(spark, str(tmp_path / "panel.csv"), ("ticker", "as_of"), ("growth",)).first()
    assert (r["ticker"], r["growth"], r["extras"]) == ("ABC", 0.5, {"odd": 9.0})


def test_instances_and_json(spark, tmp_path):
    xml = '<x xmlns:d="d"><context id="c"><entity><segment><explicitMember dimension="us:Axis">m</explicitMember></segment></entity><period><startDate>2020-01-01</startDate><endDate>2020-12-31</endDate></period></context><unit id="u"><measure>iso:USD</measure></unit><Revenue contextRef="c" unitRef="u">12.5</Revenue><Text contextRef="c">no number</Text></x>'
    df = spark.createDataFrame([(1, xml), (2, "<broken"), (3, None)], "k int, body string")
    (r,) = f.parse_instance(df, "k", "body").collect()
    assert (r["tag"], r["val"], r["unit"], str(r["end"]), r["dims"]) == ("Revenue", 12.5, "USD", "2020-12-31", {"us:Axis": "m"})
    one = spark.range(1).select(F.lit(0.1234567).alias("b"), F.lit(float("nan")).alias("a"), F.array(F.lit(1.0)).alias("c"))
    assert f.to_json(one).first()["json"] == '{"a":null,"b":0.123457,"c":[1.0]}'
    (tmp_path / "d.txt").write_bytes(b"abc")
    assert f.digests(spark, str(tmp_path / "d.txt")).first()["sha256"].startswith("ba7816bf")
    kept = f.cached(spark.range(3).toDF("x"), str(tmp_path / "kept"), "k")
    assert f.cached(spark.range(9).toDF("x"), str(tmp_path / "kept"), "k").count() == kept.count() == 3


def test_tickers_and_fields(spark):
    t = spark.createDataFrame([("abc",), ("CIK0000012",), ("old",), ("none",)], "ticker string")
    current = spark.createDataFrame([("ABC", 5)], "ticker string, cik long")
    former = spark.sql("select 'OLD' ticker, 9L cik, date '2010-01-01' since, date '2012-01-01' through")
    got = {r["ticker"]: (r["cik"], r["source"]) for r in f.resolved_tickers(t, current, former, "2011-01-01").collect()}
    assert got == {"abc": (5, "current list"), "CIK0000012": (12, "id"), "old": (9, "former listing"), "none": (None, "unresolved")}
    r = f.read_field(spark.createDataFrame([("1x",)], "a string"), "a", "double").first()
    assert (r["a"], r["problem"]) == (None, "a: 1x")
