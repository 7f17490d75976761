import json

import pytest
from pyspark.sql import functions as F

from strandwerk import schemas
from strandwerk.operators import finance
from strandwerk.sources import readers, sinks
from strandwerk.streaming import incremental


def test_readers(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n{broken\n{"a": 2}\n[1]\n')
    assert sorted(r.a for r in readers.read_jsonl_tolerant(spark, str(p), "a bigint, b string").collect()) == [1, 2]
    with pytest.raises(ValueError):
        readers.read_any(spark, "x.txt")
    sec = spark.createDataFrame([(json.dumps({"fields": ["cik", "name", "ticker", "exchange"], "data": [[320193, "Apple", "AAPL", "Nasdaq"]]}),)], "payload string")
    assert tuple(readers.securities(sec, "fields").first()) == ("0000320193", "AAPL", "Apple", "Nasdaq")
    num = spark.createDataFrame([(json.dumps({"0": {"cik_str": 1, "ticker": "A", "title": "T"}}),)], "payload string")
    assert tuple(readers.securities(num, "numbered").first()) == ("0000000001", "A", "T", None)
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "processed_1.json").write_text('{"a":\n 1}')
    (tmp_path / "d" / "other.json").write_text('{"a": 2}')
    assert [r.a for r in readers.read_recursive(spark, str(tmp_path / "d"), "processed_*.json", "a bigint").collect()] == [1]
    files = spark.createDataFrame([("d", "a_cal.xml"), ("d", "a.xml"), ("d", "abc_htm.xml"), ("d", "R1.xml"), ("d", "a.xsd")], "doc string, name string")
    assert [(r.name, r["rank"]) for r in readers.xbrl_candidates(files).orderBy("rank").collect()] == [("abc_htm.xml", 1), ("a.xml", 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("u1", None), ("u2", ["x"])], "url string, l array<string>")
    sinks.append_new(df, str(tmp_path / "t"))
    sinks.append_new(df.unionByName(spark.createDataFrame([("u3", None)], df.schema)), str(tmp_path / "t"))
    assert sorted(r.url for r in readers.read_any(spark, str(tmp_path / "t") + "/*.parquet").collect()) == ["u1", "u2", "u3"]
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert any('"l":null' in x.read_text() for x in (tmp_path / "j").glob("part*"))
    assert [r.l for r in sinks.empty_lists(df).orderBy("url").collect()] == [[], ["x"]]
    sinks.graph_csv(spark.createDataFrame([("1", "a", None)], "id string, name string, ticker string"), spark.createDataFrame([("1", "2", "owns")], "src string, dst string, relationship string"), str(tmp_path / "g"))
    assert (tmp_path / "g" / "edges" / "relationship=owns").exists()


def test_nested_round_trip(spark, tmp_path):
    s = "block_key string, resolved_companies array<struct<uuid:string,source_uuids:array<string>,match_skip_history:array<bigint>>>"
    df = spark.createDataFrame([("a", [("u", ["x"], None)]), ("b", []), ("c", None)], s)
    sinks.write_parquet(df, str(tmp_path / "p"), single=True)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "p")).collect())) == sorted(map(str, df.collect()))


def test_schemas(spark):
    n = schemas.normalize_companies(spark.createDataFrame([(1, "x", "b", 9)], "id int, name string, block_key string, extra int"), keep_extra=True)
    assert n.schema["id"].dataType.typeName() == "long" and n.columns[-1] == "extra" and "block_key" not in n.columns and n.first().cik is None
    assert schemas.widen(schemas.schema_of("a array<struct<b:int>>"))["a"].dataType.simpleString() == "array<struct<b:bigint>>"
    assert "companies" in schemas.schema_of(schemas.ARTICLE).names
    with pytest.raises(ValueError):
        schemas.require(spark.range(1))


def test_xbrl(spark):
    x = """<xbrl xmlns:us-gaap="http://fasb.org/us-gaap/2023" xmlns:dei="http://xbrl.sec.gov/dei/2023"><context id="c1"><period><endDate>2023-12-31</endDate></period></context>
    <context id="c2"><entity><segment><explicitMember>m</explicitMember></segment></entity><period><instant>2023-12-31</instant></period></context>
    <us-gaap:Revenues contextRef="c2" unitRef="usd">5</us-gaap:Revenues><us-gaap:Revenues contextRef="c1" unitRef="usd">7</us-gaap:Revenues><dei:DocumentType contextRef="c1">10-K</dei:DocumentType></xbrl>"""
    f = finance.xbrl_facts(spark.createDataFrame([("d", x), ("bad", "<a>"), ("none", None)], "doc string, xml string"))
    best = {r.tag: r.val for r in finance.best_facts(f).collect()}
    assert best == {"us-gaap:Revenues": "7", "dei:DocumentType": "10-K"}


def test_returns(spark):
    p = spark.createDataFrame([("A", 1, 10.0), ("A", 2, 15.0), ("Z", 1, 0.0), ("Z", 2, 1.0), ("N", 1, None), ("B", 1, 10.0), ("B", 2, 5.0)], "symbol string, ts int, close double")
    assert [(r.symbol, r.return_pct) for r in finance.returns(p).collect()] == [("A", 50.0), ("B", -50.0)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("u", "2024-01-01 00:00:00", 1), ("u", "2024-01-01 01:00:00", 2), ("v", "2024-01-01 00:30:00", 3)], "url string, at string, seq bigint").select("url", F.col("at").cast("timestamp").alias("collected_at"), "seq").write.parquet(str(src))
    stream = spark.readStream.schema("url string, collected_at timestamp, seq bigint").parquet(str(src))
    q = incremental.seen_once(stream).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select distinct url from seen").count() == 2 and spark.sql("select * from seen").count() == 2
    q = incremental.upsert_newest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "url", "collected_at", "seq")
    q.awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out" / "v0")).collect()) == [2, 3]


def test_entry(spark):
    import importlib.util
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    s = importlib.util.spec_from_file_location("entry_module", os.path.join(root, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(s)
    s.loader.exec_module(m)
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90
