"""Queries and their SQL cover all rows."""

import datetime as dt
import os

import duckdb

import __spark_entry__ as entry
from strandwerk.operators import evaluate


def results(spark, name, tables, folder):
    """The query's rows over the given tables, and its SQL's, as dicts."""
    con = duckdb.connect()
    for n, df in tables.items():
        df.write.mode("overwrite").parquet(path := os.path.join(str(folder), f"{n}.parquet"))
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{path}/*.parquet'")
    got = [r.asDict() for r in entry.queries()[name](spark, str(folder)).collect()]
    sql = entry.oracle_sql().get(name)
    rel = con.sql(sql) if sql else None
    return got, [dict(zip(rel.columns, r)) for r in rel.fetchall()] if rel else []


def test_x26_all_events(spark, tmp_path):
    ids = [0, 19_999, 20_000, 99_999]
    got, sql = results(spark, "x26_epoch_iso", {"events": spark.createDataFrame([(i,) for i in ids], "event_id bigint")}, tmp_path)
    assert {r["event_id"]: r["iso"] for r in got} == {i: (dt.datetime(1970, 1, 1) + dt.timedelta(days=i)).strftime("%Y-%m-%dT%H:%M:%SZ") for i in ids}
    assert len(sql) == len(ids) and all(r in got for r in sql)


def test_a15_names_of_all_scripts(spark, tmp_path):
    names = {1: ["Zürich AG", "Zurich AG", "Zürich AG"], 2: ["Ａcme", "Acme", "日本"], 3: ["Abc", "Abd"], 4: [None]}
    blocks = spark.createDataFrame([(b, [(n,) for n in ns]) for b, ns in names.items()], "block_id bigint, original_companies array<struct<name:string>>")
    got, sql = results(spark, "a15_j14_x12_name_distances", {"blocks": blocks}, tmp_path)
    assert {r["block_key"]: tuple(r.values())[1:] for r in got} == {"1": (2, 1, 1, 1, 1.0), "2": (3, 0, 1, 4, 3.0), "3": (2, 0, 1, 1, 1.0)}
    assert len(sql) == len(got) and all(r in got for r in sql)


def test_j13_match_among_queries(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (100, [0.8, 0.6]), (1, [0.0, 1.0]), (200, [0.0, -1.0])]
    got, _ = results(spark, "j13_cosine_best", {"embeddings": spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")}, tmp_path)
    assert sorted(tuple(r.values()) for r in got) == [(0, 100, 0.8), (100, 0, 0.8)]


def test_x22_all_titles(spark, tmp_path):
    titles = ["plain", "Up $5 to $1", "back\\slash", " outer ", "a | b", "x]y", "z]", "k = v", "O'Neil <b>", "{one}"]
    got, sql = results(spark, "x22_wiki_markdown", {"documents": spark.createDataFrame([*enumerate(titles), (99, None)], "doc_id bigint, title string")}, tmp_path)
    assert {r["doc_id"]: r["md"] for r in got} == {i: f"## {x.strip()}\n**bold** *it* {x} [text](https://a.example/x) " for i, x in enumerate(titles)}
    assert len(sql) == len(titles) and all(r in got for r in sql)


def test_e9_references_and_overlap(spark, tmp_path):
    u = lambda n: f"00000000-0000-4000-8000-{n:012d}"
    block = lambda i, ins, outs: (i, i, None, True, [(u(n),) for n in ins], [(u(n), "x", [u(s) for s in ss], skip, None) for n, ss, skip in outs])
    rows = [block(1, [1, 2], [(11, [1, 2], False)]), block(2, [11, 3], [(21, [11, 3, 1], False)]), block(3, [21], [(31, [21, 99], False)]), block(4, [31, 5], [(31, [31, 5], False), (5, [5], True)])]
    schema = "block_id bigint, iteration bigint, error string, was_resolved boolean, original_companies array<struct<uuid:string>>, resolved_companies array<struct<uuid:string,name:string,source_uuids:array<string>,match_skip:boolean,match_skip_reason:string>>"
    blocks = spark.createDataFrame(rows, schema)
    got, sql = results(spark, "e9_a7_metrics", {"blocks": blocks}, tmp_path)
    assert {r["iteration"]: (r["refs"], r["valid_refs"], r["invalid_refs"], r["made"], r["overlap"], r["overlap_pct"]) for r in got} == {1: (2, 2, 0, 1, 0, 0.0), 2: (3, 3, 0, 1, 0, 0.0), 3: (2, 1, 1, 1, 0, 0.0), 4: (3, 3, 0, 1, 1, 100.0)}
    assert {tuple(r) for r in evaluate.passed(evaluate.metrics(blocks)).collect()} == {(1, True), (2, True), (3, False), (4, False)}
    assert len(sql) == 4 and all(r in got for r in sql)
