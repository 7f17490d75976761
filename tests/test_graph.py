import random

import pytest
from pyspark.sql import functions as F

from strandwerk.operators import blocking, dedup, evaluate, graph, graph_build, iterate, kv, matching, refine

C = "uuid string, id bigint, name string, description string, cik string, website_url string, revenue_usd bigint, source_uuids array<string>"


def test_blocks_are_bounded_and_complete(spark):
    rows = [(f"u{i}", i, "Hot Name" if i < 120 else f"Name{i} Two", None, None, None, None, None) for i in range(200)] + [("n1", 1, None, *[None] * 5), ("n2", 1, "  ", *[None] * 5), (None, 1, "x", *[None] * 5), ("u1", 1, "Hot Name", *[None] * 5)]
    b = blocking.build_blocks(spark.createDataFrame(rows, C), 50).collect()
    assert all(1 <= x.block_size == len(x.companies) <= 50 for x in b)
    assert {c.uuid for x in b for c in x.companies} == {r[0] for r in rows if r[0]}
    hot = [x for x in b if x.block_key.startswith("HOT")]
    assert sorted(x.block_key for x in hot) == [f"HOT_chunk_{i}" for i in (1, 2, 3)] and sum(x.block_size for x in hot) == 120
    assert sorted(x.block_key for x in b if x.block_key_type == "unblocked") == ["UNBLOCKED_n1", "UNBLOCKED_n2"]
    assert blocking.build_blocks(spark.createDataFrame([], C), 50).count() == 0


def test_first_word_and_acronym_collide(spark):
    rows = [("1", 1, "Apple Inc", *[None] * 5), ("2", 2, "Apple Corp", *[None] * 5), ("3", 3, "Google LLC", *[None] * 5)]
    b = {x.block_key: x for x in blocking.build_blocks(spark.createDataFrame(rows, C)).collect()}
    assert b["APPLE"].block_size == 2 and b["APPLE"].block_key_type == "combined"


def test_split(spark):
    df = spark.createDataFrame([("K", list("abcdefg"), 7), ("L", list("abc"), 3), ("M", [], 0), ("N", None, 0)], "block_key string, companies array<string>, block_size bigint")
    assert [(r.block_key, r.block_size) for r in blocking.split_blocks(df, 3).collect()] == [("K_chunk_1", 3), ("K_chunk_2", 3), ("K_chunk_3", 1), ("L", 3), ("M", 0), ("N", 0)]


def test_clones_converge(spark):
    rows = [(f"u{i}", i, "Acme Corporation", None, None, None, None, []) for i in range(10)]
    out = iterate.resolve(spark.createDataFrame(rows, C), max_size=2, rounds=5).collect()
    assert len(out) == 1 and {f"u{i}" for i in range(10)} <= set(out[0].source_uuids)


def test_lineage_is_kept(spark):
    m = spark.createDataFrame([("b", 1, "u1", "Test B", ["old-1", "old-2"]), ("b", 2, "u2", "Test B Inc.", ["old-3"]), ("b", 3, "u3", "Test C", None), ("s", 1, "u9", "Alone", None)], "block_key string, id bigint, uuid string, name string, source_uuids array<string>")
    r = {x.name: x for x in matching.merge_members(m).collect()}
    assert r["Test B Inc."].source_uuids == ["old-1", "old-2", "old-3", "u1", "u2"] and r["Test B Inc."].master_uuid == "u1"
    assert r["Alone"].match_skip and r["Alone"].uuid == "u9" and r["Alone"].match_skip_reason == "singleton_block" and not r["Test C"].match_skip
    lost = matching.recover(m, spark.createDataFrame([("b", ["u1"])], "block_key string, source_uuids array<string>"))
    assert {(x.block_key, x.uuid) for x in lost.collect()} == {("b", "u2"), ("b", "u3"), ("s", "u9")}


def test_integrity_and_names(spark):
    schema = "article_id bigint, url string, companies array<struct<id:bigint,name:string>>, relationships array<struct<src_company:bigint,dst_company:bigint>>"
    a = spark.createDataFrame([(1, "u", [(1, "A\r\nB")], [(1, 1), (None, 1), None]), (2, "u", [(1, "A")], [(1, 2)]), (3, "u", None, [(None, None)]), (4, "u", None, [(1, None)]), (5, "u", None, None)], schema)
    assert {r.article_id: r.ok for r in graph_build.with_integrity(a).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}
    e = {r.article_id: r for r in graph_build.entities(a, "companies").collect()}
    assert e[1].name == "A B" and e[1].uuid != e[2].uuid
    df = spark.createDataFrame([("a", ["x", None, "z"]), ("b", None), ("c", [])], "k string, ids array<string>")
    n = spark.createDataFrame([("x", "X"), (None, "N")], "uuid string, name string")
    assert {r.k: r.ids for r in graph_build.names_for_ids(df, "k", "ids", n).collect()} == {"a": ["X", "z"], "b": None, "c": []}


def test_components_and_degrees(spark):
    random.seed(5)
    es = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in es:
        p[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(es, "src bigint, dst bigint")
    assert {r.node: r.component for r in graph.components(df).collect()} == {x: find(x) for x in list(p)}
    assert sum(r.degree for r in graph.degrees(df).collect()) == 2 * len(es)
    scc = graph.strong_components(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)], "src bigint, dst bigint"))
    assert {r.node: r.component for r in scc.collect()} == {1: 3, 2: 3, 3: 3, 4: 5, 5: 5, 6: 6, 7: 7}
    r = graph.reachable(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src bigint, dst bigint"), spark.createDataFrame([(1,)], "node bigint"), 9)
    assert {x.node: x.depth for x in r.collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_newest_and_majority(spark):
    df = spark.createDataFrame([("u", "t1", 1), ("u", "t2", 2), ("u", "t2", 3), (None, "t", 4), (None, "t", 5), ("v", None, 6)], "url string, at string, seq bigint")
    assert sorted(r.seq for r in dedup.newest(df, "url", "at", "seq").collect()) == [2, 4, 5, 6]
    m = spark.createDataFrame([("k", "a"), ("k", "bb"), ("k", None), ("k", None), ("k", None)], "k string, v string")
    assert dedup.majority(m, "k", "v").collect()[0].v == "bb"


def test_merge_edges_and_nodes(spark):
    e = spark.createDataFrame([(1, "a", "b", "r", "2024", None, "x", ["ibm"], "u1"), (2, "a", "b", "r", "2023", 5.0, None, None, "u2"), (3, "a", "b", "s", "2023", None, None, [], None)], "rel_id bigint, src string, dst string, relationship string, posted_at string, amount double, description string, technologies array<string>, url string")
    e = e.withColumns({c: F.lit(None).cast("string") for c in ("currency", "date", "quarter")}).withColumns({"percentage": F.lit(None).cast("double"), "products": F.array().cast("array<string>")})
    r = {x.relationship: x for x in refine.merge_edges(e).collect()}
    assert (r["r"].amount, r["r"].description, r["r"].urls, r["r"].technologies, r["r"].edges) == (5.0, "x", ["u1", "u2"], ["Ibm"], 2)
    assert {x.uuid for x in refine.connected(spark.createDataFrame([("a",), ("z",)], "uuid string"), e).collect()} == {"a"}


def test_query_language_and_overlap(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "n bigint, s string")
    q = kv.run_query(df, {"AND": [{"EQ": {"s": "a"}}, {"OR": [{"LT": {"n": 3}}, {"IN": {"n": [6, 8]}}]}]}, [("n", "DESC")], 2, 1)
    assert [r.n for r in q.collect()] == [6, 2] and kv.run_query(df).count() == 10
    assert tuple(evaluate.overlap(spark.createDataFrame([("a",), ("b",)], "uuid string"), spark.createDataFrame([("b",), (None,)], "uuid string")).first()) == (2, 1, 1)


def test_strong_components_of_a_chain(spark):
    pairs = [(10 * i, 10 * i + 1) for i in (3, 2, 1)]
    edges = spark.createDataFrame([e for a, b in pairs for e in ((a, b), (b, a))] + [(31, 20), (21, 10)], "src bigint, dst bigint")
    with pytest.raises(ValueError, match="after 1 passes"):
        graph.strong_components(edges, rounds=1)
    assert {tuple(r) for r in graph.strong_components(edges).collect()} == {(x, b) for a, b in pairs for x in (a, b)}
