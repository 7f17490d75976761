"""Functions and operators added after the first round, against brute force and small cases."""

import io
import json
import os
import random
import re
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandwerk import schemas
from strandwerk.functions import names, text
from strandwerk.operators import blocking, dedup, drift, graph, refine, semantic, tickers
from strandwerk.sources import readers


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_best_match_by_ratio_against_all_pairs(spark):
    random.seed(4)
    word = lambda: "".join(random.choice("fghwxz") for _ in range(random.randint(1, 9)))
    listed = [(f"{word()} {word()}", f"T{i:03d}") for i in range(80)] + [(None, "X"), ("!!", "Y"), ("abc", None)]
    queries = [(f"{word()} {word()} Inc",) for _ in range(120)] + [(None,), ("...",), (listed[3][0],)]
    key = lambda s: s.replace(" Inc", "").replace(" ", "")
    score = lambda a, b: round(200 * lcs(a, b) / (len(a) + len(b)), 6)
    want = {}
    for (q,) in queries:
        if q and key(q).strip("."):
            want[q] = min((-score(key(q), key(t)), tick) for t, tick in listed if t and tick and key(t).strip("!"))
    q, l = spark.createDataFrame(queries, "name string"), spark.createDataFrame(listed, "title string, ticker string")
    got = {r.name: (-r.score, r.ticker) for r in tickers.best_fuzzy(q, l).collect()}
    assert got == want
    assert tickers.best_fuzzy(q, l.limit(0)).count() == 0 and tickers.best_fuzzy(q.limit(0), l).count() == 0
    tickers.BLOCK, old = 30, tickers.BLOCK
    try:
        assert {r.name: (-r.score, r.ticker) for r in tickers.best_fuzzy(q, l).collect()} == want  # several blocks of securities
    finally:
        tickers.BLOCK = old


def test_cosine_best_in_blocks(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.8, 0.6]), (1, [0.0, 1.0]), (200, [0.0, -1.0]), (7, [0.8, 0.6]), (8, None), (None, [1.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    q = e.where("vec_id % 100 = 0")
    want = [(0, 7, 0.8), (100, 7, 1.0)]
    assert sorted(map(tuple, tickers.cosine_best(q, e, 0.2, apart=True).collect())) == want
    tickers.BLOCK, old = 1, tickers.BLOCK
    try:
        assert sorted(map(tuple, tickers.cosine_best(q, e, 0.2, apart=True).collect())) == want
    finally:
        tickers.BLOCK = old
    assert tickers.cosine_best(q.limit(0), e).count() == 0 and tickers.cosine_best(q, e.limit(0)).count() == 0


def test_semantic_blocks_are_bounded(spark):
    random.seed(5)
    rows = [(i, [1.0, random.random() / 100]) for i in range(300)] + [(i, [random.random() / 100, 1.0]) for i in range(300, 320)] + [(999, None)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    b = semantic.semantic_blocks(v, target=160, max_size=40).collect()
    assert sorted(r.vec_id for r in b) == sorted(i for i, _ in rows)
    sizes = {}
    for r in b:
        sizes[r.block_key] = sizes.get(r.block_key, 0) + 1
    assert max(sizes.values()) <= 40 and sizes["unblocked_999"] == 1


def test_legal_forms_of_many_countries(spark):
    cases = {"Bayer AG": "Bayer", "Foo S.A.": "Foo", "Foo S.p.A.": "Foo", "Foo B.V.": "Foo", "Bar Pty Ltd": "Bar", "Baz Sdn Bhd": "Baz", "Qux GmbH & Co. KG": "Qux", "Aktia Oyj": "Aktia", "Moller A.S": "Moller", "Nusa L.L.C.": "Nusa", "Siemens Aktiengesellschaft": "Siemens"}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.x for r in df.select("n", names.base_name(F.col("n")).alias("x")).collect()} == cases
    df = spark.createDataFrame([("Bank der Stadt und Land",), ("Banco de los Andes",)], "n string")
    assert [r.x for r in df.select(names.acronym(F.col("n")).alias("x")).collect()] == ["BSL", "BA"]


def test_page_facts_and_dates(spark):
    page = "Acme (NYSE: ACM) is headquartered in Halvik, Norsland. It was founded in 1492 and a 1999 establishment. Annual revenue of US$1,200.5 million. It employs 12,345 people. CEO Ann Bo Cole said. wikipedia https://en.wikipedia.org/x linkedin.com/company/acme-1"
    f = spark.createDataFrame([(page,), ("",), (None,)], "t string").select(text.company_facts(F.col("t")).alias("f")).select("f.*").collect()
    assert tuple(f[0]) == ("ACM", "NYSE", None, "Halvik", 1999, 1_200_500_000.0, 12345, "Ann Bo Cole", "https://www.linkedin.com/company/acme-1")
    assert set(f[1]) == set(f[2]) == {None}
    d = spark.createDataFrame([('<meta name="og:published_time" content="2024-02-03">',), ('x "datePublished": "2024-02-03T04:05Z"',), ("<time>",), (None,)], "h string")
    assert [r[0] for r in d.select(text.posted_date(F.col("h"))).collect()] == ["2024-02-03T00:00:00+00:00", "2024-02-03T04:05Z", None, None]
    u = spark.createDataFrame([("https://semianalysis.com/2024/x",), ("https://a/blog/y",), ("https://a/z",), (None,)], "u string")
    assert [r[0] for r in u.select(text.article_url(F.col("u"), text.ARTICLE_URLS["semianalysis.com"])).collect()] == [True, True, False, False]


def test_nested_types_and_flat_columns(spark):
    t = schemas.ids_as_text(StructType.fromDDL("id bigint, n int, companies array<struct<id:int,products:array<bigint>,size:bigint>>"))
    assert t.simpleString() == "struct<id:string,n:int,companies:array<struct<id:string,products:array<string>,size:bigint>>>"
    df = spark.createDataFrame([(1, (2, None), ["x", None], 5), (2, None, None, None)], "id bigint, c struct<a:bigint,b:string>, l array<string>, c_a bigint")
    assert [tuple(r) for r in schemas.flat_columns(df).collect()] == [(1, 2, None, "x", 2, 5), (2, None, None, "", 0, None)]
    assert schemas.flat_columns(df).columns == ["id", "c_a_", "c_b", "l", "n_l", "c_a"]
    assert df.select(schemas.without_nulls(F.col("c"))).first()[0] == '{"a":2}'


def test_csv_files_in_archives(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("in/pairs.csv", "id,name,score\n1,a,0.5\n2,b,1\n3,,0\n")
        z.writestr("notes.txt", "x")
        z.writestr("other.csv", "k\nv\n")
    (tmp_path / "a.zip").write_bytes(data.getvalue())
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    made = readers.zipped_csv_to_parquet(spark, f"file://{tmp_path}/*.zip", f"{tmp_path}/out")
    assert [m.rpartition("/")[2] for m in made] == ["other.parquet", "pairs.parquet"] or [m.rpartition("/")[2] for m in made] == ["pairs.parquet", "other.parquet"]
    p = spark.read.parquet(f"{tmp_path}/out/pairs.parquet")
    assert sorted(tuple(r) for r in p.collect()) == [(1, "a", 0.5), (2, "b", 1.0), (3, None, 0.0)] and p.dtypes == [("id", "int"), ("name", "string"), ("score", "double")]


def test_hot_keys_stay_bounded(spark):
    keys = spark.createDataFrame([("HOT", "first_word", f"u{i}") for i in range(400)] + [("HOT", "acronym", "u1"), ("B", "acronym", "u1")], "block_key string, key_type string, uuid string")
    b = blocking.assign_blocks(keys, 50)
    sizes = {r.block_key: r["count"] for r in b.groupBy("block_key").count().collect()}
    assert sizes == {**{f"HOT_chunk_{i}": 50 for i in range(1, 9)}, "B": 1}
    assert {r.block_key_type for r in b.where("block_key <> 'B'").collect()} == {"combined"}
    edges = spark.createDataFrame([("a", "b", i, "k") for i in range(25)] + [("a", None, 99, "k")], "src string, dst string, rel_id bigint, relationship string")
    e = refine.edge_blocks(edges, 10).collect()
    assert sorted((r.dst or "", r.chunk, r.block_size) for r in e) == [("", 1, 1), ("b", 1, 10), ("b", 2, 10), ("b", 3, 5)]
    assert refine.edge_blocks(edges.limit(0)).count() == 0


def test_directed_clustering_against_definition(spark):
    random.seed(6)
    edges = {(random.randrange(12), random.randrange(12)) for _ in range(60)}
    a = lambda i, j: (i, j) in edges and i != j
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    want = {}
    for u in nodes:
        t = sum((a(u, v) + a(v, u)) * (a(u, w) + a(w, u)) * (a(v, w) + a(w, v)) for v in nodes for w in nodes if len({u, v, w}) == 3) / 2
        deg, mutual = sum(a(u, v) + a(v, u) for v in nodes), sum(a(u, v) and a(v, u) for v in nodes)
        most = 2 * (deg * (deg - 1) - 2 * mutual)
        want[u] = (deg, mutual, int(t), round(t / most, 6) if most else 0.0)
    df = spark.createDataFrame(sorted(edges) + [(0, 0)], "src bigint, dst bigint")
    assert {r.node: tuple(r)[1:] for r in graph.directed_clustering(df).collect()} == want
    nx_like = sum(x[3] for x in want.values()) / len(want)
    assert abs(graph.summary(df).first().mean_clustering - nx_like) < 1e-5


def test_batches_newest_first(spark):
    rows = [(i, None if i % 7 == 0 else f"2024-01-{i % 28 + 1:02d}") for i in range(95)]
    got = {r.id: r.batch for r in dedup.newest_batches(spark.createDataFrame(rows, "id bigint, at string"), "at", "id", 10).collect()}
    order = sorted((r for r in rows if r[1]), key=lambda r: r[0])
    order = sorted(order, key=lambda r: r[1], reverse=True) + [r for r in rows if not r[1]]
    assert got == {r[0]: i // 10 + 1 for i, r in enumerate(order)}
    assert dedup.newest_batches(spark.createDataFrame([], "id bigint, at string"), "at", "id").count() == 0


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    from strandwerk import session

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://x:7077", "_jsc": type("J", (), {"sc": staticmethod(lambda: type("K", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})})

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(Far())


def changes_by_hand(rows):
    """The changes of fields by plain Python, from (feed, file_no, payload) rows."""
    files = {}
    for feed, no, text in rows:
        fields = files.setdefault(feed, {}).setdefault(no, {})
        try:
            o = json.loads(text, parse_float=lambda x: ("number", float(x)), parse_int=lambda x: ("integer", int(x)), parse_constant=lambda x: 1 / 0)
        except Exception:
            continue
        if isinstance(o, dict):
            for k, v in o.items():
                fields.setdefault(k, []).append((o.get("uuid"), v))

    def kind(v):
        return None if v is None else v[0] if isinstance(v, tuple) else {str: "string", bool: "boolean", dict: "object", list: "array"}[type(v)]

    def main(values):
        n = Counter(k for _, v in values if (k := kind(v)))
        return max(n, key=lambda k: (n[k], -drift.TYPES.index(k))) if n else None

    def scalar(v):
        if isinstance(v, list):
            v = v[0] if v else None
        if isinstance(v, dict):
            v = v.get("value", v.get("id"))
        if isinstance(v, tuple):
            v = v[1]
        if v is None or isinstance(v, bool):
            return None if v is None else str(int(v))
        s = str(v).strip().lower()
        try:
            return f"{round(float(re.sub(' *[a-z]{3}$', '', s).replace(',', '')), 4):g}"
        except ValueError:
            return None if s in drift.FILLERS else {"true": "1", "yes": "1", "false": "0", "no": "0"}.get(s, s)

    out = set()
    for feed, by_no in files.items():
        for before, no in zip(sorted(by_no), sorted(by_no)[1:]):
            a, b = ({k: v for k, v in by_no[n].items() if k != "uuid"} for n in (before, no))
            gone, come = set(a) - set(b), set(b) - set(a)
            best = []
            for g in gone:
                x = {u: s for u, v in a[g] if u and (s := scalar(v)) is not None}
                for c in come:
                    y = {u: s for u, v in b[c] if u and (s := scalar(v)) is not None}
                    shared = set(x) & set(y)
                    same = sum(x[u] == y[u] for u in shared)
                    if same and same >= 0.6 * len(shared):
                        best.append((-same / len(shared), -same, g, c))
            for *_, g, c in sorted(best):
                if g in gone and c in come:
                    gone.remove(g)
                    come.remove(c)
                    out.add((feed, no, "renamed", g, c))
                    if main(a[g]) and main(b[c]) and main(a[g]) != main(b[c]):
                        out.add((feed, no, "type_changed", g, c))
            out |= {(feed, no, "removed", g, "") for g in gone} | {(feed, no, "added", "", c) for c in come}
            out |= {(feed, no, "type_changed", f, f) for f in set(a) & set(b) if main(a[f]) and main(b[f]) and main(a[f]) != main(b[f])}
    return out


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/raw_files.parquet"), reason="needs the test tables")
def test_field_changes_against_plain_python(spark):
    raw = spark.read.parquet("/root/testdata/sf0.1/raw_files.parquet")
    want = changes_by_hand((r.feed_name, r.file_no, r.payload or "") for r in raw.collect())
    assert {tuple(r) for r in drift.field_changes(raw).collect()} == want and len(want) > 300


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    from strandwerk.streaming import incremental

    schema = "url string, collected_at string, seq bigint"
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    want = {}
    for n, rows in enumerate([[(f"u{i}", "2024-01-01", i) for i in range(30)], [("u3", "2024-02-01", 100), ("u4", "2023-01-01", 101), ("new", None, 102)], [("u3", "2024-03-01", 200)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        for u, at, s in rows:
            want[u] = max(want.get(u, ("", -1)), (at or "", s))
        q = incremental.upsert_newest(spark.readStream.schema(schema).parquet(src), out, cp, "url", "collected_at", "seq")
        q.awaitTermination()
        got = incremental.read_upserted(spark, out, spark.createDataFrame([], schema).schema)
        assert {r.url: (r.collected_at or "", r.seq) for r in got.collect()} == want and got.count() == len(want)
    assert len([p for p in os.listdir(f"{out}/v2") if p.startswith("_bucket")]) == 1
