import json

from pyspark.sql import functions as F

from strandwerk.operators import drift, nested, skew, units

RAW = "feed_name string, file_no bigint, file_name string, line_no bigint, entity string, payload string, arrived_at timestamp_ntz"


def raw(spark, files):
    rows = [("f", no, f"{no}", i, "companies", p if isinstance(p, (str, type(None))) else json.dumps(p), None) for no, lines in files.items() for i, p in enumerate(lines)]
    return spark.createDataFrame(rows, RAW)


def test_drift(spark):
    files = {
        1: [{"uuid": str(i), "revenue_usd": 1000 + i, "name": f"n{i}", "flag": True, "old": i} for i in range(6)] + ["{broken", None, "", "null, "],
        3: [{"uuid": str(i), "revenueUsd": [1000 + i], "name": {"value": f"n{i}"}, "flag": True, "extra": None} for i in range(6)] * 2,
        4: [{"uuid": str(i), "Revenueusd": f"{1000 + i:,}", "name": f"n{i}", "flag": "yes", "extra": 1.0} for i in range(6)],
    }
    got = {tuple(r)[1:] for r in drift.field_changes(raw(spark, files)).collect()}
    assert got == {
        (3, "renamed", "revenue_usd", "revenueUsd"), (3, "type_changed", "revenue_usd", "revenueUsd"), (3, "type_changed", "name", "name"), (3, "removed", "old", ""), (3, "added", "", "extra"),
        (4, "renamed", "revenueUsd", "Revenueusd"), (4, "type_changed", "revenueUsd", "Revenueusd"), (4, "type_changed", "name", "name"), (4, "type_changed", "flag", "flag"),
    }
    t = drift.consistent_table(raw(spark, files), "companies")
    assert t.count() == 18 and {r.revenue_usd for r in t.collect()} == {1000 + i for i in range(6)} and {r.name for r in t.collect()} == {f"n{i}" for i in range(6)}
    assert {r.is_public for r in t.collect()} == {None}


def test_drift_json_types(spark):
    df = spark.createDataFrame([(x,) for x in ("9.0", "9", "1e5", "123456789012345678901", '"9"', "true", "{}", "[]", "null")], "x string")
    assert [r[0] for r in df.select(drift.json_type(F.try_parse_json("x"))).collect()] == ["number", "integer", "number", "integer", "string", "boolean", "object", "array", None]


def test_drift_empty(spark):
    assert drift.field_changes(raw(spark, {})).count() == 0
    assert drift.field_changes(raw(spark, {1: ["x"], 2: [{"uuid": "1", "a": 1}]})).select("change").collect()[0][0] == "added"


def test_skew(spark):
    rows = [(i, " nordvek_chunk_%d " % i if i % 2 else "NORDVEK", [{"uuid": str(j)} for j in range(10)], 99) for i in range(50)] + [(100 + i, f"K{i}", [{"uuid": "x"}], 1) for i in range(200)] + [(400, None, [{"uuid": "x"}], 1), (401, "E", None, 1), (402, "E", [], 1)]
    b = spark.createDataFrame(rows, "block_id bigint, block_key string, original_companies array<struct<uuid:string>>, block_size bigint")
    s = skew.key_sizes(b)
    assert [r[0] for r in skew.heavy_keys(s).collect()] == ["NORDVEK"]
    r = {x.block_key: x for x in skew.key_results(s).collect()}
    assert len(r) == 202 and (r["NORDVEK"].blocks, r["NORDVEK"].companies, r["NORDVEK"].heavy) == (50, 500, True) and (r["E"].companies, r["E"].blocks) == (0, 2)
    e = skew.key_sizes(b.limit(0))
    assert skew.heavy_keys(e).count() == 0 and skew.key_results(e).count() == 0


def test_units(spark):
    rows = [
        (1, "S", "It signed a deal for €1.41 million.", 1.41, None, None), (2, "S", "Sum: 683,000 dollars. It keeps 8,600 basis points of equity.", 683.0, "U.S. dollars", 0.86),
        (3, "Thousands", "No figure.", 39.0, "usd", None), (4, "S", "Terms: $596,000,000. Peers paid 2 bn for a similar asset.", 596e6, "USD", None), (5, "S", "for half a billion dollars with an interest of a quarter.", 0.5, "USD", 25.0),
        (6, "S", "putting up eight thousand rupees.", 8.0, " INR ", None), (7, None, None, None, "yen", 2500.0), (8, "Parts", None, 5.0, "EUR", 0.5), (1, "S", "It signed a deal for €1.41 million.", 1.41, None, None), (9, "S", "In a US$5,200,000 transaction", 5.2, None, None), (10, "S", "x", 0.0, "?", None),
    ]
    r = spark.createDataFrame(rows, "rel_id bigint, source string, description string, amount double, currency string, percentage double")
    n = spark.createDataFrame([("Thousands", "All amounts in '000s."), ("Parts", "Shares are printed as parts of one."), ("S", "Covers thousands of suppliers.")], "name string, note string")
    fx = spark.createDataFrame([("USD", 1.0), ("EUR", 2.0)], "currency string, usd_per_unit double")
    norm = units.normalize_units(r, n, fx)
    assert {tuple(x) for x in units.unit_findings(norm).collect()} == {
        (1, "amount", "million"), (1, "currency", "EUR"), (2, "amount", "thousand"), (2, "currency", "USD"), (2, "percentage", "fraction"), (3, "amount", "thousand"), (3, "currency", "USD"),
        (5, "amount", "billion"), (6, "amount", "thousand"), (6, "currency", "INR"), (7, "percentage", "basis_point"), (8, "percentage", "fraction"), (9, "amount", "million"), (9, "currency", "USD"),
    }
    usd = {x.rel_id: x.amount_usd for x in norm.collect()}
    assert abs(usd[1] - 2.82e6) < 1 and usd[6] is None and norm.count() == 10
    assert units.normalize_units(r.limit(0), n, fx).count() == 0


def test_nested(spark):
    schema = "article_id bigint, extra string, companies array<struct<id:bigint,name:string>>, products array<struct<id:bigint,name:string,manufacturer:bigint,technologies:array<bigint>>>, technologies array<struct<id:bigint,developer:bigint>>, relationships array<struct<src_company:bigint,dst_company:bigint,products:array<bigint>,technologies:array<bigint>>>"
    rows = [
        (1, "e", [None, (1, "A"), (2, None)], [(3, "P", 1, [5, 5, None, 9])], [(5, 2), None], [(1, 3, [3, 99], None), None, (2, 2, None, [5])]),
        (2, None, None, [], None, [(1, 1, None, None)]), (None, None, [(1, "x")], None, None, None),
    ]
    a = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in nested.links(a).collect()} == {
        (1, "products", 0, "manufacturer", "companies", 1), (1, "products", 0, "technologies", "technologies", 0), (1, "technologies", 0, "developer", "companies", 2), (1, "relationships", 0, "src_company", "companies", 1),
        (1, "relationships", 0, "products", "products", 0), (1, "relationships", 2, "src_company", "companies", 2), (1, "relationships", 2, "dst_company", "companies", 2), (1, "relationships", 2, "technologies", "technologies", 0),
    }
    t = nested.shred(a, "article_id")
    c = nested.pivot_group(t, "article_id", a.schema, "companies").collect()
    assert {tuple(r) for r in c} == {(1, 1, 1, "A"), (1, 2, 2, None)}
    assert {tuple(r) for r in nested.pivot_group(t, "article_id", a.schema, "products.technologies").collect()} == {(1, 0, 0, 5), (1, 0, 1, 5), (1, 0, 3, 9)}
    assert nested.links(a.limit(0)).count() == 0


def test_drift_all_fields(spark):
    files = {
        1: [{"uuid": str(i), "name": f"n{i}", "contact": f"c{i}", "score": i, "mixed": i, "Tags": ["a", "b"], "note.x": 1.23456} for i in range(6)],
        2: [{"uuid": str(i), "name": f"n{i}", "contactPerson": [f"c{i}"], "score": f" {i}" if i == 5 else i, "mixed": "x y", "tags": f"t{i}"} for i in range(6)],
    }
    t = drift.consistent_table(raw(spark, files), "companies")
    assert dict(t.dtypes)["score"] == "bigint" and dict(t.dtypes)["mixed"] == "string" and dict(t.dtypes)["note.x"] == "double" and len(t.columns) == 3 + len(drift.COMPANY_FIELDS) + 6
    got = {(r.file_no, r.uuid): (r.contact, r.score, r.mixed, r.Tags, r.tags_2, r["note.x"]) for r in t.collect()}
    assert got == {(1, str(i)): (f"c{i}", i, str(i), '["a","b"]', None, 1.23456) for i in range(6)} | {(2, str(i)): (f"c{i}", i, "x y", None, f"t{i}", None) for i in range(6)}
