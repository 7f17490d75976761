"""Queries on tickers, vectors, finance and graph statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwerk.functions.names import SQL
from strandwerk.operators import blocking, drift, finance, graph, kv, semantic, tickers
from strandwerk.plans.blocking import _KEYS
from strandwerk.plans.registry import Registry, table

R = Registry()
t = table

_L = f"l AS (SELECT DISTINCT {SQL.match_key('title')} AS k, ticker FROM sec_list WHERE ticker IS NOT NULL)"


@R.add(f"WITH {_L} SELECT uuid, min(ticker) AS ticker, 100.0::DOUBLE AS score FROM (SELECT DISTINCT uuid, {SQL.match_key('name')} AS k FROM (SELECT uuid, name FROM companies UNION ALL SELECT uuid, upper(title) FROM sec_list)) c JOIN l USING (k) WHERE k <> '' GROUP BY uuid, k")
def j12_g7_exact_tickers(spark, d):
    listed = t(spark, d, "sec_list")
    names = t(spark, d, "companies").select("uuid", "name").unionByName(listed.select("uuid", F.upper("title").alias("name")))
    return tickers.exact_matches(names, listed)


#: Letters of a match key; the longest common subsequence of two keys by one addition of bit vectors a letter.
_ABC = "abcdefghijklmnopqrstuvwxyz0123456789"
_MASKS = f"list_transform(range(1, {len(_ABC) + 1}), lambda i: coalesce(list_sum(list_transform(range(1, length(k) + 1), lambda j: CASE WHEN k[j] = '{_ABC}'[i] THEN 1::HUGEINT << (j - 1)::INT ELSE 0::HUGEINT END)), 0)::HUGEINT)"


@R.add(
    f"""WITH {_L}, m AS (SELECT k, ticker, length(k) AS n, (1::HUGEINT << length(k)::INT) - 1 AS full_, {_MASKS} AS masks FROM l WHERE k <> ''), q AS (SELECT q, list_transform(range(1, length(q) + 1), lambda i: strpos('{_ABC}', q[i])) AS codes FROM (SELECT DISTINCT {SQL.match_key('name')} AS q FROM companies WHERE name IS NOT NULL) WHERE q <> ''),
 p AS (SELECT q, ticker, round(200.0::DOUBLE * (n - bit_count(list_reduce(list_prepend(full_, list_transform(codes, lambda c: masks[c])), lambda v, b: ((v + (v & b)) | (v - (v & b))) & full_))) / (n + length(q)), 6) AS score FROM q, m),
 best AS (SELECT q, ticker, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, ticker) AS rn FROM p) WHERE rn = 1)
 SELECT name, ticker, score FROM (SELECT DISTINCT name, {SQL.match_key('name')} AS q FROM companies WHERE name IS NOT NULL) JOIN best USING (q)"""
)
def j12_x13_fuzzy_tickers(spark, d):
    return tickers.best_fuzzy(t(spark, d, "companies"), t(spark, d, "sec_list"))


_DOT = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"


@R.add(
    f"""WITH p AS (SELECT q.vec_id AS id, c.vec_id AS match_id, round({_DOT.format('q.embedding', 'c.embedding')}, 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
 SELECT id, match_id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, match_id) AS rn FROM p) WHERE rn = 1 AND score >= 0.2"""
)
def j13_cosine_best(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    return tickers.cosine_best(e.where("vec_id % 100 = 0"), e, 0.2, apart=True)


_CEN = "cen AS (SELECT label AS cluster, arg_min(embedding, vec_id) AS centroid FROM embeddings GROUP BY label)"
_ASSIGN = f"WITH {_CEN}, p AS (SELECT vec_id, cluster, round(1 - {_DOT.format('embedding', 'centroid')}, 6) AS distance FROM embeddings, cen), a AS (SELECT vec_id, cluster, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS rn FROM p) WHERE rn = 1)"


def _assigned(spark, d, far=None):
    e = t(spark, d, "embeddings")
    c = e.groupBy(F.col("label").alias("cluster")).agg(F.min_by("embedding", "vec_id").alias("centroid"))
    return semantic.nearest_centroid(e, c, far)


@R.add(_ASSIGN + " SELECT vec_id, cluster, distance FROM a WHERE distance <= 0.95")
def e3_j15_f9_nearest_centroid(spark, d):
    return _assigned(spark, d, 0.95)


@R.add(
    _ASSIGN + """ SELECT cluster, count(*)::BIGINT AS size, min(distance) AS min_d, max(distance) AS max_d, round(avg(distance), 6) AS mean_d, round(stddev_pop(distance), 6) AS std_d,
 round(quantile_cont(distance, 0.1), 6) AS p10, round(quantile_cont(distance, 0.5), 6) AS p50, round(quantile_cont(distance, 0.9), 6) AS p90, round(quantile_cont(distance, 0.99), 6) AS p99 FROM a GROUP BY cluster"""
)
def a14_distance_stats(spark, d):
    return semantic.distance_stats(_assigned(spark, d))


@R.add()
def e3_semantic_blocks(spark, d):
    return semantic.semantic_blocks(t(spark, d, "embeddings").select("vec_id", "embedding"), 50)


@R.add("SELECT vec_id, 1::BIGINT AS blocks, true AS bounded FROM embeddings WHERE vec_id IS NOT NULL")
def e3_e3b_semantic_cover(spark, d):
    """Each vector stands in one block, and no block is larger than asked for; at most the square root of the vectors as centroids."""
    b = semantic.semantic_blocks(t(spark, d, "embeddings").select("vec_id", "embedding"), 50, max_size=40, root=True)
    sizes = b.groupBy("block_key").agg((F.count("*") <= 40).alias("ok"))
    return b.join(sizes, "block_key").groupBy("vec_id").agg(F.count("*").alias("blocks"), F.bool_and("ok").alias("bounded"))


#: DuckDB counts an edit distance in bytes, so each letter outside ASCII gets a control character of its own first.
_LEV = """m AS (SELECT block_id, c.name AS name FROM (SELECT block_id, unnest(original_companies) AS c FROM blocks) WHERE c.name IS NOT NULL),
 ch AS (SELECT string_agg(x, '' ORDER BY x) AS a, string_agg(chr((n + CASE WHEN n >= 9 THEN 5 ELSE 0 END)::INT), '' ORDER BY x) AS b FROM (SELECT x, row_number() OVER (ORDER BY x) AS n FROM (SELECT DISTINCT unnest(regexp_extract_all(name, '[^\\x00-\\x7f]')) AS x FROM m))),
 u AS (SELECT DISTINCT block_id, name, CASE WHEN a IS NULL THEN name ELSE translate(name, a, b) END AS x FROM m, ch),
 p AS (SELECT a.block_id, levenshtein(a.x, b.x) AS d FROM u a JOIN u b ON a.block_id = b.block_id AND a.name < b.name), s AS (SELECT block_id, min(d) AS mn, max(d) AS mx, round(avg(d), 6) AS av FROM p GROUP BY block_id),
 n AS (SELECT block_id, count(*) AS n, count(DISTINCT name) AS k FROM m GROUP BY block_id),
 st AS (SELECT n.block_id::VARCHAR AS block_key, k::BIGINT AS unique_names, (n - k)::BIGINT AS exact_duplicates, coalesce(mn, 0)::BIGINT AS min_lev, coalesce(mx, 0)::BIGINT AS max_lev, coalesce(av, 0)::DOUBLE AS mean_lev FROM n LEFT JOIN s USING (block_id))"""


def _name_stats(spark, d):
    b = t(spark, d, "blocks").select(F.col("block_id").cast("string").alias("block_key"), F.col("original_companies.name").alias("names"))
    return semantic.name_distance_stats(b.where(F.size(F.filter("names", lambda n: n.isNotNull())) > 0))


@R.add(f"WITH {_LEV} SELECT * FROM st")
def a15_j14_x12_name_distances(spark, d):
    return _name_stats(spark, d)


@R.add(f"WITH {_LEV} SELECT * FROM st WHERE unique_names > 1 ORDER BY max_lev DESC, unique_names, block_key LIMIT 5")
def l8_most_diverse_blocks(spark, d):
    return semantic.most_diverse(_name_stats(spark, d))


@R.add(
    """SELECT (SELECT count(*) FROM companies)::BIGINT AS input_companies, count(*)::BIGINT AS blocks_created, coalesce(max(coalesce(block_size, 0)), 0)::BIGINT AS largest_block,
 (SELECT string_agg(k || ':' || n::VARCHAR, ',' ORDER BY n DESC, k) FROM (SELECT block_id::VARCHAR AS k, block_size AS n FROM blocks WHERE block_size IS NOT NULL ORDER BY n DESC, k LIMIT 10)) AS top_blocks FROM blocks"""
)
def a18_stage_metrics(spark, d):
    b = t(spark, d, "blocks").select(F.col("block_id").cast("string").alias("block_key"), "block_size")
    top = F.array_join(F.transform("top_blocks", lambda x: F.concat_ws(":", x["block_key"], x["block_size"].cast("string"))), ",")
    return blocking.stage_metrics(t(spark, d, "companies"), b).withColumn("top_blocks", top)


@R.add("SELECT key AS block_key, kind AS block_key_type, len(us)::INTEGER AS block_size, array_to_string(us, ',') AS uuids FROM (SELECT block_key AS key, block_key_type AS kind, list_transform(original_companies, lambda c: c.uuid) AS us FROM blocks WHERE original_companies IS NOT NULL) WHERE len(us) <= 30")
def udtf_split_large_blocks(spark, d):
    kv.register(spark)
    t(spark, d, "blocks").where("original_companies IS NOT NULL").createOrReplaceTempView("udtf_blocks")
    return spark.sql("SELECT s.block_key, s.block_key_type, s.block_size, array_join(s.uuids, ',') AS uuids FROM udtf_blocks b, LATERAL split_large_blocks(b.block_key, b.block_key_type, b.original_companies.uuid, 30) s")


@R.add(
    """WITH p AS (SELECT user_id::VARCHAR AS symbol, arg_min(value, ts) AS first_close, arg_max(value, ts) AS last_close FROM events GROUP BY user_id)
 SELECT symbol, first_close, last_close, round(100.0 * (last_close - first_close) / first_close, 6) AS return_pct FROM p WHERE first_close IS NOT NULL AND first_close <> 0 AND last_close IS NOT NULL"""
)
def a16_m1_l7_returns(spark, d):
    return finance.returns(t(spark, d, "events").select(F.col("user_id").cast("string").alias("symbol"), "ts", F.col("value").alias("close")))


_FACTS = "f AS (SELECT user_id AS entity, event_type AS tag, value AS val, ts::DATE AS \"end\", ts::DATE + (event_id % 300 - 20)::INTEGER AS filed, event_id FROM events WHERE value IS NOT NULL)"


def _facts(spark, d):
    e = t(spark, d, "events").where("value IS NOT NULL")
    day = F.col("ts").cast("date")
    return e.select(F.col("user_id").alias("entity"), F.col("event_type").alias("tag"), F.col("value").alias("val"), day.alias("end"), F.date_add(day, (F.col("event_id") % 300 - 20).cast("int")).alias("filed"), "event_id")


_CONCEPTS = [("activity", "purchase", 0), ("activity", "click", 1), ("activity", "view", 2), ("trouble", "error", 0), ("trouble", "signup", 1)]
_TAGS = list(dict.fromkeys(g for tags in finance.CONCEPTS.values() for g in tags))
_TAG_LIST = ", ".join(f"'{g}'" for g in _TAGS)
_MAP = ", ".join(f"('{c}', '{g}', {i})" for c, tags in finance.CONCEPTS.items() for i, g in enumerate(tags))
#: Events as reported facts of the 21 concepts, some dates in other notations or unreadable.
_REPORTED = f"""r AS (SELECT user_id AS entity, [{_TAG_LIST}][1 + event_id * 7 % {len(_TAGS)}] AS tag, value AS val, ts::DATE AS "end", CASE WHEN event_id % 3 = 0 THEN '10-K' ELSE '10-Q' END AS form, event_id,
 CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts - INTERVAL 2 YEAR, '%Y/%m/%d') WHEN 2 THEN strftime(ts, '%m/%d/%Y') ELSE 'soon' END AS filed FROM events WHERE value IS NOT NULL)"""


def _reported(spark, d):
    e, i = t(spark, d, "events").where("value IS NOT NULL"), F.col("event_id")
    two = F.col("ts") - F.expr("INTERVAL 2 YEAR")
    filed = F.when(i % 4 == 0, F.date_format("ts", "yyyy-MM-dd")).when(i % 4 == 1, F.date_format(two, "yyyy/MM/dd")).when(i % 4 == 2, F.date_format("ts", "MM/dd/yyyy")).otherwise("soon")
    tag = F.element_at(F.array(*[F.lit(g) for g in _TAGS]), (1 + i * 7 % len(_TAGS)).cast("int"))
    return e.select(F.col("user_id").alias("entity"), tag.alias("tag"), F.col("value").alias("val"), F.col("ts").cast("date").alias("end"), F.when(i % 3 == 0, "10-K").otherwise("10-Q").alias("form"), filed.alias("filed"), i.alias("event_id"), F.col("ts"))


def _concepts(spark):
    return spark.createDataFrame(_CONCEPTS, "concept string, tag string, tag_rank int")


@R.add(
    f"""WITH {_REPORTED}, c(concept, tag, tag_rank) AS (VALUES {_MAP}), k AS (SELECT * FROM r WHERE form = '10-Q' AND year(coalesce(try_strptime(filed, '%Y-%m-%d'), try_strptime(filed, '%Y/%m/%d'), try_strptime(filed, '%m/%d/%Y'))) >= 2023),
 latest AS (SELECT entity, tag, arg_max(val, ("end", filed, val)) AS val, max("end") AS "end" FROM k GROUP BY entity, tag)
 SELECT entity, concept, arg_min(tag, tag_rank) AS tag, arg_min(val, tag_rank) AS val, arg_min("end", tag_rank) AS "end" FROM latest JOIN c USING (tag) GROUP BY entity, concept"""
)
def m2_x29_company_facts(spark, d):
    return finance.company_facts(_reported(spark, d), finance.concept_table(spark), "10-Q", 2023)


@R.add(
    f"""WITH {_REPORTED}, c(concept, tag, tag_rank) AS (VALUES {_MAP}), f AS (SELECT entity AS doc, 'c' || (event_id % 5)::VARCHAR AS context_id, tag, val, event_id AS seq FROM r),
 x AS (SELECT entity AS doc, 'c' || (event_id % 5)::VARCHAR AS context_id, min((event_id // 5 % 2, "end")) AS m FROM r WHERE event_id % 5 > 0 GROUP BY ALL),
 j AS (SELECT f.*, m[2] AS "end", m[1] AS dims, concept, tag_rank FROM f JOIN x USING (doc, context_id) JOIN c USING (tag))
 SELECT doc, "end", concept, arg_min(tag, (tag_rank, dims > 0, seq)) AS tag, arg_min(val, (tag_rank, dims > 0, seq)) AS val FROM j GROUP BY doc, "end", concept"""
)
def j16_s12_x29_instance_values(spark, d):
    r = _reported(spark, d)
    context = F.concat(F.lit("c"), (F.col("event_id") % 5).cast("string"))
    facts = r.select(F.col("entity").alias("doc"), context.alias("context_id"), "tag", "val", F.col("event_id").alias("seq"))
    contexts = r.where("event_id % 5 > 0").select(F.col("entity").alias("doc"), context.alias("context_id"), "end", (F.floor(F.col("event_id") / 5) % 2).alias("dims"))
    return finance.instance_values(facts, contexts, finance.concept_table(spark))


@R.add(f"WITH {_FACTS} SELECT entity, tag, arg_max(val, (\"end\", filed, val)) AS val, arg_max(\"end\", (\"end\", filed, val)) AS \"end\" FROM f GROUP BY entity, tag")
def w3_w6_latest_facts(spark, d):
    return finance.latest_facts(_facts(spark, d)).select("entity", "tag", "val", "end")


_VALUES = ", ".join(f"('{c}', '{g}', {i})" for c, g, i in _CONCEPTS)
_CV = f"WITH {_FACTS}, c(concept, tag, tag_rank) AS (VALUES {_VALUES}), latest AS (SELECT entity, tag, arg_max(val, (\"end\", filed, val)) AS val FROM f GROUP BY entity, tag), cv AS (SELECT entity, concept, arg_min(tag, tag_rank) AS tag, arg_min(val, tag_rank) AS val FROM latest JOIN c USING (tag) GROUP BY entity, concept)"


@R.add(_CV + " SELECT entity, concept, tag, val FROM cv")
def w5_concept_values(spark, d):
    return finance.concept_values(_facts(spark, d), _concepts(spark)).select("entity", "concept", "tag", "val")


@R.add(_CV + " SELECT entity, count(DISTINCT concept)::BIGINT AS present, count(DISTINCT concept) >= 2 AS ok FROM cv GROUP BY entity")
def a23_enough_items(spark, d):
    return finance.enough_items(finance.concept_values(_facts(spark, d), _concepts(spark)), ("activity", "trouble"), 2)


@R.add(f"WITH {_FACTS} SELECT event_id FROM f WHERE filed - \"end\" > 0 AND filed - \"end\" <= 150")
def f15_filing_window(spark, d):
    return finance.in_filing_window(_facts(spark, d)).select("event_id")


@R.add("SELECT user_id AS doc, event_type AS tag, arg_min(value, (event_id % 3 > 0, event_id)) AS val FROM events GROUP BY ALL")
def w4_best_facts(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("tag"), (F.col("event_id") % 3).alias("dims"), F.col("event_id").alias("seq"), F.col("value").alias("val"))
    return finance.best_facts(e)


@R.add(
    f"""WITH {_FACTS}, s AS (SELECT entity, val, 'api' AS m, 0 AS i FROM f WHERE tag = 'purchase' UNION ALL SELECT entity, val, 'xbrl', 1 FROM f WHERE tag = 'error' UNION ALL SELECT entity, val, 'html', 2 FROM f WHERE tag = 'view')
 SELECT entity, arg_min(val, (i, val)) AS val, arg_min(m, (i, val)) AS source_method FROM s GROUP BY entity"""
)
def m3_source_cascade(spark, d):
    f = _facts(spark, d)
    return finance.cascade([("api", f.where("tag = 'purchase'")), ("xbrl", f.where("tag = 'error'")), ("html", f.where("tag = 'view'"))], ["entity"])


@R.add(
    """WITH x AS (SELECT user_id, event_type AS form, 'a-' || event_id::VARCHAR AS accession, strftime(ts, '%Y-%m-%d') AS filed FROM events WHERE event_type = 'click')
 SELECT lpad(user_id::VARCHAR, 10, '0') AS cik, replace(accession, '-', '') AS accession, filed FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY filed DESC, accession DESC) AS rn FROM x) WHERE rn <= 3"""
)
def s10_filings(spark, d):
    e = t(spark, d, "events").groupBy(F.col("user_id").alias("cik")).agg(F.collect_list(F.struct(F.col("event_type").alias("form"), F.concat(F.lit("a-"), F.col("event_id").cast("string")).alias("accession"), F.date_format("ts", "yyyy-MM-dd").alias("filed"))).alias("x"))
    return finance.filings(e.select("cik", F.col("x.form").alias("form"), F.col("x.accession").alias("accession"), F.col("x.filed").alias("filed")), "click", 3)


@R.add("SELECT DISTINCT ticker FROM (SELECT ticker FROM companies UNION ALL SELECT ticker FROM sec_list) WHERE ticker IS NOT NULL AND ticker <> ''")
def m4_distinct_tickers(spark, d):
    return finance.distinct_symbols(t(spark, d, "companies"), t(spark, d, "sec_list"))


_E = "e AS (SELECT DISTINCT src, dst FROM relationships WHERE src IS NOT NULL AND dst IS NOT NULL)"


def _edges(spark, d):
    return t(spark, d, "relationships").where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()


@R.add(f"WITH {_E} SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*)::BIGINT AS degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node")
def g1_degrees(spark, d):
    return graph.degrees(_edges(spark, d))


@R.add(f"WITH {_E}, x AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node) SELECT count(*)::BIGINT AS nodes, (sum(degree) / 2)::BIGINT AS edges, round(avg(degree), 6) AS mean_degree, median(degree)::DOUBLE AS median_degree FROM x")
def g1_a19_degree_summary(spark, d):
    return graph.degree_summary(_edges(spark, d))


_WCC = f"""{_E}, both_ AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(node, component) USING KEY (node) AS (SELECT src, least(src, min(dst)) FROM both_ GROUP BY src
 UNION SELECT b.src, min(r.component) FROM r JOIN both_ b ON b.dst = r.node JOIN recurring.r AS old ON old.node = b.src GROUP BY b.src HAVING min(r.component) < min(old.component))"""


@R.add(f"WITH RECURSIVE {_WCC} SELECT node, component FROM r")
def g2_components(spark, d):
    return graph.components(_edges(spark, d))


@R.add(f"WITH RECURSIVE {_WCC} SELECT size, count(*)::BIGINT AS components FROM (SELECT count(*)::BIGINT AS size FROM r GROUP BY component) GROUP BY size")
def g2_component_sizes(spark, d):
    return graph.component_sizes(graph.components(_edges(spark, d)))


@R.add(f"WITH RECURSIVE {_E}, v AS (SELECT src AS x FROM e UNION SELECT dst FROM e), r(x, y) AS (SELECT x, x FROM v UNION SELECT r.x, e.dst FROM r JOIN e ON e.src = r.y) SELECT a.x AS node, max(a.y) AS component FROM r a JOIN r b ON a.x = b.y AND a.y = b.x GROUP BY a.x")
def g3_strong_components(spark, d):
    return graph.strong_components(_edges(spark, d))


@R.add(
    f"""WITH {_E}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst), n AS (SELECT a AS x, b AS y FROM u UNION ALL SELECT b, a FROM u), deg AS (SELECT x AS node, count(*) AS degree FROM n GROUP BY x),
 tri AS (SELECT p.x AS node, count(*) AS triangles FROM n p JOIN n q ON p.x = q.x AND p.y < q.y JOIN u ON u.a = p.y AND u.b = q.y GROUP BY p.x)
 SELECT deg.node, degree::BIGINT AS degree, coalesce(triangles, 0)::BIGINT AS triangles, round(CASE WHEN degree > 1 THEN 2.0::DOUBLE * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 6)::DOUBLE AS coefficient FROM deg LEFT JOIN tri USING (node)"""
)
def g4_clustering(spark, d):
    return graph.clustering(_edges(spark, d))


_DIRECTED = f"""{_E}, s AS (SELECT * FROM e WHERE src <> dst), w AS (SELECT x AS a, y AS b, count(*) AS k FROM (SELECT src AS x, dst AS y FROM s UNION ALL SELECT dst, src FROM s) GROUP BY x, y),
 deg AS (SELECT a AS node, sum(k) AS degree, count_if(k = 2) AS mutual FROM w GROUP BY a), tri AS (SELECT p.a AS node, sum(p.k * q.k * z.k) AS triangles FROM w p JOIN w q ON p.a = q.a AND p.b < q.b JOIN w z ON z.a = p.b AND z.b = q.b GROUP BY p.a),
 cl AS (SELECT deg.node, degree::BIGINT AS degree, mutual::BIGINT AS mutual, coalesce(triangles, 0)::BIGINT AS triangles, round(CASE WHEN degree * (degree - 1) - 2 * mutual > 0 THEN coalesce(triangles, 0) / (2.0::DOUBLE * (degree * (degree - 1) - 2 * mutual)) ELSE 0 END, 6)::DOUBLE AS coefficient FROM deg LEFT JOIN tri USING (node))"""


@R.add(f"WITH {_DIRECTED} SELECT * FROM cl")
def g4_directed_clustering(spark, d):
    return graph.directed_clustering(_edges(spark, d))


@R.add(
    f"""WITH RECURSIVE {_DIRECTED.replace(_E, _WCC, 1)}, x AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node), sizes AS (SELECT count(*) AS n FROM r GROUP BY component)
 SELECT count(*)::BIGINT AS nodes, (sum(degree) / 2)::BIGINT AS edges, round(avg(degree), 6) AS mean_degree, median(degree)::DOUBLE AS median_degree, (SELECT count(*) FROM sizes)::BIGINT AS components, (SELECT max(n) FROM sizes)::BIGINT AS largest,
 (SELECT round(avg(coefficient), 6) FROM cl) AS mean_clustering, (SELECT round(median(coefficient), 6) FROM cl) AS median_clustering FROM x"""
)
def a19_graph_summary(spark, d):
    return graph.summary(_edges(spark, d))


@R.add(
    f"""WITH RECURSIVE {_E}, r(node, depth) AS (SELECT min(src), 0 FROM e UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 4) SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY node"""
)
def g6_reachable(spark, d):
    e = _edges(spark, d)
    return graph.reachable(e, e.agg(F.min("src").alias("node")), 4)


_LISTS = {"partnerships": "Partnership", "investments": "Investment", "suppliers": "Supplier", "subsidiaries": "Subsidiary"}


@R.add(
    " UNION ".join(
        f"SELECT src, dst, '{graph.REPORT_EDGES[c][0]}' AS relationship FROM relationships WHERE relationship = '{k}' AND src IS NOT NULL AND dst IS NOT NULL UNION SELECT dst, src, '{graph.REPORT_EDGES[c][1]}' FROM relationships WHERE relationship = '{k}' AND src IS NOT NULL AND dst IS NOT NULL"
        for c, k in _LISTS.items()
    )
)
def g5_report_edges(spark, d):
    r = t(spark, d, "relationships").where("src IS NOT NULL")
    return graph.report_edges(r.select(F.col("src").alias("id"), *[F.when(F.col("relationship") == k, F.array("dst")).alias(c) for c, k in _LISTS.items()]))


@R.add(_KEYS + ", " + _ASSIGN.removeprefix("WITH ") + " SELECT block_key, block_key_type, uuid AS member FROM b UNION ALL SELECT 'semantic_' || cluster::VARCHAR, 'semantic', vec_id::VARCHAR FROM a")
def e11_combined_blocks(spark, d):
    names = blocking.assign_blocks(blocking.name_keys(t(spark, d, "companies")))
    return blocking.combine_blocks(names, _assigned(spark, d).select(F.concat(F.lit("semantic_"), F.col("cluster").cast("string")).alias("block_key"), "vec_id"))


_JT = "CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' END"


@R.add(
    f"""WITH o AS (SELECT payload::JSON AS j FROM raw_files WHERE json_valid(payload) AND regexp_matches(payload, '^\\s*\\{{.*\\}}\\s*$')), f AS (SELECT field, j->('$."' || field || '"') AS v FROM (SELECT j, unnest(json_keys(j)) AS field FROM o)),
 n AS (SELECT field, {_JT} AS json_type, count(*) AS lines FROM f WHERE field <> 'uuid' AND json_type(v) <> 'NULL' GROUP BY ALL)
 SELECT field, json_type, lines::BIGINT AS lines, row_number() OVER (PARTITION BY field ORDER BY lines DESC, json_type) = 1 AS most FROM n"""
)
def a21_type_profile(spark, d):
    return drift.type_profile(t(spark, d, "raw_files"))
