"""Queries on the knowledge graph: building, matching, evaluating, refining."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwerk.functions.ids import clean_uuid
from strandwerk.functions.names import SQL, match_key
from strandwerk.operators import evaluate, graph_build, iterate, matching, refine
from strandwerk.plans.registry import Registry, table

R = Registry()
t = table

_OK = """WITH rel AS (SELECT article_id, unnest(relationships) AS r FROM articles), comp AS (SELECT article_id, unnest(companies).id AS id FROM articles),
 bad AS (SELECT DISTINCT article_id FROM rel WHERE (r.src_company IS NOT NULL AND NOT EXISTS (SELECT 1 FROM comp WHERE comp.article_id = rel.article_id AND comp.id = r.src_company))
  OR (r.dst_company IS NOT NULL AND NOT EXISTS (SELECT 1 FROM comp WHERE comp.article_id = rel.article_id AND comp.id = r.dst_company)))"""


@R.add(_OK + " SELECT article_id, article_id NOT IN (SELECT article_id FROM bad) AS ok FROM articles")
def f1_integrity(spark, d):
    return graph_build.with_integrity(t(spark, d, "articles")).select("article_id", "ok")


@R.add(_OK + " SELECT article_id, title, url, posted_at FROM articles WHERE article_id IN (SELECT article_id FROM bad)")
def so1_k3_rejected(spark, d):
    return graph_build.with_integrity(t(spark, d, "articles")).where("NOT ok").select("article_id", "title", "url", "posted_at")


def _id(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN md5(article_id::VARCHAR || '|' || {x}::VARCHAR) END"


_NAME = "trim(regexp_replace(o.name, '[\\r\\n]+', ' ', 'g'))"


@R.add(f"SELECT {_id('o.id')} AS uuid, article_id, url, {_NAME} AS name, o.revenue_usd AS revenue_usd, o.ticker.symbol AS symbol FROM (SELECT article_id, url, unnest(companies) AS o FROM articles) WHERE o.id IS NOT NULL")
def p5_n1_companies(spark, d):
    return graph_build.entities(t(spark, d, "articles"), "companies").select("uuid", "article_id", "url", "name", "revenue_usd", F.col("ticker.symbol").alias("symbol"))


@R.add(
    f"""SELECT {_id('o.id')} AS uuid, article_id, {_NAME} AS name, {_id('o.manufacturer')} AS manufacturer,
 array_to_string(list_transform(list_filter(o.technologies, lambda x: x IS NOT NULL), lambda x: md5(article_id::VARCHAR || '|' || x::VARCHAR)), ',') AS technologies FROM (SELECT article_id, unnest(products) AS o FROM articles) WHERE o.id IS NOT NULL"""
)
def p5_p6_products(spark, d):
    return graph_build.entities(t(spark, d, "articles"), "products").select("uuid", "article_id", "name", "manufacturer", F.array_join("technologies", ",").alias("technologies"))


@R.add(f"SELECT {_id('o.id')} AS uuid, article_id, {_NAME} AS name, {_id('o.developer')} AS developer FROM (SELECT article_id, unnest(technologies) AS o FROM articles) WHERE o.id IS NOT NULL")
def p5_p7_technologies(spark, d):
    return graph_build.entities(t(spark, d, "articles"), "technologies").select("uuid", "article_id", "name", "developer")


@R.add(f"SELECT {_id('o.id')} AS uuid, article_id, o.symbol AS symbol, o.exchange AS exchange FROM (SELECT article_id, unnest(tickers) AS o FROM articles) WHERE o.id IS NOT NULL")
def p5_tickers(spark, d):
    return graph_build.entities(t(spark, d, "articles"), "tickers").select("uuid", "article_id", "symbol", "exchange")


_EDGES = f"""e AS (SELECT {_id('r.src_company')} AS src, {_id('r.dst_company')} AS dst, r.type AS relationship, article_id, r.amount AS amount, r.products AS products FROM (SELECT article_id, unnest(relationships) AS r FROM articles)
 WHERE r.src_company IS NOT NULL AND r.dst_company IS NOT NULL)"""


@R.add(f"WITH {_EDGES} SELECT src, dst, relationship, article_id, amount FROM e")
def p5_p8_edges(spark, d):
    return graph_build.edges(t(spark, d, "articles")).select("src", "dst", "relationship", "article_id", "amount")


@R.add(f"WITH {_EDGES}, n AS (SELECT DISTINCT {_id('o.id')} AS uuid FROM (SELECT article_id, unnest(companies) AS o FROM articles)) SELECT src, dst, relationship, article_id FROM e WHERE src IN (SELECT uuid FROM n WHERE uuid IS NOT NULL) AND dst IN (SELECT uuid FROM n WHERE uuid IS NOT NULL)")
def j5_valid_edges(spark, d):
    a = t(spark, d, "articles")
    return graph_build.valid_edges(graph_build.edges(a), graph_build.entities(a, "companies")).select("src", "dst", "relationship", "article_id")


@R.add(
    f"""WITH p AS (SELECT uuid, min(name) AS name FROM (SELECT {_id('o.id')} AS uuid, {_NAME} AS name FROM (SELECT article_id, unnest(products) AS o FROM articles) WHERE o.id IS NOT NULL) GROUP BY uuid),
 r AS (SELECT article_id, pos, r.products AS ps FROM (SELECT article_id, unnest(relationships) AS r, unnest(range(len(relationships))) AS pos FROM articles) WHERE r IS NOT NULL),
 x AS (SELECT article_id, pos, unnest(ps) AS id, unnest(range(len(ps))) AS i FROM r),
 y AS (SELECT x.article_id, x.pos, string_agg(coalesce(p.name, md5(x.article_id::VARCHAR || '|' || x.id::VARCHAR)), '; ' ORDER BY x.i) AS names FROM x LEFT JOIN p ON p.uuid = md5(x.article_id::VARCHAR || '|' || x.id::VARCHAR) WHERE x.id IS NOT NULL GROUP BY ALL)
 SELECT r.article_id::VARCHAR || '/' || r.pos::VARCHAR AS edge, CASE WHEN ps IS NULL THEN NULL ELSE coalesce(y.names, '') END AS products FROM r LEFT JOIN y USING (article_id, pos)"""
)
def j11_names_for_ids(spark, d):
    a = t(spark, d, "articles")
    r = a.select("article_id", F.posexplode("relationships").alias("pos", "r")).where("r IS NOT NULL")
    ids = F.transform(F.col("r.products"), lambda x: graph_build.entity_id(F.col("article_id"), x))
    r = r.select(F.concat_ws("/", "article_id", "pos").alias("edge"), ids.alias("products"))
    out = graph_build.names_for_ids(r, "edge", "products", graph_build.entities(a, "products").select("uuid", "name"))
    return out.select("edge", F.array_join("products", "; ").alias("products"))


_MEM = f"""WITH m AS (SELECT block_id::VARCHAR AS block_key, o.id AS id, o.uuid AS uuid, o.name AS name, o.cik AS cik, o.revenue_usd AS revenue_usd, o.source_uuids AS source_uuids FROM (SELECT block_id, unnest(original_companies) AS o FROM blocks) WHERE o.uuid IS NOT NULL),
 m1 AS (SELECT *, coalesce(nullif({SQL.match_key('name')}, ''), '#' || uuid) AS g FROM m), n AS (SELECT block_key, count(DISTINCT uuid) AS n FROM m GROUP BY block_key),
 g AS (SELECT m1.block_key, g, max(n) AS n, arg_min(uuid, (coalesce(id, 4611686018427387904), uuid)) AS master_uuid, arg_max(name, (length(name), name)) FILTER (name IS NOT NULL) AS name, arg_min(cik, (coalesce(id, 4611686018427387904), uuid)) FILTER (cik IS NOT NULL) AS cik,
  arg_min(revenue_usd, (coalesce(id, 4611686018427387904), uuid)) FILTER (revenue_usd IS NOT NULL) AS revenue_usd, array_to_string(list_sort(list_distinct(flatten(list(list_concat([uuid], coalesce(source_uuids, []::VARCHAR[])))))), '|') AS source_uuids FROM m1 JOIN n USING (block_key) GROUP BY ALL HAVING true)"""
_MEM = _MEM.replace("FROM m1 JOIN n USING (block_key) GROUP BY ALL HAVING true", "FROM m1 JOIN n USING (block_key) GROUP BY m1.block_key, g")


def _members(spark, d):
    b = t(spark, d, "blocks").select(F.col("block_id").cast("string").alias("block_key"), F.explode("original_companies").alias("o")).where("o.uuid IS NOT NULL")
    return b.select("block_key", *[f"o.{c}" for c in ("id", "uuid", "name", "cik", "revenue_usd", "source_uuids")])


@R.add(_MEM + " SELECT block_key, CASE WHEN n = 1 THEN master_uuid ELSE md5(source_uuids || '|1') END AS uuid, master_uuid, name, cik, revenue_usd, source_uuids, n = 1 AS match_skip, CASE WHEN n = 1 THEN 'singleton_block' END AS reason FROM g")
def e4_e8_merge_blocks(spark, d):
    m = matching.merge_members(_members(spark, d))
    return m.select("block_key", "uuid", "master_uuid", "name", "cik", "revenue_usd", F.array_join("source_uuids", "|").alias("source_uuids"), "match_skip", F.col("match_skip_reason").alias("reason"))


@R.add(
    """WITH o AS (SELECT block_id, unnest(original_companies).uuid AS uuid FROM blocks), r AS (SELECT block_id, unnest(s) AS uuid FROM (SELECT block_id, unnest(resolved_companies).source_uuids AS s FROM blocks))
 SELECT DISTINCT block_id::VARCHAR AS block_key, uuid FROM o WHERE uuid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.block_id = o.block_id AND r.uuid = o.uuid)"""
)
def e6_so10_recovered(spark, d):
    b = t(spark, d, "blocks").withColumn("block_key", F.col("block_id").cast("string"))
    ins = b.select("block_key", F.explode("original_companies.uuid").alias("uuid")).where("uuid IS NOT NULL").distinct()
    outs = b.select("block_key", F.explode("resolved_companies").alias("r")).select("block_key", "r.source_uuids")
    return matching.recover(ins, outs).select("block_key", "uuid")


@R.add("WITH m AS (SELECT DISTINCT block_id::VARCHAR AS block_key, unnest(original_companies).uuid AS uuid FROM blocks) SELECT block_key, uuid, dense_rank() OVER (PARTITION BY block_key ORDER BY uuid)::INTEGER AS local_id FROM m WHERE uuid IS NOT NULL")
def n10_local_ids(spark, d):
    return matching.local_ids(_members(spark, d).select("block_key", "uuid").distinct())


def _resolved(spark, d):
    c = iterate.one_each(t(spark, d, "companies").where("uuid IS NOT NULL")).select("uuid", "id", "name", "description", "cik", "website_url", "revenue_usd", F.array().cast("array<string>").alias("source_uuids"))
    return iterate.resolve(c, rounds=3)


@R.add()
def e10_resolve_rounds(spark, d):
    return _resolved(spark, d).select("uuid", "name", F.array_join("source_uuids", "|").alias("source_uuids"))


@R.add("SELECT DISTINCT uuid FROM companies WHERE uuid IS NOT NULL")
def e10_lineage_complete(spark, d):
    """The records in the lineage of what the rounds leave: all of them."""
    made = _resolved(spark, d).select(F.explode("source_uuids").alias("uuid")).distinct()
    return made.join(t(spark, d, "companies").select("uuid"), "uuid", "left_semi")


_UU = "CASE WHEN regexp_full_match({0}, '[0-9a-f]{{32}}') AND {0} <> '00000000000000000000000000000000' THEN {0}[1:8] || '-' || {0}[9:12] || '-' || {0}[13:16] || '-' || {0}[17:20] || '-' || {0}[21:32] END"
_CLEAN = lambda x: _UU.format(f"regexp_replace(regexp_replace(lower({x}), '[{{}}\\s-]', '', 'g'), '^urn:uuid:', '')")


@R.add(
    f"""WITH b AS (SELECT iteration, count(*) AS blocks, count(error) AS errors, sum(coalesce(len(original_companies), 0)) AS originals, sum(coalesce(len(resolved_companies), 0)) AS resolved, count_if(coalesce(was_resolved, false)) AS resolved_blocks FROM blocks GROUP BY iteration),
 m AS (SELECT iteration, r FROM (SELECT iteration, unnest(resolved_companies) AS r FROM blocks) WHERE r.uuid IS NOT NULL), s AS (SELECT iteration, count_if(coalesce(r.match_skip, false)) AS skipped, count(DISTINCT r.uuid) AS entities FROM m GROUP BY iteration),
 l AS (SELECT DISTINCT iteration, {_CLEAN('u')} AS u FROM (SELECT iteration, unnest(r.source_uuids) AS u FROM m)), o AS (SELECT DISTINCT iteration, {_CLEAN('u')} AS u FROM (SELECT iteration, unnest(original_companies).uuid AS u FROM blocks)),
 c AS (SELECT o.iteration, count(*) AS inputs, count(l.u) AS covered FROM o LEFT JOIN l ON l.iteration = o.iteration AND l.u = o.u WHERE o.u IS NOT NULL GROUP BY o.iteration),
 kn AS (SELECT u, min(i) AS since FROM (SELECT u, iteration AS i FROM o UNION ALL SELECT {_CLEAN('r.uuid')}, iteration + 1 FROM m) WHERE u IS NOT NULL GROUP BY u),
 rf AS (SELECT iteration, count(*) AS refs, count_if(since <= iteration) AS valid_refs FROM (SELECT iteration, {_CLEAN('s')} AS u FROM (SELECT DISTINCT iteration, r.uuid AS e, unnest(r.source_uuids) AS s FROM m) WHERE s IS NOT NULL) LEFT JOIN kn USING (u) GROUP BY iteration),
 md AS (SELECT DISTINCT iteration, {_CLEAN('r.uuid')} AS u FROM m WHERE NOT coalesce(r.match_skip, false)), ov AS (SELECT md.iteration, count(*) AS made, count(o.u) AS overlap FROM md LEFT JOIN o ON o.iteration = md.iteration AND o.u = md.u WHERE md.u IS NOT NULL GROUP BY md.iteration)
 SELECT iteration, blocks::BIGINT AS blocks, errors::BIGINT AS errors, originals::BIGINT AS originals, resolved::BIGINT AS resolved, resolved_blocks::BIGINT AS resolved_blocks, skipped::BIGINT AS skipped, entities::BIGINT AS entities, inputs::BIGINT AS inputs, covered::BIGINT AS covered,
 round(100.0::DOUBLE * covered / inputs, 6) AS coverage_pct, round(100.0::DOUBLE * errors / blocks, 6) AS error_pct, round(100 - 100.0::DOUBLE * resolved / originals, 6) AS reduction_pct,
 refs::BIGINT AS refs, valid_refs::BIGINT AS valid_refs, (refs - valid_refs)::BIGINT AS invalid_refs, made::BIGINT AS made, overlap::BIGINT AS overlap, round(100.0::DOUBLE * (refs - valid_refs) / refs, 6) AS invalid_pct, round(100.0::DOUBLE * overlap / made, 6) AS overlap_pct
 FROM b JOIN s USING (iteration) JOIN c USING (iteration) JOIN rf USING (iteration) JOIN ov USING (iteration)"""
)
def e9_a7_metrics(spark, d):
    return evaluate.metrics(t(spark, d, "blocks"))


_A7 = f"""WITH first AS (SELECT DISTINCT u FROM (SELECT {_CLEAN('uuid')} AS u FROM companies) WHERE u IS NOT NULL), r AS (SELECT iteration, {_CLEAN('uuid')} AS u, coalesce(match_skip, false) AS sk, match_skip_reason AS reason FROM resolved_companies),
 n AS (SELECT iteration, count(*) AS n, count_if(sk) AS s, count_if(reason = 'missing_in_match_output') AS dr FROM r GROUP BY iteration), made AS (SELECT DISTINCT iteration, u FROM r WHERE NOT sk AND u IS NOT NULL), md AS (SELECT iteration, count(*) AS n FROM made GROUP BY iteration),
 ov AS (SELECT iteration, count(*) AS n FROM made JOIN first USING (u) GROUP BY iteration), kn AS (SELECT u, min(since) AS since FROM (SELECT u, 0 AS since FROM first UNION ALL SELECT u, iteration FROM r WHERE u IS NOT NULL) GROUP BY u),
 rf AS (SELECT iteration, {_CLEAN('s')} AS u FROM (SELECT iteration, unnest(source_uuids) AS s FROM resolved_companies)),
 ls AS (SELECT iteration, count(*) AS t, count(DISTINCT rf.u) AS un, count_if(since < iteration) AS v, count(DISTINCT CASE WHEN since = 0 THEN rf.u END) AS tr FROM rf LEFT JOIN kn USING (u) GROUP BY iteration),
 b AS (SELECT iteration, count(*) AS n FROM blocks GROUP BY iteration), tot AS (SELECT count(*) AS n, (SELECT count(*) FROM first) AS u FROM companies),
 x AS (SELECT n.iteration, coalesce(b.n, 0) AS blocks, CASE WHEN n.iteration > 1 THEN coalesce(p.n, 0) ELSE tot.n END AS inp, tot.n AS total, tot.u AS uniq, tot.n - n.s AS into_, n.s AS sk, coalesce(md.n, 0) AS um, n.dr, coalesce(ov.n, 0) AS ov, coalesce(un, 0) AS un, coalesce(tr, 0) AS tr, coalesce(ls.t, 0) AS t, coalesce(v, 0) AS v
  FROM n CROSS JOIN tot LEFT JOIN b ON b.iteration = n.iteration LEFT JOIN n p ON p.iteration = n.iteration - 1 LEFT JOIN md ON md.iteration = n.iteration LEFT JOIN ov ON ov.iteration = n.iteration LEFT JOIN ls ON ls.iteration = n.iteration)"""
_PCT = lambda a, b: f"round(CASE WHEN {b} > 0 THEN 100.0::DOUBLE * ({a}) / ({b}) ELSE 0 END, 6)::DOUBLE"


def _rounds(spark, d):
    return t(spark, d, "resolved_companies").select("iteration", "uuid", "source_uuids", "match_skip", "match_skip_reason")


@R.add(
    _A7 + f""" SELECT iteration, blocks::BIGINT AS total_blocks, inp::BIGINT AS iteration_input_companies, total::BIGINT AS total_original_companies, into_::BIGINT AS companies_that_went_into_matching, sk::BIGINT AS skipped_records, um::BIGINT AS unique_matched,
 (into_ - um)::BIGINT AS reduction_from_matching, {_PCT('into_ - um', 'into_')} AS reduction_from_matching_pct, dr::BIGINT AS ids_dropped_by_matching, {_PCT('dr', 'into_')} AS ids_dropped_by_matching_pct, (um + sk)::BIGINT AS total_output_companies,
 (total - um - sk)::BIGINT AS total_reduction, {_PCT('total - um - sk', 'total')} AS total_reduction_pct, ov::BIGINT AS uuid_overlap_with_original_count, {_PCT('ov', 'um')} AS uuid_overlap_with_original_pct, un::BIGINT AS unique_source_uuids, tr::BIGINT AS tracked_original_uuids,
 {_PCT('tr', 'uniq')} AS original_coverage_pct, t::BIGINT AS total_source_uuid_refs, v::BIGINT AS valid_source_uuid_count, (t - v)::BIGINT AS invalid_source_uuid_count, {_PCT('t - v', 't')} AS source_uuid_error_pct FROM x"""
)
def a7_round_metrics(spark, d):
    return evaluate.round_metrics(t(spark, d, "companies"), t(spark, d, "blocks"), _rounds(spark, d))


@R.add(_A7 + " SELECT u, since::BIGINT AS since FROM kn")
def so7_known_uuids(spark, d):
    return evaluate.known_uuids(t(spark, d, "companies"), _rounds(spark, d))


@R.add("SELECT coalesce(r.match_skip, false) AS match_skip, coalesce(r.match_skip_reason, '') AS reason, count(*)::BIGINT AS entries FROM (SELECT unnest(resolved_companies) AS r FROM blocks) WHERE r.uuid IS NOT NULL GROUP BY ALL")
def a8_f6_skip_reasons(spark, d):
    return evaluate.skip_reasons(t(spark, d, "blocks"))


@R.add("SELECT coalesce(len(source_uuids), 0)::BIGINT AS sources, count(*)::BIGINT AS entries FROM resolved_companies GROUP BY ALL")
def a8_n7_lineage_sizes(spark, d):
    return evaluate.lineage_sizes(t(spark, d, "resolved_companies"))


@R.add("SELECT block_id, r.uuid AS uuid, r.name AS name FROM (SELECT block_id, unnest(resolved_companies) AS r FROM blocks) WHERE r.uuid IS NOT NULL")
def n2_flat_matches(spark, d):
    return evaluate.flatten_matches(t(spark, d, "blocks")).select("block_id", "uuid", "name")


@R.add(
    """WITH a AS (SELECT DISTINCT uuid FROM companies WHERE uuid IS NOT NULL), b AS (SELECT DISTINCT src AS uuid FROM relationships WHERE src IS NOT NULL)
 SELECT (SELECT count(*) FROM a)::BIGINT AS "left", (SELECT count(*) FROM b)::BIGINT AS "right", (SELECT count(*) FROM (SELECT uuid FROM a INTERSECT SELECT uuid FROM b))::BIGINT AS "both" """
)
def so3_j10_overlap(spark, d):
    return evaluate.overlap(t(spark, d, "companies"), t(spark, d, "relationships").select(F.col("src").alias("uuid")))


@R.add(
    """WITH s AS (SELECT iteration, count(*) AS rows FROM resolved_companies GROUP BY iteration) SELECT s.iteration, s.rows::BIGINT AS rows, round(100 - 100.0::DOUBLE * s.rows / b.rows, 6) AS reduction_pct,
 round(100 - 100.0::DOUBLE * s.rows / (SELECT arg_min(rows, iteration) FROM s), 6) AS overall_pct FROM s LEFT JOIN s b ON b.iteration = s.iteration - 1"""
)
def a17_reduction(spark, d):
    return evaluate.reduction_by_round(t(spark, d, "resolved_companies").groupBy("iteration").agg(F.count("*").alias("rows")))


_LIN = f"""one AS (SELECT DISTINCT uuid, {SQL.match_key('name')} AS n, website_url AS w FROM companies WHERE uuid IS NOT NULL),
 links AS (SELECT uuid AS source_uuid, min(uuid) OVER (PARTITION BY n) AS uuid FROM one WHERE n <> '' UNION SELECT uuid, min(uuid) OVER (PARTITION BY w) FROM one WHERE w IS NOT NULL),
 canon AS (SELECT source_uuid, min(uuid) AS uuid FROM links GROUP BY source_uuid), rel AS (SELECT DISTINCT ON (rel_id) * FROM relationships)"""


def _rel(spark, d):
    return t(spark, d, "relationships").distinct()


def _links(spark, d):
    """Lineage pairs of companies that share a match key or a web address, towards the least uuid."""
    one = t(spark, d, "companies").where("uuid IS NOT NULL").select("uuid", match_key(F.col("name")).alias("n"), F.col("website_url").alias("w")).distinct()
    parts = []
    for k in ("n", "w"):
        part = one.where(f"{k} IS NOT NULL AND {k} <> ''")
        parts.append(part.join(part.groupBy(k).agg(F.min("uuid").alias("least")), k).select(F.col("uuid").alias("source_uuid"), F.col("least").alias("uuid")))
    return parts[0].unionByName(parts[1]).distinct()


@R.add(f"WITH {_LIN} SELECT rel_id, s.uuid AS src, d.uuid AS dst, relationship FROM rel JOIN links s ON s.source_uuid = src JOIN links d ON d.source_uuid = dst")
def j6_n3_lineage_remap(spark, d):
    return refine.remap(_rel(spark, d), _links(spark, d)).select("rel_id", "src", "dst", "relationship")


@R.add(f"WITH {_LIN} SELECT rel_id, s.uuid AS src, d.uuid AS dst FROM rel JOIN canon s ON s.source_uuid = src JOIN canon d ON d.source_uuid = dst")
def j6_canonical_remap(spark, d):
    return refine.remap(_rel(spark, d), _links(spark, d).groupBy("source_uuid").agg(F.min("uuid").alias("uuid"))).select("rel_id", "src", "dst")


@R.add(
    f"""WITH l0 AS (SELECT {_CLEAN('uuid')} AS uuid, source_uuids FROM resolved_companies), l AS (SELECT DISTINCT {_CLEAN('s')} AS source_uuid, uuid FROM (SELECT uuid, unnest(list_concat([uuid], coalesce(source_uuids, []::VARCHAR[]))) AS s FROM l0 WHERE uuid IS NOT NULL))
 SELECT source_uuid, min(uuid) AS uuid FROM l WHERE source_uuid IS NOT NULL GROUP BY source_uuid"""
)
def n3_lineage(spark, d):
    return refine.lineage(t(spark, d, "resolved_companies"), "canonical")


_O = "(posted_at, rel_id)"
_FIRST = lambda c: f"arg_min({c}, {_O}) FILTER ({c} IS NOT NULL) AS {c}"
_LABELS = "(SELECT string_agg(v, ';' ORDER BY k) FROM (SELECT v, min(k) AS k FROM (SELECT CASE WHEN x = upper(x) AND length(x) > 1 THEN x ELSE array_to_string(list_transform(string_split(lower(x), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS v, k FROM (SELECT unnest(l) AS x, unnest(range(len(l))) AS k)) GROUP BY v))"


@R.add(
    f"""WITH rel AS (SELECT DISTINCT ON (rel_id) * FROM relationships), g AS (SELECT src, dst, relationship, {_FIRST('amount')}, {_FIRST('currency')}, {_FIRST('quarter')}, {_FIRST('description')}, list_sort(list_distinct(list(url))) AS urls,
 coalesce(list_sort(list_distinct(flatten(list(technologies) FILTER (technologies IS NOT NULL)))), []) AS l, count(*)::BIGINT AS edges FROM rel WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst, relationship)
 SELECT src, dst, relationship, amount, currency, quarter, description, array_to_string(urls, ';') AS urls, coalesce({_LABELS}, '') AS technologies, edges FROM g"""
)
def a9_n5_merge_edges(spark, d):
    m = refine.merge_edges(_rel(spark, d).where("src IS NOT NULL AND dst IS NOT NULL"))
    return m.select("src", "dst", "relationship", "amount", "currency", "quarter", "description", F.array_join("urls", ";").alias("urls"), F.array_join(F.coalesce("technologies", F.array()), ";").alias("technologies"), "edges")


@R.add("WITH rel AS (SELECT DISTINCT ON (rel_id) * FROM relationships) SELECT src, dst, count(*)::BIGINT AS block_size, string_agg(rel_id::VARCHAR, ',' ORDER BY rel_id) AS rels FROM rel WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst")
def a10_j17_edge_blocks(spark, d):
    b = refine.edge_blocks(_rel(spark, d).where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", "rel_id", "relationship", "amount"))
    return b.select("src", "dst", "block_size", F.array_join(F.transform("relationships", lambda r: r["rel_id"].cast("string")), ",").alias("rels"))


@R.add(
    """WITH rel AS (SELECT DISTINCT ON (rel_id) * FROM relationships) SELECT src, dst, relationship, quarter, max(date) AS date, max(amount) AS amount, coalesce(string_agg(DISTINCT description, ' ' ORDER BY description), '') AS description, count(*)::BIGINT AS merged
 FROM rel WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst, relationship, quarter"""
)
def e12_resolve_edges(spark, d):
    return refine.resolve_edges(_rel(spark, d).where("src IS NOT NULL AND dst IS NOT NULL"))


@R.add("SELECT DISTINCT uuid FROM companies WHERE uuid IN (SELECT src FROM relationships WHERE src IS NOT NULL UNION SELECT dst FROM relationships WHERE dst IS NOT NULL)")
def j9_connected_nodes(spark, d):
    return refine.connected(t(spark, d, "companies").select("uuid").distinct(), t(spark, d, "relationships"))


@R.add("WITH rel AS (SELECT DISTINCT ON (rel_id) * FROM relationships), n AS (SELECT uuid, min(name) AS name FROM companies GROUP BY uuid) SELECT rel_id, a.name AS src_name, b.name AS dst_name FROM rel LEFT JOIN n a ON a.uuid = src LEFT JOIN n b ON b.uuid = dst")
def j8_node_names(spark, d):
    return refine.with_node_names(_rel(spark, d), t(spark, d, "companies")).select("rel_id", "src_name", "dst_name")


_NO = "(iteration, collected_at, name)"


@R.add(
    f"""WITH c AS (SELECT DISTINCT {_CLEAN('uuid')} AS u, * FROM resolved_companies) SELECT u AS uuid, arg_min(name, {_NO}) FILTER (name IS NOT NULL) AS name, arg_min(revenue_usd, {_NO}) FILTER (revenue_usd IS NOT NULL) AS revenue_usd,
 coalesce(array_to_string(list_sort(list_distinct(flatten(list(coalesce(source_uuids, []::VARCHAR[]))))), ';'), '') AS source_uuids, min(match_skip::INT)::BOOLEAN AS match_skip FROM c WHERE u IS NOT NULL GROUP BY u"""
)
def a11_a13_merge_nodes(spark, d):
    c = t(spark, d, "resolved_companies").distinct().withColumn("uuid", clean_uuid(F.col("uuid")))
    c = c.withColumn("source_uuids", F.filter("source_uuids", lambda x: x.isNotNull()))
    return refine.merge_nodes(c).select("uuid", "name", "revenue_usd", F.array_join("source_uuids", ";").alias("source_uuids"), "match_skip")


@R.add(
    """SELECT block_id, len(oc)::INTEGER AS records, list_min(list_transform(oc, lambda c: c.id)) AS master, array_to_string(list_sort(list_distinct(list_filter(list_concat(list_transform(oc, lambda c: c.uuid), flatten(list_transform(oc, lambda c: coalesce(c.source_uuids, [])))), lambda x: x IS NOT NULL))), ',') AS lineage
 FROM (SELECT block_id, original_companies AS oc, resolved_companies AS rc FROM blocks) WHERE len(oc) > 1 AND len(rc) = 1 AND rc[1].uuid IS NOT NULL AND len(list_filter(oc, lambda c: c.id IS NULL OR c.uuid IS NULL)) = 0 ORDER BY records, block_id LIMIT 5"""
)
def e13_few_shot_examples(spark, d):
    e = matching.few_shot_examples(t(spark, d, "blocks"))
    return e.select("block_id", F.size("companies").alias("records"), F.col("merged.id").alias("master"), F.array_join("merged.source_uuids", ",").alias("lineage"))
