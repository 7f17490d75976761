"""Queries of the training-data problems."""

from __future__ import annotations

from strandwerk.llm import components, fusion, leaks, tokens, toxicity, variants
from strandwerk.plans.registry import Registry, table

R = Registry()
t = table

_TEXTS = ", ".join(f"'{x}'" for x in fusion.FILLERS)
_REAL = {
    f: f"CASE WHEN regexp_matches(o.{f}, '[\\p{{L}}\\p{{N}}]') AND lower(trim(o.{f})) NOT IN ({_TEXTS})" + (f" AND regexp_full_match(trim(o.{f}), '(?i)(https?://)?(www\\.)?[^\\s/.]+(\\.[^\\s/.]+)+(/\\S*)?')" if f == "website_url" else "") + f" THEN o.{f} END"
    for f in fusion.FIELDS
    if f not in fusion.NUMBERS
} | {
    "revenue_usd": "CASE WHEN o.revenue_usd > 0 AND NOT (regexp_full_match(o.revenue_usd::VARCHAR, '9+') AND o.revenue_usd >= 999999) THEN o.revenue_usd::VARCHAR END",
    "employees": "CASE WHEN o.employees > 0 AND NOT (regexp_full_match(o.employees::VARCHAR, '9+') AND o.employees >= 999999) THEN o.employees::VARCHAR END",
    "founded_year": f"CASE WHEN o.founded_year BETWEEN {fusion.YEARS[0]} AND {fusion.YEARS[1]} THEN o.founded_year::VARCHAR END",
}
_TIME = """coalesce(CASE WHEN regexp_full_match(o.collected_at, '\\d{9,10}') THEN o.collected_at::BIGINT * 1000000 END, epoch_us(try_strptime(o.collected_at, '%a, %d %b %Y %H:%M:%S GMT')),
 epoch_us(try_cast(CASE WHEN regexp_matches(o.collected_at, '(Z|[+-]\\d\\d:\\d\\d)$') THEN o.collected_at WHEN regexp_matches(o.collected_at, '^\\d{4}-') THEN o.collected_at || CASE WHEN length(o.collected_at) = 10 THEN ' 00:00:00+00' ELSE '+00' END END AS TIMESTAMPTZ)))"""
_P1 = f"""WITH e AS (SELECT block_id, original_companies AS oc, unnest(resolved_companies) AS r FROM blocks), m AS (SELECT DISTINCT block_id, r.uuid AS g, o FROM (SELECT block_id, r, unnest(oc) AS o FROM e) WHERE list_contains(r.source_uuids, o.uuid)),
 n AS (SELECT block_id, g FROM m GROUP BY ALL HAVING count(DISTINCT o.uuid) >= 2),
 c AS ({" UNION ALL ".join(f"SELECT block_id, g, '{f}' AS field_name, o.uuid AS u, o.source AS s, {_TIME} AS tm, {x} AS v FROM m JOIN n USING (block_id, g)" for f, x in _REAL.items())})
 SELECT g AS group_uuid, field_name, u AS source_uuid FROM (SELECT c.*, row_number() OVER (PARTITION BY block_id, g, field_name ORDER BY trust_rank NULLS LAST, tm DESC NULLS LAST, u) AS rn FROM c LEFT JOIN news_sources ON name = s WHERE v IS NOT NULL) WHERE rn = 1"""


@R.add(_P1)
def p1_found(spark, d):
    return fusion.choose(t(spark, d, "blocks"), t(spark, d, "news_sources")).select("group_uuid", "field_name", "source_uuid")


@R.add()
def p1_fused(spark, d):
    return fusion.fuse(t(spark, d, "blocks"), t(spark, d, "news_sources"))


@R.add()
def p1_sources(spark, d):
    return fusion.source_accuracy(t(spark, d, "blocks"))


_HEX = "regexp_replace(regexp_replace(lower({0}), '[{{}}\\s-]', '', 'g'), '^urn:uuid:', '')"
_UUID = lambda x: "CASE WHEN regexp_full_match({0}, '[0-9a-f]{{32}}') AND {0} <> '00000000000000000000000000000000' THEN {0}[1:8] || '-' || {0}[9:12] || '-' || {0}[13:16] || '-' || {0}[17:20] || '-' || {0}[21:32] END".format(_HEX.format(x))
_P4 = f"""WITH RECURSIVE l AS (SELECT {_UUID('uuid')} AS a, {_UUID('s')} AS b FROM (SELECT uuid, unnest(CASE WHEN len(source_uuids) > 0 THEN source_uuids ELSE [NULL] END) AS s FROM resolved_companies)),
 v AS (SELECT DISTINCT x FROM (SELECT a AS x FROM l UNION ALL SELECT b FROM l) WHERE x IS NOT NULL), e AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) WHERE a IS NOT NULL AND b IS NOT NULL),
 r(x, y) AS (SELECT x, x FROM v UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y) SELECT x AS uuid, min(y) AS group_uuid FROM r GROUP BY x"""


@R.add(_P4)
def p4_found(spark, d):
    return components.consolidate(t(spark, d, "resolved_companies"))


@R.add()
def p5_found(spark, d):
    return variants.variant_pairs(t(spark, d, "companies"))


@R.add()
def p5_groups(spark, d):
    return variants.group_variants(t(spark, d, "companies")).selectExpr("uuid", "lower(hex(`group`)) AS group_id")


@R.add()
def p8_ids(spark, d):
    return tokens.encode(t(spark, d, "documents"))


@R.add()
def p9_found(spark, d):
    return leaks.find_leaks(t(spark, d, "documents"), t(spark, d, "benchmark"))


#: The machine of each session and data folder, so that its queries fit it once.
_MACHINES: dict[tuple[str, str], tuple] = {}


def _scored(spark, d):
    docs, key = t(spark, d, "documents"), (spark.sparkContext.applicationId, d)
    if key not in _MACHINES:
        _MACHINES[key] = toxicity.fit(spark, toxicity.labelled(docs, t(spark, d, "labels")))
    return toxicity.score_with(docs, *_MACHINES[key])


@R.add()
def p10_found(spark, d):
    return _scored(spark, d).where(f"score >= {toxicity.THRESHOLD}").select("doc_id").distinct()


@R.add()
def p10_scores(spark, d):
    return _scored(spark, d)


@R.add()
def p10_rates(spark, d):
    return toxicity.rates(_scored(spark, d))
