"""Queries of the general data problems: schema drift, skew, units, nesting."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwerk.operators import drift, nested, skew, units
from strandwerk.plans.registry import Registry, table

R = Registry()
t = table


@R.add()
def p2_found(spark, d):
    return drift.field_changes(t(spark, d, "raw_files"))


_TYPE = "CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' END"


@R.add(
    f"""WITH o AS (SELECT feed_name AS feed, file_no, payload::JSON AS j FROM raw_files WHERE json_valid(payload) AND regexp_matches(payload, '^\\s*\\{{.*\\}}\\s*$') AND feed_name IS NOT NULL AND file_no IS NOT NULL),
 f AS (SELECT feed, file_no, field, j->('$."' || field || '"') AS v FROM (SELECT *, unnest(json_keys(j)) AS field FROM o)), n AS (SELECT feed, file_no, field, {_TYPE} AS ty, count(*) AS n FROM f WHERE field <> 'uuid' GROUP BY ALL),
 c AS (SELECT feed, file_no, field, arg_min(ty, (-n, list_position(['string', 'integer', 'number', 'boolean', 'object', 'array'], ty))) FILTER (ty IS NOT NULL) AS json_type FROM n GROUP BY feed, file_no, field),
 o2 AS (SELECT feed, file_no, row_number() OVER (PARTITION BY feed ORDER BY file_no) AS pos FROM (SELECT DISTINCT feed_name AS feed, file_no FROM raw_files WHERE feed_name IS NOT NULL AND file_no IS NOT NULL)),
 b AS (SELECT c.*, pos, CASE WHEN pos - lag(pos) OVER w = 1 AND json_type IS NOT DISTINCT FROM lag(json_type) OVER w THEN 0 ELSE 1 END AS new FROM c JOIN o2 USING (feed, file_no) WINDOW w AS (PARTITION BY feed, field ORDER BY pos)),
 i AS (SELECT *, sum(new) OVER (PARTITION BY feed, field ORDER BY pos) AS island FROM b)
 SELECT feed, field, any_value(json_type) AS json_type, min(file_no) AS first_file, max(file_no) AS last_file, count(*)::BIGINT AS files FROM i GROUP BY feed, field, island"""
)
def p2_lifespans(spark, d):
    return drift.lifespans(t(spark, d, "raw_files"))


@R.add()
def p2_companies(spark, d):
    return drift.consistent_table(t(spark, d, "raw_files"), "companies")


@R.add()
def p2_relationships(spark, d):
    return drift.consistent_table(t(spark, d, "raw_files"), "relationships")


_KEYS = """WITH k AS (SELECT regexp_replace(upper(trim(block_key)), '\\s*_CHUNK_[0-9]+\\s*$', '') AS block_key, coalesce(len(original_companies), 0) AS n
 FROM blocks)"""


@R.add(_KEYS + " SELECT block_key FROM k WHERE block_key IS NOT NULL GROUP BY block_key HAVING sum(n) >= 0.02 * (SELECT sum(n) FROM k)")
def p3_found(spark, d):
    return skew.heavy_keys(skew.key_sizes(t(spark, d, "blocks")))


@R.add(_KEYS + " SELECT block_key, count(*)::BIGINT AS blocks, sum(n)::BIGINT AS companies, min(n)::BIGINT AS min_size, max(n)::BIGINT AS max_size, round(sum(n) / count(*), 6) AS avg_size FROM k WHERE block_key IS NOT NULL GROUP BY block_key")
def p3_key_results(spark, d):
    return skew.key_results(skew.key_sizes(t(spark, d, "blocks"))).drop("heavy")


@R.add()
def p6_found(spark, d):
    return units.unit_findings(units.normalize_units(t(spark, d, "relationships"), t(spark, d, "news_sources"), t(spark, d, "fx_rates")))


@R.add()
def p6_normalized(spark, d):
    return units.normalize_units(t(spark, d, "relationships"), t(spark, d, "news_sources"), t(spark, d, "fx_rates"))


def _link_sql(path: str, to: str) -> str:
    child, link = path.split(".")
    ref = f"unnest(c.{link})" if link in ("technologies", "products") else f"c.{link}"
    return f"""SELECT DISTINCT x.article_id, '{child}' AS child_kind, x.pos::BIGINT AS child_pos, '{link}' AS link_name, '{to}' AS parent_kind, y.pos::BIGINT AS parent_pos
 FROM (SELECT article_id, pos, {ref} AS ref FROM (SELECT article_id, unnest({child}) AS c, unnest(range(len({child}))) AS pos FROM articles)) x
 JOIN (SELECT article_id, unnest({to}) AS c, unnest(range(len({to}))) AS pos FROM articles) y ON x.article_id = y.article_id AND x.ref = y.c.id"""


@R.add(" UNION ALL ".join(_link_sql(p, k) for p, k in nested.LINKS.items()))
def p7_found(spark, d):
    return nested.links(t(spark, d, "articles"))


def _flat(group: str, cols: dict[str, str]):
    """A flat table of a list of structs: the columns given, as name to SQL expression over ``c``."""
    sql = f"SELECT article_id, pos::BIGINT AS pos, {', '.join(f'{e} AS {n}' for n, e in cols.items())} FROM (SELECT article_id, unnest({group}) AS c, unnest(range(len({group}))) AS pos FROM articles) WHERE c IS NOT NULL"

    def run(spark, d):
        a = t(spark, d, "articles")
        own = [x.path for x in nested.leaves(a.schema) if x.group == group]
        return nested.pivot_group(nested.shred(a, "article_id", [group, *own]), "article_id", a.schema, group)

    R.add(sql, f"p7_{group}")(run)


_flat("companies", {n: f"c.{n}" for n in ("id", "name", "cik", "description", "website_url", "headquarters_location", "revenue_usd", "employees", "founded_year", "ceo")} | {f"ticker_{n}": f"c.ticker.{n}" for n in ("id", "symbol", "exchange")})
_flat("products", {n: f"c.{n}" for n in ("id", "name", "description", "manufacturer")})
_flat("technologies", {n: f"c.{n}" for n in ("id", "name", "developer", "description")})
_flat("relationships", {n: f"c.{n}" for n in ("src_company", "dst_company", "type", "description", "percentage", "amount", "currency", "date", "quarter", "contract_duration_years", "geographic_scope", "is_material")} | {f"country_{n}": f"c.country.{n}" for n in ("common_name", "full_name", "iso_2", "iso_3", "gdp")})
