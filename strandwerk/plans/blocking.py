"""Queries on names and blocking."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwerk.functions import names
from strandwerk.functions.names import SQL
from strandwerk.operators import blocking as B
from strandwerk.plans.registry import Registry, table

R = Registry()
t = table

_LEG = "regexp_replace(regexp_replace(regexp_replace({}, '^ +', ''), ' +$', ''), '^$', '')"


@R.add(f"SELECT DISTINCT name, {SQL.strip_domain('name')} AS stripped, {SQL.first_word('name')} AS first_word, {SQL.acronym('name')} AS acronym, {SQL.acronym_key('name')} AS acronym_key FROM companies WHERE name IS NOT NULL")
def x1_x3_name_keys(spark, d):
    n = F.col("name")
    return t(spark, d, "companies").where("name IS NOT NULL").select("name", names.strip_domain(n).alias("stripped"), names.first_word_key(n).alias("first_word"), names.acronym(n).alias("acronym"), names.acronym_key(n).alias("acronym_key")).distinct()


@R.add(f"SELECT DISTINCT title, {SQL.base_name('title')} AS base, {SQL.match_key('title')} AS match_key, nullif(trim(substring({SQL.spaced('title')}, length({SQL.base_name('title')}) + 1)), '') AS ending FROM sec_list WHERE title IS NOT NULL")
def x4_x8_base_names(spark, d):
    n = F.col("title")
    return t(spark, d, "sec_list").where("title IS NOT NULL").select("title", names.base_name(n).alias("base"), names.match_key(n).alias("match_key"), names.legal_ending(n).alias("ending")).distinct()


@R.add(
    f"""SELECT DISTINCT title, ticker, coalesce(nullif(upper(trim(ticker)), ''), CASE WHEN length(regexp_replace({SQL.base_name('title')}, '[^A-Za-z0-9]', '', 'g')) >= 2
 THEN regexp_replace({SQL.base_name('title')}, '[^A-Za-z0-9]', '', 'g') END, regexp_replace(title, '[^A-Za-z0-9]', '', 'g')) AS company_id FROM sec_list WHERE title IS NOT NULL"""
)
def x9_company_ids(spark, d):
    return t(spark, d, "sec_list").where("title IS NOT NULL").select("title", "ticker", names.company_id(F.col("title"), F.col("ticker")).alias("company_id")).distinct()


@R.add("SELECT uuid, trim(regexp_replace(name, '[\\r\\n]+', ' ', 'g')) AS name FROM companies WHERE name IS NOT NULL AND trim(name) <> '' AND uuid IS NOT NULL")
def x10_f8_clean_names(spark, d):
    c = t(spark, d, "companies").where("name IS NOT NULL AND trim(name) <> '' AND uuid IS NOT NULL")
    return c.select("uuid", names.clean_name(F.col("name")).alias("name"))


_INIT = "array_to_string(list_transform(string_split(lower(x), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@R.add(f"SELECT x AS label, CASE WHEN x = upper(x) AND length(x) > 1 THEN x ELSE {_INIT} END AS normal FROM (SELECT DISTINCT unnest(technologies) AS x FROM relationships) WHERE x IS NOT NULL")
def x11_labels(spark, d):
    return t(spark, d, "relationships").select(F.explode("technologies").alias("label")).where("label IS NOT NULL").distinct().select("label", names.label(F.col("label")).alias("normal"))


_KEYS = f"""WITH c AS (SELECT uuid, min(name) AS name FROM companies WHERE uuid IS NOT NULL GROUP BY uuid),
 k0 AS (SELECT uuid, {SQL.first_word('name')} AS fw, {SQL.acronym_key('name')} AS ac FROM c),
 k AS (SELECT fw AS block_key, 'first_word' AS key_type, uuid FROM k0 WHERE fw IS NOT NULL UNION ALL SELECT ac, 'acronym', uuid FROM k0 WHERE ac IS NOT NULL),
 kinds AS (SELECT block_key, CASE WHEN bool_or(key_type = 'first_word') AND bool_or(key_type = 'acronym') THEN 'combined' WHEN bool_or(key_type = 'first_word') THEN 'first_word' ELSE 'acronym' END AS block_key_type,
  count(DISTINCT uuid) AS size FROM k GROUP BY block_key),
 m AS (SELECT block_key, uuid, row_number() OVER (PARTITION BY block_key ORDER BY md5(uuid), uuid) AS pos FROM (SELECT DISTINCT block_key, uuid FROM k)),
 b AS (SELECT CASE WHEN size > 50 THEN block_key || '_chunk_' || ((pos - 1) // 50 + 1)::VARCHAR ELSE block_key END AS block_key, block_key_type, uuid FROM m JOIN kinds USING (block_key)),
 u AS (SELECT 'UNBLOCKED_' || uuid AS block_key, 'unblocked' AS block_key_type, uuid FROM k0 WHERE fw IS NULL AND ac IS NULL),
 blocks2 AS (SELECT block_key, block_key_type, count(*)::BIGINT AS block_size, array_to_string(list(uuid ORDER BY uuid), ',') AS members FROM (SELECT * FROM b UNION ALL SELECT * FROM u) GROUP BY ALL)"""


@R.add(_KEYS + " SELECT block_key, block_key_type, block_size, members FROM blocks2")
def e1_name_blocks(spark, d):
    b = B.build_blocks(t(spark, d, "companies"), 50, ["uuid", "name"])
    return b.select("block_key", "block_key_type", "block_size", F.array_join(F.transform("companies", lambda c: c["uuid"]), ",").alias("members"))


@R.add(_KEYS + " SELECT block_key, block_key_type, size::BIGINT AS size FROM kinds")
def a1_a3_key_distribution(spark, d):
    return B.key_kinds(B.name_keys(t(spark, d, "companies")))


@R.add(_KEYS + " SELECT block_key, size::BIGINT AS size FROM kinds ORDER BY size DESC, block_key LIMIT 20")
def l1_l3_largest_keys(spark, d):
    return B.key_kinds(B.name_keys(t(spark, d, "companies"))).select("block_key", "size").orderBy(F.desc("size"), "block_key").limit(20)


_RANGE = "CASE WHEN {0} = 1 THEN '1' WHEN {0} <= 5 THEN '2-5' WHEN {0} <= 10 THEN '6-10' WHEN {0} <= 20 THEN '11-20' WHEN {0} <= 50 THEN '21-50' WHEN {0} <= 100 THEN '51-100' ELSE '100+' END"


@R.add(
    _KEYS + f""" SELECT size_range, CASE size_range WHEN '1' THEN 1 WHEN '2-5' THEN 2 WHEN '6-10' THEN 3 WHEN '11-20' THEN 4 WHEN '21-50' THEN 5 WHEN '51-100' THEN 6 ELSE 7 END::BIGINT AS range_no,
 count(*)::BIGINT AS blocks, sum(size)::BIGINT AS members FROM (SELECT {_RANGE.format('size')} AS size_range, size FROM kinds) GROUP BY size_range"""
)
def a2_size_histogram(spark, d):
    return B.size_histogram(B.key_kinds(B.name_keys(t(spark, d, "companies"))))


@R.add(
    _KEYS + """ SELECT count(*)::BIGINT AS blocks, sum(block_size)::BIGINT AS members, count_if(block_size = 1)::BIGINT AS singletons, min(block_size)::BIGINT AS min_size,
 max(block_size)::BIGINT AS max_size, round(avg(block_size), 6) AS avg_size, round(count_if(block_size = 1) / count(*), 6) AS singleton_share FROM blocks2"""
)
def a5_a6_block_summary(spark, d):
    return B.block_summary(B.build_blocks(t(spark, d, "companies"), 50, ["uuid"]))


@R.add(_KEYS + " SELECT DISTINCT k.block_key, c.uuid, c.name FROM k JOIN kinds USING (block_key) JOIN c USING (uuid) WHERE block_key_type = 'combined'")
def j2_j4_rows_of_combined_keys(spark, d):
    c = t(spark, d, "companies")
    keys = B.name_keys(c)
    both = B.key_kinds(keys).where("block_key_type = 'combined'").select("block_key")
    one = c.where("uuid IS NOT NULL").groupBy("uuid").agg(F.min("name").alias("name"))
    return keys.join(both, "block_key", "left_semi").select("block_key", "uuid").distinct().join(one, "uuid").select("block_key", "uuid", "name")


@R.add(_KEYS + " SELECT DISTINCT block_key, uuid FROM k WHERE block_key NOT IN (SELECT block_key FROM kinds WHERE block_key_type = 'combined')")
def j3_rows_of_single_kind_keys(spark, d):
    keys = B.name_keys(t(spark, d, "companies"))
    return keys.join(B.key_kinds(keys).where("block_key_type = 'combined'"), "block_key", "left_anti").select("block_key", "uuid").distinct()


@R.add(
    """WITH n AS (SELECT block_id, block_key, original_companies AS m, coalesce(len(original_companies), 0) AS n FROM blocks),
 p AS (SELECT block_id, block_key, n, m, unnest(range(CASE WHEN n > 5 THEN (n - 1) // 5 + 1 ELSE 1 END)) AS i FROM n)
 SELECT block_id, CASE WHEN n > 5 THEN block_key || '_chunk_' || (i + 1)::VARCHAR ELSE block_key END AS block_key, len(CASE WHEN n > 5 THEN m[i * 5 + 1 : i * 5 + 5] ELSE m END)::BIGINT AS n,
 array_to_string(list_transform(CASE WHEN n > 5 THEN m[i * 5 + 1 : i * 5 + 5] ELSE m END, lambda c: c.uuid), ',') AS members FROM p WHERE m IS NOT NULL"""
)
def e2_w1_split_blocks(spark, d):
    b = t(spark, d, "blocks").where("original_companies IS NOT NULL").select("block_id", "block_key", F.col("original_companies.uuid").alias("m"))
    return B.split_blocks(b, 5, members="m").select("block_id", "block_key", F.size("m").cast("bigint").alias("n"), F.array_join("m", ",").alias("members"))


@R.add("SELECT block_id, block_key, block_size FROM blocks WHERE block_size BETWEEN 2 AND 10 ORDER BY block_size DESC, block_key, block_id LIMIT 50")
def f5_l2_blocks_by_size(spark, d):
    return B.filter_blocks(t(spark, d, "blocks"), 2, 10).orderBy(F.desc("block_size"), "block_key", "block_id").limit(50).select("block_id", "block_key", "block_size")
