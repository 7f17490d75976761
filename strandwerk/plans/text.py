"""Queries on text, URLs, dates, sources, de-duplication and the key/value language."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwerk import schemas
from strandwerk.functions import text as T
from strandwerk.operators import dedup, graph, html, kv
from strandwerk.plans.registry import Registry, table
from strandwerk.sources import readers

R = Registry()
t = table

_BLOCKED = " AND ".join(f"NOT contains(lower(coalesce(title, '')), '{b}')" for b in T.BLOCKED_TITLES)


@R.add(f"SELECT doc_id, {_BLOCKED} AND length(coalesce(text, '')) >= 200 AS ok FROM documents")
def f3_valid_articles(spark, d):
    return t(spark, d, "documents").select("doc_id", T.valid_article(F.col("title"), F.col("text")).alias("ok"))


_HOST = "nullif(lower(regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"


@R.add(f"SELECT DISTINCT url, {_HOST.format('url')} AS host, coalesce({_HOST.format('url')}, '') IN ('chipledger.example') OR ends_with(coalesce({_HOST.format('url')}, ''), '.chipledger.example') OR coalesce({_HOST.format('url')}, '') = 'grid-rack.example' OR ends_with(coalesce({_HOST.format('url')}, ''), '.grid-rack.example') AS ignored FROM documents WHERE url IS NOT NULL")
def f10_ignored_urls(spark, d):
    u = F.col("url")
    return t(spark, d, "documents").where("url IS NOT NULL").select("url", T.host(u).alias("host"), T.ignored(u, ["chipledger.example", "grid-rack.example"]).alias("ignored")).distinct()


_SITE = (("https://grid-rack.example/",), ("/d/1", "/story/"))


@R.add("SELECT doc_id, coalesce(starts_with(url, 'https://grid-rack.example/') OR contains(url, '/d/1') OR contains(url, '/story/'), false) AS article FROM documents")
def f11_article_urls(spark, d):
    return t(spark, d, "documents").select("doc_id", T.article_url(F.col("url"), _SITE).alias("article"))


_PAGE = "'<html><head><title>' || title || ' | Site</title></head><body><a href=\"' || url || '\">x</a> <img src=''https://img.example/' || doc_id::VARCHAR || '.png''><a href=\"/local\">l</a> see https://plain.example/' || doc_id::VARCHAR || ' and ' || url || '</body></html>'"


def _pages(spark, d):
    c = F.col
    page = F.concat(F.lit("<html><head><title>"), c("title"), F.lit(' | Site</title></head><body><a href="'), c("url"), F.lit("\">x</a> <img src='https://img.example/"), c("doc_id").cast("string"), F.lit(".png'><a href=\"/local\">l</a> see https://plain.example/"), c("doc_id").cast("string"), F.lit(" and "), c("url"), F.lit("</body></html>"))
    return t(spark, d, "documents").where("url IS NOT NULL AND title IS NOT NULL").select("doc_id", "url", "title", page.alias("html"))


@R.add("SELECT doc_id, array_to_string(list_sort(list_distinct([url, 'https://img.example/' || doc_id::VARCHAR || '.png', 'https://plain.example/' || doc_id::VARCHAR])), ' ') AS urls FROM documents WHERE url IS NOT NULL AND title IS NOT NULL")
def x16_urls_of_pages(spark, d):
    return _pages(spark, d).select("doc_id", F.array_join(T.urls(F.col("html")), " ").alias("urls"))


@R.add("SELECT doc_id, 'https://plain.example/' || doc_id::VARCHAR || ' ' || url AS urls FROM documents WHERE url IS NOT NULL")
def x17_urls_in_order(spark, d):
    s = F.concat(F.lit("see https://plain.example/"), F.col("doc_id").cast("string"), F.lit(" and "), F.col("url"), F.lit(" or "), F.col("url"))
    return t(spark, d, "documents").where("url IS NOT NULL").select("doc_id", F.array_join(T.urls_in_order(s), " ").alias("urls"))


@R.add("SELECT doc_id, nullif(trim(split_part(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' | ', 1)), '') AS page_title FROM documents WHERE url IS NOT NULL AND title IS NOT NULL")
def x18_page_titles(spark, d):
    return _pages(spark, d).select("doc_id", T.page_title(F.col("html")).alias("page_title"))


_DATED = ("<meta property=\"article:published_time\" content=\"{}\">", "<meta name=\"og:published_time\" content=\"{}\"> <time datetime=\"x\">", "<script>{{\"datePublished\" : \"{}\"}}</script>", "<p><time datetime=\"{}\"></p>", "<p>{}</p>")
_STATED = "CASE WHEN doc_id % 2 = 0 THEN strftime(posted_at, '%Y-%m-%d') ELSE strftime(posted_at, '%Y-%m-%dT%H:%M:%SZ') END"


@R.add(f"SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN CASE WHEN doc_id % 2 = 0 THEN {_STATED} || 'T00:00:00+00:00' ELSE {_STATED} END END AS posted FROM documents WHERE posted_at IS NOT NULL")
def x18_posted_dates(spark, d):
    stated = F.when(F.col("doc_id") % 2 == 0, F.date_format("posted_at", "yyyy-MM-dd")).otherwise(F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    page = F.element_at(F.array(*[F.concat(F.lit(a.replace("{{", "{").replace("}}", "}")), stated, F.lit(b.replace("{{", "{").replace("}}", "}"))) for a, b in (x.split("{}") for x in _DATED)]), (F.col("doc_id") % 5).cast("int") + 1)
    return t(spark, d, "documents").where("posted_at IS NOT NULL").select("doc_id", T.posted_date(page).alias("posted"))


_BLANKS = "[\\s\\x0b\\x1c-\\x1f\\x85\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@R.add(
    f"""WITH p AS (SELECT doc_id, {_PAGE} AS html, 'Title: ' || trim(regexp_replace(title || ' | Site', '{_BLANKS}', ' ', 'g')) || chr(10) || 'x l see https://plain.example/' || doc_id::VARCHAR || ' and ' || url AS text FROM documents WHERE url IS NOT NULL AND title IS NOT NULL)
 SELECT doc_id, text, round(100.0::DOUBLE * (length(html) - length(text)) / length(html), 2) AS reduction_pct FROM p"""
)
def x14_x15_html_text(spark, d):
    p = _pages(spark, d).select("doc_id", "html", html.html_to_text(F.col("html")).alias("text"))
    return p.select("doc_id", "text", html.reduction_pct(F.col("html"), F.col("text")).alias("reduction_pct"))


@R.add("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS excerpt FROM documents WHERE text IS NOT NULL")
def x19_excerpts(spark, d):
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@R.add("SELECT article_id, concat_ws(' ', title, summary, 'Comments:') || coalesce(' ' || array_to_string(list_transform(list_filter(companies, lambda c: c IS NOT NULL AND c.name IS NOT NULL)[1:10], lambda c: '- ' || c.name), ' '), '') AS doc FROM articles WHERE len(list_filter(companies, lambda c: c IS NOT NULL AND c.name IS NOT NULL)) > 0")
def x20_thread_documents(spark, d):
    names = F.filter(F.transform("companies", lambda c: c["name"]), lambda n: n.isNotNull())
    return t(spark, d, "articles").where(F.size(names) > 0).select("article_id", T.thread_document(F.col("title"), F.col("summary"), names).alias("doc"))


_RX = lambda p, i=1: f"regexp_extract(x, '{p}', {i})"
_GOOD = lambda k, ok: "coalesce(" + ", ".join(f"CASE WHEN {ok.format(_RX(p))} THEN {_RX(p)} END" for p in T.FACTS[k]) + ")"
_ANY = lambda k: _GOOD(k, "{} <> ''")
_MONEY = "coalesce(" + ", ".join(f"CASE WHEN {_RX(p)} <> '' THEN try_cast(replace({_RX(p)}, ',', '') AS DOUBLE) * CASE lower({_RX(p, 2)}) WHEN 'billion' THEN 1e9 ELSE 1e6 END END" for p in T.FACTS["revenue_usd"]) + ")"
_WEB = _GOOD("website_url", "{0} <> '' AND NOT contains(lower({0}), 'wikipedia')")
#: Documents as company pages: their own text behind facts of their row, so that every kind of fact occurs.
_ABOUT = "text || ' It is traded as ' || upper(left(coalesce(lang, 'x'), 2)) || chr(10) || 'Official website ' || coalesce(url, 'n.a') || chr(10) || 'annual revenue of US$' || (doc_id % 90 + 1)::VARCHAR || '.5 billion, CEO Ann Bo Cole' || chr(10) || 'see linkedin.com/company/c-' || doc_id::VARCHAR || ' '"


@R.add(
    f"""SELECT doc_id, {_ANY('symbol')} AS symbol, CASE WHEN {_RX(T.FACTS['symbol'][0])} <> '' THEN 'NASDAQ' WHEN {_RX(T.FACTS['symbol'][1])} <> '' THEN 'NYSE' END AS exchange, CASE WHEN starts_with({_WEB}, 'http') THEN {_WEB} ELSE 'https://' || {_WEB} END AS website_url,
 trim({_ANY('headquarters_location')}) AS headquarters_location, try_cast({_GOOD('founded_year', 'try_cast({} AS INT) BETWEEN 1800 AND 2025')} AS BIGINT) AS founded_year, {_MONEY} AS revenue_usd,
 try_cast(replace({_GOOD('employees', "regexp_matches({}, '[0-9]')")}, ',', '') AS BIGINT) AS employees, {_GOOD('ceo', "{0} <> '' AND len(regexp_split_to_array({0}, '[ ]+')) BETWEEN 2 AND 4")} AS ceo, 'https://www.linkedin.com/company/' || {_ANY('linkedin_url')} AS linkedin_url
 FROM (SELECT doc_id, {_ABOUT} AS x FROM documents WHERE text IS NOT NULL)"""
)
def x21_facts_by_patterns(spark, d):
    c, s = F.col, lambda x: F.col(x).cast("string")
    about = F.concat(
        c("text"), F.lit(" It is traded as "), F.upper(F.left(F.coalesce(c("lang"), F.lit("x")), F.lit(2))), F.lit("\nOfficial website "), F.coalesce(c("url"), F.lit("n.a")), F.lit("\nannual revenue of US$"), (c("doc_id") % 90 + 1).cast("string"),
        F.lit(".5 billion, CEO Ann Bo Cole\nsee linkedin.com/company/c-"), s("doc_id"), F.lit(" "),
    )
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.company_facts(about).alias("f")).select("doc_id", "f.*")


def _wiki_sql(x: str) -> str:
    """The steps of wiki mark-up as replacements in SQL."""
    steps = [("(?s)<ref[^>]*?/>|<ref[^>]*>.*?</ref>", ""), ("\\{\\{[^{}]*\\}\\}", ""), ("\\{\\{[^{}]*\\}\\}", "")]
    steps += [(f"(?m)^={{{n}}}\\s*(.*?)\\s*={{{n}}}\\s*$", "#" * n + " \\1") for n in range(6, 1, -1)]
    steps += [("\\[\\[(?:[^|\\]]*\\|)?((?:[^\\]]|\\][^\\]])*\\]?)\\]\\]", "\\1"), ("\\[(https?://\\S+)\\s+([^\\]]+)\\]", "[\\2](\\1)"), ("'''", "**"), ("''", "*")]
    for a, b in steps:
        x = "regexp_replace({}, '{}', '{}', 'g')".format(x, a.replace("'", "''"), b)
    return x


_WIKI = "'== ' || title || ' ==' || chr(10) || '''''''bold'''''' ''''it'''' [[page|' || title || ']] [https://a.example/x text] {{note|x {{y}}}}<ref name=''a''/>'"


@R.add(f"SELECT doc_id, {_wiki_sql(_WIKI)} AS md FROM documents WHERE title IS NOT NULL")
def x22_wiki_markdown(spark, d):
    c = F.col("title")
    src = F.concat(F.lit("== "), c, F.lit(" ==\n'''bold''' ''it'' [[page|"), c, F.lit("]] [https://a.example/x text] {{note|x {{y}}}}<ref name='a'/>"))
    return t(spark, d, "documents").where(c.isNotNull()).select("doc_id", T.wiki_markdown(src).alias("md"))


@R.add("SELECT DISTINCT uuid, coalesce(nullif(website_url, ''), 'https://' || uuid || '.example') AS website FROM companies WHERE uuid IS NOT NULL")
def x23_own_or_other(spark, d):
    return t(spark, d, "companies").where("uuid IS NOT NULL").select("uuid", T.own_or(F.col("website_url"), F.concat(F.lit("https://"), "uuid", F.lit(".example"))).alias("website")).distinct()


@R.add("SELECT DISTINCT rel_id, -(rel_id * 1000 + 7)::DOUBLE AS a, (rel_id * 1000000)::DOUBLE AS b, NULL::DOUBLE AS c FROM relationships")
def x24_money_cells(spark, d):
    n = F.format_number(F.col("rel_id") * 1000 + 7, 0)
    return t(spark, d, "relationships").select("rel_id", T.money_cell(F.concat(F.lit("$("), n, F.lit(")"))).alias("a0"), T.money_cell(F.concat(F.lit("("), n, F.lit(")"))).alias("a"), T.money_cell(F.concat(F.lit("$ "), F.format_number("rel_id", 0)), F.lit("Million")).alias("b"), T.money_cell(F.lit("-")).alias("c")).drop("a0").distinct()


_D4 = "coalesce(try_strptime({0}, '%Y-%m-%d')::DATE, try_strptime({0}, '%Y/%m/%d')::DATE, try_strptime({0}, '%m/%d/%Y')::DATE, try_cast(nullif(regexp_extract({0}, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})[T ]', 1), '') AS DATE))"


@R.add(f"SELECT DISTINCT c.collected_at AS s, {_D4.format('c.collected_at')} AS d FROM (SELECT unnest(original_companies) AS c FROM blocks) WHERE c.collected_at IS NOT NULL")
def x25_flexible_dates(spark, d):
    b = t(spark, d, "blocks").select(F.explode("original_companies.collected_at").alias("s")).where("s IS NOT NULL").distinct()
    return b.select("s", T.flexible_date(F.col("s")).alias("d"))


@R.add("SELECT event_id, strftime(make_timestamp(event_id * 86400 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def x26_epoch_iso(spark, d):
    return t(spark, d, "events").select("event_id", T.epoch_iso(F.col("event_id") * 86400).alias("iso"))


@R.add("SELECT DISTINCT rel_id FROM relationships WHERE try_cast(left(date, 4) AS INT) >= 2023 OR try_cast(date AS DATE) IS NULL")
def f12_year_filter(spark, d):
    return t(spark, d, "relationships").where(T.recent(F.col("date"), 2023)).select("rel_id").distinct()


_EX = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.EXCHANGES.items())


@R.add(f"SELECT uuid, sym, CASE upper(regexp_extract(sym, '\\.([A-Za-z]+)$', 1)) {_EX} END AS exchange FROM (SELECT uuid, ticker || '.' || exchange[1:1] AS sym FROM sec_list WHERE ticker IS NOT NULL AND exchange IS NOT NULL)")
def x27_exchange_of_suffix(spark, d):
    s = t(spark, d, "sec_list").where("ticker IS NOT NULL AND exchange IS NOT NULL").select("uuid", F.concat("ticker", F.lit("."), F.left("exchange", F.lit(1))).alias("sym"))
    return s.select("uuid", "sym", T.exchange_of(F.col("sym")).alias("exchange"))


_KNOWN = tuple(schemas.EXCHANGE_CODES)


@R.add(f"SELECT DISTINCT article_id, x.symbol AS symbol, CASE WHEN x.exchange IN {_KNOWN} THEN x.exchange ELSE 'UNK' END AS exchange FROM (SELECT article_id, unnest(tickers) AS x FROM articles) WHERE x.symbol IS NOT NULL AND x.symbol <> ''")
def x28_f14_tickers(spark, d):
    js = t(spark, d, "articles").select("article_id", F.explode("tickers").alias("x")).select("article_id", T.ticker_of(F.to_json("x")).alias("x"))
    return js.where("x IS NOT NULL").select("article_id", "x.symbol", "x.exchange").distinct()


@R.add("SELECT DISTINCT cik, lpad(ltrim(cik, '0'), 10, '0') AS padded, regexp_replace(title, '[^A-Za-z0-9._-]+', '_', 'g') AS file_name FROM sec_list WHERE title IS NOT NULL")
def x31_ids_and_file_names(spark, d):
    return t(spark, d, "sec_list").where("title IS NOT NULL").select("cik", F.lpad(F.regexp_replace("cik", "^0+", ""), 10, "0").alias("padded"), T.safe_file_name(F.col("title")).alias("file_name")).distinct()


@R.add("SELECT feed_name, CASE WHEN length(payload) > 300 THEN 'object_store' ELSE 'state_store' END AS tier, count(*)::BIGINT AS rows FROM raw_files WHERE payload IS NOT NULL GROUP BY ALL")
def x32_storage_tiers(spark, d):
    return t(spark, d, "raw_files").where("payload IS NOT NULL").groupBy("feed_name", T.storage_tier(F.col("payload"), 300).alias("tier")).agg(F.count("*").alias("rows"))


@R.add("SELECT DISTINCT rel_id, relationship, amount FROM relationships WHERE (relationship IN ('Acquisition', 'Investment') OR amount >= 1000000) AND is_material = true ORDER BY amount DESC NULLS LAST, rel_id LIMIT 40 OFFSET 20")
def f16_l6_query_language(spark, d):
    q = {"AND": [{"OR": [{"IN": {"relationship": ["Acquisition", "Investment"]}}, {"GTE": {"amount": 1_000_000}}]}, {"EQ": {"is_material": True}}]}
    r = t(spark, d, "relationships").select("rel_id", "relationship", "amount", "is_material").distinct()
    return kv.run_query(r, q, [("amount", "DESC"), ("rel_id", "ASC")], 40, 20).drop("is_material")


_NEWEST = "SELECT article_id, url, title FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY collected_at DESC NULLS LAST, article_id) AS rn FROM articles) WHERE rn = 1 OR url IS NULL"


@R.add(_NEWEST)
def so8_newest_by_url(spark, d):
    return dedup.newest(t(spark, d, "articles").select("article_id", "url", "title", "collected_at"), "url", "collected_at", "article_id").select("article_id", "url", "title")


@R.add("SELECT min(article_id) AS article_id, url FROM articles WHERE url IS NOT NULL GROUP BY url")
def so9_first_by_url(spark, d):
    return dedup.first_seen(t(spark, d, "articles").select("article_id", "url"), "url", "article_id")


@R.add("SELECT DISTINCT uuid, url FROM companies WHERE url IS NULL OR url NOT IN (SELECT url FROM relationships WHERE url IS NOT NULL)")
def k5_j7_f13_new_urls(spark, d):
    return dedup.not_known(t(spark, d, "companies").select("uuid", "url").distinct(), t(spark, d, "relationships"))


@R.add("SELECT website_url, arg_max(headquarters_location, (n, length(headquarters_location), headquarters_location)) AS headquarters_location FROM (SELECT website_url, headquarters_location, count(*) AS n FROM companies WHERE headquarters_location IS NOT NULL AND website_url IS NOT NULL GROUP BY ALL) GROUP BY website_url")
def a12_w2_majority(spark, d):
    return dedup.majority(t(spark, d, "companies").where("website_url IS NOT NULL"), "website_url", "headquarters_location")


_OBJECT = "CASE WHEN json_valid(payload) AND regexp_matches(payload, '^\\s*\\{.*\\}\\s*$') THEN payload::JSON END"


@R.add(f"SELECT p->>'$.uuid' AS uuid, p->>'$.name' AS name, p->>'$.jurisdiction' AS jurisdiction FROM (SELECT {_OBJECT} AS p FROM raw_files) WHERE p IS NOT NULL")
def s5_s6_tolerant_lines(spark, d):
    return readers.parse_lines(t(spark, d, "raw_files"), "uuid string, name string, jurisdiction string")


@R.add("SELECT layout, lpad(cik, 10, '0') AS cik, ticker AS symbol, title AS name, CASE WHEN layout <> 'numbered' THEN exchange END AS exchange FROM sec_list, (VALUES ('fields'), ('numbered'), ('lines')) AS l(layout) WHERE ticker IS NOT NULL")
def s7_s8_p14_securities(spark, d):
    s = t(spark, d, "sec_list")
    text = F.collect_list(F.to_json(F.array(F.coalesce("cik", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("ticker", F.lit("")), F.coalesce("exchange", F.lit("")))))
    whole = s.where("ticker IS NOT NULL AND cik IS NOT NULL AND title IS NOT NULL AND exchange IS NOT NULL").agg(F.concat(F.lit('{"fields":["cik","name","ticker","exchange"],"data":['), F.array_join(text, ","), F.lit("]}")).alias("payload"))
    part = F.to_json(F.struct(F.col("cik").alias("cik_str"), "ticker", "title"))
    numbered = s.select(F.concat(F.lit('{"0":'), part, F.lit("}")).alias("payload"))
    lines = s.select(F.to_json(F.struct(F.col("cik").alias("cik_str"), "ticker", "title", "exchange")).alias("payload"))
    out = None
    for layout, rows in (("fields", whole), ("numbered", numbered), ("lines", lines)):
        x = readers.securities(rows, layout).select(F.lit(layout).alias("layout"), "*")
        out = x if out is None else out.unionByName(x)
    return out


@R.add("SELECT id, uuid, name, cik, revenue_usd, employees, founded_year, NULL::VARCHAR AS match_skip_reason, jurisdiction FROM companies")
def p1_p9_normalized_companies(spark, d):
    n = schemas.normalize_companies(t(spark, d, "companies").drop("ticker"))
    return n.select("id", "uuid", "name", "cik", "revenue_usd", "employees", "founded_year", "match_skip_reason", "jurisdiction")


@R.add("SELECT rel_id, country.common_name AS country_common_name, country.iso_2 AS country_iso_2, coalesce(array_to_string(list_filter(technologies, lambda x: x IS NOT NULL), ', '), '') AS technologies, coalesce(len(technologies), 0)::INTEGER AS n_technologies FROM (SELECT DISTINCT * FROM relationships)")
def p12_p6_flat_columns(spark, d):
    r = t(spark, d, "relationships").distinct()
    flat = schemas.flat_columns(r.select("rel_id", F.struct("country.common_name", "country.iso_2").alias("country"), "technologies"))
    return flat.select("rel_id", "country_common_name", "country_iso_2", "technologies", "n_technologies")


@R.add("SELECT relationship, count(*)::BIGINT AS rows FROM relationships GROUP BY relationship")
def a20_g8_counts(spark, d):
    from strandwerk.operators.graph import counts_by

    return counts_by(t(spark, d, "relationships"), "relationship")


@R.add("SELECT count(*)::BIGINT AS rows, count(DISTINCT uuid)::BIGINT AS ids, count(name)::BIGINT AS names, coalesce(sum(employees), 0)::BIGINT AS employees FROM companies")
def a22_a5_totals(spark, d):
    return graph.totals(t(spark, d, "companies"), "uuid", "name", "employees").select("rows", F.col("ids"), F.col("known").alias("names"), F.col("total").alias("employees"))


@R.add("SELECT DISTINCT uuid, name FROM companies UNION ALL SELECT DISTINCT uuid, title FROM sec_list")
def so2_so4_so5_union(spark, d):
    return t(spark, d, "companies").select("uuid", "name").distinct().unionByName(t(spark, d, "sec_list").select("uuid", F.col("title").alias("name")).distinct())


@R.add("SELECT name, uuid FROM companies WHERE name IS NOT NULL ORDER BY name, uuid LIMIT 100")
def l4_l5_sorted_names(spark, d):
    return t(spark, d, "companies").where("name IS NOT NULL").select("name", "uuid").orderBy("name", "uuid").limit(100)


@R.add("SELECT article_id, ((row_number() OVER (ORDER BY collected_at DESC NULLS LAST, article_id) - 1) // 100 + 1)::BIGINT AS batch FROM articles")
def l9_newest_batches(spark, d):
    return dedup.newest_batches(t(spark, d, "articles").select("article_id", "collected_at"), "collected_at", "article_id").select("article_id", "batch")


@R.add("SELECT rel_id, country.iso_2 IS NULL AS no_code, country.iso_2 AS code, coalesce(technologies, []) = [] AS no_list FROM (SELECT DISTINCT * FROM relationships) WHERE country IS NOT NULL")
def p13_without_nulls(spark, d):
    j = t(spark, d, "relationships").distinct().where("country IS NOT NULL").select("rel_id", schemas.without_nulls(F.struct(F.struct("country.iso_2").alias("country"), F.nullif(F.col("technologies"), F.array().cast("array<string>")).alias("technologies"))).alias("j"))
    return j.select("rel_id", (~F.col("j").contains('"iso_2"')).alias("no_code"), F.get_json_object("j", "$.country.iso_2").alias("code"), (~F.col("j").contains('"technologies"')).alias("no_list"))
