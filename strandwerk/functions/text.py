"""Text, URL, date and number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles of blocked pages, least length of an article, patterns of URLs and dates, exchange codes by suffix.
BLOCKED_TITLES = ("just a moment...", "access denied", "please wait...", "checking your browser", "attention required", "one more step", "verify you are human")
MIN_CONTENT = 200
URL = r"""https?://[^\s<>"{}|\\^`\[\]']+"""
ATTRIBUTE = r"""(?i)(?:href|src)\s*=\s*["']\s*(https?://[^"']+?)\s*["']"""
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "MMMM d, yyyy")
EXCHANGES = {
    "O": "NASDAQ", "Q": "NASDAQ", "N": "NYSE", "A": "AMEX", "P": "ARCA", "Z": "BATS", "K": "OTC", "OB": "OTCBB", "PK": "OTCPK",
    "TO": "TSX", "V": "TSXV", "CN": "CSE", "NE": "NEO", "L": "LSE", "LON": "LSE", "IL": "ISEQ", "DUB": "ISEQ",
    "PA": "EPA", "AS": "AMS", "BR": "EBR", "LS": "ELI", "MI": "MIL", "MC": "MCE", "DE": "XETRA", "F": "FRA", "BE": "BER", "HA": "HAM", "HM": "HAN", "MU": "MUN", "SG": "STU",
    "SW": "SWX", "S": "SWX", "VX": "VTX", "CO": "CPH", "ST": "STO", "HE": "HEL", "IC": "ICE", "OL": "OSL", "VS": "VSE", "PR": "PRA", "WA": "WSE", "BD": "BUD", "BU": "BUC", "AT": "ATH", "IS": "IST",
    "HK": "HKEX", "SS": "SSE", "SZ": "SZSE", "SH": "SSE", "T": "TSE", "TYO": "TSE", "OS": "OSE", "NK": "NSE", "SP": "SSE", "FS": "FSE", "JP": "JPX", "KS": "KOSPI", "KQ": "KOSDAQ", "NS": "NSE", "BO": "BSE",
    "SI": "SGX", "TW": "TWSE", "TWO": "TPE", "TB": "TFEX", "BK": "SET", "KL": "KLSE", "JK": "IDX", "PS": "PSE", "VN": "HOSE", "HN": "HNX", "CM": "CSE", "KA": "KSE", "DSE": "DSE", "AX": "ASX", "NZ": "NZX",
    "TA": "TASE", "TLV": "TASE", "AB": "ADX", "DU": "DFM", "QA": "QSE", "SR": "TADAWUL", "KW": "KSE", "BH": "BSE", "OM": "MSM", "AM": "ASE", "CA": "EGX", "JO": "JSE", "CAS": "CASE", "NBO": "NSE", "NASE": "NASE",
    "DSM": "DSE", "LUS": "LUSE", "ZSE": "ZSE", "BRVM": "BRVM", "MX": "BMV", "BVMF": "B3", "SA": "B3", "SN": "BCS", "BA": "BCBA", "LM": "BVL", "CR": "BVC", "CCS": "BVCV",
    "CC": "CRYPTO", "COIN": "CRYPTO", "CBT": "CBOT", "CME": "CME", "NYM": "NYMEX", "CMX": "COMEX", "ICE": "ICE", "LME": "LME",
}
SCALE_WORDS = {"thousand": 1e3, "million": 1e6, "billion": 1e9}
# Where a page states its date, in order; where a company page states its facts, in order.
POSTED = (
    r'(?i)<meta\s+(?:property|name)="(?:article:published_time|datePublished|publication_date)"\s+content="([^"]+)"',
    r'(?i)<meta\s+(?:property|name)="(?:og:published_time)"\s+content="([^"]+)"',
    r'(?i)"datePublished"\s*:\s*"([^"]+)"',
    r'(?i)<time\s+(?:datetime|pubdate)="([^"]+)"',
)
FACTS = {
    "symbol": (r"NASDAQ:\s*([A-Z]{1,5})", r"NYSE:\s*([A-Z]{1,5})", r"traded as ([A-Z]{1,5})"),
    "website_url": (r"(?i)(?:official website|website)\s*[\n\r]*([^\s\n]+\.[^\s\n]+)", r"(?i)(?:official website|website)(?:\s+is)?\s+(\S+\.\S+)", r"(?i)(https?://[^\s]+)"),
    "headquarters_location": (r"(?i)(?:headquartered in|headquarters in|based in)\s+([^,\.\n]+)", r"(?i)headquarters?:\s*([^,\.\n]+)"),
    "founded_year": (r"(?i)(?:founded|established|incorporated)(?:\s+in)?\s+(\d{4})", r"(?i)(\d{4})\s+(?:founding|establishment)"),
    "revenue_usd": (
        r"(?i)annual revenue of (?:US\$)?([\d.,]+)\s*(billion|million)", r"(?i)revenue(?:\s+of)?\s+(?:US\$)?([\d.,]+)\s*(billion|million)",
        r"(?i)(?:US\$)?([\d.,]+)\s*(billion|million)\s+(?:in\s+)?revenue",
    ),
    "employees": (r"(?i)([\d,]+)\s+employees", r"(?i)employs?\s+([\d,]+)", r"(?i)workforce\s+of\s+([\d,]+)"),
    "ceo": (r"CEO\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", r"chief executive officer\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s+(?:is|serves as)\s+(?:the\s+)?CEO"),
    "linkedin_url": (r"(?i)linkedin\.com/company/([a-zA-Z0-9-]+)",),
}
#: Years in which a company can have been founded; words of a chief executive's name.
FOUNDED, CEO_WORDS = (1800, 2025), (2, 4)
#: Article pages by site: the URL starts with one of the first or holds one of the second.
ARTICLE_URLS = {"semianalysis.com": (("https://semianalysis.com/20",), ("/blog/", "/article/"))}


def valid_article(title: Column, content: Column) -> Column:
    """No blocked title and enough content; a NULL title is fine, NULL content is not."""
    low = F.lower(F.coalesce(title, F.lit("")))
    blocked = F.lit(False)
    for b in BLOCKED_TITLES:
        blocked = blocked | low.contains(b)
    return ~blocked & (F.length(F.coalesce(content, F.lit(""))) >= MIN_CONTENT)


def host(url: Column) -> Column:
    """The host of a URL in lower case without port; NULL if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def ignored(url: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below it; URLs without a host are kept."""
    h = F.coalesce(host(url), F.lit(""))
    out = F.lit(False)
    for d in domains:
        out = out | (h == d.lower()) | h.endswith("." + d.lower())
    return out


def urls(html: Column, domains: list[str] | None = None) -> Column:
    """The absolute http(s) URLs of attributes and text, each once, sorted, without the ignored ones."""
    found = F.concat(F.regexp_extract_all(html, F.lit(ATTRIBUTE), F.lit(1)), F.regexp_extract_all(F.regexp_replace(html, "<[^>]*>", " "), F.lit(URL), F.lit(0)))
    found = F.array_sort(F.array_distinct(found))
    return F.filter(found, lambda u: ~ignored(u, domains)) if domains else found


def urls_in_order(text: Column) -> Column:
    """The URLs of a chat text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(URL), F.lit(0)))


def page_title(html: Column) -> Column:
    """The title element's text, blanks collapsed, up to ' | '; NULL if there is none."""
    t = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.nullif(F.trim(F.split_part(t, F.lit(" | "), F.lit(1))), F.lit(""))


def posted_date(html: Column) -> Column:
    """The date a page states, by the first of POSTED that matches; a bare date is midnight UTC, other notations stay; NULL if none does."""
    found = F.trim(F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in POSTED]))
    return F.when(~found.contains("T") & found.rlike("-.*-"), F.concat(found, F.lit("T00:00:00+00:00"))).otherwise(found)


def slug_title(slug: Column) -> Column:
    """A slug as a title."""
    return F.initcap(F.regexp_replace(slug, "[-_]+", " "))


def excerpt(text: Column, n: int = 200) -> Column:
    """The first n characters, with '...' if there are more."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def flexible_date(s: Column) -> Column:
    """A date in one of DATE_FORMATS, or the date part of an ISO time; else NULL."""
    iso = F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})[T ]", 1)
    return F.coalesce(*[F.try_to_timestamp(F.trim(s), F.lit(f)).cast("date") for f in DATE_FORMATS], F.nullif(iso, F.lit("")).try_cast("date"))


def epoch_iso(seconds: Column) -> Column:
    """Epoch seconds as ISO time with Z."""
    return F.concat(F.date_format(F.convert_timezone(None, F.lit("UTC"), F.timestamp_seconds(seconds).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def money_cell(s: Column, unit: Column | None = None) -> Column:
    """The number in a table cell: currency signs and separators dropped, brackets negative, dashes NULL, times the unit's scale."""
    bare = F.regexp_replace(F.trim(s), r"[$,\s]", "")
    negative = bare.rlike(r"^\(.*\)$")
    n = F.regexp_replace(bare, "[()]", "").try_cast("double")
    n = F.when(negative, -n).otherwise(n)
    if unit is None:
        return n
    scale = F.create_map(*[F.lit(x) for k, v in SCALE_WORDS.items() for x in (k, v)])
    return n * F.coalesce(scale[F.lower(unit)], F.lit(1.0))


def first_match(text: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that matches; NULL if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def _first_good(text: Column, patterns, good) -> Column:
    """The first group of the first pattern whose first match is good; NULL if there is none."""
    return F.coalesce(*[F.when(good(F.regexp_extract(text, p, 1)), F.regexp_extract(text, p, 1)) for p in patterns])


def company_facts(text: Column) -> Column:
    """A struct of what a company page states: symbol, exchange, website_url, headquarters_location, founded_year, revenue_usd, employees, ceo, linkedin_url.

    Each fact comes from the first of its FACTS whose first match holds: a year within FOUNDED, a name of CEO_WORDS
    words, an address outside the encyclopedia.  NULL where no pattern holds.
    """
    get = lambda k, good=lambda x: x != "": _first_good(text, FACTS[k], good)
    symbol = F.coalesce(*[F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("symbol"), F.lit(x).cast("string").alias("exchange"))) for p, x in zip(FACTS["symbol"], ("NASDAQ", "NYSE", None))])
    web = get("website_url", lambda x: (x != "") & ~F.lower(x).contains("wikipedia"))
    scale = F.create_map(*[F.lit(x) for k, v in SCALE_WORDS.items() for x in (k, v)])
    revenue = F.coalesce(*[F.when(text.rlike(p), F.regexp_replace(F.regexp_extract(text, p, 1), ",", "").try_cast("double") * scale[F.lower(F.regexp_extract(text, p, 2))]) for p in FACTS["revenue_usd"]])
    linked = get("linkedin_url")
    return F.struct(
        symbol["symbol"].alias("symbol"), symbol["exchange"].alias("exchange"),
        F.when(web.startswith("http"), web).otherwise(F.concat(F.lit("https://"), web)).alias("website_url"),
        F.trim(get("headquarters_location")).alias("headquarters_location"),
        get("founded_year", lambda x: x.try_cast("int").between(*FOUNDED)).try_cast("bigint").alias("founded_year"),
        revenue.alias("revenue_usd"),
        F.regexp_replace(get("employees", lambda x: x.rlike(r"\d")), ",", "").try_cast("bigint").alias("employees"),
        F.trim(get("ceo", lambda x: F.size(F.split(F.trim(x), r"\s+")).between(*CEO_WORDS) & (x != ""))).alias("ceo"),
        F.concat(F.lit("https://www.linkedin.com/company/"), linked).alias("linkedin_url"),
    )


def article_url(url: Column, rule: tuple[tuple[str, ...], tuple[str, ...]]) -> Column:
    """Whether a URL is an article page by a site's rule, as those of ARTICLE_URLS; NULL is none."""
    starts, holds = rule
    out = F.lit(False)
    for s in starts:
        out = out | url.startswith(s)
    for h in holds:
        out = out | url.contains(h)
    return F.coalesce(out, F.lit(False))


def recent(date: Column, year: int) -> Column:
    """The year is at least ``year``, or the date can't be read."""
    y = F.year(flexible_date(date))
    return (y >= year) | y.isNull()


def thread_document(title: Column, text: Column, comments: Column, most: int = 10) -> Column:
    """A discussion as one text: title, text, 'Comments:' and the first comments with a dash before each; NULL parts are left out."""
    own = F.filter(comments, lambda x: x.isNotNull())
    return F.concat_ws(" ", title, text, F.lit("Comments:"), F.transform(F.slice(own, 1, most), lambda x: F.concat(F.lit("- "), x)))


def ticker_of(json: Column) -> Column:
    """``{symbol, exchange}`` of a ticker as JSON text; exchanges outside the known codes are UNK, texts without a symbol NULL."""
    from strandwerk.schemas import EXCHANGE_CODES

    x = F.from_json(json, "symbol string, exchange string")
    return F.when(x["symbol"] != "", F.struct(x["symbol"].alias("symbol"), F.when(x["exchange"].isin(*EXCHANGE_CODES), x["exchange"]).otherwise("UNK").alias("exchange")))


def own_or(a: Column, b: Column) -> Column:
    """The own text unless it is missing or empty, else the other's."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def exchange_of(symbol: Column) -> Column:
    """The exchange code of a symbol's suffix after the last dot; NULL if unknown."""
    m = F.create_map(*[F.lit(x) for k, v in EXCHANGES.items() for x in (k, v)])
    return m[F.upper(F.regexp_extract(symbol, r"\.([A-Za-z]+)$", 1))]


def safe_file_name(s: Column) -> Column:
    """Letters, digits, dot, dash and underscore only."""
    return F.regexp_replace(s, r"[^A-Za-z0-9._-]+", "_")


def wiki_markdown(s: Column) -> Column:
    """Wiki text as Markdown: headings, links, bold and italic; templates and references dropped."""
    s = F.regexp_replace(s, r"(?s)<ref[^>]*?/>|<ref[^>]*>.*?</ref>", "")
    for _ in range(2):
        s = F.regexp_replace(s, r"\{\{[^{}]*\}\}", "")
    for n in range(6, 1, -1):
        s = F.regexp_replace(s, rf"(?m)^={{{n}}}\s*(.*?)\s*={{{n}}}\s*$", "#" * n + " $1")
    s = F.regexp_replace(s, r"\[\[(?:[^|\]]*\|)?((?:[^\]]+|\](?!\])|\](?=\]\]))*)\]\]", "$1")
    s = F.regexp_replace(s, r"\[(https?://\S+)\s+([^\]]+)\]", "[$2]($1)")
    return F.regexp_replace(F.regexp_replace(s, "'''", "**"), "''", "*")


def storage_tier(payload: Column, limit: int = 1 << 20) -> Column:
    """Where a payload is kept: the object store above the limit."""
    return F.when(F.length(payload) > limit, "object_store").otherwise("state_store")
