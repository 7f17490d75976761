"""Keys from company names: domain endings, legal forms, first words, acronyms, match keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domain endings, legal forms and stop words.
DOMAINS = (
    "com org net edu gov mil int io ai co uk us ca au de fr jp cn in br ru it es nl se no dk fi pl mx kr tw sg hk nz ie be ch at cz za il ae sa th vn ph id my pk bd ng ke ug tz gh zm zw"
    " biz info name pro museum coop aero xxx travel mobi tel asia cat jobs post"
).split()
LEGAL_FORMS = (
    "incorporated corporation company limited holdings inc corp corpn co llc lllp llp lp ltd plc pllc pc pty pte cic gmbh ggmbh mbh ag kg kgaa ohg gbr ug ev eg se sa sarl sas sasu sca scs snc eurl sci"
    " nv bv vof cv bvba sprl scrl asbl vzw ab hb kb as asa ans da ks aps ivs oy oyj ky spa srl srls sapa ss scarl sl slu slne sll scoop lda ltda eireli kft zrt nyrt kkt rt doo dd ad ead eood ood sro spol"
    " ou uab sia oao ooo zao pao ao too tov sdn bhd berhad pt tbk pvt kk yk gk"
).split() + [
    "gesellschaft mit beschränkter haftung", "aktiengesellschaft", "kommanditgesellschaft", "société anonyme", "sociedad anónima", "sociedad limitada", "società per azioni", "aktiebolag", "aktieselskab", "osakeyhtiö",
    "naamloze vennootschap", "besloten vennootschap", "limited liability company", "public limited company", "limited partnership", "kabushiki kaisha",
]
STOP_WORDS = (
    "a about above after again all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here"
    " him his how i if in into is it its itself me more most my no nor not of off on once only or other our out over own same she should so some such than that the their them then there these they this those through"
    " to too under until up very was we were what when where which while who whom why will with would you your"
    " le la les des du et der die das und von für el los las y e de het een en van il lo gli di og och"
).split()

_DOMAIN = r"(?i)\.(" + "|".join(sorted(DOMAINS, key=len, reverse=True)) + ")$"
#: A short form may be written with a dot behind each letter.
_LEGAL = r"(?i)(^|[\s,]+)(" + "|".join(r"\.?".join(w) if len(w) <= 4 else w for w in sorted(LEGAL_FORMS, key=len, reverse=True)) + ")$"
_TAIL = r"[^\p{L}\p{N})]+$"


def spaced(c: Column) -> Column:
    """White space collapsed to single blanks, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_domain(c: Column) -> Column:
    """The name without one known domain ending, any case; then trimmed."""
    return F.trim(F.regexp_replace(c, _DOMAIN, ""))


def base_name(c: Column) -> Column:
    """The name without legal forms (up to three) and trailing punctuation; NULL for NULL or an empty name."""
    s = F.regexp_replace(spaced(c), _TAIL, "")
    for _ in range(3):
        s = F.regexp_replace(F.regexp_replace(s, _LEGAL, ""), _TAIL, "")
    return F.when(F.trim(c) != "", s)


def legal_ending(c: Column) -> Column:
    """What ``base_name`` takes off the end, trimmed; NULL if nothing."""
    s = spaced(c)
    return F.nullif(F.trim(F.substring(s, F.length(base_name(c)) + 1, F.length(s))), F.lit(""))


def acronym(c: Column) -> Column:
    """Initials of a name of at least two words, or a single all-upper-case word; else NULL."""
    s = base_name(F.regexp_replace(F.regexp_replace(spaced(c), r"^\$", ""), r"[()]", ""))
    words = F.filter(F.split(s, "[ -]+"), lambda w: w.rlike(r"^\p{Lu}$") | ((F.length(w) > 1) & ~F.lower(w).isin(*STOP_WORDS)))
    one = F.get(words, F.lit(0))
    initials = F.array_join(F.transform(words, lambda w: F.upper(F.left(w, F.lit(1)))), "")
    return F.when(F.size(words) >= 2, initials).when((F.size(words) == 1) & (one == F.upper(one)) & one.rlike(r"\p{Lu}"), one)


def first_word_key(c: Column) -> Column:
    """The first word in upper case, after the domain ending is off; NULL where there is none."""
    return F.nullif(F.upper(F.get(F.split(strip_domain(F.trim(c)), r"\s+"), F.lit(0))), F.lit(""))


def acronym_key(c: Column) -> Column:
    """The acronym, or the first-word key where a name has none."""
    return F.coalesce(acronym(strip_domain(F.trim(c))), first_word_key(c))


def match_key(c: Column) -> Column:
    """The base name in lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(base_name(c)), "[^a-z0-9]", "")


def company_id(name: Column, symbol: Column) -> Column:
    """The ticker symbol in upper case, else the base name's letters and digits, or the whole name's if those are fewer than two."""
    alnum = lambda x: F.regexp_replace(x, "[^A-Za-z0-9]", "")
    short = alnum(base_name(name))
    return F.coalesce(F.nullif(F.upper(F.trim(symbol)), F.lit("")), F.when(F.length(short) >= 2, short), alnum(name))


def clean_name(c: Column) -> Column:
    """Line breaks as blanks, trimmed."""
    return F.trim(F.regexp_replace(c, r"[\r\n]+", " "))


def label(c: Column) -> Column:
    """A label as it is if it is all upper case and longer than one letter, else with capitalised words."""
    return F.when((c == F.upper(c)) & (F.length(c) > 1), c).otherwise(F.initcap(c))


def labels(arr: Column) -> Column:
    """Labels normalised, each once, in order."""
    return F.array_distinct(F.transform(arr, label))


def edit_share(a: Column, b: Column) -> Column:
    """Edit distance divided by the longer length; 0 for two empty texts."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / n)


class SQL:
    """The same in DuckDB's SQL, as text over an expression, for the oracles."""

    @staticmethod
    def spaced(x: str) -> str:
        return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"

    @staticmethod
    def strip_domain(x: str) -> str:
        return f"trim(regexp_replace({x}, '{_DOMAIN}', ''))"

    @staticmethod
    def base_name(x: str) -> str:
        s = f"regexp_replace({SQL.spaced(x)}, '{_TAIL}', '')"
        for _ in range(3):
            s = f"regexp_replace(regexp_replace({s}, '{_LEGAL}', ''), '{_TAIL}', '')"
        return f"CASE WHEN trim({x}) <> '' THEN {s} END"

    @staticmethod
    def acronym(x: str) -> str:
        s = SQL.base_name(f"regexp_replace(regexp_replace({SQL.spaced(x)}, '^\\$', ''), '[()]', '', 'g')")
        stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
        words = f"list_filter(regexp_split_to_array({s}, '[ -]+'), lambda w: regexp_full_match(w, '\\p{{Lu}}') OR (length(w) > 1 AND lower(w) NOT IN ({stop})))"
        return f"(SELECT CASE WHEN len(ws) >= 2 THEN array_to_string(list_transform(ws, lambda w: upper(w[1])), '') WHEN len(ws) = 1 AND ws[1] = upper(ws[1]) AND regexp_matches(ws[1], '\\p{{Lu}}') THEN ws[1] END FROM (SELECT {words} AS ws))"

    @staticmethod
    def first_word(x: str) -> str:
        return f"nullif(upper(regexp_split_to_array({SQL.strip_domain(f'trim({x})')}, '\\s+')[1]), '')"

    @staticmethod
    def acronym_key(x: str) -> str:
        return f"coalesce({SQL.acronym(SQL.strip_domain(f'trim({x})'))}, {SQL.first_word(x)})"

    @staticmethod
    def match_key(x: str) -> str:
        return f"regexp_replace(lower({SQL.base_name(x)}), '[^a-z0-9]', '', 'g')"
