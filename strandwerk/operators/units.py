"""Quantities recorded in different units: amounts in whole currency units with an ISO code, percentages in percent.

The identities used are ``amount x unit = value stated in the text`` and ``percentage x unit = percent stated in
the text``: of all pairs of a stated value and a unit the one with the least logarithmic residual is chosen, if the
residual is near zero.  Without such a pair the note of the row's source decides, then the bound that a percentage
can't exceed 100; what neither settles is flagged as not unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwerk.operators.joins import lookup

# Notations that several currencies share, in lower case.
SHARED = ("kr", "crowns", "¥", "fr.", "francs", "dollars", "dollar", "$", "pounds", "rs", "rs.", "rupees")
# Scales, currencies and percent notations as they occur in texts.
SCALES = {
    1e3: ("thousand", "thou", "tsd.", "tsd", "k", "K"),
    1e6: ("million", "millions", "mln", "Mio.", "Mio", "MM", "mn", "m", "M"),
    1e9: ("billion", "billions", "bln", "Mrd.", "Mrd", "milliard", "bn", "B", "b"),
    1e12: ("trillion", "trn", "tn"),
}
CURRENCIES = {
    "USD": ("US$", "$", "US dollars", "U.S. dollars", "dollars", "dollar", "USD"),
    "EUR": ("€", "euros", "euro", "EUR"),
    "GBP": ("£", "pounds sterling", "pounds", "sterling", "GBP"),
    "JPY": ("¥", "yen", "JPY"),
    "KRW": ("₩", "won", "KRW"),
    "CHF": ("SFr", "SFr.", "Fr.", "Swiss francs", "francs", "CHF"),
    "SEK": ("Swedish kronor", "kronor", "crowns", "kr", "SEK"),
    "INR": ("₹", "Rs.", "Rs", "rupees", "INR"),
    "TWD": ("NT$", "New Taiwan dollars", "TWD"),
    "CAD": ("CA$", "C$", "Canadian dollars", "Can. dollars", "CAD"),
}
PERCENT = ("%", "percent", "per cent", "pct", "p.c.")
BASIS_POINTS = ("basis points", "bps", "bp")
PARTS = {"all": 100.0, "half": 50.0, "a half": 50.0, "a third": 100 / 3, "a quarter": 25.0, "a fifth": 20.0, "a sixth": 100 / 6, "a tenth": 10.0, "two thirds": 200 / 3, "three quarters": 75.0, "one third": 100 / 3, "one quarter": 25.0, "one half": 50.0}
UNIT_WORDS = {"half a": 0.5, "half of a": 0.5, "a quarter of a": 0.25, "quarter of a": 0.25, "three quarters of a": 0.75, "one and a half": 1.5, "a": 1.0} | {
    w: float(n)
    for n, w in enumerate("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split(), 1)
} | {w: float(n) for n, w in zip(range(30, 101, 10), "thirty forty fifty sixty seventy eighty ninety hundred".split())}
NOTES = {"thousand": r"(?i)'000|thousands?\b(?! of)", "million": r"(?i)in millions?\b", "billion": r"(?i)in billions?\b", "one": r"(?i)\bin full\b"}
FRACTION_NOTE = r"(?i)parts of one|proportion|fraction|1 ?= ?all"

#: A stated value and amount x unit agree if their natural logarithms differ by at most this.
TOLERANCE = 0.02
#: Residuals within so much of each other are alike: stated sums are rounded.
SAME = 0.005


def _any(words) -> str:
    return "|".join("\\Q" + w + "\\E" for w in sorted(words, key=len, reverse=True))


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)])


_SCALE = _any(w for ws in SCALES.values() for w in ws)
_CURRENCY = _any(w for ws in CURRENCIES.values() for w in ws)
_NUMBER = r"\d[\d,]*(?:\.\d+)?"
MONEY = rf"(?<![\w.,])({_CURRENCY})?\s?({_NUMBER}|(?:{_any(UNIT_WORDS)})(?=\s(?:{_SCALE})(?![A-Za-z])))(?![\d])\s?(?:({_SCALE})(?![A-Za-z]))?\s?(?:({_CURRENCY})(?![A-Za-z]))?(?!\s?(?:%|per ?cent|pct|p\.c\.|basis|bps?\b))"
SHARE = rf"(?<![\w.,])({_NUMBER}|{_any(PARTS)})\s?({_any(PERCENT + BASIS_POINTS)}|(?=held|of (?:the |equity|its)|[.,;)]|$))"


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(i))


def stated_money(text: Column) -> Column:
    """The sums of money in a text, in order: array of (value, code); ``code`` is NULL where the text names no currency."""
    scale, code, words = _map({w: s for s, ws in SCALES.items() for w in ws}), _map({w: c for c, ws in CURRENCIES.items() for w in ws}), _map(UNIT_WORDS)

    def one(m: Column) -> Column:
        n = F.coalesce(words[m["n"]], F.regexp_replace(m["n"], ",", "").try_cast("double"))
        # a number needs a scale or a currency to be money, a word needs a scale
        real = F.when(m["n"].rlike(r"^\d"), (m["s"] != "") | (m["a"] != "") | (m["b"] != "")).otherwise(m["s"] != "")
        return F.struct(F.when(real, n * F.coalesce(scale[m["s"]], F.lit(1.0))).alias("value"), F.coalesce(code[m["a"]], code[m["b"]]).alias("code"))

    found = F.arrays_zip(*[_group(text, MONEY, i).alias(k) for i, k in ((1, "a"), (2, "n"), (3, "s"), (4, "b"))])
    return F.filter(F.transform(found, one), lambda m: m["value"] > 0)


def stated_percent(text: Column) -> Column:
    """The shares in a text, in order, in percent: array of double."""
    parts = _map(PARTS)

    def one(m: Column) -> Column:
        n = F.when(m["n"].rlike(r"^\d"), F.when(m["u"] != "", F.regexp_replace(m["n"], ",", "").try_cast("double"))).otherwise(parts[m["n"]])
        return F.when(m["u"].isin(*BASIS_POINTS), n / 100).otherwise(n)

    found = F.arrays_zip(*[_group(text, SHARE, i).alias(k) for i, k in ((1, "n"), (2, "u"))])
    return F.filter(F.transform(found, one), lambda p: p > 0)


def _nearest(stated: Column, value: Column, units: dict[str, float], of: Column | None = None) -> Column:
    """The combination of a stated value and a unit with the least residual, as (residual, pos, unit, code), and how many units fit."""
    pick = lambda m, i: F.array(*[F.struct(F.round(F.abs(F.ln(value * u / (m["value"] if of is None else m))), 6).alias("residual"), i.alias("pos"), F.lit(n).alias("unit"), (m["code"] if of is None else F.lit(None).cast("string")).alias("code")) for n, u in units.items()])
    return F.filter(F.flatten(F.transform(stated, pick)), lambda c: c["residual"] <= TOLERANCE)


def iso_code(currency: Column, known: Column | None = None) -> Column:
    """The ISO code of a currency written in any of the known ways; NULL where it is not recognised."""
    code = _map({w.lower(): c for c, ws in CURRENCIES.items() for w in ws})
    return code[F.lower(F.trim(currency))]


def normalize_units(relationships: DataFrame, sources: DataFrame, rates: DataFrame) -> DataFrame:
    """One row for each ``rel_id`` with amounts, currencies and percentages in common units.

    Columns: rel_id, amount, currency, percentage (as recorded), amount_unit (one, thousand, million, billion),
    amount_full, currency_code, amount_usd, percentage_unit (percent, fraction, basis_point), percent, and
    amount_unique / percentage_unique: false where several units fit or none is evidenced (the value is then taken
    as it stands); currency_unique: false where none is known, or only by a notation that several currencies share.  NULL, zero and negative values keep the unit the note gives; NULLs stay NULL.
    Repeated rows come out once; an empty table gives an empty table.
    """
    r = relationships.select("rel_id", "source", "description", "amount", "currency", "percentage").where("amount IS NOT NULL OR percentage IS NOT NULL")
    r = r.groupBy("rel_id").agg(F.min(F.struct(*r.columns)).alias("r")).select("r.*")
    note = lookup(sources.groupBy(F.col("name").alias("source")).agg(F.min("note").alias("note")))
    r = r.join(note, "source", "left")
    money = _nearest(stated_money(F.col("description")), F.abs("amount"), {"one": 1.0, "thousand": 1e3, "million": 1e6, "billion": 1e9})
    share = _nearest(stated_percent(F.col("description")), F.abs("percentage"), {"percent": 1.0, "fraction": 100.0, "basis_point": 0.01}, of=F.lit(1))
    r = r.select("*", F.when(F.col("amount") != 0, money).alias("m"), F.when(F.col("percentage") != 0, share).alias("p"))
    # the least residual decides; of combinations that fit equally well, up to rounding of the stated sums, the first stated one
    first = lambda c: F.get(F.array_sort(F.transform(c, lambda x: F.struct(F.floor(x["residual"] / SAME).alias("r"), x["pos"].alias("pos"), x["residual"].alias("residual"), x["unit"].alias("unit"), x["code"].alias("code")))), 0)
    several = lambda c: F.size(F.array_distinct(F.transform(c, lambda x: x["unit"]))) > 1
    r = r.select("*", first(F.col("m")).alias("m1"), first(F.col("p")).alias("p1"))
    by_note = F.coalesce(*[F.when(F.col("note").rlike(p), F.lit(u)) for u, p in NOTES.items()])
    unit = F.coalesce(F.col("m1.unit"), by_note)
    pct = F.coalesce(F.col("p1.unit"), F.when(F.col("note").rlike(FRACTION_NOTE) & (F.abs("percentage") <= 1), "fraction"), F.when(F.abs("percentage") > 100, "basis_point"))
    r = r.select(
        "rel_id", "amount", "currency", "percentage",
        F.when(F.col("amount").isNotNull(), F.coalesce(unit, F.lit("one"))).alias("amount_unit"),
        F.when(F.col("amount").isNotNull(), F.coalesce(unit.isNotNull() & ~several(F.coalesce(F.col("m"), F.array())), F.lit(False))).alias("amount_unique"),
        F.coalesce(iso_code(F.col("currency")), F.col("m1.code")).alias("currency_code"),
        # a notation of several currencies tells one for certain only if the text names the same
        F.when(F.col("amount").isNotNull(), F.coalesce(F.when(F.lower(F.trim("currency")).isin(*SHARED), iso_code(F.col("currency")) == F.col("m1.code")).otherwise(iso_code(F.col("currency")).isNotNull() | F.col("m1.code").isNotNull()), F.lit(False))).alias("currency_unique"),
        F.when(F.col("percentage").isNotNull(), F.coalesce(pct, F.lit("percent"))).alias("percentage_unit"),
        F.when(F.col("percentage").isNotNull(), F.coalesce(pct.isNotNull() & ~several(F.coalesce(F.col("p"), F.array())), F.lit(False))).alias("percentage_unique"),
    )
    size = _map({"one": 1.0, "thousand": 1e3, "million": 1e6, "billion": 1e9})
    part = _map({"percent": 1.0, "fraction": 100.0, "basis_point": 0.01})
    r = r.withColumns({"amount_full": F.col("amount") * size[F.col("amount_unit")], "percent": F.col("percentage") * part[F.col("percentage_unit")]})
    usd = lookup(rates.groupBy(F.col("currency").alias("currency_code")).agg(F.min("usd_per_unit").alias("usd_per_unit")))
    return r.join(usd, "currency_code", "left").select(
        "rel_id", "amount", "currency", "percentage", "amount_unit", "amount_full", "currency_code", F.expr("amount_full * usd_per_unit").alias("amount_usd"),
        "percentage_unit", "percent", "amount_unique", "currency_unique", "percentage_unique",
    )


def unit_findings(normalized: DataFrame) -> DataFrame:
    """``(rel_id, field_name, unit_name)``: the values that were not in the common unit, from ``normalize_units``."""
    found = F.array(
        F.when(F.col("amount_unit") != "one", F.struct(F.lit("amount").alias("field_name"), F.col("amount_unit").alias("unit_name"))),
        F.when(F.col("percentage_unit") != "percent", F.struct(F.lit("percentage").alias("field_name"), F.col("percentage_unit").alias("unit_name"))),
        F.when(F.col("amount").isNotNull() & F.col("currency_code").isNotNull() & ~F.col("currency").eqNullSafe(F.col("currency_code")), F.struct(F.lit("currency").alias("field_name"), F.col("currency_code").alias("unit_name"))),
    )
    return normalized.select("rel_id", F.explode(F.array_compact(found)).alias("f")).select("rel_id", "f.field_name", "f.unit_name")
