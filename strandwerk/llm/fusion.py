"""Best representative of each duplicate group.

Each group's records claim values of fields.  Two policies choose the survivors over the same claims:

* ``fuse``: Bayesian fusion with copy detection.  Source accuracies are estimated from the claims; two sources that
  agree on values that are probably false more often than chance allows are taken as dependent; copied votes are
  discounted; the value of maximum posterior survives.
* ``choose``: the lexicographic rule of the data description (trust rank, then recency, then uuid).  Trust decides
  there before any number of votes, which no posterior reproduces; so ``p1_found`` uses this policy.

No group is collected: records meet their group by an equi-join and combine on the map side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwerk.operators.joins import lookup
from strandwerk.session import Cut

FIELDS = ("website_url", "headquarters_location", "jurisdiction", "revenue_usd", "employees", "founded_year", "ceo")
NUMBERS = ("revenue_usd", "employees", "founded_year")
#: Texts that only fill a field, in lower case; texts without any letter or digit count too.
FILLERS = (
    "null", "none", "nil", "nan", "n/a", "#n/a", "na", "n.a.", "not available", "not disclosed", "undisclosed", "unknown", "unspecified", "tbd", "tba", "to be determined", "see website",
    "nicht bekannt", "unbekannt", "k.a.", "inconnu", "non disponible", "desconocido", "no disponible", "onbekend", "missing", "x", "xx", "xxx", "test",
)
YEARS = (1500, 2100)

#: Rounds of the estimation, accuracy of a source before any evidence, and weight of that in claims.
ROUNDS, PRIOR_ACCURACY, PRIOR_WEIGHT = 4, 0.8, 20.0
#: False values a field could take, and how likely a copier copies a given value.
FALSE_VALUES, COPY_RATE = 50.0, 0.8
#: Accuracy before any evidence of a source of the best trust rank, and of the worst or none.
BEST, WORST = 0.95, 0.6


def real_value(field: str, c: Column) -> Column:
    """The value as text if it is a real one, not a filler; else NULL."""
    if field in NUMBERS:
        n = c.cast("bigint")
        nines = n.cast("string").rlike("^9{4,}$") & ((n >= 999_999) | F.lit(field == "founded_year"))
        ok = n.between(*YEARS) if field == "founded_year" else (n > 0) & ~nines
        return F.when(ok, n.cast("string"))
    s = F.trim(F.regexp_replace(c, r"[\s ]+", " "))
    ok = s.rlike(r"[\p{L}\p{N}]") & ~F.lower(s).isin(*FILLERS)
    if field == "website_url":
        ok = ok & s.rlike(r"(?i)^(https?://)?(www\.)?[^\s/.]+(\.[^\s/.]+)+(/\S*)?$")
    return F.when(ok, s)


def same_value(field: str, c: Column) -> Column:
    """The form in which two records' values are compared as votes."""
    s = F.lower(c)
    if field == "website_url":
        return F.regexp_replace(s, r"^(https?://)?(www\.)?|/.*$", "")
    return F.split_part(s, F.lit(","), F.lit(1)) if field == "headquarters_location" else s


def moment(c: Column) -> Column:
    """Microseconds since 1970 of a time in any of the notations seen; UTC where no zone is given, NULL if unreadable."""
    s = F.trim(c)
    iso = F.when(s.rlike(r"(Z|[+-]\d\d:?\d\d)$") & s.contains(":"), s).when(s.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(s, F.lit("T00:00:00Z"))).otherwise(F.concat(F.regexp_replace(s, " ", "T"), F.lit("Z")))
    iso = F.when(s.rlike(r"^\d{4}-\d\d-\d\d"), iso).try_cast("timestamp")
    rfc = F.regexp_replace(F.regexp_replace(s, r"^\p{L}+,\s*", ""), r"\b(GMT|UTC|UT|Z)$", "+0000")
    rfc = F.when(s.rlike(r"^\p{L}+, ?\d"), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")))
    n = F.when(s.rlike(r"^\d{9,10}$"), s.try_cast("bigint") * 1_000_000).when(s.rlike(r"^\d{12,13}$"), s.try_cast("bigint") * 1000)
    return F.coalesce(n, F.unix_micros(F.coalesce(iso, rfc)))


def members(blocks: DataFrame) -> DataFrame:
    """``(block_id, group_uuid, uuid, source, collected, v)``: each record that a resolved entry of its block lists, with
    the struct ``v`` of its real values; an equi-join of the blocks' records with the entries' lists.

    Time grows with the records and the listed uuids, however they spread over blocks and entries.  Blocks with NULL
    or empty lists, entries without uuid or list, and listed uuids outside the block give nothing.
    """
    low = lambda x: F.lower(F.trim(x))
    o = blocks.select("block_id", F.explode("original_companies").alias("o")).where("o.uuid IS NOT NULL")
    values = F.struct(*[real_value(f, F.col(f"o.{f}")).alias(f) for f in FIELDS])
    o = o.select("block_id", low("o.uuid").alias("k"), F.col("o.uuid").alias("uuid"), F.col("o.source").alias("source"), moment(F.col("o.collected_at")).alias("collected"), values.alias("v"))
    e = blocks.select("block_id", F.explode(F.transform("resolved_companies", lambda r: F.struct(r["uuid"].alias("uuid"), r["source_uuids"].alias("s")))).alias("r")).where("r.uuid IS NOT NULL")
    e = e.select("block_id", F.col("r.uuid").alias("group_uuid"), F.explode("r.s").alias("s")).select("block_id", "group_uuid", low("s").alias("k")).where("k IS NOT NULL")
    return e.distinct().join(o, ["block_id", "k"]).drop("k")


def claims(blocks: DataFrame) -> DataFrame:
    """``(block_id, group_uuid, field_name, source_uuid, source, value, vote)``: each real value of the records of groups of at least two."""
    m, g = members(blocks), ["block_id", "group_uuid"]
    several = m.groupBy(*g).agg(F.min("uuid").alias("lo"), F.max("uuid").alias("hi")).where("lo <> hi").select(*g)
    each = [F.struct(F.lit(f).alias("field_name"), F.col(f"v.{f}").alias("value"), same_value(f, F.col(f"v.{f}")).alias("vote")) for f in FIELDS]
    m = m.join(several, g, "left_semi").select(*g, F.col("uuid").alias("source_uuid"), "source", F.explode(F.array(*each)).alias("f"))
    return m.select(*g, "f.field_name", "source_uuid", "source", "f.value", "f.vote").where("value IS NOT NULL")


def _trust(sources: DataFrame) -> DataFrame:
    s = sources.where("name IS NOT NULL AND trust_rank IS NOT NULL")
    return lookup(s.groupBy(F.col("name").alias("source")).agg(F.min("trust_rank").alias("trust_rank")))


def choose(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """``(group_uuid, field_name, source_uuid, value)``: for each group of at least two records and each field the claim
    of the best trust rank (no or unlisted source: last), then the latest, then of the smallest uuid; no row without a
    real value.

    A record repeated in its block is one record; where its copies differ, the claims of all count.
    """
    m = members(blocks).join(_trust(sources), "source", "left")
    # least of the struct: rank (NULL last), -time (missing is oldest), uuid
    order = F.struct(F.col("trust_rank").isNull().alias("n"), F.col("trust_rank").alias("t"), (-F.coalesce("collected", F.lit(-(2**62)))).alias("c"), F.col("uuid").alias("u"))
    m = m.select("block_id", "group_uuid", "uuid", order.alias("o"), "v")
    best = [F.min(F.when(F.col(f"v.{f}").isNotNull(), F.struct("o", F.col(f"v.{f}").alias("value")))).alias(f) for f in FIELDS]
    m = m.groupBy("block_id", "group_uuid").agg(F.min("uuid").alias("lo"), F.max("uuid").alias("hi"), *best).where("lo <> hi")
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.o.u").alias("source_uuid"), F.col(f"{f}.value").alias("value")) for f in FIELDS])
    return m.select("group_uuid", F.inline(each)).where("source_uuid IS NOT NULL")


def _log(x: Column) -> Column:
    return F.ln(F.greatest(x, F.lit(1e-9)))


def prior_accuracy(names: DataFrame, sources: DataFrame | None) -> DataFrame:
    """``(source, prior)``: the accuracy of each named source before any evidence: by its trust rank, if ranks are given.

    The best rank has BEST, the worst and sources without a rank WORST, the ranks between lie evenly spaced.
    """
    if sources is None:
        return names.select("source", F.lit(PRIOR_ACCURACY).alias("prior"))
    ranked = sources.where("name IS NOT NULL AND trust_rank IS NOT NULL").groupBy(F.col("name").alias("source")).agg(F.min("trust_rank").alias("t"))
    lo, hi = ranked.agg(F.min("t")).scalar(), ranked.agg(F.max("t")).scalar()
    share = F.coalesce(F.try_divide((F.col("t") - lo).cast("double"), hi - lo), F.lit(0.0))
    return names.join(lookup(ranked), "source", "left").select("source", F.when(F.col("t").isNull(), WORST).otherwise(BEST - (BEST - WORST) * share).alias("prior"))


def votes(blocks: DataFrame, cut: Cut, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The claims by (group, field, vote, source) with their posterior after ROUNDS rounds; accuracies; dependences.

    ``accuracy(source, accuracy)`` and ``copies(source, other, dependence)`` are tables like the claims, broadcast while
    they are small.  Two sources' shared votes are joined by the vote, and what they don't share is counted by group
    and field, so that a group of many records never meets itself.
    """
    g = ["block_id", "group_uuid", "field_name"]
    c = cut.write(claims(blocks).where("source IS NOT NULL").select(*g, "source", "vote").distinct())
    prior = cut.write(prior_accuracy(c.select("source").distinct(), sources))
    accuracy, copies, scored = prior.select("source", F.col("prior").alias("accuracy")), None, None
    held = F.count("*").alias("n")
    for r in range(ROUNDS):
        acc = lookup(accuracy)
        x = c.join(acc, "source")
        own = F.lit(1.0)
        if copies is not None:
            # a vote counts for the part that is not copied from a more accurate source of the same value
            model = x.select(*g, "vote", F.col("source").alias("other"), F.col("accuracy").alias("a2"))
            copied = x.join(model, [*g, "vote"]).where("other <> source AND (a2 > accuracy OR (a2 = accuracy AND other < source))").join(lookup(copies), ["source", "other"])
            copied = copied.groupBy(*g, "vote", "source").agg(F.exp(F.sum(_log(1 - COPY_RATE * F.col("dependence")))).alias("own"))
            x, own = x.join(copied, [*g, "vote", "source"], "left"), F.coalesce("own", F.lit(1.0))
        v = x.groupBy(*g, "vote").agg(F.sum(own * (_log(F.col("accuracy") * FALSE_VALUES) - _log(1 - F.col("accuracy")))).alias("score"))
        v = v.join(v.groupBy(*g).agg(F.max("score").alias("top")), g).withColumn("e", F.exp(F.col("score") - F.col("top")))
        norm = v.groupBy(*g).agg((F.sum("e") + FALSE_VALUES * F.exp(-F.max("top"))).alias("z"))
        new = cut.write(v.join(norm, g).select(*g, "vote", (F.col("e") / F.col("z")).alias("posterior")))
        if scored is not None:
            cut.free(scored)
        scored = new
        if r == ROUNDS - 1:
            break
        p = c.join(scored, [*g, "vote"])
        # the first round's votes may be copies: they only tell dependences
        if r:
            seen = p.groupBy("source").agg(F.sum("posterior").alias("s"), held)
            told = (F.coalesce("s", F.lit(0.0)) + F.col("prior") * PRIOR_WEIGHT) / (F.coalesce("n", F.lit(0)) + PRIOR_WEIGHT)
            cut.free(accuracy)
            accuracy = cut.write(prior.join(seen, "source", "left").select("source", F.least(F.greatest(told, F.lit(0.05)), F.lit(0.99)).alias("accuracy")))
        est = lookup(accuracy)
        one = p.join(est, "source").select(*g, "vote", F.col("source").alias("s1"), F.col("accuracy").alias("a1"), "posterior")
        two = c.join(est, "source").select(*g, "vote", F.col("source").alias("s2"), F.col("accuracy").alias("a2"))
        shared = one.join(two, [*g, "vote"]).where("s1 < s2").groupBy("s1", "s2").agg(F.sum(evidence(F.lit(True), F.col("posterior"), F.col("a1"), F.col("a2"))).alias("e"), held)
        each = c.groupBy(*g, "source").agg(F.count("*").alias("k"))
        both = each.select(*g, F.col("source").alias("s1"), F.col("k").alias("k1")).join(each.select(*g, F.col("source").alias("s2"), F.col("k").alias("k2")), g).where("s1 < s2")
        both = both.groupBy("s1", "s2").agg(F.sum(F.col("k1") * F.col("k2")).alias("all"))
        pairs = both.join(shared, ["s1", "s2"], "left").select("s1", "s2", dependence(F.coalesce("e", F.lit(0.0)) + (F.col("all") - F.coalesce("n", F.lit(0))) * math.log(1 - COPY_RATE)).alias("dependence"))
        if copies is not None:
            cut.free(copies)
        copies = cut.write(pairs.select(F.explode(F.array(F.struct(F.col("s1").alias("source"), F.col("s2").alias("other"), "dependence"), F.struct(F.col("s2").alias("source"), F.col("s1").alias("other"), "dependence"))).alias("p")).select("p.*"))
    return c.join(scored, [*g, "vote"]), accuracy, copies


def evidence(same: Column, true: Column, a1: Column, a2: Column) -> Column:
    """The log odds that one item gives for two sources' dependence: they share a value, true with probability ``true``, or differ.

    Two sources share a false value by chance far more seldom than a true one; whether the shared value is true is summed out.
    """
    a = F.greatest(a1, a2)
    pt, pf = a1 * a2, (1 - a1) * (1 - a2) / FALSE_VALUES
    dt, df = a * COPY_RATE + pt * (1 - COPY_RATE), (1 - a) * COPY_RATE + pf * (1 - COPY_RATE)
    return F.when(same, _log(true * dt + (1 - true) * df) - _log(true * pt + (1 - true) * pf)).otherwise(F.lit(math.log(1 - COPY_RATE)))


def dependence(log_odds: Column, prior: float = 0.2) -> Column:
    """Posterior that two sources depend on each other, from the sum of their items' evidence."""
    x = F.greatest(F.least(log_odds + math.log(prior / (1 - prior)), F.lit(500.0)), F.lit(-500.0))
    return 1 / (1 + F.exp(-x))


def fuse(blocks: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """One surviving record for each group: ``group_uuid``, the seven fields, and ``confidence``, the mean posterior.

    ``sources(name, trust_rank)`` give the sources' accuracy before any evidence.  Values without a named source vote
    with no weight and survive only where nothing else is claimed (then the smallest text).  Ties fall to the smaller
    value, so that repeated runs agree.
    """
    g = ["block_id", "group_uuid", "field_name"]
    v, _, _ = votes(blocks, Cut(blocks.sparkSession, "fusion"), sources)
    v = v.groupBy(*g, "vote").agg(F.max("posterior").alias("posterior"))
    each = claims(blocks).groupBy(*g, "vote").agg(F.min("value").alias("value"))
    best = each.join(v, [*g, "vote"], "left").groupBy(*g).agg(F.min_by(F.struct("value", "posterior"), F.struct(-F.coalesce("posterior", F.lit(0.0)), F.col("value"))).alias("b"))
    cols = [F.max(F.when(F.col("field_name") == f, F.col("b.value"))).alias(f) for f in FIELDS]
    out = best.groupBy("block_id", "group_uuid").agg(*cols, F.round(F.avg(F.coalesce("b.posterior", F.lit(0.0))), 6).alias("confidence"))
    return out.select("group_uuid", *[F.col(f).try_cast("bigint").alias(f) if f in NUMBERS else F.col(f) for f in FIELDS], "confidence")


def source_accuracy(blocks: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``(source, accuracy, copies_from, dependence)``: each source's estimated accuracy and its likeliest model, if any is likelier than not."""
    _, accuracy, copies = votes(blocks, Cut(blocks.sparkSession, "fusion"), sources)
    likeliest = copies.groupBy("source").agg(F.max(F.struct("dependence", "other")).alias("m"))
    out = accuracy.join(likeliest, "source", "left")
    return out.select("source", F.round("accuracy", 6).alias("accuracy"), F.when(F.col("m.dependence") > 0.5, F.col("m.other")).alias("copies_from"), F.round(F.coalesce("m.dependence", F.lit(0.0)), 6).alias("dependence"))
