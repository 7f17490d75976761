"""Evaluation of matching: what came out, what it covers, how much was saved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwerk.functions.ids import clean_uuid


def flatten_matches(blocks: DataFrame) -> DataFrame:
    """``(block_id, iteration, uuid, name, source_uuids, match_skip, match_skip_reason)``: the resolved entries, one row each."""
    return blocks.select("block_id", "iteration", F.explode("resolved_companies").alias("r")).where("r.uuid IS NOT NULL").select("block_id", "iteration", "r.uuid", "r.name", "r.source_uuids", "r.match_skip", "r.match_skip_reason")


def metrics(blocks: DataFrame) -> DataFrame:
    """One row a round: blocks, errors, entries in and out, skipped, lineage covered, reduction, references, overlap; shares are NULL where nothing was.

    ``refs`` are the different (entry, listed source) pairs; valid ones name an input of this or an earlier round or
    an output of an earlier one.  ``overlap`` counts the entries not skipped that have the uuid of an input.
    """
    b = blocks.groupBy("iteration").agg(
        F.count("*").alias("blocks"), F.count("error").alias("errors"), F.sum(F.greatest(F.coalesce(F.size("original_companies.uuid"), F.lit(0)), F.lit(0))).cast("bigint").alias("originals"),
        F.sum(F.greatest(F.coalesce(F.size("resolved_companies.uuid"), F.lit(0)), F.lit(0))).cast("bigint").alias("resolved"), F.count_if(F.coalesce("was_resolved", F.lit(False))).alias("resolved_blocks"),
    )
    m = flatten_matches(blocks)
    skipped = m.groupBy("iteration").agg(F.count_if(F.coalesce("match_skip", F.lit(False))).alias("skipped"), F.count_distinct("uuid").alias("entities"))
    listed = m.select("iteration", F.explode("source_uuids").alias("s")).select("iteration", clean_uuid(F.col("s")).alias("u")).where("u IS NOT NULL").distinct()
    own = blocks.select("iteration", F.explode("original_companies.uuid").alias("s")).select("iteration", clean_uuid(F.col("s")).alias("u")).where("u IS NOT NULL").distinct()
    covered = own.join(listed, ["iteration", "u"], "left_semi").groupBy("iteration").agg(F.count("*").alias("covered"))
    total = own.groupBy("iteration").agg(F.count("*").alias("inputs"))
    uuids = lambda df: df.select("iteration", clean_uuid(F.col("uuid")).alias("u")).where("u IS NOT NULL").distinct()
    known = own.unionByName(uuids(m).withColumn("iteration", F.col("iteration") + 1)).groupBy("u").agg(F.min("iteration").alias("since"))
    refs = m.select("iteration", "uuid", F.explode("source_uuids").alias("s")).where("s IS NOT NULL").distinct().select("iteration", clean_uuid(F.col("s")).alias("u"))
    refs = refs.join(known, "u", "left").groupBy("iteration").agg(F.count("*").alias("refs"), F.count_if(F.col("since") <= F.col("iteration")).alias("valid_refs"))
    made = uuids(m.where(~F.coalesce("match_skip", F.lit(False))))
    overlapping = made.join(own.withColumn("known", F.lit(True)), ["iteration", "u"], "left").groupBy("iteration").agg(F.count("*").alias("made"), F.count("known").alias("overlap"))
    r = b.join(skipped, "iteration", "left").join(total, "iteration", "left").join(covered, "iteration", "left").join(refs, "iteration", "left").join(overlapping, "iteration", "left")
    r = r.na.fill(0, ["skipped", "entities", "inputs", "covered", "refs", "valid_refs", "made", "overlap"]).withColumn("invalid_refs", F.col("refs") - F.col("valid_refs"))
    share = lambda a, n: F.round(F.try_divide(F.lit(100.0) * F.col(a), F.col(n)), 6)
    r = r.withColumns({"invalid_pct": share("invalid_refs", "refs"), "overlap_pct": share("overlap", "made")})
    return r.withColumns({"coverage_pct": share("covered", "inputs"), "error_pct": share("errors", "blocks"), "reduction_pct": F.round(100 - F.try_divide(F.lit(100.0) * F.col("resolved"), F.col("originals")), 6)})


def passed(m: DataFrame, coverage: float = 99.99, errors: float = 0.01, overlap: float = 1.0) -> DataFrame:
    """``(iteration, passed)`` of a metrics table: inputs covered, references valid, uuids new."""
    low = lambda c, most: F.coalesce(F.col(c) < most, F.lit(True))
    return m.select("iteration", (F.coalesce(F.col("coverage_pct") >= coverage, F.lit(False)) & low("invalid_pct", errors) & low("overlap_pct", overlap)).alias("passed"))


def skip_reasons(blocks: DataFrame) -> DataFrame:
    """``(match_skip, reason, entries)`` histogram; NULL flags count as not skipped."""
    return flatten_matches(blocks).groupBy(F.coalesce("match_skip", F.lit(False)).alias("match_skip"), F.coalesce("match_skip_reason", F.lit("")).alias("reason")).agg(F.count("*").alias("entries"))


def lineage_sizes(resolved: DataFrame) -> DataFrame:
    """``(sources, entries)``: how many entries list how many records."""
    n = F.greatest(F.coalesce(F.size("source_uuids"), F.lit(0)), F.lit(0)).cast("bigint")
    return resolved.groupBy(n.alias("sources")).agg(F.count("*").alias("entries"))


def overlap(a: DataFrame, b: DataFrame, col: str = "uuid") -> DataFrame:
    """One row: distinct values in either table and in both."""
    x, y = a.select(col).where(f"{col} IS NOT NULL").distinct(), b.select(col).where(f"{col} IS NOT NULL").distinct()
    both = x.join(y, col, "left_semi").agg(F.count("*")).scalar()
    return x.agg(F.count("*").alias("left")).select("left", y.agg(F.count("*")).scalar().alias("right"), both.alias("both"))


def reduction_by_round(sizes: DataFrame) -> DataFrame:
    """``(iteration, rows, reduction_pct, overall_pct)`` from ``sizes(iteration, rows)``: against the round before and the first."""
    before = sizes.select((F.col("iteration") + 1).alias("iteration"), F.col("rows").alias("_b"))
    pct = lambda a: F.round(100 - F.try_divide(F.lit(100.0) * F.col("rows"), F.col(a)), 6)
    with_first = sizes.join(before, "iteration", "left").withColumn("_f", sizes.agg(F.min_by("rows", "iteration")).scalar())
    return with_first.select("iteration", "rows", pct("_b").alias("reduction_pct"), pct("_f").alias("overall_pct"))


def known_uuids(inputs: DataFrame, rounds: DataFrame) -> DataFrame:
    """``(u, since)``: every uuid of the original records (``since`` 0) and of all rounds' outputs, with the first round it came out of."""
    first = lambda df, r: df.select(clean_uuid(F.col("uuid")).alias("u"), r.alias("since")).where("u IS NOT NULL")
    return first(inputs, F.lit(0).cast("bigint")).unionByName(first(rounds, F.col("iteration").cast("bigint"))).groupBy("u").agg(F.min("since").alias("since"))


def round_metrics(inputs: DataFrame, blocks: DataFrame, rounds: DataFrame) -> DataFrame:
    """The 23 metrics of each round, one row a round, from original records ``(uuid)``, ``blocks(iteration)`` and
    ``rounds(iteration, uuid, source_uuids, match_skip, match_skip_reason)``, the entries that came out.

    Entries skipped by matching count as rows, the others by their different uuids.  A listed uuid is valid if it is
    an original record's or came out of an earlier round; entries that name no record are invalid.  Shares are 0
    where nothing was, as the first round's are for a second one without rows.
    """
    n = lambda df, **cols: df.groupBy("iteration").agg(*[c.alias(k) for k, c in cols.items()])
    skip = F.coalesce("match_skip", F.lit(False))
    all_in = inputs.select(clean_uuid(F.col("uuid")).alias("u"))
    first = all_in.where("u IS NOT NULL").distinct()
    total, unique = inputs.agg(F.count("*")).scalar(), first.agg(F.count("*")).scalar()
    r = rounds.withColumn("u", clean_uuid(F.col("uuid")))
    rows = n(r, rows=F.count("*"), skipped_records=F.count_if(skip), ids_dropped_by_matching=F.count_if(F.coalesce(F.col("match_skip_reason") == "missing_in_match_output", F.lit(False))))
    made = r.where(~skip).where("u IS NOT NULL").select("iteration", "u").distinct()
    again = n(made.join(first, "u", "left_semi"), uuid_overlap_with_original_count=F.count("*"))
    refs = r.select("iteration", F.explode("source_uuids").alias("s")).select("iteration", clean_uuid(F.col("s")).alias("u"))
    # each uuid of a round is looked up once, however often it is listed
    counted = refs.groupBy("iteration", "u").agg(F.count("*").alias("k")).join(known_uuids(inputs, rounds), "u", "left")
    valid = F.coalesce(F.col("since") < F.col("iteration"), F.lit(False))
    listed = n(counted, total_source_uuid_refs=F.sum("k"), unique_source_uuids=F.count("u"), valid_source_uuid_count=F.coalesce(F.sum(F.when(valid, F.col("k"))), F.lit(0)), tracked_original_uuids=F.count_if(F.col("since") == 0))
    m = rows.join(n(blocks, total_blocks=F.count("*")), "iteration", "left").join(n(made, unique_matched=F.count("*")), "iteration", "left").join(again, "iteration", "left").join(listed, "iteration", "left")
    before = rows.select((F.col("iteration") + 1).alias("iteration"), F.col("rows").alias("_b"))
    m = m.join(before, "iteration", "left").na.fill(0)
    m = m.withColumns({"total_original_companies": total, "_unique": unique, "iteration_input_companies": F.when(F.col("iteration") > 1, F.col("_b")).otherwise(total)})
    m = m.withColumn("companies_that_went_into_matching", F.col("total_original_companies") - F.col("skipped_records"))
    m = m.withColumns({"reduction_from_matching": F.col("companies_that_went_into_matching") - F.col("unique_matched"), "total_output_companies": F.col("unique_matched") + F.col("skipped_records")})
    m = m.withColumns({"total_reduction": F.col("total_original_companies") - F.col("total_output_companies"), "invalid_source_uuid_count": F.col("total_source_uuid_refs") - F.col("valid_source_uuid_count")})
    pct = lambda a, b: F.round(F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b)).otherwise(F.lit(0.0)), 6)
    into = "companies_that_went_into_matching"
    return m.select(
        "iteration", "total_blocks", "iteration_input_companies", "total_original_companies", into, "skipped_records", "unique_matched", "reduction_from_matching", pct("reduction_from_matching", into).alias("reduction_from_matching_pct"),
        "ids_dropped_by_matching", pct("ids_dropped_by_matching", into).alias("ids_dropped_by_matching_pct"), "total_output_companies", "total_reduction", pct("total_reduction", "total_original_companies").alias("total_reduction_pct"),
        "uuid_overlap_with_original_count", pct("uuid_overlap_with_original_count", "unique_matched").alias("uuid_overlap_with_original_pct"), "unique_source_uuids", "tracked_original_uuids", pct("tracked_original_uuids", "_unique").alias("original_coverage_pct"),
        "total_source_uuid_refs", "valid_source_uuid_count", "invalid_source_uuid_count", pct("invalid_source_uuid_count", "total_source_uuid_refs").alias("source_uuid_error_pct"),
    )
