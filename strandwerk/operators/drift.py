"""Schemas that drift between files: what each file's fields are, each change, and one consistent table.

The files are JSON lines without footers, so the catalogue of field lifespans is an aggregate of the lines (feed, file,
field) with the counts of each JSON type.  Islands in the feed's order of files give starts, endings and changes of
type; a rename is an ending and a start in the same
file that hold the same values for the same record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwerk.functions.let import let
from strandwerk.operators.joins import lookup
from strandwerk.session import Cut

#: JSON types in the order that breaks a tie between equally frequent ones.
TYPES = ("string", "integer", "number", "boolean", "object", "array")
#: Texts that stand for an absent value.
FILLERS = ("", "n/a", "na", "unknown", "null", "none", "-", "--", "?", "tbd", "undisclosed", "not disclosed")
#: A start is the new name of an ending if at least this share of the records they share hold the same value.
SAME_SHARE = 0.6
#: Names seen for the fields of one consistent table are schema metadata; more than so many are refused.
MAX_NAMES = 20_000

COMPANY_FIELDS = {
    "name": "string", "description": "string", "cik": "string", "ticker": "string", "website_url": "string", "headquarters_location": "string",
    "jurisdiction": "string", "revenue_usd": "bigint", "employees": "bigint", "founded_year": "bigint", "ceo": "string", "linkedin_url": "string", "is_public": "boolean",
}
RELATIONSHIP_FIELDS = {
    "src": "string", "dst": "string", "type": "string", "description": "string", "developer": "string", "percentage": "double", "amount": "double",
    "currency": "string", "country": "string", "date": "string", "quarter": "string", "contract_duration_years": "bigint", "is_material": "boolean",
}


def valid_lines(raw: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``(feed, file_no, line, v)``: the lines whose payload is one JSON object, as VARIANT, ``line`` a hash of its text; other lines don't count.

    ``files(feed, file_no)``: only the lines of these are parsed.
    """
    if files is not None:
        named = files.select(F.col("feed").alias("feed_name"), "file_no")
        raw = raw.join(lookup(named), ["feed_name", "file_no"], "left_semi")
    v = F.try_parse_json(F.when(F.col("payload").rlike(r"(?s)^\s*\{.*\}\s*$"), F.col("payload")))
    return raw.select(F.col("feed_name").alias("feed"), "file_no", F.xxhash64("payload").alias("line"), v.alias("v")).where("v IS NOT NULL AND feed IS NOT NULL AND file_no IS NOT NULL")


def _fields(lines: DataFrame) -> DataFrame:
    """One row for each line and top-level field, with the field's value as VARIANT."""
    lines.createOrReplaceTempView(name := f"drift_lines_{abs(hash(lines.semanticHash()))}")
    out = lines.sparkSession.sql(f"SELECT t.feed, t.file_no, t.line, try_variant_get(t.v, '$.uuid', 'string') AS record, e.key AS field, e.value AS value FROM {name} t, LATERAL variant_explode(t.v) e WHERE e.key <> 'uuid'")
    lines.sparkSession.catalog.dropTempView(name)
    return out


def json_type(v: Column) -> Column:
    """The JSON type of a VARIANT; NULL for JSON null.

    A VARIANT keeps 9.0 as the decimal 9, an integer of up to 18 digits as BIGINT; a whole decimal of fewer than 19
    digits was therefore written with a point.
    """
    kind = lambda s: (
        F.when(s == "STRING", "string").when(s == "BIGINT", "integer").when(s.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "integer").when(s.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(s == "BOOLEAN", "boolean").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array")
    )
    return let(F.schema_of_variant(v), kind)


def plain_value(v: Column) -> Column:
    """The scalar a VARIANT holds, whatever its notation: the element of a list, ``value`` or ``id`` of an object,
    numbers without separators, currency code and needless decimals, yes/no/true/false as 1/0; NULL for a filler."""
    inner = F.coalesce(F.try_variant_get(v, "$[0]", "string"), F.try_variant_get(v, "$.value", "string"), F.try_variant_get(v, "$.id", "string"), F.try_variant_get(v, "$", "string"))
    number = lambda s: F.regexp_replace(F.regexp_replace(s, r"\s*[a-z]{3}$", ""), ",", "")
    short = lambda n: F.regexp_replace(F.format_number(n.try_cast("double"), 4).cast("string"), r",|\.?0+$", "")
    known = lambda x: F.when(x.isin("true", "yes"), "1").when(x.isin("false", "no"), "0").when(~x.isin(*FILLERS), x)
    one = lambda s: let(number(s), lambda n: let(F.when(n.rlike(r"^-?\d+(\.\d+)?(e[+-]?\d+)?$"), short(n)).otherwise(s), known))
    return let(F.lower(F.trim(inner)), one)


def field_catalog(raw: DataFrame) -> DataFrame:
    """``(feed, file_no, field, lines, filled, json_type)``: each field of each file, with its most frequent type.

    ``json_type`` is NULL where all values are null.  A feed that holds most lines is no burden: the lines are
    counted on the map side, and only (feed, file, field) rows are shuffled.
    """
    f = _fields(valid_lines(raw)).select("feed", "file_no", "field", json_type(F.col("value")).alias("t"))
    counts = [F.count_if(F.col("t") == t).alias(f"n_{t}") for t in TYPES]
    c = f.groupBy("feed", "file_no", "field").agg(F.count("*").alias("lines"), F.count("t").alias("filled"), *counts)
    most = F.greatest(*[F.col(f"n_{t}") for t in TYPES])
    kind = F.coalesce(*[F.when((most > 0) & (F.col(f"n_{t}") == most), F.lit(t)) for t in TYPES])
    return c.select("feed", "file_no", "field", "lines", "filled", kind.alias("json_type"))


def type_profile(raw: DataFrame) -> DataFrame:
    """``(field, json_type, lines, most)``: how many valid lines give a field each type, nulls aside, and the most common type (ties by name)."""
    f = _fields(valid_lines(raw)).select("field", json_type(F.col("value")).alias("json_type")).where("json_type IS NOT NULL")
    n = f.groupBy("field", "json_type").agg(F.count("*").alias("lines"))
    top = n.groupBy("field").agg(F.min_by("json_type", F.struct(-F.col("lines"), "json_type")).alias("top"))
    return n.join(top, "field").select("field", "json_type", "lines", (F.col("json_type") == F.col("top")).alias("most"))


def file_order(raw: DataFrame) -> DataFrame:
    """``(feed, file_no, pos, prev_file, next_file)``: the files of each feed in order."""
    w = Window.partitionBy("feed").orderBy("file_no")
    files = raw.select(F.col("feed_name").alias("feed"), "file_no").where("feed IS NOT NULL AND file_no IS NOT NULL").distinct()
    return files.select("feed", "file_no", F.row_number().over(w).alias("pos"), F.lag("file_no").over(w).alias("prev_file"), F.lead("file_no").over(w).alias("next_file"))


def islands(raw: DataFrame) -> DataFrame:
    """``(feed, field, json_type, p0, p1, first_file, last_file, prev_file, next_file, files)``: each unbroken stretch of
    files, from position ``p0`` to ``p1``, in which a feed's field has one type; ``prev_file`` and ``next_file`` are the feed's files around it."""
    spans = field_catalog(raw).join(file_order(raw), ["feed", "file_no"])
    w = Window.partitionBy("feed", "field").orderBy("pos")
    broken = (F.col("pos") - F.lag("pos").over(w) != 1) | ~F.col("json_type").eqNullSafe(F.lag("json_type").over(w))
    spans = spans.withColumn("island", F.sum(F.coalesce(broken, F.lit(True)).cast("int")).over(w))
    return spans.groupBy("feed", "field", "island").agg(
        F.min("json_type").alias("json_type"), F.min("pos").alias("p0"), F.max("pos").alias("p1"), F.min("file_no").alias("first_file"), F.max("file_no").alias("last_file"),
        F.min_by("prev_file", "pos").alias("prev_file"), F.max_by("next_file", "pos").alias("next_file"), F.count("*").alias("files"),
    ).drop("island")


def lifespans(raw: DataFrame) -> DataFrame:
    """``(feed, field, json_type, first_file, last_file, files)``: the ``islands`` by their files."""
    return islands(raw).select("feed", "field", "json_type", "first_file", "last_file", "files")


def field_changes(raw: DataFrame) -> DataFrame:
    """``(feed_name, file_no, change, field_before, field_after)``: each change of a top-level field against the feed's preceding file.

    ``change`` is added, removed, renamed or type_changed, as the data description defines them.  A feed's first file
    changes nothing.  Lines that are no JSON object are ignored, repeated lines count as they are; a file without
    any valid line has no fields.  An empty table gives an empty report.
    """
    cut = Cut(raw.sparkSession, "drift")
    spans = cut.write(islands(raw))
    w = Window.partitionBy("feed", "field").orderBy("p0")
    spans = spans.select("*", F.lag("p1").over(w).alias("p"), F.lead("p0").over(w).alias("n"), F.lag("json_type").over(w).alias("type_before"))
    starts = spans.where("p0 > 1 AND (p IS NULL OR p0 - p > 1)").select("feed", F.col("first_file").alias("file_no"), "prev_file", F.lit("added").alias("change"), "field", "json_type")
    endings = spans.where("next_file IS NOT NULL AND (n IS NULL OR n - p1 > 1)").select("feed", F.col("next_file").alias("file_no"), F.col("last_file").alias("prev_file"), F.lit("removed").alias("change"), "field", "json_type")
    retyped = spans.where("p0 - p = 1 AND json_type <> type_before").select("feed", F.col("first_file").alias("file_no"), F.col("field").alias("before"), F.col("field").alias("after"))
    edges = cut.write(starts.unionByName(endings))
    both = edges.groupBy("feed", "file_no", "prev_file").agg(F.count_if(F.col("change") == "added").alias("a"), F.count_if(F.col("change") == "removed").alias("r")).where("a > 0 AND r > 0").select("feed", "file_no", "prev_file")
    # the values of the fields that come or go in a file where some come and some go
    sides = both.select("feed", F.col("file_no").alias("at"), F.explode(F.array(F.struct(F.col("file_no").alias("file_no"), F.lit("added").alias("change")), F.struct(F.col("prev_file").alias("file_no"), F.lit("removed").alias("change")))).alias("s")).select("feed", "at", "s.file_no", "s.change")
    wanted = cut.write(sides.join(edges.select("feed", F.col("file_no").alias("at"), "change", "field"), ["feed", "at", "change"]))
    # only the values of those fields are read as scalars
    lines = valid_lines(raw, wanted.select("feed", "file_no").distinct())
    hashed = let(plain_value(F.col("value")), lambda x: F.when(x.isNotNull(), F.xxhash64(x)))
    values = _fields(lines).join(lookup(wanted), ["feed", "file_no", "field"]).select("feed", "at", "change", "field", "record", hashed.alias("x")).distinct()
    # NULLs are dropped behind the written table: a filter in front of it would move below the join and read all fields
    stored = cut.write(values)
    values = stored.where("record IS NOT NULL AND x IS NOT NULL")
    old = values.where("change = 'removed'").select("feed", "at", "record", F.col("field").alias("before"), F.col("x").alias("x0"))
    new = values.where("change = 'added'").select("feed", "at", "record", F.col("field").alias("after"), F.col("x").alias("x1"))
    pairs = old.join(new, ["feed", "at", "record"]).groupBy("feed", "at", "before", "after").agg(F.count_if(F.expr("x0 = x1")).alias("same"), F.count("*").alias("shared"))
    pairs = pairs.where((F.col("same") >= SAME_SHARE * F.col("shared")) & (F.col("same") > 0))
    rank = lambda own, other: F.row_number().over(Window.partitionBy("feed", "at", own).orderBy(F.desc(F.col("same") / F.col("shared")), F.desc("same"), other))
    renames = pairs.select("*", rank("before", "after").alias("i"), rank("after", "before").alias("j")).where("i = 1 AND j = 1").select("feed", F.col("at").alias("file_no"), "before", "after")
    renames = cut.write(renames)
    cut.free(wanted, stored)
    gone = renames.select("feed", "file_no", F.explode(F.array(F.struct(F.lit("removed").alias("change"), F.col("before").alias("field")), F.struct(F.lit("added").alias("change"), F.col("after").alias("field")))).alias("g")).select("feed", "file_no", "g.*")
    plain = edges.join(gone, ["feed", "file_no", "change", "field"], "left_anti")
    types = edges.select("feed", "file_no", "change", "field", "json_type")
    twice = (
        renames.join(types.where("change = 'removed'").select("feed", "file_no", F.col("field").alias("before"), F.col("json_type").alias("t0")), ["feed", "file_no", "before"])
        .join(types.where("change = 'added'").select("feed", "file_no", F.col("field").alias("after"), F.col("json_type").alias("t1")), ["feed", "file_no", "after"])
        .where("t0 <> t1")
    )
    row = lambda df, change, before, after: df.select(F.col("feed").alias("feed_name"), "file_no", change.alias("change"), before.alias("field_before"), after.alias("field_after"))
    b, a = F.col("before"), F.col("after")
    return (
        row(plain, F.col("change"), F.when(F.col("change") == "added", "").otherwise(F.col("field")), F.when(F.col("change") == "removed", "").otherwise(F.col("field")))
        .unionByName(row(renames, F.lit("renamed"), b, a)).unionByName(row(retyped, F.lit("type_changed"), b, a)).unionByName(row(twice, F.lit("type_changed"), b, a))
    )


def _renames(changes: DataFrame) -> dict[str, set[str]]:
    """For each renamed name, the names one rename away."""
    pairs = changes.where("change = 'renamed'").select("field_before", "field_after").distinct().limit(MAX_NAMES + 1).collect()
    if len(pairs) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} renames of different names")
    near: dict[str, set[str]] = {}
    for before, after in pairs:
        near.setdefault(before, set()).add(after)
        near.setdefault(after, set()).add(before)
    return near


def _owners(near: dict[str, set[str]], fields) -> dict[str, str]:
    """The field that each name belongs to: the one that the fewest renames lead to."""
    owner, front = {f: f for f in fields}, sorted(fields)
    while front:
        reached = {}
        for x in front:
            for y in sorted(near.get(x, ())):
                if y not in owner:
                    reached.setdefault(y, owner[x])
        owner |= reached
        front = sorted(reached)
    return owner


def alias_table(changes: DataFrame, fields: dict[str, str]) -> dict[str, list[str]]:
    """For each field of the consistent table, the names that renames lead to from it or to it, however many steps away."""
    owner = _owners(_renames(changes), fields)
    return {f: sorted((n for n, o in owner.items() if o == f), key=lambda n: (n != f, n)) for f in fields}


def _several(v: Column) -> Column:
    """The VARIANT is a list of more than one element."""
    return F.try_variant_get(v, "$[1]", "variant").isNotNull()


def other_fields(lines: DataFrame, near: dict[str, set[str]], known: set[str]) -> dict[str, tuple[str, list[str]]]:
    """``{name: (type, names)}``: each class of renamed names seen besides the known ones, by its most frequent name.

    The type is that of the most frequent JSON type if all its values have it, else string.
    """
    v = F.col("value")
    f = _fields(lines).where(~F.col("field").isin(*known)).select("field", json_type(v).alias("t"), F.when(_several(v), F.to_json(v)).otherwise(plain_value(v)).alias("x"))
    fits = {"bigint": F.col("x").try_cast("bigint").isNotNull(), "double": F.col("x").try_cast("double").isNotNull(), "boolean": F.col("x").isin("0", "1")}
    counts = [F.count_if(F.col("t") == t).alias(f"n_{t}") for t in TYPES] + [F.count_if(e).alias(k) for k, e in fits.items()]
    seen = f.groupBy("field").agg(F.count("*").alias("lines"), F.count("x").alias("values"), *counts).limit(MAX_NAMES + 1).collect()
    if len(seen) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} different names")
    left, out = {r.field: r for r in seen}, {}
    for name in sorted(left, key=lambda n: (-left[n].lines, n)):
        if name in left:
            names = [name, *sorted(n for n in _owners(near, [name]) if n in left and n != name)]
            rows = [left.pop(n) for n in names]
            total = {k: sum(r[k] for r in rows) for k in ("values", *fits, *(f"n_{t}" for t in TYPES))}
            kind = {"integer": "bigint", "number": "double", "boolean": "boolean"}.get(max(TYPES, key=lambda t: total[f"n_{t}"]), "string")
            out[name] = (kind if kind == "string" or total[kind] == total["values"] else "string", names)
    return out


def consistent_table(raw: DataFrame, entity: str, fields: dict[str, str] | None = None, changes: DataFrame | None = None) -> DataFrame:
    """All valid lines of an entity in one table, whatever name and type each file gave the fields.

    ``fields`` (name: type) come first, with values that can't be cast as NULL; every other field that a line has
    follows by name, those that renames connect as one, as text if its values have no common type.  A name that
    equals another column's but for case gets a number.  The casts are generated from the alias table of the
    detected renames; lines delivered twice come out once.  Columns: feed_name, file_no, uuid, then the fields.
    """
    fields = fields or (COMPANY_FIELDS if entity == "companies" else RELATIONSHIP_FIELDS)
    raw = raw.where(F.col("entity") == entity)
    changes = changes if changes is not None else field_changes(raw)
    names, near = alias_table(changes, fields), _renames(changes)
    others = other_fields(valid_lines(raw), near, {n for ns in names.values() for n in ns})
    taken, column = {x.lower() for x in ("feed_name", "file_no", "uuid", *fields)}, {}
    for n in sorted(others):
        column[n] = next(x for x in (n, *(f"{n}_{i}" for i in range(2, MAX_NAMES))) if x.lower() not in taken)
        taken.add(column[n].lower())
    names |= {n: ns for n, (_, ns) in others.items()}
    v = F.col("value")
    key = F.create_map(*[F.lit(x) for f, ns in names.items() for i, n in enumerate(ns) for x in (n, F.struct(F.lit(f).alias("f"), F.lit(i).alias("i")))])
    text = F.trim(F.coalesce(F.try_variant_get(v, "$[0]", "string"), F.try_variant_get(v, "$.value", "string"), F.try_variant_get(v, "$.id", "string"), F.try_variant_get(v, "$", "string")))
    f = _fields(valid_lines(raw)).select("feed", "file_no", "line", "record", key[F.col("field")].alias("k"), plain_value(v).alias("x"), text.alias("text"), F.when(_several(v), F.to_json(v)).alias("list"))
    f = f.select("*", "k.f", "k.i")
    # of two names of one field in a line, the first in the alias table that has a value
    best = lambda n, c, has="x": F.min_by(c, F.when((F.col("f") == n) & F.col(has).isNotNull(), F.col("i")))
    cols = [best(n, F.col("text")).alias(n) if kind == "string" else best(n, F.col("x")).alias(n) for n, kind in fields.items()]
    f = f.withColumn("any", F.coalesce("list", "x"))
    cols += [best(n, F.struct(F.coalesce("list", "text").alias("text"), "x"), "any").alias(column[n]) for n in column]
    out = f.groupBy("feed", "file_no", "line").agg(F.first("record").alias("uuid"), *cols)
    q = lambda n: F.col(f"`{n.replace('`', '``')}`")
    typed = [F.col(n).try_cast("double").try_cast(kind).alias(n) if kind in ("bigint", "double") else F.col(n).try_cast(kind).alias(n) for n, kind in fields.items()]
    for n, c in column.items():
        kind = others[n][0]
        own, x = q(c)["text"], q(c)["x"]
        typed.append((own if kind == "string" else F.coalesce(own.try_cast(kind), x.try_cast(kind))).alias(c))
    return out.select(F.col("feed").alias("feed_name"), "file_no", "uuid", *typed)
