"""Identifiers: uuids in one notation, hashed ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid_hex(c: Column) -> Column:
    """The 32 lower-case hex digits of a uuid in any notation (braces, blanks, upper case, no hyphens, urn prefix); else NULL.

    The nil uuid (all zeros) is a filler and gives NULL too.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), r"[{}\s-]", ""), "^urn:uuid:", "")
    return F.when(plain.rlike("^[0-9a-f]{32}$") & (plain != "0" * 32), plain)


def hyphens(h: Column) -> Column:
    """A uuid of 32 hex digits in the usual 8-4-4-4-12 form."""
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def clean_uuid(c: Column) -> Column:
    """A uuid in lower case with hyphens, or NULL where the text names no record."""
    h = uuid_hex(c)
    return F.when(h.isNotNull(), hyphens(h))


def hashed_id(*parts: Column) -> Column:
    """A deterministic id of the parts: md5 of their texts joined by '|' (NULL counts as the empty text)."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
