"""Consolidating pairwise matches into groups.

The component of the highest-degree vertex (the giant, if there is one) is peeled by
frontier breadth-first joins and anti-joined away; what remains is labelled by minimum
propagation in star form, where every round joins each vertex to the least vertex it
knows of, so that chains shrink geometrically.  Components that are stars already take part in no further round, and
the rounds end when all are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwerk.functions.ids import hyphens, uuid_hex
from strandwerk.session import Cut

#: A frontier of up to so many ids is broadcast (16 bytes each); a larger one is joined by shuffle.
BROADCAST_IDS = 200_000
#: Rounds of breadth-first search for the giant; a component not finished by then stays whole and is labelled by propagation.
PEEL_ROUNDS = 16
#: Rounds of minimum propagation after which finished components are set aside.
CHECK = 2


def _peel(edges: DataFrame, cut: Cut, ids: int = BROADCAST_IDS) -> tuple[DataFrame, int] | None:
    """The vertices of the component of the highest-degree vertex, or None if it isn't closed within PEEL_ROUNDS."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    top = both.groupBy("u").count().orderBy(F.desc("count"), "u").limit(1).select("u")
    frontier = cut.write(top.select(F.col("u").alias("x")))
    # what was reached is the union of the frontiers' tables; none is written again
    seen, total, size = frontier, 1, 1
    for _ in range(PEEL_ROUNDS):
        small = F.broadcast(frontier) if size <= ids else frontier
        reached = both.join(small, both.u == frontier.x, "left_semi").select(F.col("v").alias("x")).distinct()
        known = F.broadcast(seen) if total <= ids else seen
        frontier = cut.write(reached.join(known, "x", "left_anti"))
        size = frontier.count()
        if not size:
            return seen, total
        total += size
        seen = seen.unionByName(frontier)
    return None


def _live(e: DataFrame, cut: Cut, ids: int = BROADCAST_IDS) -> tuple[DataFrame, DataFrame] | None:
    """The edges of components that are no stars yet, and those of finished ones; None if all are finished.

    A star is finished if its root has no smaller neighbour and each leaf no other neighbour.
    """
    roles = e.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    roles = roles.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    loose = cut.write(roles.where("up > 1 OR (up > 0 AND down > 0)").select("x"))
    n = loose.count()
    if not n:
        cut.free(loose)
        return None
    x = F.broadcast(loose) if n <= ids else loose
    roots = e.join(x, e.a == loose.x, "left_semi").select("b").unionByName(e.join(x, e.b == loose.x, "left_semi").select("b")).distinct()
    roots = cut.write(roots)
    r = F.broadcast(roots) if roots.count() <= ids else roots
    live, finished = cut.write(e.join(r, "b", "left_semi")), cut.write(e.join(r, "b", "left_anti"))
    cut.free(loose, roots)
    return live, finished


def components(edges: DataFrame, cut: Cut | None = None, ids: int = BROADCAST_IDS) -> DataFrame:
    """``edges(a, b)`` of any orderable type to ``(x, root)``: every vertex of an edge between two different
    vertices, with the least vertex of its component.

    Self-loops, NULL ends and repeated edges add nothing; an empty table gives an empty table.  ``ids``: as BROADCAST_IDS,
    for a driver that has other tables to hold.
    """
    cut = cut or Cut(edges.sparkSession, "components")
    # every edge points from the larger to the smaller end
    e = cut.write(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("x"), F.col("b").alias("root"))
    giant = None
    if peeled := _peel(e, cut, ids):
        seen, total = peeled
        giant = cut.write(seen.withColumn("root", F.lit(seen.agg(F.min("x")).first()[0])))
        known = F.broadcast(seen) if total <= ids else seen
        rest = cut.write(e.join(known, e.a == seen.x, "left_anti"))
        cut.free(e, seen)
        e = rest
    done, rounds = [], 0
    while not e.isEmpty():
        if rounds and not rounds % CHECK:
            parts = _live(e, cut, ids)
            if parts is None:
                done.append(e)
                break
            cut.free(e)
            e = parts[0]
            done.append(parts[1])
        rounds += 1
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: larger neighbours move to the least vertex of the neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut.write(large)
        # small star: smaller neighbours, and the vertex itself, move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("s"))
        new = cut.write(small.select("s.a", "s.b").where("a <> b").distinct())
        cut.free(e, large)
        e = new
    out = e.limit(0)
    for part in done:
        out = out.unionByName(part)
    out = out.select(F.col("a").alias("x"), F.col("b").alias("root"))
    out = out.unionByName(out.select(F.col("root").alias("x"), "root").distinct())
    return out.unionByName(giant.select("x", "root")) if giant is not None else out


def consolidate(df: DataFrame, id_col: str = "uuid", links_col: str = "source_uuids") -> DataFrame:
    """Records that name each other to ``(uuid, group_uuid)``: one row for each record named in either column.

    A uuid counts in any notation (upper case, braces, blanks, no hyphens); entries that are no uuid (NULL, '',
    'unknown') name no record and link nothing.  NULL and empty lists leave the row's own record alone in its
    group; repeated rows and entries add nothing.  ``group_uuid`` is the least uuid of the group.
    """
    own = F.unhex(uuid_hex(F.col(f"`{id_col}`")))
    pairs = df.select(own.alias("a"), F.explode_outer(F.col(f"`{links_col}`")).alias("l")).select("a", F.unhex(uuid_hex(F.col("l"))).alias("b")).distinct()
    cut = Cut(df.sparkSession, "consolidate")
    pairs = cut.write(pairs)
    found = components(pairs, cut)
    named = pairs.select(F.explode(F.array("a", "b")).alias("x")).where("x IS NOT NULL").distinct()
    text = lambda c: hyphens(F.lower(F.hex(c)))
    return named.join(found, "x", "left").select(text("x").alias("uuid"), text(F.coalesce("root", "x")).alias("group_uuid"))
