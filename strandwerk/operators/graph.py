"""Graph statistics and searches over edge tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwerk.session import Cut

#: Steps of a spreading search that are planned as one job.
STEPS = 4


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, in_degree, out_degree, degree)`` of directed edges (src, dst); isolated nodes have no row."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    d = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return d.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def degree_summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean and median degree."""
    d = degrees(edges)
    return d.agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("bigint").alias("edges"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.percentile("degree", 0.5).alias("median_degree"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: the weakly connected components by their least node, by hooking and pointer jumping.

    Each round a node takes the least label of its neighbourhood, then that label's label; rounds grow with the
    logarithm of the longest path.  Every round is written to the shared folder.
    """
    cut = Cut(edges.sparkSession, "wcc")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    both = cut.write(both)
    labels = cut.write(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("component")).withColumnRenamed("src", "node"))
    while True:
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("component").alias("m"))
        hook = labels.join(near, labels.node == near.src).select("node", F.col("component").alias("old"), F.least("component", "m").alias("m"))
        jump = hook.join(labels.select(F.col("node").alias("m"), F.col("component").alias("j")), "m", "left")
        new = cut.write(jump.select("node", F.least("m", F.coalesce("j", "m")).alias("component"), "old"))
        changed = new.where("component <> old").limit(1).count()
        cut.free(labels)
        labels = new.drop("old")
        if not changed:
            return labels


def component_sizes(labels: DataFrame) -> DataFrame:
    """``(size, components)``: the histogram of component sizes."""
    return labels.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components"))


def clustering(edges: DataFrame) -> DataFrame:
    """``(node, degree, triangles, coefficient)`` of the undirected graph; nodes of one neighbour have coefficient 0.

    Edges are directed from the lower to the higher degree, so that a hub starts few pairs; triangles are two equi-joins.
    """
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    d = e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    x = e.join(d.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = x.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("t"))
    wedge = o.join(o.select("s", F.col("t").alias("u")), "s").where("t < u")
    tri = wedge.join(e, (F.col("t") == e.a) & (F.col("u") == e.b), "left_semi")
    n = tri.select(F.explode(F.array("s", "t", "u")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    r = d.join(n, "node", "left").select("node", "degree", F.coalesce("triangles", F.lit(0)).cast("bigint").alias("triangles"))
    return r.withColumn("coefficient", F.round(F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(F.lit(0.0)), 6))


def directed_clustering(edges: DataFrame) -> DataFrame:
    """``(node, degree, mutual, triangles, coefficient)`` of the directed graph without self-loops.

    ``degree`` counts edges in and out, ``mutual`` the neighbours on both ways, ``triangles`` the directed triangles
    through the node, of up to eight on three nodes; the coefficient is triangles / (2 x (degree x (degree - 1) - 2 x
    mutual)), 0 where there can be none.  Triangles of the undirected graph are found as in ``clustering``, from the
    lower to the higher degree; each counts by the product of its three edges' directions.
    """
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    e = e.groupBy("a", "b").agg(F.count_distinct("up").alias("k"))
    d = e.select(F.explode(F.array("a", "b")).alias("node"), "k").groupBy("node").agg(F.sum("k").alias("degree"), F.count_if(F.col("k") == 2).alias("mutual"), F.count("*").alias("near"))
    n = d.select("node", "near")
    x = e.join(n.select(F.col("node").alias("a"), F.col("near").alias("da")), "a").join(n.select(F.col("node").alias("b"), F.col("near").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = x.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("t"), "k")
    wedge = o.join(o.select("s", F.col("t").alias("u"), F.col("k").alias("k2")), "s").where("t < u")
    tri = wedge.join(e.select(F.col("a").alias("t"), F.col("b").alias("u"), F.col("k").alias("k3")), ["t", "u"])
    n = tri.select(F.explode(F.array("s", "t", "u")).alias("node"), (F.col("k") * F.col("k2") * F.col("k3")).alias("w")).groupBy("node").agg(F.sum("w").alias("triangles"))
    r = d.join(n, "node", "left").select("node", "degree", "mutual", F.coalesce("triangles", F.lit(0)).cast("bigint").alias("triangles"))
    most = F.col("degree") * (F.col("degree") - 1) - 2 * F.col("mutual")
    return r.withColumn("coefficient", F.round(F.when(most > 0, F.col("triangles") / (2.0 * most)).otherwise(F.lit(0.0)), 6))


def summary(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, mean and median degree, components, the largest component's nodes, mean and median directed clustering."""
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    c = directed_clustering(e).agg(F.round(F.avg("coefficient"), 6).alias("mean_clustering"), F.round(F.percentile("coefficient", 0.5), 6).alias("median_clustering"))
    sizes = (components(e) if labels is None else labels).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))
    return degree_summary(e).join(F.broadcast(sizes), F.lit(True)).join(F.broadcast(c), F.lit(True))


def reachable(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``(node, depth)``: breadth-first from ``start(node)``, each node at its least depth, up to ``depth`` steps.

    Each frontier is one join; nodes seen are anti-joined away, so cycles end.
    """
    cut = Cut(edges.sparkSession, "bfs")
    frontier = cut.write(start.select("node").distinct())
    seen = frontier.select("node", F.lit(0).alias("depth"))
    e = edges.select(F.col("src").alias("node"), "dst").where("dst IS NOT NULL").distinct()
    for i in range(1, depth + 1):
        frontier = cut.write(e.join(frontier, "node", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("node", F.lit(i).alias("depth")))
    return seen


def strong_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(node, component)``: strongly connected components, by their greatest node, by colouring.

    Each pass spreads the greatest node forwards until nothing changes; the nodes that reach their colour's root
    backwards inside the colour are its component and leave the graph, until none is left.  For graphs of moderate depth: nodes left after ``rounds``
    passes, if that is given, raise an error.
    """
    cut = Cut(edges.sparkSession, "scc")
    e = cut.write(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    nodes = cut.write(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    done = None
    for i in count() if rounds is None else range(rounds):
        # nodes without an edge in or out are components of their own; without them their neighbours may be too
        n = e.count()
        while n:
            left = e
            for _ in range(STEPS):
                left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            old, e = e, cut.write(left.select("src", "dst"))
            cut.free(old)
            n, m = e.count(), n
            if n == m:
                break
        core = cut.write(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
        out = nodes.join(core, "node", "left_anti").select("node", F.col("node").alias("component"))
        done, nodes = out if done is None else done.unionByName(out), core
        if not n:
            break
        colour, colour_table = nodes.select("node", F.col("node").alias("c")), None
        while True:
            new = colour.select("node", "c", F.col("c").alias("old"))
            for _ in range(STEPS):
                come = e.join(new, e.src == new.node).groupBy("dst").agg(F.max("c").alias("m"))
                new = new.join(come, new.node == come.dst, "left").select("node", F.greatest("c", F.coalesce("m", "c")).alias("c"), "old")
            old, new = (None if colour_table is None else colour_table), cut.write(new)
            colour, colour_table = new.drop("old"), new
            if old is not None:
                cut.free(old)
            if new.where("c <> old").isEmpty():
                break
        # backwards from each root within its colour
        s, d = colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), colour.select(F.col("node").alias("dst"), F.col("c").alias("cd"))
        inside = cut.write(e.join(s, "src").join(d, "dst").where("cs = cd").select("src", "dst"))
        hit = front = cut.write(colour.where("node = c"))
        while not front.isEmpty():
            found = front
            for _ in range(STEPS):
                found = inside.join(found, inside.dst == found.node).select(F.col("src").alias("node"), "c").unionByName(found).distinct()
            was, front = (front, hit), cut.write(found.join(hit, "node", "left_anti"))
            hit = cut.write(hit.unionByName(front))
            cut.free(*was)
        out = hit.select("node", F.col("c").alias("component"))
        done = out if done is None else done.unionByName(out)
        if i % 32 == 31:
            done = cut.write(done)
        nodes = cut.write(nodes.join(hit, "node", "left_anti"))
        old, e = e, cut.write(e.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        cut.free(old, inside, colour_table)
    else:
        if not nodes.isEmpty():
            raise ValueError(f"nodes without a component after {rounds} passes")
    return done if done is not None else nodes.select("node", F.col("node").alias("component"))


# The edge kind of each list of a report, and the kind of its inverse edge (the same for a symmetric one).
REPORT_EDGES = {"partnerships": ("partnered_with", "partnered_with"), "investments": ("invests_in", "has_investor"), "suppliers": ("has_supplier", "supplies"), "subsidiaries": ("has_subsidiary", "subsidiary_of")}


def report_edges(reports: DataFrame) -> DataFrame:
    """``reports(id, partnerships[], investments[], suppliers[], subsidiaries[])`` of ids to ``(src, dst, relationship)``
    in seven kinds, each edge with its inverse, each once; NULL lists and ids give none."""
    out = None
    for col, (forward, back) in REPORT_EDGES.items():
        x = reports.select(F.col("id").alias("src"), F.explode(col).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
        both = x.select("src", "dst", F.lit(forward).alias("relationship")).unionByName(x.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(back).alias("relationship")))
        out = both if out is None else out.unionByName(both)
    return out.distinct()


def counts_by(df: DataFrame, col: str) -> DataFrame:
    """``(col, rows)``: rows of each value."""
    return df.groupBy(col).agg(F.count("*").alias("rows"))


def totals(df: DataFrame, key: str, filled: str, amount: str) -> DataFrame:
    """One row: rows, different keys (``ids``), rows with ``filled`` (``known``), and the sum of ``amount`` (``total``, 0 without any)."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("ids"), F.count(filled).alias("known"), F.coalesce(F.sum(amount), F.lit(0)).alias("total"))
