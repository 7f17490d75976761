"""Deeply nested records as related flat tables.

A record is parsed in one pass into (path, value, ordinals) triples; paths that share a repeated ancestor form a
group; each group is pivoted into one flat table whose rows keep the record's key and their positions.  References
between objects are resolved by a join on (record, id), so that a very large record is spread like many small ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


@dataclass(frozen=True)
class Leaf:
    """A scalar of a record: its path, the repeated ancestor it belongs to, and how deep the lists around it are."""

    path: str
    group: str
    depth: int


def leaves(schema: StructType) -> list[Leaf]:
    """The leaves of a schema, each with the path of its innermost list ('' for the record itself)."""
    out: list[Leaf] = []

    def walk(kind: DataType, path: str, group: str, depth: int) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name, group, depth)
        elif isinstance(kind, ArrayType):
            walk(kind.elementType, path, path, depth + 1)
        else:
            out.append(Leaf(path, group, depth))

    walk(schema, "", "", 0)
    return out


def _triples(value: Column, kind: DataType, path: str, ordinals: Column, wanted: set[str] | None) -> list[Column]:
    """Expressions, each an array of (path, value, ordinals) of one leaf below ``value``."""
    if isinstance(kind, StructType):
        return [t for f in kind.fields for t in _triples(value[f.name], f.dataType, f"{path}.{f.name}" if path else f.name, ordinals, wanted)]
    if isinstance(kind, ArrayType):
        # one expression for each leaf below keeps column pruning at work
        def under(p: str) -> Column:
            return F.flatten(F.transform(value, lambda e, i: F.flatten(F.array(*_triples(e, kind.elementType, path, F.concat(ordinals, F.array(i.cast("bigint"))), {p})))))

        below = [path + x.path[1:] for x in leaves(StructType().add("x", kind.elementType))]
        inner = [under(p) for p in below if wanted is None or p in wanted]
        if isinstance(kind.elementType, StructType) and (wanted is None or path in wanted):
            # that an object is there at all
            there = lambda e, i: F.struct(F.lit(path).alias("path"), F.when(e.isNotNull(), "").alias("value"), F.concat(ordinals, F.array(i.cast("bigint"))).alias("ordinals"))
            inner.append(F.transform(value, there))
        return [F.coalesce(x, F.array().cast(_TRIPLES)) for x in inner]
    if wanted is not None and path not in wanted:
        return []
    return [F.array(F.struct(F.lit(path).alias("path"), value.cast("string").alias("value"), ordinals.alias("ordinals")))]


_TRIPLES = "array<struct<path:string,value:string,ordinals:array<bigint>>>"


def shred(df: DataFrame, key: str, paths: list[str] | None = None) -> DataFrame:
    """``(key, path, ordinals, value)``: the non-null scalars of each record, of all paths or of those given; the path of a
    list of objects gives an empty text for each object that isn't null.

    ``ordinals`` are the positions, from 0, in the lists around the value; null elements count as positions.
    Records with a NULL key give no rows.  Only the columns the paths need are read.
    """
    wanted = set(paths) if paths else None
    arrays: list[Column] = []
    for f in df.schema.fields:
        if f.name != key:
            own = {x.path for x in leaves(StructType().add(f))} | {x.group for x in leaves(StructType().add(f))}
            if wanted is None or own & wanted:
                arrays += _triples(F.col(f"`{f.name}`"), f.dataType, f.name, F.array().cast("array<bigint>"), None if wanted is None else own & wanted)
    t = df.where(F.col(key).isNotNull()).select(F.col(key), F.explode(F.flatten(F.array(*arrays))).alias("t"))
    return t.select(key, "t.path", "t.ordinals", "t.value").where("value IS NOT NULL")


def pivot_group(triples: DataFrame, key: str, schema: StructType, group: str) -> DataFrame:
    """The flat table of a repeated ancestor: key, one position for each list down to it, one column for each leaf.

    Lists of scalars inside the group are groups of their own.  An object whose leaves are all NULL has a row if the
    triples hold the path of its list.
    """
    kinds = {}

    def walk(kind: DataType, path: str) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name)
        elif isinstance(kind, ArrayType):
            walk(kind.elementType, path)
        else:
            kinds[path] = kind

    walk(schema, "")
    own = [x for x in leaves(schema) if x.group == group and x.path != key]
    cols = [F.max(F.when(F.col("path") == x.path, F.col("value"))).alias(x.path) for x in own]
    g = triples.where(F.col("path").isin(group, *[x.path for x in own])).groupBy(key, "ordinals").agg(*cols)
    pos = [F.get("ordinals", F.lit(i)).alias("pos" if own[0].depth == 1 else f"pos_{i}") for i in range(own[0].depth)]
    name = lambda p: (p[len(group) + 1 :] if group and p.startswith(group + ".") else p.rsplit(".", 1)[-1]).replace(".", "_")
    return g.select(key, *pos, *[F.col(f"`{x.path}`").try_cast(kinds[x.path]).alias(name(x.path) or "value") for x in own])


#: The references of an article: path, array it points to.
LINKS = {
    "products.manufacturer": "companies", "technologies.developer": "companies", "relationships.src_company": "companies", "relationships.dst_company": "companies",
    "products.technologies": "technologies", "relationships.technologies": "technologies", "relationships.products": "products",
}


def links(df: DataFrame, key: str = "article_id", refs: dict[str, str] | None = None) -> DataFrame:
    """``(key, child_kind, child_pos, link_name, parent_kind, parent_pos)``: each distinct reference that finds an
    object of the right kind in the same record.

    Null references, references to nothing or to another kind, null lists and null elements give no row; positions
    count null elements.  An id that occurs twice in a list gives a row for each occurrence.
    """
    refs = refs or LINKS
    targets = sorted({f"{t}.id" for t in refs.values()})
    t = shred(df, key, [*refs, *targets])
    pos = F.get("ordinals", F.lit(0))
    kind = F.split_part(F.col("path"), F.lit("."), F.lit(1))
    parents = t.where(F.col("path").isin(*targets)).select(key, kind.alias("parent_kind"), pos.alias("parent_pos"), F.col("value").try_cast("bigint").alias("id"))
    to = F.create_map(*[F.lit(x) for p, k in refs.items() for x in (p, k)])
    children = t.where(F.col("path").isin(*refs)).select(key, kind.alias("child_kind"), pos.alias("child_pos"), F.split_part(F.col("path"), F.lit("."), F.lit(2)).alias("link_name"), to[F.col("path")].alias("parent_kind"), F.col("value").try_cast("bigint").alias("id")).distinct()
    return children.join(parents, [key, "parent_kind", "id"]).select(key, "child_kind", "child_pos", "link_name", "parent_kind", "parent_pos")
