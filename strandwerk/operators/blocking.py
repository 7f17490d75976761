"""Name blocking: companies with equal name keys, in blocks of bounded size.

Members of a key are numbered without ever standing in one task: within hash slices of the key, then by the sum of the
slices before; sizes and kinds come from the slices too.  So a key that holds a third of all rows is split into blocks like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwerk.functions import names

MAX_BLOCK = 50


def name_keys(companies: DataFrame, id_col: str = "uuid", name_col: str = "name") -> DataFrame:
    """``(block_key, key_type, uuid)``: each company's first-word key and acronym key; companies without a key give none.

    Rows without an id are dropped, repeated ids count once (the row of the least name).
    """
    c = companies.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("uuid")).agg(F.min(name_col).alias("name"))
    keys = F.array(F.struct(names.first_word_key(F.col("name")).alias("block_key"), F.lit("first_word").alias("key_type")), F.struct(names.acronym_key(F.col("name")).alias("block_key"), F.lit("acronym").alias("key_type")))
    return c.select("uuid", F.inline(keys)).where("block_key IS NOT NULL").select("block_key", "key_type", "uuid")


def members_of(keys: DataFrame) -> DataFrame:
    """``(block_key, uuid, fw, ac)``: each member of a key once, and whether the key is its first word or its acronym."""
    return keys.groupBy("block_key", "uuid").agg(F.bool_or(F.col("key_type") == "first_word").alias("fw"), F.bool_or(F.col("key_type") == "acronym").alias("ac"))


def kind_of(fw: Column, ac: Column) -> Column:
    """The kind of a key: first_word, acronym, or combined."""
    return F.when(fw & ac, "combined").when(fw, "first_word").otherwise("acronym")


def key_kinds(keys: DataFrame) -> DataFrame:
    """``(block_key, block_key_type, size)``: keys used as first word and as acronym are ``combined``."""
    k = members_of(keys).groupBy("block_key").agg(F.bool_or("fw").alias("fw"), F.bool_or("ac").alias("ac"), F.count("*").alias("size"))
    return k.select("block_key", kind_of(F.col("fw"), F.col("ac")).alias("block_key_type"), "size")


def numbered(df: DataFrame, key: str, order: str, flags: tuple[str, ...] = (), digits: int = 3) -> DataFrame:
    """``df`` with ``pos``, the 1-based position of each row in its key by md5(order), then order, and ``total``, the
    key's rows; no task sees a whole key.

    Keys are cut into slices by the first ``digits`` hex digits of the hash; 3 give 4,096 slices, so that a key of
    10^10 rows stands in slices of 2.4 million.  ``flags`` are boolean columns; each becomes whether any row of the key has it.
    """
    h = F.md5(F.col(order))
    d = df.withColumns({"_h": h, "_slice": F.left(h, F.lit(digits))})
    all_slices = Window.partitionBy(key)
    before = d.groupBy(key, "_slice").agg(F.count("*").alias("_n"), *[F.bool_or(f).alias(f) for f in flags])
    before = before.select(
        key, "_slice", (F.sum("_n").over(all_slices.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(all_slices).alias("total"),
        *[F.max(f).over(all_slices).alias(f) for f in flags],
    )
    d = d.drop(*flags).withColumn("_i", F.row_number().over(Window.partitionBy(key, "_slice").orderBy("_h", order)))
    return d.join(before, [key, "_slice"]).withColumn("pos", F.col("_i") + F.col("_before")).drop("_h", "_slice", "_i", "_before")


def assign_blocks(keys: DataFrame, max_size: int = MAX_BLOCK) -> DataFrame:
    """``(block_key, block_key_type, uuid)``: the members of each block; keys of more than ``max_size`` members become
    ``<key>_chunk_<n>`` from 1, each of at most that size."""
    m = numbered(members_of(keys), "block_key", "uuid", ("fw", "ac"))
    chunk = F.concat(F.col("block_key"), F.lit("_chunk_"), (F.floor((F.col("pos") - 1) / max_size) + 1).cast("string"))
    return m.select(F.when(F.col("total") > max_size, chunk).otherwise(F.col("block_key")).alias("block_key"), kind_of(F.col("fw"), F.col("ac")).alias("block_key_type"), "uuid")


def build_blocks(companies: DataFrame, max_size: int = MAX_BLOCK, columns: list[str] | None = None) -> DataFrame:
    """``(block_key, block_key_type, block_size, companies)``: blocks with their companies as structs, sorted by uuid.

    Companies without any key come out as blocks ``UNBLOCKED_<uuid>`` of one.  Every list holds at most ``max_size``.
    """
    cols = columns or [c for c in companies.columns if not c.startswith("block_")]
    c = companies.where("uuid IS NOT NULL").groupBy("uuid").agg(F.min(F.struct(*[F.col(x) for x in cols])).alias("c"))
    keys = name_keys(companies)
    blocks = assign_blocks(keys, max_size)
    rest = c.join(keys.select("uuid").distinct(), "uuid", "left_anti").select(F.concat(F.lit("UNBLOCKED_"), "uuid").alias("block_key"), F.lit("unblocked").alias("block_key_type"), F.lit(1).cast("bigint").alias("block_size"), F.array("c").alias("companies"))
    b = blocks.join(c, "uuid").groupBy("block_key", "block_key_type").agg(F.count("*").alias("block_size"), F.array_sort(F.collect_list(F.struct("uuid", "c"))).alias("m"))
    return b.select("block_key", "block_key_type", "block_size", F.transform("m", lambda x: x["c"]).alias("companies")).unionByName(rest)


def split_blocks(blocks: DataFrame, max_size: int = MAX_BLOCK, key: str = "block_key", members: str = "companies") -> DataFrame:
    """Blocks whose list is longer than ``max_size`` cut into chunks; others, with empty and NULL lists, unchanged.  No shuffle."""
    arr = F.col(members)
    n = F.coalesce(F.size(arr), F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / max_size), F.lit(0)).cast("int")), lambda i: F.slice(arr, i * max_size + 1, max_size))
    cut = blocks.withColumn("_p", F.when(n > max_size, parts).otherwise(F.array(arr))).select("*", F.posexplode("_p").alias("_i", "_m"))
    out = cut.withColumn(key, F.when(n > max_size, F.concat(key, F.lit("_chunk_"), (F.col("_i") + 1).cast("string"))).otherwise(F.col(key))).withColumn(members, F.col("_m")).drop("_p", "_i", "_m")
    return out.withColumn("block_size", F.greatest(F.size(members), F.lit(0)).cast("bigint")) if "block_size" in blocks.columns else out


def size_range(n: Column) -> Column:
    """The histogram range of a size."""
    return F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 10, "6-10").when(n <= 20, "11-20").when(n <= 50, "21-50").when(n <= 100, "51-100").otherwise("100+")


def size_histogram(sizes: DataFrame, col: str = "size") -> DataFrame:
    """``(size_range, range_no, blocks, members)`` in the order of the ranges."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(("1", "2-5", "6-10", "11-20", "21-50", "51-100", "100+"), 1) for x in (r, i)])
    h = sizes.groupBy(size_range(F.col(col)).alias("size_range")).agg(F.count("*").alias("blocks"), F.sum(col).alias("members"))
    return h.select("size_range", order[F.col("size_range")].cast("bigint").alias("range_no"), "blocks", "members").orderBy("range_no")


def block_summary(blocks: DataFrame, size: str = "block_size") -> DataFrame:
    """One row: blocks, members, singletons, min, max, mean size, share of singletons; zeros for an empty table."""
    n = F.col(size)
    s = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum(n), F.lit(0)).alias("members"), F.count_if(n == 1).alias("singletons"), F.min(n).alias("min_size"), F.max(n).alias("max_size"), F.round(F.avg(n), 6).alias("avg_size"))
    return s.withColumn("singleton_share", F.round(F.try_divide(F.col("singletons").cast("double"), F.col("blocks")), 6))


def filter_blocks(blocks: DataFrame, low: int = 1, high: int | None = None, limit: int | None = None) -> DataFrame:
    """Blocks of a size range, the largest ``limit`` of them if given (ties by key)."""
    b = blocks.where(F.col("block_size") >= low)
    b = b.where(F.col("block_size") <= high) if high else b
    return b.orderBy(F.desc("block_size"), "block_key").limit(limit) if limit else b


def combine_blocks(names: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(block_key, block_key_type, member)``: blocks by name ``(block_key, block_key_type, uuid)`` and by vector ``(block_key, vec_id)`` in one table, each kind with its own keys."""
    v = vectors.select("block_key", F.lit("semantic").alias("block_key_type"), F.col("vec_id").cast("string").alias("member"))
    return names.select("block_key", "block_key_type", F.col("uuid").alias("member")).unionByName(v)


def stage_metrics(companies: DataFrame, blocks: DataFrame, top: int = 10) -> DataFrame:
    """One row: input_companies, blocks_created, largest_block (0 without blocks), and top_blocks, the largest by ``block_size`` (ties by key)."""
    n = F.coalesce("block_size", F.lit(0))
    first = blocks.where("block_size IS NOT NULL").orderBy(F.desc("block_size"), "block_key").limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("block_size")).alias("s"), "block_key"))).alias("t"))
    row = blocks.agg(F.count("*").alias("blocks_created"), F.coalesce(F.max(n), F.lit(0)).cast("bigint").alias("largest_block"))
    row = row.select(companies.agg(F.count("*")).scalar().alias("input_companies"), "blocks_created", "largest_block")
    return row.join(F.broadcast(first), F.lit(True)).select("input_companies", "blocks_created", "largest_block", F.transform("t", lambda x: F.struct(x["block_key"].alias("block_key"), (-x["s"]).alias("block_size"))).alias("top_blocks"))
