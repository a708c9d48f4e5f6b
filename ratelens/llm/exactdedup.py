"""Exact dedup by deterministic block naming. DataFrame operations only.

Texts are lower-cased (A-Z only) and cut into blocks of ``block`` characters. The blocks of all documents
are sorted, and a block's integer name is the place of the first one equal to it; then adjacent pairs of
names are sorted and named in the same way, again and again, until each document has one name. Two
documents of equally many blocks have the same name exactly if they are equal: names stand for contents
one to one, hashes only say where blocks are sorted.

Text passes one exchange, from which names are read off without a join. A block that more rows hold than
``HOT_ROWS`` and a ``HOT_SHARE``-th of all blocks is sorted in several salted runs; the few runs' names are
then made one by comparing one block of each. Levels are written as work tables, so that a lost task can't
give the same block another name. The number of levels is the logarithm of the longest text's blocks.
Groups are counted with partial aggregation, and joined back to rows by shuffle joins whose sides both have
exchanges of their own, so that Spark can split a hot group of copies; the one that moves texts is a merge
join at any size, so that small and large inputs have the same plan.

Defined results: a null text counts as empty; all empty texts are equal. Of equal texts the row with
the largest doc_id stays; rows with a null doc_id come after all others. Rows that repeat a doc_id and
its text count in the group's size, and the operator keeps one of them. Other columns don't matter and
pass through ``distinct_rows`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.common import discard, lower_ascii, written

#: Runs of equal blocks hold about so many rows at most, or one part in HOT_SHARE of all blocks: fewer blocks than HOT_SHARE are more frequent.
HOT_ROWS, HOT_SHARE = 4096, 1 << 16
#: Blocks of a chunk: texts are cut into chunks first, as finding a place in a text takes time in proportion to it.
CHUNK = 64


def normalised(c: Column) -> Column:
    return lower_ascii(F.coalesce(c, F.lit("")))


def pair_names(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) in sorted order, each with an integer name that grows with its place."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.select("a", "b").distinct().repartitionByRange(n, "a", "b").sortWithinPartitions("a", "b")
    return written(rows.select("a", "b", F.monotonically_increasing_id().alias("name")), "pair-names")


def cut(rows: DataFrame, block: int) -> DataFrame:
    """rid, parts (the text's number of blocks), pos, block of each row (rid, norm); an empty text is one empty block."""
    count = lambda text, size: F.greatest(F.ceil(F.char_length(text) / size), F.lit(1)).cast("int")
    pieces = lambda text, size: F.posexplode(F.transform(F.sequence(F.lit(0), count(text, size) - 1), lambda i: F.substring(text, i * size + 1, F.lit(size))))
    chunks = rows.select("rid", count("norm", block).cast("long").alias("parts"), pieces("norm", block * CHUNK).alias("at", "chunk"))
    blocks = chunks.select("rid", "parts", "at", pieces("chunk", block).alias("in_chunk", "block"))
    return blocks.select("rid", "parts", (F.col("at").cast("long") * CHUNK + F.col("in_chunk")).alias("pos"), "block")


def block_names(blocks: DataFrame) -> DataFrame:
    """rid, parts, left, pos and the name of each block: equal blocks have the same and unequal ones don't."""
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = written(blocks.groupBy(F.xxhash64("block").alias("key")).count(), "block-counts")
    most = max(HOT_ROWS, (counts.agg(F.sum("count")).first()[0] or 0) // HOT_SHARE)
    hot = counts.filter(F.col("count") > most).select("key", F.ceil(F.col("count") / most).alias("salts"))
    keyed = blocks.withColumn("key", F.xxhash64("block")).join(F.broadcast(hot), "key", "left")  # fewer than HOT_SHARE rows
    by = ["head", "key", "salt"]
    salted = keyed.select("rid", "parts", "pos", "block", "key", F.substring("block", 1, 32).alias("head"), F.coalesce(F.pmod("rid", "salts"), F.lit(0)).alias("salt"), F.col("salts").isNotNull().alias("hot"))
    placed = salted.repartitionByRange(n, *by).sortWithinPartitions(*by, "block").withColumn("place", F.monotonically_increasing_id())
    runs = placed.withColumn("name", F.min("place").over(Window.partitionBy(*by, "block")))
    level = written(runs.select("rid", "parts", F.col("parts").alias("left"), "pos", "name", F.when(F.col("hot") & (F.col("place") == F.col("name")), F.col("block")).alias("first")), "level")
    discard(counts)
    firsts = level.filter("first is not null").groupBy("first").agg(F.min("name").alias("one"), F.collect_list("name").alias("names"))  # one name a salt
    one = written(firsts.select("one", F.explode("names").alias("name")), "salted-names")
    return level.join(one, "name", "left").select("rid", "parts", "left", "pos", F.coalesce("one", "name").alias("name"))


def identities(rows: DataFrame, block: int = 4096) -> DataFrame:
    """rid, parts, name of each row (rid, norm): equal texts have equal (parts, name) and unequal ones don't."""
    level = block_names(cut(rows, block))
    done = level.filter("left = 1").select("rid", "parts", "name")
    while True:
        open_ = level.filter("left > 1")
        if open_.isEmpty():
            return done
        pairs = open_.groupBy("rid", "parts", "left", F.expr("pos div 2").alias("pos")).agg(F.max(F.expr("case when pos % 2 = 0 then name end")).alias("a"), F.coalesce(F.max(F.expr("case when pos % 2 = 1 then name end")), F.lit(-1)).alias("b"))
        names = pair_names(pairs)
        level = written(pairs.join(names, ["a", "b"]).select("rid", "parts", F.expr("(left + 1) div 2").alias("left"), "pos", "name"), "level")
        discard(names)
        done = done.unionByName(level.filter("left = 1").select("rid", "parts", "name"))


def _members(docs: DataFrame, key: str, block: int, carried: Column, norm: Column) -> tuple[DataFrame, DataFrame]:
    """The rows (rid, doc_id, carried), written, and of those in groups of equal texts: rid, group_size, keep_id, keep_rid.

    norm: the normalised text, in terms of carried.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("doc_id"), carried.alias("carried")), "rows")
    ids = identities(rows.select("rid", norm.alias("norm")), block)
    ids = written(rows.select("rid", "doc_id").join(ids, "rid"), "identities")
    of = ["parts", "name"]
    groups = written(ids.groupBy(*of).agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("rid", "doc_id"), F.max("rid")).alias("keep_rid")).filter("group_size > 1"), "groups")
    member = written(ids.join(groups, of).select("rid", "group_size", "keep_id", "keep_rid"), "members")
    discard(ids, groups)
    return rows, member


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = 4096, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size and kept_row of each row, and the carried expressions of the row."""
    carried = F.struct(*[v.alias(k) for k, v in (carry or {}).items()], normalised(F.col(text)).alias("_norm"))
    rows, member = _members(docs, key, block, carried, F.col("carried._norm"))
    out = rows.join(member, "rid", "left")
    return out.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_rid") == F.col("rid"), F.lit(True)).alias("kept_row"),
        *[F.col("carried").getField(k).alias(k) for k in carry or {}],
    )


def distinct_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = 4096) -> DataFrame:
    """The rows that stay, with their own columns only."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows, member = _members(docs, key, block, whole, normalised(F.col("carried").getField(text)))
    gone = member.filter("rid <> keep_rid").select("rid")
    left = rows.join(gone.hint("merge"), "rid", "left_anti")
    return left.select(*[F.col("carried").getField(c).alias(c) for c in docs.columns])
