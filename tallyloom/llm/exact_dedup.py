"""Exact duplicates by deterministic block naming.

Texts are stripped of white space and cut into blocks of a fixed number of code points.  Equal blocks get
equal integer names: the distinct blocks are sorted inside hash partitions and numbered.  Adjacent names are
paired and the pairs named in turn, level by level, until every text has one name.  Names are given to block
*contents*, so equal names mean equal texts.

What crosses the network is one copy per task of each distinct block (combined before the shuffle) and, for
every text, 16-byte block keys.  The keys only carry names back to the texts; should two different blocks ever
share a key, the naming is repeated with another seed, so the result stays collision-free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import BLANK_RUN, Scratch, text_mark

#: Code points of a block.  Most texts are one block; a longer text takes log2(blocks) pairing levels.
BLOCK = 16_384


def _blocks(text: Column, size: int) -> Column:
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _key(block: Column, seed: int, bits: int) -> Column:
    low, high = F.xxhash64(F.lit(2 * seed), block), F.xxhash64(F.lit(2 * seed + 1), block)
    if bits < 64:
        low, high = low.bitwiseAND(F.lit((1 << bits) - 1)), F.lit(0).cast("bigint")
    return F.struct(low.alias("low"), high.alias("high"))


def _named(distinct: DataFrame, *order: str) -> DataFrame:
    """Number the rows after sorting each partition; the caller writes the result, which fixes the numbers."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, key_bits: tuple[int, ...] = ()) -> DataFrame:
    """One row per input row: its id, the id of the row that stays, the size of its group, whether it stays.

    Columns: doc_id, keep_id, group_size, kept, text_sha256, n_points, mark (a hash of the text as it was).  Of equal texts the row with the most code
    points stays, then the smallest id (null last); of rows repeated with one id exactly one stays.  A null text
    is empty; texts without content form one group.  Other columns of ``docs`` are not read.  ``key_bits`` narrows
    the keys of the first attempts (for tests).
    """
    scratch = Scratch(docs.sparkSession)
    plain = F.regexp_replace(F.col("_text"), BLANK_RUN, "")
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    attempt = 0
    while True:
        bits = key_bits[attempt] if attempt < len(key_bits) else 64
        found = scratch.keep(source.select("doc_id", F.length("_text").alias("n_points"), text_mark("_text").alias("mark"), plain.alias("_plain")).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "n_points", "mark", F.sha2("_plain", 256).alias("text_sha256"),
            F.transform(_blocks(F.col("_plain"), block), lambda b: _key(b, attempt, bits)).alias("keys"),
        ))
        contents = source.select(plain.alias("_plain")).select(F.explode(_blocks(F.col("_plain"), block)).alias("block"))
        names = scratch.keep(_named(contents.groupBy("block").agg(F.count("*").alias("_n")), "block").select(_key(F.col("block"), attempt, bits).alias("key"), "name"))
        if names.groupBy("key").count().where("count > 1").isEmpty():
            break
        scratch.free(found, names)
        attempt += 1

    parts = found.select("row", F.posexplode("keys").alias("at", "key"), (F.size("keys") > 1).alias("long")).join(names, "key").select("row", "at", "name", "long")
    parts = scratch.keep(parts)
    whole = _pair_up(parts.where("long").drop("long"), found.agg(F.max(F.size("keys"))).first()[0] or 0, scratch)
    identity = parts.where("not long").select("row", "name", F.lit(0).alias("kind")).unionByName(whole.select("row", "name", F.lit(1).alias("kind")))
    rows = scratch.keep(found.drop("keys").join(identity, "row"))

    first = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    # Written, so that both sides of the join are plain exchanges and a hot group's rows may be split.
    groups = scratch.keep(rows.groupBy("kind", "name").agg(first.alias("first"), F.count("*").alias("group_size")))
    return rows.join(groups, ["kind", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", "n_points", "mark",
    )


def _pair_up(parts: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """Name adjacent pairs until one name is left per row; a missing partner is -1."""
    while most > 1:
        even, odd = F.col("at") % 2 == 0, F.col("at") % 2 == 1
        pairs = parts.groupBy("row", F.floor(F.col("at") / 2).cast("int").alias("at")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("b"))
        names = scratch.keep(_named(pairs.groupBy("a", "b").agg(F.count("*").alias("_n")), "a", "b").drop("_n"))
        parts = scratch.keep(pairs.join(names, ["a", "b"]).select("row", "at", "name"))
        most = (most + 1) // 2
    return parts
