"""The corpus pipeline: documents in, packed pieces out; each stage is one operator of ``tallyloom.llm``.

Quality classifier, exact dedup, near-duplicate groups, source mix, packing.  Every stage takes all that the one before
kept, reads it from written Parquet, and (but for the last) returns whole rows of documents.  A row is known by its id and
a hash of its text, so repeated ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import exact_dedup, jaccard_join, mixing, packing, quality
from tallyloom.llm.tables import Scratch, decided, fresh, row_key, table, text_mark

#: Words of a shingle and similarity in percent of near copies: 2.2 percent of the words may differ (op1's 3 and 90 allow 1.75).
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the given labels, does not reject."""
    scores = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    return decided(docs, scores.select("doc_id", "mark", (F.col("predicted") == 1).alias("kept")))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    return decided(docs, exact_dedup.exact_duplicates(docs).select("doc_id", "mark", "kept"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group linked by near-duplicate pairs; rows without words all stay."""
    groups = Scratch(spark).keep(jaccard_join.jaccard_components(docs, size=NEAR_SHINGLE, percent=NEAR_PERCENT).select("doc_id", "mark", "n_shingles", "kept"))
    again = groups.where("kept and n_shingles > 0").groupBy("doc_id", "mark").agg(F.count("*").alias("rows")).where("rows > 1")
    return decided(docs, groups.select("doc_id", "mark", "kept").unionByName(again.select("doc_id", "mark", F.lit(False).alias("kept"))))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none to three times."""
    key, copies, rows, copy = fresh(docs, "_key", "_copies", "_rows", "_copy")
    mix = mixing.mix(docs).where("copies > 0")
    taken = Scratch(spark).keep(mix.groupBy(row_key(F.col("doc_id"), F.col("mark")).alias(key)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)))
    marked = docs.withColumn(key, row_key(F.col("doc_id"), text_mark("text"))).join(taken, key)
    if not taken.where(F.col(rows) > 1).isEmpty():  # rows with one id and text share their copies
        marked = marked.where(F.col(rows) == 1).unionByName(marked.where(F.col(rows) > 1).dropDuplicates([key]))
    return marked.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, with_ids=False)


STAGES = [("quality", good), ("exact_dedup", unique), ("near_dedup", distinct), ("mix", mixed), ("packing", packed)]

#: No twin: SQL can express neither the classifier nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written before the next stage reads it."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
