"""Mixing sources to target weights by systematic sampling.

Targets come from water filling over one row per source.  Inside a source every document has the same expected
number of copies, target / size of the source.  Documents are put in order of size (so that the sample is even
over sizes), the expected copies are summed along that order, one random offset is added per source, and a
document is emitted once per integer boundary its interval crosses.  What a source takes then differs from its target by
less than its longest document; of a few offsets drawn, the nearest is used.

The running sum needs no window over a source: rows are range partitioned and sorted, each task numbers its
rows, and a small table of rows per task and source says where each task begins.  A hot source is simply spread
over many ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import WORD, Scratch, text_mark, unit_number

#: No source may be repeated more than this often.
MOST_COPIES = 3

#: Offsets drawn for a source, of which it takes the best.
DRAWS = 16


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Target per source from (source, size); sources by code point, null last, weigh 1, 2, 3, repeating.

    All targets add up to all sizes.  A target stops at ``most`` times the size; the excess goes to the others by
    weight, which ends where min(cap, level * weight) adds up to the total.  The rows here are one per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.withColumn("weight", F.pmod(F.row_number().over(ordered) - 1, F.lit(3)) + 1).withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    # In order of cap / weight the sources reach their caps.  With those before a source full, the others would stand at
    # its level; that rises up to the first source that does not reach its cap, and falls after it.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    reached = weighed.withColumn("level", level).withColumn("water", F.max("level").over(everything))
    return reached.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, source, size (words), source_size, target, copies, taken (words, repeats counted), mark (a hash of the
    text), one row per document.

    A null text has no words; a document without words is never taken.  A null source is a source of its own.
    Documents of one source and size are taken in order of their ids; rows repeated with one id count each.
    The same input and seed give the same result.
    """
    scratch = Scratch(docs.sparkSession)
    sizes = scratch.keep(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), text_mark(text).alias("mark")))
    goal = scratch.keep(targets(sizes, most))

    # Written in order, so that the place of a row is fixed: (task, row in the task).
    spread = sizes.repartitionByRange(F.col("source"), F.col("size"), F.col("doc_id"), F.col("mark")).sortWithinPartitions("source", "size", "doc_id", "mark")
    placed = scratch.keep(spread.withColumn("place", F.monotonically_increasing_id()).withColumn("task", F.shiftright("place", 33)))
    per_task = placed.groupBy("source", "task").agg(F.min("place").alias("begin"), F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    starts = starts.join(goal, starts["source"].eqNullSafe(goal["source"])).select(
        starts["source"], "task", "begin", "before", "source_size", "target")

    numbered = placed.alias("p").join(starts.alias("s"), F.expr("p.task = s.task and p.source <=> s.source")).select(
        "p.doc_id", "p.mark", "p.source", "p.size", "s.source_size", "s.target", (F.col("place") - F.col("begin") + F.col("before")).alias("rank"))
    # Of a few drawn offsets a source takes the one that brings it nearest to its target: one sum each, no more passes.
    offsets = [unit_number(F.lit(str(seed)), F.coalesce(F.col("source"), F.lit("\0null")), F.lit(str(k))) for k in range(DRAWS)]
    drawn = scratch.keep(goal.select("source", F.array(*offsets).alias("offsets")))
    tried = numbered.alias("n").join(drawn.alias("d"), F.expr("n.source <=> d.source")).select("n.*", "d.offsets")
    sums = [F.sum(_copies(F.col("offsets")[k], most) * F.col("size")).alias(f"sum_{k}") for k in range(DRAWS)]
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"sum_{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(DRAWS)]))["k"]
    chosen = tried.groupBy("source", "target", "offsets").agg(*sums).select("source", F.element_at("offsets", nearest + 1).alias("offset"))
    chosen = scratch.keep(chosen)
    final = numbered.alias("n").join(chosen.alias("c"), F.expr("n.source <=> c.source")).select("n.*", _copies(F.col("c.offset"), most).alias("copies"))
    return final.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "mark")


def _copies(offset: F.Column, most: int) -> F.Column:
    """Integers crossed by a document's interval of expected copies."""
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(offset + share * (F.col("rank") + 1)) - F.floor(offset + share * F.col("rank"))
    return F.when(F.col("size") > 0, F.least(crossed, F.lit(most))).otherwise(0).cast("bigint")
