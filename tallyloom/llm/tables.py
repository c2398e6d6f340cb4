"""Reading the given tables, written intermediates, and joins with a checked size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import register, work_folder

#: Keys that a filter by key may send to every executor (16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 500_000

#: Short rows that one task writes, and the least number of tasks.
ROWS_PER_TASK, FEW_TASKS = 250_000, 6

#: White space and words of the contracts, as Java patterns.
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables of one operator in the folder that all executors share.

    A lost executor then costs a read, not a lineage; ``free`` deletes what no later step reads.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Write and read back; a table known to have few short rows goes to few tasks and files."""
        if rows is not None:
            df = df.coalesce(max(FEW_TASKS, rows // ROWS_PER_TASK))
        path = f"{work_folder(self.spark)}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        register(path)  # ``session.release`` deletes it once no result needs it
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (path, back)
        return back

    def free(self, *tables: DataFrame) -> None:
        for df in tables:
            path, _ = self.paths.pop(id(df))
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def arrow_batches(spark: SparkSession, limit: int) -> Iterator[None]:
    """Plans made inside give Python batches of about so many bytes; with 10,000 texts a batch, a task's memory is that of its longest texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def filter_by_key(df: DataFrame, keys: DataFrame, on: str, how: str, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Semi- or anti-join on one key; the key list is sent to all executors only if it is counted to be short."""
    few = keys.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(keys) if few else keys, on, how)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until the frame has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def row_key(doc_id: Column, mark: Column) -> Column:
    """Id and mark of a row as one value that joins nulls too."""
    return F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id.cast("bigint"), F.lit(0)).alias("id"), mark.alias("mark"))


def text_mark(text: str) -> Column:
    """A hash of the text, null as empty: tells rows with one id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def decided(docs: DataFrame, decisions: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that were kept, with all their columns: ``decisions`` has doc_id, mark and kept for every row.

    Usually few rows go, so their keys are sent to all executors if they are counted to be few.  A row repeated with
    its id and text of which some go and some stay comes out once.
    """
    (key,) = fresh(docs, "_key")
    votes = decisions.select(row_key(F.col("doc_id"), F.col("mark")).alias(key), "kept").groupBy(key).agg(F.count_if("kept").alias("stay"), F.count("*").alias("rows"))
    votes = Scratch(docs.sparkSession).keep(votes.where("stay < rows"))
    marked = docs.withColumn(key, row_key(F.col(doc_id), text_mark(text)))
    rest = filter_by_key(marked, votes.select(key), key, "left_anti")
    torn = votes.where("stay > 0").select(key)
    if not torn.isEmpty():
        rest = rest.unionByName(filter_by_key(marked, torn, key, "left_semi").dropDuplicates([key]))
    return rest.select(*docs.columns)


def unit_number(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends only on the given values (52 bits of an MD5)."""
    text = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))
