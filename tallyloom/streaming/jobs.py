"""Streaming runs over the adapter views: the rows are written once as files and
read back as a stream in several micro-batches (``availableNow``)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans import derived, views
from tallyloom.session import materialise, work_folder
from tallyloom.sources import notifications
from tallyloom.streaming import connection
from tallyloom.streaming import counters as stream_counters
from tallyloom.streaming import tables


def _folder(spark: SparkSession) -> str:
    return f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _ranges(rows: DataFrame, order: str, edges: list) -> list[DataFrame]:
    """Rows in consecutive ranges of the order column, each up to and including its edge; the last range is open."""
    bounds = zip([None, *edges], [*edges, None])
    return [rows.where(F.lit(True) if low is None else F.col(order) > low).where(F.lit(True) if high is None else F.col(order) <= high) for low, high in bounds]


def run_live_state(spark: SparkSession, d: str) -> DataFrame:
    """Notifications, full lists and connection rows in one stream; the table as seen at four moments.

    Columns: phase, thread_id, state, name, turn_id, updated_at, is_realtime.  A phase is one run of the stream on the same
    checkpoint: ``listed`` after a full list, ``lost`` after the connection was lost, ``opened`` after it was opened
    again, ``end`` after a new list and what follows it.
    """
    folder = _folder(spark)
    texts = materialise(derived.connection_texts(spark, d))
    threads = connection.LiveThreads(spark, f"{folder}/live", fan=2)
    seen = []
    for phase, part in zip(derived.PHASES, _ranges(texts, "event_seq", derived.phase_edges(spark, d))):
        part.select("value").write.mode("append").text(f"{folder}/in")
        rows = notifications.stream_notifications(spark, f"{folder}/in")
        _finish(rows.writeStream.foreachBatch(threads.keep()).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start())
        seen.append(materialise(threads.current().withColumn("phase", F.lit(phase))))
    return reduce(DataFrame.unionByName, seen)


def run_counters(spark: SparkSession, d: str, ranges: int = 4, lines_per_slot: int = 64) -> DataFrame:
    """The counter log in line ranges, normalised with state between batches.

    Each range is as many files as its tasks write and one run on the same checkpoint, so a session's lines arrive in order.
    """
    folder = _folder(spark)
    lines = materialise(views.counter_log(spark, d).drop("user_id"))
    edges = lines.approxQuantile("line_no", [i / ranges for i in range(1, ranges)], 0.05)
    stream = stream_counters.CounterStream(spark, f"{folder}/counters", lines_per_slot, fan=2)
    for part in _ranges(lines, "line_no", sorted(set(edges))):
        part.write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema(lines.schema).parquet(f"{folder}/in")
        _finish(rows.writeStream.foreachBatch(stream.keep()).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start())
    return stream.deltas()


def run_daily(spark: SparkSession, d: str, ranges: int = 5, zones: tuple[str, ...] = ("UTC",)) -> DataFrame:
    """The ledger as a stream into the daily mart; with two zones it changes half-way and the days so far are rebuilt."""
    folder = _folder(spark)
    ledger = materialise(views.usage_events(spark, d))
    edges = sorted({row[0] for row in ledger.agg(F.percentile_approx(F.unix_micros("ts"), [i / ranges for i in range(1, ranges)], 1000).alias("p")).selectExpr("explode(p) as p").collect()})
    mart = tables.DailyMart(spark, f"{folder}/mart", zones[0], fan=2)
    timed = ledger.withColumn("at", F.unix_micros("ts"))
    for number, part in enumerate(_ranges(timed, "at", edges)):
        part.drop("at").write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema(ledger.schema).parquet(f"{folder}/in")
        _finish(rows.writeStream.foreachBatch(mart.keep()).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start())
        if number == ranges // 2 and len(zones) > 1:
            # A job between two runs of the stream: its number is that of the last batch, whose rows the rebuilt days hold.
            mart.rezone(number, spark.read.schema(ledger.schema).parquet(f"{folder}/in"), zones[1])
    return mart.current()


def run_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Transcript files found by the stream in two rounds: lines seen by type.

    Files of the second round are read once; those of the first are not read again.
    """
    folder = _folder(spark)
    texts = derived.transcript_texts(spark, d).select("line_no", "value")
    src, out = f"{folder}/in", f"{folder}/out"
    for part in (0, 1):
        texts.where(F.col("line_no") % 2 == part).select("value").write.mode("append").text(src)
        found = tables.discover_files(spark, src)
        _finish(
            found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/ck")
            .trigger(availableNow=True).start()
        )
    seen = spark.read.parquet(out)
    return seen.groupBy(F.get_json_object("value", "$.type").alias("line_type")).agg(F.count("*").alias("line_count"))
