"""Jobs over file trees that change between their rounds, built from the adapter views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans import derived
from tallyloom.session import materialise, work_folder
from tallyloom.sources import increments, logs, notifications


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def refreshed_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Transcript lines after two refreshes of one store.

    By conversation modulo five, files are left alone, deleted, replaced by longer ones, put back with the time of an
    earlier writing, or new in the second round.
    """
    folder = _folder(spark, "refresh")
    root, away = f"{folder}/in", f"{folder}/away"
    kind = F.regexp_extract("file_path", "([0-9]+)[.]jsonl$", 1).cast("bigint") % 5
    texts = materialise(derived.transcript_texts(spark, d).select("line_no", "value", kind.alias("kind")))

    def put(part: int, where: str, rows: DataFrame = texts) -> None:
        rows.where(F.col("kind") == part).select("value").write.mode("overwrite").text(f"{where}/part-{part}")

    def scan(session: SparkSession, path: str | list[str]) -> DataFrame:
        return logs.parse_transcripts(logs.scan_lines(session, path, logs.TRANSCRIPT_MARKS))

    put(3, away)
    put(0, root)
    put(1, root)
    put(2, root, texts.where("line_no < 2"))
    store = increments.FileStore(spark, f"{folder}/store")
    store.refresh(root, scan, "*.txt")
    folder_1, files = _path(spark, f"{root}/part-1")
    files.delete(folder_1, True)
    put(2, root)
    files.rename(_path(spark, f"{away}/part-3")[0], _path(spark, f"{root}/part-3")[0])
    put(4, root)
    return store.refresh(root, scan, "*.txt")


def tailed_notifications(spark: SparkSession, d: str) -> DataFrame:
    """Notifications of files that grow between two runs of one stream.

    Each file holds a share of the threads.  In the second round it is the same file with more lines at its end.
    """
    folder = _folder(spark, "tail")
    root, out = f"{folder}/in", f"{folder}/out"
    texts = materialise(derived.notification_texts(spark, d).select("thread_id", "value", "event_seq", (F.col("event_seq") % 3 == 2).cast("int").alias("late")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def put(rows: DataFrame, name: str) -> None:
        """One file per share, its lines in order, under a name that stays the same."""
        dealt = rows.repartition(parts, "thread_id").sortWithinPartitions("late", "event_seq")
        dealt.select("value").write.text(f"{folder}/{name}")
        written, files = _path(spark, f"{folder}/{name}")
        files.mkdirs(_path(spark, root)[0])
        for status in files.listStatus(written):
            if status.getPath().getName().startswith("part-"):
                target = _path(spark, f"{root}/{status.getPath().getName()[:10]}.jsonl")[0]
                files.delete(target, False)
                files.rename(status.getPath(), target)

    for name, rows in (("early", texts.where("late = 0")), ("whole", texts)):
        put(rows, name)
        seen = notifications.stream_notifications(spark, root, growing=True)
        query = seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(seen.schema).parquet(out)
