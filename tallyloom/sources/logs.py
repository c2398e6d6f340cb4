"""Line-oriented scans: session logs and transcripts.

Both prefilter raw lines before any JSON is parsed, and number lines without a
shuffle: ``line_no`` grows with the position in the file, also when Spark splits
the file over many tasks.  It is unique per file but not dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import names as nm
from tallyloom.functions.times import parse_instant
from tallyloom.schemas import LOG_LINE, TOKEN_COLUMNS, TRANSCRIPT_LINE

# Fixed values.
MAX_LINE_BYTES = 4 * 1024 * 1024
LOG_TYPES = ("session_meta", "turn_context", "token_count", "function_call", "custom_tool_call")
WORK_TYPES = ("task_started", "task_complete")
TRANSCRIPT_MARKS = '"usage"|"tool_use"|attribution'


def _position() -> Column:
    """Order-preserving line number of a text scan.

    A task numbers its lines below 2^33 in file order, and a task never holds more
    lines than bytes of its splits; doubling the block start keeps later blocks above.
    """
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") * 2 + in_task


def scan_lines(
    spark: SparkSession, path: str | list[str], pattern: str, *, modified_after: str | None = None, glob: str | None = None
) -> DataFrame:
    """Raw lines that match a pattern: (file_path, modified_at, line_no, value)."""
    # Longer lines are passed over while reading, so one huge line never is in memory as a whole.
    reader = spark.read.option("recursiveFileLookup", "true").option("mapreduce.input.linerecordreader.line.maxlength", MAX_LINE_BYTES + 1)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    numbered = reader.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
        _position().alias("line_no"),
        "value",
    )
    return numbered.where((F.octet_length("value") <= MAX_LINE_BYTES) & F.col("value").rlike(pattern))


def parse_session_logs(lines: DataFrame, types: tuple[str, ...] = LOG_TYPES) -> DataFrame:
    """Records of session-log lines (file_path, line_no, value):
    (file_path, line_no, ts, type, payload).

    Lines that are no JSON, lines without payload and other record types are skipped.
    """
    parsed = lines.withColumn("r", F.from_json("value", LOG_LINE))
    kind = F.when(F.col("r.type").isin("session_meta", "turn_context"), F.col("r.type")).otherwise(F.col("r.payload.type"))
    return parsed.where("r.payload is not null").select(
        "file_path", "line_no", parse_instant("r.timestamp").alias("ts"), kind.alias("type"), F.col("r.payload").alias("payload")
    ).where(F.col("type").isin(*types))


def type_pattern(types: tuple[str, ...]) -> str:
    """Cheap test that a line may be a record of one of the types."""
    return '"type"\\s*:\\s*"(' + "|".join(types) + ')"'


def scan_session_logs(spark: SparkSession, path: str | list[str], types: tuple[str, ...] = LOG_TYPES, **options) -> DataFrame:
    """Session-log files to records."""
    return parse_session_logs(scan_lines(spark, path, type_pattern(types), **options), types)


def thread_of(file_path: str | Column) -> Column:
    """File stem, the session's key when no thread table is at hand."""
    path = F.col(file_path) if isinstance(file_path, str) else file_path
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)


def plain_path(uri: str | Column) -> Column:
    """A file's path without scheme, as a thread table writes it (escapes of the listing undone)."""
    column = F.col(uri) if isinstance(uri, str) else uri
    return F.regexp_replace(F.url_decode(F.replace(column, F.lit("+"), F.lit("%2B"))), "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")


def by_threads(records: DataFrame, threads: DataFrame) -> DataFrame:
    """Records of the files that the thread table names, with the thread's id.

    The table's ``log_path`` tells which file belongs to which thread; file names need not hold the id.  Of several
    threads with one file, and for threads without usage, ``threads.with_logs`` decides.
    """
    from tallyloom.sources.threads import with_logs

    named = with_logs(threads).select("thread_id", F.regexp_replace("log_path", "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/").alias("_path"))
    return records.withColumn("_path", plain_path("file_path")).join(named, "_path").drop("_path")


def _counters(struct: str) -> Column:
    fields = [F.col(f"{struct}.{c}").try_cast("double").cast("bigint").alias(c) for c in TOKEN_COLUMNS]
    exact = [F.coalesce(F.col(f"{struct}.{c}").try_cast("bigint"), f).alias(c) for c, f in zip(TOKEN_COLUMNS, fields)]
    return F.when(F.col(struct).isNotNull(), F.struct(*exact))


def counter_lines(records: DataFrame, thread: Column | None = None) -> DataFrame:
    """Session-log records in the shape the counter and lineage operators read:
    (thread_id, line_no, line_type, ts, model, forked_from_id, cum, last).

    Counter lines without a readable time are skipped.
    """
    cum, last = _counters("payload.info.total_token_usage"), _counters("payload.info.last_token_usage")
    counting = F.col("type") == "token_count"
    return records.where(
        F.col("type").isin("session_meta", "turn_context") | (counting & F.col("ts").isNotNull())
    ).select(
        (thread if thread is not None else thread_of("file_path")).alias("thread_id"), "line_no",
        F.col("type").alias("line_type"), "ts", F.col("payload.model").alias("model"),
        F.col("payload.forked_from_id").alias("forked_from_id"),
        F.when(counting, cum).alias("cum"), F.when(counting, last).alias("last"),
    )


def call_lines(records: DataFrame, thread: Column | None = None) -> DataFrame:
    """Tool calls with their argument fields: (thread_id, seq, tool_name, ts, arguments, input, cmd, command)."""
    return records.where(F.col("type").isin("function_call", "custom_tool_call")).select(
        (thread if thread is not None else thread_of("file_path")).alias("thread_id"), F.col("line_no").alias("seq"),
        F.col("payload.name").alias("tool_name"), "ts",
        *[F.col(f"payload.{c}").alias(c) for c in ("arguments", "input", "cmd", "command")],
    )


def turn_marks(records: DataFrame, thread: Column | None = None) -> DataFrame:
    """Turn starts and completions of session logs (scan with ``WORK_TYPES``)."""

    def seconds(name: str) -> Column:
        return F.timestamp_micros(F.round(F.col(f"payload.{name}").try_cast("double") * 1_000_000).cast("bigint"))

    started = F.col("type") == "task_started"
    return records.select(
        (thread if thread is not None else thread_of("file_path")).alias("thread_id"), "line_no",
        F.col("payload.turn_id").alias("turn_id"),
        F.when(started, "started").otherwise("completed").alias("mark"),
        F.when(started, seconds("started_at")).otherwise(seconds("completed_at")).alias("at"),
        F.col("payload.duration_ms").try_cast("double").alias("duration_ms"),
    ).where("turn_id is not null and at is not null")


# ----------------------------------------------------------------- transcripts


def _text(column: str) -> Column:
    return F.when(F.col(column) != "", F.col(column))


def _long(column: str) -> Column:
    return F.coalesce(F.col(column).try_cast("bigint"), F.col(column).try_cast("double").cast("bigint"))


def scan_transcripts(spark: SparkSession, path: str | list[str], pattern: str = TRANSCRIPT_MARKS, **options) -> DataFrame:
    """Transcript files to lines with usage, tool calls or skill attribution."""
    return parse_transcripts(scan_lines(spark, path, pattern, glob="*.jsonl", **options))


def parse_transcripts(lines: DataFrame) -> DataFrame:
    """Fields of transcript lines (file_path, modified_at, line_no, value).

    The session is the file stem; a line without a readable time takes the file's
    modification time; the project starts from the decoded directory name.
    """
    parsed = lines.withColumn("r", F.from_json("value", TRANSCRIPT_LINE))
    usage = "r.message.usage"
    directory = F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1)
    return parsed.where("r is not null").select(
        "file_path", "line_no", thread_of("file_path").alias("session_id"),
        F.coalesce(parse_instant("r.timestamp"), F.col("modified_at")).alias("ts"),
        F.coalesce(_text("r.message.id"), _text("r.uuid"), _text("r.id")).alias("message_id"),
        F.coalesce(_text("r.message.model"), _text("r.model")).alias("model"),
        F.coalesce(_text("r.cwd"), _text("r.projectPath")).alias("cwd"),
        nm.decode_directory(directory).alias("seed_project"),
        _long(f"{usage}.input_tokens").alias("input"),
        _long(f"{usage}.cache_creation_input_tokens").alias("cache_create"),
        _long(f"{usage}.cache_read_input_tokens").alias("cache_read"),
        _long(f"{usage}.output_tokens").alias("output"),
        _long(f"{usage}.reasoning_output_tokens").alias("reasoning"),
        _long(f"{usage}.total_tokens").alias("total"),
        F.coalesce(_text("r.attributionSkill"), _text("r.attribution_skill"),
                   _text("r.message.attributionSkill"), _text("r.message.attribution_skill")).alias("skill_name"),
        F.filter(F.coalesce(F.col("r.message.content"), F.array().cast("array<struct<type:string,id:string,name:string>>")),
                 lambda c: (c["type"] == "tool_use") & (c["name"] != "")).alias("tool_uses"),
        F.col("r.subtype").alias("subtype"),
        F.col("r.durationMs").try_cast("double").alias("duration_ms"),
    )


def transcript_calls(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("session_id").alias("thread_id"), F.col("line_no").alias("seq"), "ts", F.explode("tool_uses").alias("u")
    ).select("thread_id", "seq", F.col("u.name").alias("tool_name"), "ts")


def transcript_skill_loads(lines: DataFrame) -> DataFrame:
    """Attributed skills, and tool calls whose name mentions a skill."""
    named = lines.where("skill_name is not null").select(
        F.col("session_id").alias("thread_id"), F.col("line_no").alias("seq"), "skill_name", "ts"
    )
    called = transcript_calls(lines).where(F.lower("tool_name").contains("skill")).select(
        "thread_id", "seq", F.col("tool_name").alias("skill_name"), "ts"
    )
    return named.unionByName(called)
