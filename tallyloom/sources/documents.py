"""Whole-file scans: task documents, quota snapshots, counters, schedules and skill files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import names as nm
from tallyloom.functions.measures import text_tokens
from tallyloom.functions.rows import once
from tallyloom.functions.times import parse_instant

MAX_SKILL_BYTES = 4 * 1024 * 1024


def scan_files(spark: SparkSession, path: str | list[str], glob: str = "*.json") -> DataFrame:
    """One row per file with its text: (path, modified_at, value).  For small documents."""
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .text(path, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_modification_time").alias("modified_at"), "value",
        )
    )


def _documents(files: DataFrame) -> DataFrame:
    return once(files, doc=F.try_parse_json("value")).where("doc is not null")


def _first(doc: str, kind: str, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(doc, f"$.{p}", kind) for p in paths])


def _text(doc: str, *paths: str) -> Column:
    return F.coalesce(*[F.when(F.try_variant_get(doc, f"$.{p}", "string") != "", F.try_variant_get(doc, f"$.{p}", "string")) for p in paths])


def _time(doc: str, *paths: str) -> Column:
    return F.coalesce(*[parse_instant(F.try_variant_get(doc, f"$.{p}", "string")) for p in paths])


def parse_tasks(files: DataFrame) -> DataFrame:
    """Task documents: (path, status, title, updated_at, project)."""
    docs = _documents(files)
    stem = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    return docs.select(
        "path", _text("doc", "status").alias("status"),
        F.coalesce(_text("doc", "subject", "title"), stem).alias("title"),
        F.coalesce(_time("doc", "updatedAt", "updated_at"), F.col("modified_at")).alias("updated_at"),
        _text("doc", "project", "projectPath", "project_path", "cwd").alias("project"),
    )


def parse_status_snapshots(files: DataFrame) -> DataFrame:
    """Quota snapshots with named windows: one row per file with both windows as slots.

    Percentages are cut to 0..100; the window lengths are implied by the names.
    """
    docs = _documents(files)

    def window(camel: str, snake: str, mins: int) -> Column:
        places = [f"{outer}.{inner}" for outer in ("rateLimits", "rate_limits") for inner in (camel, snake)]
        used = _first("doc", "double", *[f"{p}.{n}" for p in places for n in ("usedPercentage", "used_percentage")])
        resets = _time("doc", *[f"{p}.{n}" for p in places for n in ("resetsAt", "resets_at")])
        return F.when(
            used.isNotNull(),
            F.struct(F.greatest(F.lit(0.0), F.least(F.lit(100.0), used)).alias("used_percent"),
                     F.lit(mins).alias("window_mins"), resets.alias("resets_at")),
        )

    return docs.select(
        "path", F.lit("transcript").alias("runtime"), F.xxhash64("path").alias("snapshot_id"),
        _time("doc", "capturedAt", "captured_at").alias("captured_at"),
        window("fiveHour", "five_hour", 300).alias("primary"), window("sevenDay", "seven_day", 10_080).alias("secondary"),
    )


def read_limit_documents(docs: DataFrame, preferred: str, text: str = "value") -> DataFrame:
    """Rate-limit responses to snapshots with two nullable slots.

    ``docs`` carries the JSON text; the entry named ``preferred`` wins over the
    default one.  Adds has_fields (one of the slots is named), malformed (a slot is
    there but has no percentage), available_count and credits.
    """
    parsed = once(docs, _d=F.try_parse_json(text))
    named = F.try_variant_get("_d", f"$.rateLimitsByLimitId['{preferred}']", "variant")
    default = F.try_variant_get("_d", "$.rateLimits", "variant")
    read = once(parsed, _named=named, _default=default)
    limits = F.when(_is_object(F.col("_named")), F.col("_named")).when(_is_object(F.col("_default")), F.col("_default"))
    staged = once(read, _l=limits)

    def slot(name: str) -> tuple[Column, Column]:
        raw = F.try_variant_get("_l", f"$.{name}", "variant")
        present = raw.isNotNull() & ~F.is_variant_null(raw)
        used = F.try_variant_get("_l", f"$.{name}.usedPercent", "string").try_cast("double")
        mins = F.try_variant_get("_l", f"$.{name}.windowDurationMins", "string").try_cast("double").cast("int")
        at = F.try_variant_get("_l", f"$.{name}.resetsAt", "string").try_cast("double")
        value = F.when(
            present & used.isNotNull(),
            F.struct(used.alias("used_percent"), mins.alias("window_mins"),
                     F.timestamp_micros((at * 1_000_000).cast("bigint")).alias("resets_at")),
        )
        return value, present & used.isNull()

    (primary, bad_primary), (secondary, bad_secondary) = slot("primary"), slot("secondary")
    has = F.try_variant_get("_l", "$.primary", "variant").isNotNull() | F.try_variant_get("_l", "$.secondary", "variant").isNotNull()
    credits = F.try_variant_get(
        "_d", "$.rateLimitResetCredits.credits", "array<struct<id:string,status:string,expiresAt:string>>"
    )
    return staged.where("_l is not null").select(
        *docs.columns,
        F.try_variant_get("_l", "$.limitId", "string").alias("limit_id"),
        primary.alias("primary"), secondary.alias("secondary"),
        F.coalesce(has, F.lit(False)).alias("has_fields"),
        F.coalesce(bad_primary | bad_secondary, F.lit(False)).alias("malformed"),
        F.try_variant_get("_d", "$.rateLimitResetCredits.availableCount", "string").try_cast("bigint").alias("available_count"),
        F.transform(credits, lambda c: F.struct(
            c["id"].alias("id"), c["status"].alias("status"),
            F.timestamp_micros((c["expiresAt"].try_cast("double") * 1_000_000).cast("bigint")).alias("expires_at"))).alias("credits"),
    )


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def parse_stats_cache(files: DataFrame) -> DataFrame:
    """Fallback totals: (path, today, seven_day, lifetime tokens, cost, updated_at); empty ones dropped."""
    docs = _documents(files)

    def number(*names: str) -> Column:
        return F.coalesce(*[F.try_variant_get("doc", f"$.{n}", "string").try_cast("double").cast("bigint") for n in names])

    today = F.coalesce(number("todayTokens", "today_tokens"), F.lit(0))
    week = F.coalesce(number("sevenDayTokens", "seven_day_tokens"), F.lit(0))
    return docs.select(
        "path", today.alias("today_tokens"), week.alias("seven_day_tokens"),
        F.coalesce(number("totalTokens", "total_tokens"), F.greatest(today, week)).alias("lifetime_tokens"),
        F.coalesce(_first("doc", "double", "totalCostUSD", "total_cost_usd"), F.lit(0.0)).alias("cost_usd"),
        _time("doc", "updatedAt", "updated_at").alias("updated_at"),
    ).where("lifetime_tokens > 0")


def parse_skill_counters(files: DataFrame) -> DataFrame:
    """Global skill counters: a value is a number or an object with count and time; other kinds are dropped."""
    docs, spark = _documents(files), files.sparkSession
    held = F.coalesce(F.try_variant_get("doc", "$.skillUsage", "variant"), F.try_variant_get("doc", "$.skill_usage", "variant"))
    counters = once(docs, m=held).select("path", "m").where(_is_object(F.col("m")))
    rows = counters.lateralJoin(spark.tvf.variant_explode(F.col("m").outer())).select("path", F.col("key").alias("skill_name"), "value")
    kind = F.schema_of_variant("value")
    is_object = kind.startswith("OBJECT")
    is_number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")
    counted = F.coalesce(*[F.try_variant_get("value", f"$.{n}", "string").try_cast("double").cast("bigint") for n in ("loadCount", "load_count")], F.lit(1))
    plain = F.coalesce(F.try_variant_get("value", "$", "double").cast("bigint"), F.try_variant_get("value", "$", "bigint"))
    return rows.where(is_object | is_number).select(
        "path", "skill_name",
        F.greatest(F.when(is_object, counted).otherwise(plain), F.lit(1)).cast("bigint").alias("load_count"),
        F.when(is_object, _time("value", "lastLoadedAt", "last_loaded_at")).alias("last_loaded_at"),
    )


def parse_schedules(files: DataFrame) -> DataFrame:
    """Active schedules from files of key = value lines: (path, schedule_id, name, kind, rrule)."""
    text = files.select("path", "value")
    line = nm.strip("line")
    pairs = text.select("path", F.posexplode(F.split("value", "\n")).alias("at", "line")).select(
        "path", "at", line.alias("line")
    ).where(~F.col("line").startswith("#") & F.col("line").contains("="))
    raw = nm.strip(F.regexp_extract("line", r"^[^=]*=(.*)$", 1))
    bare = F.when(raw.rlike('(?s)^".*"$') & (F.char_length(raw) >= 2), F.substring(raw, F.lit(2), F.char_length(raw) - 2)).otherwise(raw)
    value = F.replace(F.replace(bare, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    keyed = pairs.select("path", "at", nm.strip(F.regexp_extract("line", r"^([^=]*)=", 1)).alias("key"), value.alias("value"))
    wanted = ("id", "name", "kind", "rrule", "status")
    # The last line of a key wins; five fixed fields need no pivot over unknown keys.
    wide = keyed.where(F.col("key").isin(*wanted)).groupBy("path").agg(
        *[F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("at"))).alias(k) for k in wanted]
    )
    directory = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    ident = F.coalesce("id", directory)
    return wide.where(F.upper("status") == "ACTIVE").select(
        "path", ident.alias("schedule_id"), F.coalesce("name", ident).alias("name"),
        F.coalesce("kind", F.lit("cron")).alias("kind"), "rrule",
    )


def scan_skill_files(spark: SparkSession, path: str | list[str], glob: str = "*.md") -> DataFrame:
    """Skill and command files: (skill_path, byte_count, token_estimate, modified_at).

    Files beyond 4 MiB keep null sizes; the length filter reaches the source, so their content is never read.
    Spark skips hidden folders below a root, so a root (or glob) names them itself,
    such as ``/home/*/.claude``.
    """
    return skill_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path))


def skill_files(files: DataFrame) -> DataFrame:
    """Rows of a binary scan (path, modificationTime, length, content) as skill files."""
    path, modified = F.regexp_replace("path", "^file:/*", "/").alias("skill_path"), F.col("modificationTime").alias("modified_at")
    none = F.lit(None).cast("bigint")
    read = files.where(F.col("length") <= MAX_SKILL_BYTES).select(
        path, F.col("length").alias("byte_count"), text_tokens(F.decode("content", "UTF-8")).alias("token_estimate"), modified)
    listed = files.where(F.col("length") > MAX_SKILL_BYTES).select(path, none.alias("byte_count"), none.alias("token_estimate"), modified)
    return read.unionByName(listed)
