"""Skill loads: extraction, catalogue lookup, name resolution, ranking and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import names as nm

ARGUMENT_FIELDS = ("arguments", "input", "cmd", "command")


def extract_loads(calls: DataFrame, home: str) -> DataFrame:
    """Skill files mentioned in the argument fields of tool calls, distinct per call."""
    present = [c for c in ARGUMENT_FIELDS if c in calls.columns]
    found = F.flatten(F.array(*[F.coalesce(nm.skill_mentions(c), F.array().cast("array<string>")) for c in present]))
    paths = F.array_distinct(F.array_compact(F.transform(found, lambda p: nm.canonical_skill_path(p, home))))
    return calls.withColumn("skill_path", F.explode(paths))


def adopt_installed(loads: DataFrame, catalog: DataFrame, home: str) -> DataFrame:
    """Keep loads of existing files; a plugin file of another version takes the newest
    installed one of the same family, plugin and skill; files under home stay anyway.

    ``catalog`` has skill_path and modified_at.
    """
    plugin = r"/cache/(openai-[^/]+)/([^/]+)/.*/?skills/([^/]+)/(?:.*/)?SKILL\.md$"

    def ident(path: str) -> Column:
        return F.when(F.col(path).rlike(plugin), F.array(*[F.regexp_extract(path, plugin, g) for g in (1, 2, 3)]))

    existing = catalog.select(F.col("skill_path"), F.lit(True).alias("_exists"))
    newest = (
        catalog.withColumn("_ident", ident("skill_path")).where("_ident is not null")
        .groupBy("_ident").agg(F.max_by("skill_path", F.struct("modified_at", "skill_path")).alias("_newest"))
    )
    joined = loads.join(existing, "skill_path", "left").withColumn("_ident", ident("skill_path")).join(newest, "_ident", "left")
    path = (
        F.when(F.col("_exists"), F.col("skill_path")).when(F.col("_newest").isNotNull(), F.col("_newest"))
        .when(F.col("skill_path").startswith(home + "/"), F.col("skill_path"))
    )
    return joined.withColumn("skill_path", path).where("skill_path is not null").drop("_exists", "_ident", "_newest")


def attach_catalog(usage: DataFrame, catalog: DataFrame) -> DataFrame:
    """Byte and token size by path, null when the file is unknown.

    Applied to ranked skills, so both sides have one row per path and a hot skill
    is already reduced to one row.
    """
    sizes = catalog.groupBy("skill_path").agg(
        F.min(F.struct("byte_count", "token_estimate")).alias("size")
    )
    return usage.join(sizes, "skill_path", "left").withColumns(
        {"byte_count": F.col("size.byte_count"), "token_estimate": F.col("size.token_estimate")}
    ).drop("size")


def skill_usage(loads: DataFrame, catalog: DataFrame, home: str = "") -> DataFrame:
    """Loads, distinct sessions and latest load per skill, with sizes, ranked."""
    grouped = loads.groupBy("skill_path").agg(
        F.count("*").alias("load_count"), F.count_distinct("thread_id").alias("thread_count"),
        F.max("ts").alias("last_loaded_at"),
    )
    sized = attach_catalog(grouped, catalog)
    return sized.select(
        "skill_path", nm.skill_name("skill_path").alias("name"), nm.skill_source("skill_path", home).alias("source_label"),
        "load_count", F.greatest("thread_count", F.lit(1)).alias("thread_count"), "last_loaded_at",
        "byte_count", "token_estimate",
    ).orderBy(F.desc("load_count"), F.desc(F.coalesce("token_estimate", F.lit(-1))), "name", "skill_path")


# ------------------------------------------------------------ name resolution


def _ancestors(path: Column) -> Column:
    """The directory and its parents up to the root, nearest first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(
        F.sequence(F.size(parts), F.lit(0), F.lit(-1)),
        lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")),
    )


def _child(directory: Column, rest: Column) -> Column:
    return F.when(directory == "/", F.concat(F.lit("/"), rest)).otherwise(F.concat(directory, F.lit("/"), rest))


def _safe(component: Column) -> Column:
    return (component != "") & (component != ".") & (component != "..") & ~component.contains("/")


def search_directories(requests: DataFrame, roots: DataFrame) -> DataFrame:
    """Directories to search for a request, nearest first: from the working directory up
    to the repository root, or the working directory alone when no root is known.

    ``roots`` lists directories that hold a repository (column path).
    """
    distinct = requests.select("project_path").distinct().where("project_path like '/%'")
    chain = distinct.select("project_path", F.posexplode(_ancestors(nm.standard_path("project_path"))).alias("depth", "path"))
    rooted = chain.join(roots.select("path").distinct(), "path", "left_semi").groupBy("project_path").agg(
        F.min("depth").alias("root_depth")
    )
    return chain.join(rooted, "project_path", "left").where("depth <= coalesce(root_depth, 0)").groupBy(
        "project_path"
    ).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "path"))), lambda s: s["path"]).alias("directories"))


def resolve_names(requests: DataFrame, catalog: DataFrame, roots: DataFrame, home: str, config: str = ".claude") -> DataFrame:
    """Skill file for (skill_name, explicit_path, project_path), null when undecided.

    Candidates in priority order: the explicit path; the personal skill; skills of
    the project directories; the personal command; commands of the project
    directories.  ``space:name`` needs exactly one match among the project and the
    plugins.  Unsafe names resolve to nothing.  Distinct requests are resolved once.
    """
    keys = ["skill_name", "explicit_path", "project_path"]
    # Missing paths become empty text so that every key joins by plain equality.
    requests = requests.select(*[F.coalesce(c, F.lit("")).alias(c) for c in keys])
    directories = search_directories(requests, roots)
    asked = requests.select(*keys).distinct().join(directories, "project_path", "left").withColumn(
        "directories", F.coalesce("directories", F.array().cast("array<string>"))
    )
    name = F.regexp_replace(nm.strip("skill_name"), r"^/+|/+$", "")
    asked = asked.withColumns(
        {
            "_name": name,
            "_space": F.regexp_extract(name, r"^(.*):[^:]*$", 1),
            "_tail": F.regexp_extract(name, r"^.*:([^:]*)$", 1),
        }
    )
    space_ok = (
        (F.col("_space") != "") & ~F.col("_space").startswith("/")
        & F.forall(F.split("_space", "/"), lambda p: (p != "") & (p != ".") & (p != ".."))
    )
    qualified = space_ok & _safe(F.col("_tail"))
    simple = ~qualified & _safe(F.col("_name"))
    skill = F.concat(F.lit(f"{config}/skills/"), F.col("_name"), F.lit("/SKILL.md"))
    command = F.concat(F.lit(f"{config}/commands/"), F.col("_name"), F.lit(".md"))
    personal = F.lit(home)
    lookups = F.concat(
        F.array(_child(personal, skill)),
        F.transform("directories", lambda d: _child(d, skill)),
        F.array(_child(personal, command)),
        F.transform("directories", lambda d: _child(d, command)),
    )
    nested = F.concat(F.col("_space"), F.lit(f"/{config}/skills/"), F.col("_tail"), F.lit("/SKILL.md"))
    ends = F.array_distinct(F.array_compact(F.array(F.try_element_at("directories", F.lit(1)), F.try_element_at("directories", F.lit(-1)))))
    none = F.array().cast("array<string>")
    ranked = F.concat(
        F.array(F.when(F.col("explicit_path") != "", F.col("explicit_path"))),
        F.when(simple, lookups).otherwise(none),
    )
    files = catalog.select(F.col("skill_path").alias("path")).distinct()

    by_rank = (
        asked.select(*keys, F.posexplode(ranked).alias("rank", "path")).where("path is not null")
        .join(files, "path", "left_semi")
    )
    first = by_rank.groupBy(*keys).agg(F.min_by("path", "rank").alias("_first"))

    in_project = asked.where(qualified).select(*keys, F.explode(F.transform(ends, lambda d: _child(d, nested))).alias("path")).join(
        files, "path", "left_semi"
    ).select(*keys, "path")
    # A plugin file ends in /<space>/skills/<name>/SKILL.md: the suffix is an equi-join key.
    plugins = catalog.where(F.col("skill_path").startswith(f"{home}/{config}/plugins/")).select(
        F.col("skill_path").alias("path"), F.regexp_extract("skill_path", r"^(.*)/skills/([^/]+)/SKILL\.md$", 1).alias("_before"),
        F.regexp_extract("skill_path", r"^(.*)/skills/([^/]+)/SKILL\.md$", 2).alias("_tail"),
    ).where("_tail <> ''")
    # All tails of the part before /skills/ that a namespace could name.
    before = F.split("_before", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(before) - 1), lambda n: F.array_join(F.slice(before, n + 1, F.size(before)), "/"))
    plugin_keys = plugins.select("path", "_tail", F.explode(tails).alias("_space"))
    in_plugins = asked.where(qualified).select(*keys, "_space", "_tail").join(plugin_keys, ["_space", "_tail"]).select(*keys, "path")
    only = in_project.unionByName(in_plugins).groupBy(*keys).agg(
        F.count_distinct("path").alias("_n"), F.min("path").alias("_only")
    ).where("_n = 1")

    out = requests.distinct().join(first, keys, "left").join(only.drop("_n"), keys, "left")
    return out.select(*keys, F.coalesce("_first", "_only").alias("resolved_path"))


# ------------------------------------------------------------------------ merge


def merge_global(skills: DataFrame) -> DataFrame:
    """Merge transcript skills with global counters.

    Input: skill_id, name, path, source (transcript / global), load_count,
    thread_count, token_estimate, byte_count, last_loaded_at.  An entry without a
    path adopts the only resolved path of its name.  Transcript entries of one id add
    up; a global counter then only raises the result to its own value.
    """
    resolved = F.col("path").startswith("/") & F.col("token_estimate").isNotNull()
    only = (
        skills.where(resolved).groupBy("name")
        .agg(F.count_distinct("skill_id").alias("_ids"), F.min(F.struct("skill_id", "path", "token_estimate", "byte_count")).alias("_r"))
        .where("_ids = 1").select("name", "_r")
    )
    adopt = ~F.col("path").startswith("/") & F.col("_r").isNotNull()
    named = skills.join(only, "name", "left").withColumns(
        {c: F.when(adopt, F.col(f"_r.{c}")).otherwise(F.col(c)) for c in ("skill_id", "path", "token_estimate", "byte_count")}
    )
    local = F.col("source") == "transcript"

    def combined(column: str) -> Column:
        added = F.sum(F.when(local, F.col(column)))
        largest = F.max(F.when(~local, F.col(column)))
        return F.greatest(added, largest).alias(column)

    return named.groupBy("skill_id").agg(
        F.min("name").alias("name"), F.min("path").alias("path"),
        F.when(F.bool_or(local), "transcript").otherwise("global").alias("source"),
        combined("load_count"), combined("thread_count"),
        F.max("token_estimate").alias("token_estimate"), F.max("byte_count").alias("byte_count"),
        F.max("last_loaded_at").alias("last_loaded_at"),
    ).orderBy(F.desc("load_count"), "skill_id")


def merge_runtimes(skills: DataFrame) -> DataFrame:
    """Skill rows of all runtimes by id: sums, first known size, latest load."""
    return skills.groupBy("skill_id").agg(
        F.min_by("name", "runtime").alias("name"), F.sum("load_count").alias("load_count"),
        F.sum("thread_count").alias("thread_count"),
        F.min_by("token_estimate", F.when(F.col("token_estimate").isNotNull(), F.col("runtime"))).alias("token_estimate"),
        F.max("last_loaded_at").alias("last_loaded_at"),
    ).orderBy(F.desc("load_count"), "skill_id")
