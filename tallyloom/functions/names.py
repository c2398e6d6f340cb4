"""Project, title, tool, skill, worker and task naming rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNCATEGORIZED = "uncategorized"

# Tool categories, first match wins (lower-cased name contains a keyword).
LOG_TOOL_CATEGORIES = (
    ("terminal", ("exec", "shell", "stdin")),
    ("edit", ("patch", "edit")),
    ("browser", ("web", "browser", "page", "click", "screenshot", "snapshot")),
    ("visual", ("image", "figma")),
    ("docs", ("docs", "library", "mcp", "resource")),
    ("planning", ("plan", "goal")),
)
TRANSCRIPT_TOOL_CATEGORIES = (
    ("terminal", ("bash", "shell", "terminal")),
    ("edit", ("edit", "write", "patch")),
    ("docs", ("read", "grep", "glob")),
    ("browser", ("web", "browser", "fetch")),
    ("planning", ("task", "agent", "todo")),
    ("mcp", ("mcp",)),
)

# Task status words of the transcript runtime.
TASK_STATES = (
    (("in_progress", "active", "running"), "active", "running"),
    (("pending",), "pending", "pending"),
    (("failed", "error"), "pending", "failed"),
    (("blocked",), "pending", "blocked"),
    (("scheduled",), "scheduled", "scheduled"),
    (("completed", "done", "success"), "done", "completed"),
)

# Skill path roots and their labels, first match wins.
SKILL_ROOTS = (
    ("/ai-infra/skills/", "ai-infra"),
    ("/.agents/skills/", "agents"),
    ("/.codex/skills/.system/", "system"),
    ("/.codex/skills/", "personal"),
)

# Fixed value: how a skill file is mentioned in tool arguments.
SKILL_PATH_PATTERN = r"(?:(?:~|/)[^\s\"'`<>,;)]*SKILL\.md)"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def blank_to_null(text: str | Column) -> Column:
    trimmed = strip(text)
    return F.when(trimmed != "", trimmed)


# ------------------------------------------------------------------- projects


def last_component(path: str | Column) -> Column:
    """Name after the last slash, trailing slashes ignored."""
    return F.regexp_extract(_col(path), r"([^/]+)/*$", 1)


def project_id(path: str | Column, runtime: str | Column = "runtime") -> Column:
    trimmed = F.coalesce(strip(path), F.lit(""))
    ident = F.when(trimmed == "", F.lit(UNCATEGORIZED)).otherwise(F.hex(F.xxhash64(trimmed)))
    return F.concat_ws(":", _col(runtime), ident)


def project_name(path: str | Column) -> Column:
    trimmed = F.coalesce(strip(path), F.lit(""))
    return F.when(trimmed == "", F.lit(UNCATEGORIZED)).otherwise(last_component(trimmed))


def decode_directory(name: str | Column) -> Column:
    """``-a-b`` stands for ``/a/b``; other names stay as they are."""
    raw = _col(name)
    return F.when(raw.startswith("-"), F.replace(raw, F.lit("-"), F.lit("/"))).otherwise(raw)


def title(first: str | Column, second: str | Column) -> Column:
    """First non-blank text on one line, cut to 45 characters and an ellipsis."""
    raw = F.coalesce(blank_to_null(first), blank_to_null(second), F.lit("Untitled"))
    line = F.regexp_replace(raw, r"\s+", " ")
    return F.when(F.char_length(line) <= 48, line).otherwise(F.concat(F.substring(line, 1, 45), F.lit("...")))


# ---------------------------------------------------------------------- tools


def tool_category(name: str | Column, profile: str = "log") -> Column:
    rules = LOG_TOOL_CATEGORIES if profile == "log" else TRANSCRIPT_TOOL_CATEGORIES
    lowered = F.lower(_col(name))
    chain = None
    for category, words in rules:
        hit = lowered.rlike("|".join(words))
        chain = F.when(hit, category) if chain is None else chain.when(hit, category)
    return chain.otherwise("tool")


# --------------------------------------------------------------------- skills


def skill_mentions(text: str | Column) -> Column:
    """All skill paths mentioned in a text, in order, as an array."""
    return F.regexp_extract_all(_col(text), F.lit(SKILL_PATH_PATTERN), 0)


def _fold_dots(parts: Column) -> Column:
    """Resolve ``.`` and ``..`` in an array of path components."""
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part.isin("", "."), acc)
        .when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(part))),
    )


def standard_path(path: str | Column) -> Column:
    raw = _col(path)
    folded = F.concat(F.lit("/"), F.array_join(_fold_dots(F.split(raw, "/")), "/"))
    return F.when(raw.rlike(r"//|/\.{1,2}(/|$)|.+/$"), folded).otherwise(raw)


def canonical_skill_path(path: str | Column, home: str) -> Column:
    """Punctuation cut off, ``~`` expanded, dots resolved; null when not absolute."""
    trimmed = F.regexp_replace(_col(path), "^[ \\n\\r\\t\"'`;,.)\\]]+|[ \\n\\r\\t\"'`;,.)\\]]+$", "")
    full = F.when(trimmed.startswith("~/"), F.concat(F.lit(home), F.substr(trimmed, F.lit(2)))).otherwise(trimmed)
    usable = trimmed.endswith("/SKILL.md") & full.startswith("/")
    return F.when(usable, standard_path(full))


def skill_name(path: str | Column) -> Column:
    """Directory that holds the file."""
    return F.regexp_extract(_col(path), r"([^/]+)/+[^/]+/*$", 1)


def skill_source(path: str | Column, home: str = "") -> Column:
    """Plugin family and name below a cache folder, else a known root, else the path."""
    raw = _col(path)
    shown = raw
    if home:
        shown = (
            F.when(raw == home, F.lit("~"))
            .when(raw.startswith(home + "/"), F.concat(F.lit("~"), F.substr(raw, F.lit(len(home) + 1))))
            .otherwise(raw)
        )
    parts = F.filter(F.split(raw, "/"), lambda p: p != "")
    at = F.array_position(parts, F.lit("cache")).cast("int")
    plugin = F.concat_ws("/", F.try_element_at(parts, at + 1), F.try_element_at(parts, at + 2))
    chain = F.when((at > 0) & (F.size(parts) >= at + 2), plugin)
    for root, label in SKILL_ROOTS:
        chain = chain.when(shown.contains(root), label)
    return chain.otherwise(shown)


# -------------------------------------------------------------------- workers


def worker_kind(source: str | Column) -> Column:
    lowered = F.lower(F.coalesce(_col(source), F.lit("")))
    return F.when(lowered.isin("subagent", "automation"), lowered).otherwise("main")


def is_subagent_file(path: str | Column) -> Column:
    return _col(path).contains("/subagents/")


def automation_id(source: str | Column, text: str | Column) -> Column:
    """Identifier on the line after ``Automation ID: `` in an automation's title."""
    found = strip(F.regexp_extract(_col(text), r"Automation ID: ([^\n]*)\n", 1))
    return F.when((_col(source) == "automation") & (found != ""), found)


def worker_id(kind: str | Column, thread_id: str | Column, automation: str | Column, runtime: str = "log") -> Column:
    named = F.when((_col(kind) == "automation") & _col(automation).isNotNull(),
                   F.concat_ws(":", F.lit(runtime), F.lit("automation"), _col(automation)))
    return F.coalesce(named, F.concat_ws(":", F.lit(runtime), _col(kind), _col(thread_id)))


# ---------------------------------------------------------------------- tasks


def activity_column(updated_at: str | Column, as_of: Column) -> Column:
    """Active when touched in the last two hours, else pending."""
    return F.when(_col(updated_at) >= as_of - F.expr("interval 2 hours"), "active").otherwise("pending")


def activity_state(updated_at: str | Column, as_of: Column) -> Column:
    return F.when(activity_column(updated_at, as_of) == "active", "recentlyActive").otherwise("continueLater")


def _status(raw: str | Column, pick: int, fallback: str) -> Column:
    word = F.lower(strip(raw))
    chain = None
    for words, *values in TASK_STATES:
        hit = word.isin(*words)
        chain = F.when(hit, values[pick]) if chain is None else chain.when(hit, values[pick])
    return chain.otherwise(fallback)


def task_column(raw_status: str | Column) -> Column:
    return _status(raw_status, 0, "pending")


def task_state(raw_status: str | Column) -> Column:
    return _status(raw_status, 1, "unknown")


def is_subagent(thread_source: Column, source_text: Column | None = None, source_keys: Column | None = None) -> Column:
    """Hidden from the board: the source says subagent, as text or as an object key."""
    test = F.lower(thread_source).eqNullSafe("subagent")
    if source_text is not None:
        test = test | F.lower(source_text).eqNullSafe("subagent")
    if source_keys is not None:
        test = test | F.coalesce(F.exists(source_keys, lambda k: F.lower(k) == "subagent"), F.lit(False))
    return test
