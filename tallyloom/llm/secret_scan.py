"""Secrets in texts, told from widely copied examples by how many repositories and owners hold the same value.

Patterns alone can't tell a live credential from a sample that everyone pastes.  So every text gives, besides the base
spans of three fixed patterns, its *candidates*: opaque strings that look random.  Values of all of them, as 128-bit hashes, are
counted over the whole corpus by distinct repositories and distinct owners.  A value that few owners hold is specific to
them and counts as live, one that many hold is an example.  Base spans stay whatever the count says; a candidate outside them
is reported (kind ``live``) only if it is specific.

Texts are read once, in one pass of regular expressions.  Only spans, hashes and counts are written and shuffled.  Counting is by (value,
repository) first, so a value that fills the corpus is combined before it moves, and values nobody asks about go nowhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Scratch

#: The base patterns in their order, and the least length of a secret.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "live")

#: Opaque strings of this many characters, different characters and owners look live and specific.
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}+")
DIFFERENT, OWNERS, REPOSITORIES = 10, 3, 6

_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def looks_live(value: str) -> bool:
    """Long, with letters and digits, and many different characters."""
    return bool(len(value) >= 20 and _DIGIT.search(value) and _LETTER.search(value) and len(set(value)) >= DIFFERENT)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, secret) of the base patterns; positions are code points, the end exclusive."""
    found = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found)


def candidate_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of opaque strings that touch no base span."""
    out, reach = [], [(s, e) for s, _, e, _ in base]
    for m in OPAQUE.finditer(text):
        if looks_live(m.group()) and not any(s < m.end() and m.start() < e for s, e in reach):
            out.append((m.start(), m.end(), m.group()))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.binary()), ("live_looking", pa.bool_())]))
_SHAPE = "doc_id bigint, repository string, owner string, spans array<struct<start: bigint, kind: int, end: bigint, value: binary, live_looking: boolean>>"


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: Column | None = None, owner: Column | None = None, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """doc_id and spans (array of start, kind, end, verdict, owners, repositories) of every row, by start, then kind.

    Spans are base spans and, of kind ``live``, opaque strings outside them whose value at most ``owners`` owners and
    ``repositories`` repositories hold.  ``verdict`` says of every span whether its value is ``live`` (looks random and is
    specific), an ``example`` (looks random, widely copied) or ``plain``.  Overlapping base spans of different kinds all stay.
    The owner is the source and a repository one language of it, unless columns are given; repositories count per owner, and
    a null owner or repository is one of its own, unlike any named one.

    A null or empty text has no spans.  Rows are never merged: repeated rows, rows with one id and null ids each come out
    once per row, and copies under one owner count once.  A very long text is scanned whole.  Other columns may have any name.
    """
    scratch = Scratch(docs.sparkSession)
    owner = F.col("source") if owner is None else owner
    repository = F.to_json(F.struct(F.col("source"), F.col("lang"))) if repository is None else repository

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(0):
                body = value.as_py() or ""
                base = base_spans(body)
                spans = [(s, k, e, v) for s, k, e, v in base] + [(s, 3, e, v) for s, e, v in candidate_spans(body, base)]
                found.append([{"start": s, "kind": k, "end": e, "value": hashlib.md5(v.encode("utf-8", "surrogatepass")).digest(), "live_looking": looks_live(v)} for s, k, e, v in spans])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(found, _SPANS)], ["doc_id", "repository", "owner", "spans"])

    read = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("bigint").alias("doc_id"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"))
    rows = scratch.keep(read.mapInArrow(scan, _SHAPE).withColumn("row", F.monotonically_increasing_id()))
    spans = rows.where(F.size("spans") > 0).select("row", "repository", "owner", F.explode("spans").alias("s")).select("row", "repository", "owner", "s.*")

    # Combined by value, repository and owner before anything is counted: copies within a repository move once a task.
    held = spans.where("live_looking").groupBy("value", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    counts = scratch.keep(held.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")))
    specific = (F.col("owners") <= owners) & (F.col("repositories") <= repositories)
    judged = spans.join(counts, "value", "left").withColumn("verdict", F.when(~F.col("live_looking"), "plain").when(specific, "live").otherwise("example"))
    judged = judged.where("kind < 3 or verdict = 'live'")
    names = F.array(*map(F.lit, KINDS))
    span = F.struct("start", "kind", "end", "verdict", "owners", "repositories")
    gathered = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    named = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(names, s["kind"] + 1).alias("kind"), s["end"].alias("end"), s["verdict"].alias("verdict"), s["owners"].alias("owners"), s["repositories"].alias("repositories")))
    whole = rows.select("row", "doc_id").join(gathered, "row", "left")
    return whole.select("doc_id", F.coalesce(named, F.array()).alias("spans"))



def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
