"""Not-modified revisits of a web archive, resolved by an as-of join on the canonical URL.

A revisit record says that a server answered "not modified": its body is that of the latest earlier full response of the
same URL, if the validators agree, and only some of its headers replace the stored ones.

The as-of join sorts once by (URL, time) in ranges, so a URL with very many captures spreads over tasks.  Each task walks
its rows in order and carries the last full response; what a task needs from earlier ones is the last response of its
first URL, at most one row per task.  Bodies never move: a resolved record names the response that has its body.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Scratch

#: Header fields that a not-modified answer may bring up to date (HTTP semantics, status 304).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, tracking parameters and final slash dropped, host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^(?i)[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www[0-9]*\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    parameters = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    return F.concat(host, path, F.when(F.size(parameters) > 0, F.concat(F.lit("?"), F.array_join(parameters, "&"))).otherwise(""))


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that become equal the last in order of spelling stays."""
    entries = F.array_sort(F.map_entries(headers))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != F.lower(e["key"])), F.map_from_arrays(F.array(F.lower(e["key"])), F.array(e["value"]))))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """record_id, url_key, kind, state, ref_id, headers for every row of (record_id, kind, url, at, headers).

    ``kind`` is ``response`` (full) or ``revisit``; other kinds, and rows whose url, time or kind is null, pass through
    with state ``ignored``.  States of a revisit: ``orphan`` without an earlier full response of the URL (``at`` strictly
    smaller; of the latest ones the largest record_id), ``changed`` if the validators disagree, else ``resolved``.
    Entity tags are compared first, weakly; without one on both sides, Last-Modified; without either, nothing disagrees.
    ``ref_id`` is the response compared with; a resolved record has its headers, with the permitted fields of the revisit
    over them.  Header names come out in lower case.  Null headers are none.  Repeated rows are resolved each.
    """
    scratch = Scratch(records.sparkSession)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = records.select(
        F.col("record_id").cast("bigint"), F.col("kind"), canonical_url(F.col("url")).alias("url_key"), F.col("at").cast("bigint"),
        lower_names(F.coalesce(F.col("headers"), none)).alias("headers"))
    taking_part = F.col("url_key").isNotNull() & F.col("at").isNotNull() & F.coalesce(F.col("kind").isin("response", "revisit"), F.lit(False))
    ordered = rows.where(taking_part).withColumn("full", F.col("kind") == "response").repartitionByRange(F.col("url_key"), F.col("at"))
    ordered = ordered.sortWithinPartitions("url_key", "at", "full", "record_id")  # at one time, revisits come first

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, carried, opening = TaskContext.get().partitionId(), None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            opening = table.column("url_key")[0] if opening is None else opening
            lead = 0 if carried is None else 1
            joined = table if carried is None else pa.concat_tables([carried, table])
            url, full = joined.column("url_key"), joined.column("full").to_numpy()
            n = np.arange(len(joined))
            same = np.append(False, pc.equal(url.slice(1), url.slice(0, len(joined) - 1)).to_numpy(zero_copy_only=False)) if len(joined) > 1 else np.zeros(1, bool)
            begin = np.maximum.accumulate(np.where(same, 0, n))
            last = np.maximum.accumulate(np.where(full, n, -1))
            ref = np.where(~full & (last >= begin), last, -1)[lead:]
            index = pa.array(ref, mask=ref < 0)
            open_ = pc.and_(pc.equal(table.column("url_key"), opening), pa.chunked_array([pa.array(~full[lead:] & (ref < 0))]))
            out = table.append_column("task", pa.array(np.full(len(table), task, np.int32))).append_column("open", open_)
            out = out.append_column("ref_id", joined.column("record_id").take(index)).append_column("ref_headers", joined.column("headers").take(index))
            yield from out.combine_chunks().to_batches()
            at = int(last[-1])
            carried = joined.slice(at, 1) if at >= begin[-1] else None

    shape = "record_id bigint, kind string, url_key string, at bigint, headers map<string,string>, full boolean, task int, open boolean, ref_id bigint, ref_headers map<string,string>"
    walked = scratch.keep(ordered.mapInArrow(walk, shape))

    # What a task's first URL takes over: the last response of the tasks before it.  One row per task.
    first = walked.groupBy("task").agg(F.min("url_key").alias("url_key"))
    shared = first.groupBy("url_key").agg(F.max("task").alias("until"))
    last = walked.where("full").join(F.broadcast(shared), "url_key").where(F.col("task") < F.col("until"))
    place = F.struct("at", "record_id")
    tails = last.groupBy("url_key", "task").agg(F.max(place).alias("place"), F.max_by("headers", place).alias("last_headers"))
    steps = first.join(tails, ["url_key", "task"], "full")
    upto = Window.partitionBy("url_key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    taken = steps.select("task", "url_key", F.last("place", True).over(upto).alias("place"), F.last("last_headers", True).over(upto).alias("last_headers"))
    taken = taken.where("place is not null").select("task", "url_key", F.col("place.record_id").alias("late_id"), "last_headers")
    taken = scratch.keep(taken)

    found = walked.join(taken, ["task", "url_key"], "left").withColumn("late", F.col("open") & F.col("late_id").isNotNull())
    found = found.withColumn("ref_id", F.when(F.col("late"), F.col("late_id")).otherwise(F.col("ref_id"))).withColumn("ref_headers", F.when(F.col("late"), F.col("last_headers")).otherwise(F.col("ref_headers")))
    mine, theirs = F.col("headers"), F.col("ref_headers")
    tags = mine["etag"].isNotNull() & theirs["etag"].isNotNull()
    dates = mine["last-modified"].isNotNull() & theirs["last-modified"].isNotNull()
    disagree = F.when(tags, _strong(mine["etag"]) != _strong(theirs["etag"])).when(dates, mine["last-modified"] != theirs["last-modified"]).otherwise(False)
    state = F.when(F.col("full"), "response").when(theirs.isNull(), "orphan").when(disagree, "changed").otherwise("resolved")
    brought = F.map_filter(mine, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.map_contains_key(brought, k)), brought)
    done = found.withColumn("state", state).select(
        "record_id", "url_key", "kind", "state", F.when(F.col("full"), F.lit(None)).otherwise(F.col("ref_id")).alias("ref_id"), F.when(F.col("state") == "resolved", merged).otherwise(mine).alias("headers"))
    rest = rows.where(~taking_part).select("record_id", "url_key", "kind", F.lit("ignored").alias("state"), F.lit(None).cast("bigint").alias("ref_id"), "headers")
    return done.unionByName(rest)


def captures_of(pages: DataFrame) -> DataFrame:
    """Five captures of each page: full responses and revisits with agreeing, other, or no entity tags, some orphans.

    (record_id, kind, url, at, headers), derived from the page's id, url and html.
    """
    page, visit = F.col("page_id"), F.col("visit")
    renewed = (page % 3 == 0) & (visit == 2)
    tag = lambda salt: F.concat(F.lit('"'), F.substring(F.md5(F.concat(F.coalesce(F.col("html"), F.lit("")), F.lit(salt))), 1, 12), F.lit('"'))
    weak = F.when((visit == 1) & (page % 2 == 0), F.concat(F.lit("W/"), F.col("old"))).when(visit == 4, None).when(renewed, F.col("new")).otherwise(F.col("old"))
    spelt = F.when(visit % 2 == 1, F.concat(F.regexp_replace("url", "^https?://", "HTTP://WWW."), F.lit("#again"))).otherwise(F.col("url"))
    day = F.when(renewed, page % 28 + 2).otherwise(page % 28 + 1).cast("string")
    every = pages.select("page_id", "url", tag("").alias("old"), tag("2").alias("new")).withColumn("visit", F.explode(F.sequence(F.lit(0), F.lit(4))))
    headers = F.map_filter(F.map_from_arrays(
        F.array(*map(F.lit, ("ETag", "Last-Modified", "Date", "Content-Type", "Content-Length", "X-Visit"))),
        F.array(weak, F.concat(F.lit("day "), day), F.concat(F.lit("visit "), visit.cast("string")), F.lit("text/html"), F.when((visit == 0) | renewed, "1").otherwise("0"), visit.cast("string"))),
        lambda _, v: v.isNotNull())
    return every.where(~((page % 10 == 9) & (visit == 0))).select(
        (page * 5 + visit).alias("record_id"), F.when((visit == 0) | renewed, "response").otherwise("revisit").alias("kind"), spelt.alias("url"), (page * 10 + visit * 1_000_003).alias("at"), headers.alias("headers"))
