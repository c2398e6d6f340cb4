"""Queries of the operators: each reads its whole table and applies the operator with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, hard_negatives, jaccard_join, mixing, neighbours, packing, periodic_runs, quality, revisits, secret_scan, substring_dedup, suffix_dedup, token_counts
from .tables import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).drop("mark", "kept")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.captures_of(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])))
    return found.select("record_id", "url_key", "kind", "state", "ref_id", F.array_join(lines, "\n").alias("headers"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeated_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("mark")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("mark")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("mark")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components are whole numbers of 64 bits; larger ones stop at the largest."""
    usable = table(spark, sf_dir, "embeddings").where("label is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    moved = F.expr("if(vec_id % 7 = 0, cast((cast(label as bigint) + 1) % 10 as bigint), cast(label as bigint))")
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return hard_negatives.mine(usable.select("vec_id", moved.alias("label"), whole.alias("v")), F.col("vec_id") % 50 == 0)


def looped(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """The contract's rewriting of one text in ten: from word a on, its words repeat with period p."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((words[:a], words[a + np.arange(n - a) % p]))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id is not rewritten."""
    found = periodic_runs.collapse_runs(table(spark, sf_dir, "documents"), rewrite=looped)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.withColumn("longest", longest)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("longest.start").alias("start"), (-F.col("longest.shorter")).alias("length"), F.col("longest.period").alias("period"),
        F.expr("-1000 * longest.shorter div longest.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))

    def number(field: str, value: str) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("bigint")

    return found.select(
        "doc_id", *(number("kind", kind).alias(f"n_{kind}") for kind in secret_scan.KINDS), number("verdict", "example").alias("n_example"),
        F.sha2(secret_scan.joined(F.filter("spans", lambda s: s["kind"] != "live")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_ngram_jaccard, op2_token_counts, op3_best_fit_packing, op4_warc_revisits, op5_substring_dedup, op6_exact_dedup, op7_source_mix, op8_quality_classifier, op9_nearest_neighbours, op10_suffix_dedup, op11_hard_negatives, op12_periodic_runs, op13_secret_scan,
)}
