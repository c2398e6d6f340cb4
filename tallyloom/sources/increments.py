"""Re-read only what changed: file fingerprints against a stored manifest."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import materialise
from tallyloom.sources.logs import plain_path


def fingerprints(spark: SparkSession, path: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """Size and modification time of every file; the listing reads no content."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
        .select(F.col("path").alias("file_path"), F.col("length").alias("file_size"),
                F.unix_micros("modificationTime").alias("modified_micros"))
    )


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or whose fingerprint differs."""
    return listing.join(manifest, ["file_path", "file_size", "modified_micros"], "left_anti")


def live_rows(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Parsed rows whose file still exists."""
    return rows.join(listing.select("file_path"), "file_path", "left_semi")


def merge_parsed(parsed: DataFrame, fresh: DataFrame, listing: DataFrame, changed: DataFrame) -> DataFrame:
    """Parsed rows after a refresh: unchanged live files keep theirs, changed files bring new ones."""
    kept = live_rows(parsed, listing).join(changed.select("file_path"), "file_path", "left_anti")
    return kept.unionByName(fresh)


def _plain(path: str) -> F.Column:
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")


#: Hash buckets of a store: a refresh rewrites whole buckets, so many mean little is rewritten for one changed file.
BUCKETS = 256

#: (session, path or paths) -> rows with a ``file_path``
Scan = Callable[..., DataFrame]


class FileStore:
    """Parsed rows of a tree of files, kept in hash buckets of the file path.

    A refresh lists the files, reads only new and changed ones, by name, and rewrites only the buckets that hold a new,
    changed or deleted file; all other buckets stay where an earlier refresh wrote them.  ``rows/version=v/bucket=b`` holds
    what version v wrote; ``manifests/v``, written last, names every file with its fingerprint and the version of its bucket.
    A refresh that fails leaves the last manifest in force.  Bucket folders that the last two manifests do not name are
    deleted, so a reader of the version before can finish.  One refresh runs at a time.

    The driver holds the names of the changed files, as Spark's own listing does, and at most ``buckets`` folder names.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _hadoop(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions whose manifest is complete."""
        folder, files = self._hadoop(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        done = [n for n in names if n.isdigit() and files.exists(self._hadoop(f"{self.path}/manifests/{n}/_SUCCESS")[0])]
        return sorted(map(int, done))

    def manifest(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifests/{version}")

    def _parts(self, manifest: DataFrame) -> set[tuple[int, int]]:
        """(version, bucket) of the folders a manifest names."""
        return {(r["version"], r["bucket"]) for r in manifest.select("version", "bucket").distinct().collect()}

    def _rows(self, parts: set[tuple[int, int]]) -> DataFrame:
        """Rows of bucket folders; a bucket whose files have no rows has no folder."""
        where = [f"{self.path}/rows/version={v}/bucket={b}" for v, b in sorted(parts)]
        found = [p for p in where if self._hadoop(p)[1].exists(self._hadoop(p)[0])]
        shape = self.spark.read.parquet(f"{self.path}/shape").schema
        return self.spark.read.schema(shape).parquet(*found) if found else self.spark.createDataFrame([], shape)

    def current(self) -> DataFrame:
        return self._rows(self._parts(self.manifest(self.versions()[-1])))

    def refresh(self, path: str | list[str], scan: Scan, glob: str = "*.jsonl") -> DataFrame:
        """Rows of all files under ``path`` as they are now.  ``scan(spark, paths)`` parses files to rows with a ``file_path``."""
        listing = fingerprints(self.spark, path, glob).withColumnRenamed("file_path", "uri").withColumn("file_path", _plain("uri"))
        listing = materialise(listing.withColumn("bucket", F.pmod(F.xxhash64("file_path"), F.lit(self.buckets)).cast("int")))
        versions = self.versions()
        version = versions[-1] + 1 if versions else 0
        if versions:
            old = self.manifest(versions[-1])
            changed = materialise(changed_files(listing, old.drop("bucket")))
            gone = old.join(listing.select("file_path"), "file_path", "left_anti")
            touched = {r["bucket"] for r in changed.select("bucket").union(gone.select("bucket")).distinct().collect()}
            parts = self._parts(old)
            if not touched:
                return self._rows(parts)
        else:
            changed, touched, parts = listing, set(range(self.buckets)), set()
            self.parsed(scan(self.spark, path)).drop("bucket").limit(0).write.mode("overwrite").parquet(f"{self.path}/shape")

        names = [r["uri"] for r in changed.select("uri").collect()]
        fresh = [self.parsed(scan(self.spark, [_literal(n) for n in names]))] if names else []
        staying = {(v, b) for v, b in parts if b in touched}
        if staying:
            same = listing.join(changed.select("file_path"), "file_path", "left_anti").select("file_path", "bucket")
            fresh.append(self._rows(staying).join(same, "file_path"))
        if fresh:
            shape = self.spark.read.parquet(f"{self.path}/shape").columns
            rows = reduce(DataFrame.unionByName, [f.select(*shape, "bucket") for f in fresh])
            # A bucket with a huge file is written by many tasks.
            rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={version}")

        before = self.spark.createDataFrame([(b, v) for v, b in parts if b not in touched], "bucket int, before bigint")
        listing.join(F.broadcast(before), "bucket", "left").withColumn("version", F.coalesce("before", F.lit(version).cast("bigint"))).drop("before").write.mode(
            "overwrite").parquet(f"{self.path}/manifests/{version}")
        self._tidy(versions)
        return self.current()

    def parsed(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("file_path", plain_path("file_path"))
        return rows.withColumn("bucket", F.pmod(F.xxhash64("file_path"), F.lit(self.buckets)).cast("int"))

    def _tidy(self, older: list[int]) -> None:
        """Delete what only manifests before the last two name (``older`` are those before the newest)."""
        if len(older) < 2:
            return
        last = self._parts(self.manifest(older[-1])) | self._parts(self.manifest(older[-1] + 1))
        for gone in older[:-1]:
            for v, b in self._parts(self.manifest(gone)) - last:
                folder, files = self._hadoop(f"{self.path}/rows/version={v}/bucket={b}")
                files.delete(folder, True)
            folder, files = self._hadoop(f"{self.path}/manifests/{gone}")
            files.delete(folder, True)


def _literal(path: str) -> str:
    """A file name as the reader takes it, which would read some characters as patterns."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def refresh(spark: SparkSession, path: str | list[str], store: str, scan: Scan, glob: str = "*.jsonl", buckets: int = BUCKETS) -> DataFrame:
    """Parsed rows of all files under ``path``, of which only new and changed files are read."""
    return FileStore(spark, store, buckets).refresh(path, scan, glob)
