"""Tables that micro-batches add to: partial results, merged level by level.

A batch writes one small folder, ``level-first-last`` with its own number twice.  Before it does, any level that has
``fan`` folders of earlier batches is combined into one folder of the next level, which covers the same range of batch
numbers.  So a row is rewritten once per level, and folders number at most ``fan`` a level, whatever the number of batches.

Readers take, of the complete folders (Spark leaves ``_SUCCESS`` last), the widest that overlap no other.  Folders that a
wider one covers are deleted by the batch after the one that merged them, so a reader of the old ones can finish.  A batch
that is tried again overwrites its own folder, or writes one that is covered already and is ignored; a merge never holds
the batch that runs, so ``before`` can always leave that one out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Folders of a level before they are merged.
FAN = 8


class LevelledTable:
    """``combine`` folds any number of partial rows per key into one of the same schema, in any order and grouping."""

    def __init__(self, spark: SparkSession, path: str, schema: str, combine: Callable[[DataFrame], DataFrame], fan: int = FAN) -> None:
        self.spark, self.path, self.schema, self.combine, self.fan = spark, path.rstrip("/"), schema, combine, fan
        self.columns = [part.split()[0] for part in schema.split(", ")]

    def _folders(self) -> list[tuple[int, int, int]]:
        """(level, first batch, last batch) of the complete folders."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        return sorted(tuple(map(int, p.getName().split("-"))) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _cover(self, before: int | None = None) -> list[tuple[int, int, int]]:
        """Disjoint folders that hold every batch, or every batch before a number."""
        taken: list[tuple[int, int, int]] = []
        reach = -1
        for folder in sorted(self._folders(), key=lambda f: (f[1], -f[2])):
            if folder[1] > reach and (before is None or folder[2] < before):
                taken.append(folder)
                reach = folder[2]
        return taken

    def _where(self, folder: tuple[int, int, int]) -> str:
        return f"{self.path}/{folder[0]}-{folder[1]}-{folder[2]}"

    def _read(self, folders: list[tuple[int, int, int]]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*map(self._where, folders))

    def _write(self, rows: DataFrame, folder: tuple[int, int, int]) -> None:
        rows.select(*self.columns).write.mode("overwrite").parquet(self._where(folder))

    def _tidy(self, batch: int) -> None:
        """Delete what is covered, then merge full levels of earlier batches, the lowest first."""
        cover = set(self._cover())
        for folder in self._folders():
            if folder not in cover and folder[2] < batch:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self._where(folder))
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        level = 0
        while True:
            members = [f for f in self._cover(batch) if f[0] == level]
            if len(members) >= self.fan:
                self._write(self.combine(self._read(members)), (level + 1, members[0][1], members[-1][2]))
            elif level >= max((f[0] for f in self._cover(batch)), default=0):
                return
            level += 1

    def append(self, batch: int, partial: DataFrame) -> None:
        """Add the folded rows of one batch."""
        self._tidy(batch)
        self._write(partial, (0, batch, batch))

    def before(self, batch: int) -> DataFrame:
        """Rows as of all batches before the one that runs."""
        return self.combine(self._read(self._cover(batch)))

    def current(self) -> DataFrame:
        return self.combine(self._read(self._cover()))
