"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings every job relies on.  All are plain SQL settings, so they can
#: be applied to a session that somebody else built.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

#: Settings that only a new session can take; a session built elsewhere works without them.
#: Call-site capture for every Column costs more than planning itself.
AT_START = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


#: Tables this process wrote, and the folders of local sessions without a shared one.
_WRITTEN: list[str] = []
_LOCAL_FOLDERS: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators assume (UTC clock, adaptive execution)."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build(app: str = "tallyloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session for scripts, tests and the bench; a cluster passes its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **AT_START, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(os.environ.get("TALLYLOOM_LOG", "ERROR"))
    return prepare(spark)


def work_folder(spark: SparkSession) -> str:
    """The folder every executor sees, named by ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a folder of its own; on a
    cluster there is no fall-back to a machine-local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder every executor can reach")
        application = spark.sparkContext.applicationId
        if application not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="tallyloom-")
        folder = _LOCAL_FOLDERS[application]
    return f"{folder.rstrip('/')}/tallyloom"


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables this process wrote, once no result needs them."""
    gone = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def register(path: str) -> None:
    """Have ``release`` delete a table that was written elsewhere."""
    _WRITTEN.append(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write an intermediate result once and read it back, so that several consumers
    share it and a lost executor costs one read, not the whole lineage."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)
