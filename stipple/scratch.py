"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting to delete a query's shuffle files when it ends; nothing else can read those of a write.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[str] = []


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with a scheme: one without is of the cluster's default file system, as in Spark's own readers."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    default = jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(conf)
    scheme = place.toUri().getScheme() or default.getScheme()
    if scheme != "file":
        return place.makeQualified(default, jvm.org.apache.hadoop.fs.Path("/")).toString()
    return "file://" + place.toUri().getPath()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh directory URI in the folder that spark.checkpoint.dir names.

    A local temporary folder is used only when the setting is missing and the master is local.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stipple-")
        spark.conf.set("spark.checkpoint.dir", base)
    base = qualified(spark, base)
    _made.append(f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def materialize(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back.

    Cuts the lineage at replicated storage, so that a lost executor costs a re-read and not a recomputation. The
    shuffle files behind the table go as soon as it is written. options: of the Parquet writer.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` at once, which nothing that is still to be computed may read."""
    for df in tables:
        names = {file.split("/")[-2] for file in df.inputFiles()}
        for path in [p for p in _made if p.rsplit("/", 1)[1] in names]:
            place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            _made.remove(path)


def clear_scratch(spark: SparkSession) -> int:
    """Deletes what this process has put into the scratch folder, and returns how many tables and files that were.

    To be called when no result that was made from them is needed any more.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
