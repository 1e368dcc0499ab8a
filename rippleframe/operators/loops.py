"""Lineage cuts for driver loops, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: dict[str, list[str]] = {}  # by application


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own where it is unset and all tasks run on this machine."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not jsc.isLocal():
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="ckpt-")
        spark.sparkContext.setCheckpointDir(folder)
    return jsc.getCheckpointDir().get()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for files that Python reads and writes, which goes with `release`."""
    at = shared_dir(spark)
    scheme, _, rest = at.partition(":")
    if rest and scheme != "file":
        raise RuntimeError(f"Python cannot write files to {at}: spark.checkpoint.dir must be a mounted folder")
    path = "/" + (rest or at).lstrip("/") + f"/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append("file://" + path)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # at the end of an execution, not when the driver collects garbage


def cut(df: DataFrame) -> DataFrame:
    """The same rows as a written table: survives lost executors, ends the lineage. The shuffle files of
    the write go with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def cut_counted(df: DataFrame, where: str | None = None) -> tuple[DataFrame, int]:
    """`cut`, and the number of rows, which the write itself counts; with `where` the number of rows where
    that boolean column, which is not written, is true."""
    seen = Observation()
    counted = df.observe(seen, (F.count_if(where) if where else F.count(F.lit(1))).alias("n"))
    out = cut(counted.drop(where) if where else counted)
    return out, seen.get["n"]


def forget(*tables: DataFrame) -> None:
    """Remove tables that `cut` wrote, when nothing reads them any more."""
    for table in tables:
        spark, at = table.sparkSession, table._cut_path
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _written[spark.sparkContext.applicationId].remove(at)


def release(spark: SparkSession) -> int:
    """Remove all tables that `cut` wrote in this application, when no result that reads them is wanted
    any more; returns their number."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)
