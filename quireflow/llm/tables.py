"""Written tables in the folder that the whole cluster shares, and small helpers that several operators need."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, which the whole cluster must share. Without it there is no place for written tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables written in the step that is running, if one is.
_step: ContextVar[list[str] | None] = ContextVar("step", default=None)
#: Spark's setting by which the shuffle files of a query go when it has ended.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder, partitioned by columns if some are given: later steps read files that outlive any executor.

    Nothing before the table is needed again, so the shuffle files of the query that writes it are freed.
    """
    conf, path = df.sparkSession.conf, new_path(df.sparkSession, name)
    if (own := _step.get()) is not None:
        own.append(path)
    before = conf.get(_FREE, None)
    conf.set(_FREE, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        conf.unset(_FREE) if before is None else conf.set(_FREE, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a written table, in whatever file system it is; one that is gone already is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def finished(spark: SparkSession, name: str, make: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """What make() gives, as a written table, partitioned by columns if some are given; all other tables written meanwhile are deleted, and if it fails all of them.

    Steps may be nested: the result of an inner one is a table of the outer one. What make() gives may read nothing that is deleted: only the result is handed out.
    """
    outer, own = _step.get(), []
    token = _step.set(own)
    kept = None
    try:
        result = written(make(), name, by)
        kept = own[-1]
        if outer is not None:
            outer.append(kept)
        return result
    finally:
        _step.reset(token)
        for path in own:
            if path != kept:
                delete(spark, path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_or_not(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most so many (narrow) rows; else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df
