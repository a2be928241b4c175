"""Counts over event time, and joins of two streams, with rows that come late; each works on tables as well."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def timed(rows: DataFrame, time: str, late: str) -> DataFrame:
    """rows with time as a timestamp of the session's zone and, on a stream, a watermark: what ends so long before the latest time seen is closed."""
    rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late) if rows.isStreaming else rows


def window_counts(rows: DataFrame, *, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", slide: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(start, end, *by, n) of tumbling windows or, with slide, of overlapping ones. A row without time is in none.

    On a stream a window comes out once, when the watermark has passed its end; rows that come after that are dropped.
    """
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return timed(rows, time, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")


def session_counts(rows: DataFrame, *, by: tuple[str, ...], time: str = "ts", late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """(start, end, *by, n) of sessions: runs of rows of the same key, each less than the gap after the one before; a session ends one gap after its last row."""
    return timed(rows, time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")


def follow_up(first: DataFrame, then: DataFrame, *, key: str, first_time: str, then_time: str, late: str = "10 minutes", within: str = "1 hour", outer: bool = True) -> DataFrame:
    """Rows of first with those of then of the same key that come at the same time or up to `within` after; with outer also those of first that none follows.

    Columns but the key must differ. Two streams keep rows of either side as long as a partner may come: a row of then until the watermark has passed it, one of first until it is
    `within` behind, when it comes out without partner if it had none. Rows that come behind the watermark are dropped. A null key has no partner.
    """
    a, b = timed(first, first_time, late).alias("a"), timed(then, then_time, late).alias("b")
    soon = F.col(f"b.{then_time}").between(F.col(f"a.{first_time}"), F.col(f"a.{first_time}") + F.expr(f"INTERVAL {within}"))
    joined = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & soon, "left" if outer else "inner")
    return joined.drop(F.col(f"b.{key}"))


def arrivals(rows: DataFrame, number: Column, folder: str) -> Iterator[int]:
    """Appends rows to folder one batch after the other, by ascending number, and yields that number; a row without number never comes. Numbers are counted to be few: they are collected.

    Rows are read and numbered once, and dealt to folders by their numbers beside `folder`, each of which is read when its rows come.
    """
    spark, dealt = rows.sparkSession, f"{folder}-dealt"
    rows.withColumn("__batch", number.cast("long")).write.partitionBy("__batch").parquet(dealt)
    numbered = StructType([*rows.schema.fields, StructField("__batch", LongType())])
    for (n,) in sorted(spark.read.schema(numbered).parquet(dealt).where(F.col("__batch").isNotNull()).select("__batch").distinct().collect()):
        spark.read.schema(rows.schema).parquet(f"{dealt}/__batch={n}").write.mode("append").parquet(folder)
        yield n


def catch_up(stream: DataFrame, folder: str, mode: str = "append", settings: dict[str, str] | None = None, once: bool = False) -> list[dict]:
    """Adds to folder/out what the stream has new, from the checkpoint in folder, and stops. Returns the progress of its batches, the last of which only closes what the watermark has passed.

    settings hold while the query starts. State that ends by the clock always has another batch to do: with `once` there is only one. A run that fails goes on where it was when it is started again, and out holds each batch once.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        query = _start(stream, folder, mode, once)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress]


def _start(stream: DataFrame, folder: str, mode: str, once: bool) -> StreamingQuery:
    return stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(**({"once": True} if once else {"availableNow": True})).start()
