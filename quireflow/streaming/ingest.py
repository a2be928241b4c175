"""Documents as a stream: ingest with isolated failures, lifecycle states, time-outs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def run_available(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Processes all there is, batch by batch, exactly as often as the checkpoint lacks it, and stops."""
    query = stream.writeStream.foreachBatch(process).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_folder(spark: SparkSession, path: str, schema, form: str = "parquet", files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(path)


def windowed_counts(events: DataFrame, *, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Events per window and kind; works on tables and, with a watermark, on streams. Times without zone are taken as the session's."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def latest_state(events: DataFrame, key: str, state: str, time: str, tie: str) -> DataFrame:
    """The last state of each key."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(time, tie)).alias("state"), F.max(time).alias("since"))


def expired(docs: DataFrame, now, minutes: int = 20) -> DataFrame:
    """Documents with those still unfinished after so many minutes marked failed."""
    late = F.col("status").isin("uploaded", "processing") & (F.col("upload_time") < F.lit(now) - F.expr(f"interval {minutes} minutes"))
    return docs.withColumn("status", F.when(late, "failed").otherwise(F.col("status")))


def lifecycle(events: DataFrame, key: str = "document_id", minutes: int = 20, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """(document_id, status) changes from a stream of (document_id, status, ts); an unfinished document without news for so many minutes fails.

    State per document is its last status and time; changes of one batch count in the order of columns.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status = state.get[0]
            state.remove()
            if status in ("uploaded", "processing"):
                yield pd.DataFrame({key: [k[0]], "status": ["failed"]})
            return
        status, at = state.get if state.exists else (None, -1)
        for frame in frames:
            newest = frame[frame["ts"] == frame["ts"].max()]
            if len(newest) and (ms := int(newest["ts"].iloc[0].timestamp() * 1000)) >= at:
                status, at = newest.sort_values(list(order))["status"].iloc[-1], ms
        state.update((status, at))
        if status in ("uploaded", "processing"):
            state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs()) + minutes * 60_000)
        yield pd.DataFrame({key: [k[0]], "status": [status]})

    kind = events.schema[key].dataType.simpleString()
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string", "status string, at long", "update", GroupStateTimeout.EventTimeTimeout)
