"""Streams over `events`, each with the batch query that it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ingest as I
from .registry import Registry, place_of_its_own, table

ADD = Registry()


def _place(spark) -> str:
    return place_of_its_own(spark, "stream")


@ADD("SELECT user_id, max_by(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id")
def lifecycle_latest(spark, d):
    return I.latest_state(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id").select("user_id", "state")


@ADD("SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    return I.windowed_counts(table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@ADD("SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) AND doc_id % 60 > 20 THEN 'failed' ELSE ['uploaded', 'processing', 'indexed', 'failed'][doc_id % 4 + 1] END AS status FROM documents")
def expired_uploads(spark, d):
    now = F.lit("2026-01-01 12:00:00").cast("timestamp")
    docs = table(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, ("uploaded", "processing", "indexed", "failed"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("status"), F.timestamp_add("MINUTE", -(F.col("doc_id") % 60), now).alias("upload_time"))
    return I.expired(docs, now).select("doc_id", "status")


@ADD("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_ingest_counts(spark, d):
    """The events table read as a stream and appended batch by batch; the result is what was written."""
    schema = table(spark, d, "events").schema
    place = _place(spark)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    I.run_available(stream, lambda batch, n: batch.select("event_type").write.mode("append").parquet(f"{place}/out"), f"{place}/checkpoint")
    return spark.read.parquet(f"{place}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@ADD("""
WITH e AS (SELECT event_id % 500 AS document_id, CASE event_type WHEN 'purchase' THEN 'indexed' ELSE 'processing' END AS status, ts, event_id FROM events),
l AS (SELECT document_id, max_by(status, (ts, event_id)) AS status, max(ts) AS ts FROM e GROUP BY document_id)
SELECT document_id, CASE WHEN status = 'processing' AND ts + INTERVAL 20 MINUTE <= (SELECT max(ts) FROM e) - INTERVAL 10 MINUTE THEN 'failed' ELSE status END AS status FROM l""")
def lifecycle_stream(spark, d):
    """States of documents from a stream of their changes; one without news for 20 minutes of event time fails. Batches are numbered, the last state of each is kept."""
    place, source = _place(spark), table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    status = F.when(F.col("event_type") == "purchase", "indexed").otherwise("processing")
    states = I.lifecycle(stream.select((F.col("event_id") % 500).alias("document_id"), status.alias("status"), "ts", "event_id"), order=("ts", "event_id"))
    I.run_available(states, lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{place}/out"), f"{place}/checkpoint", "update")
    return spark.read.parquet(f"{place}/out").groupBy("document_id").agg(F.max_by("status", "batch").alias("status"))
