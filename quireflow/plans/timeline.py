"""Event time over `events`: counts, joins and expiries on streams whose rows come in several runs, some late, with a restart before each; polling; as-of joins.

A row arrives as many hours after its time as its property k modulo 24 says; where k is 95 or more it comes 15 days after, unless it is of the last ten days. What has arrived is
processed every eight days. The SQL finds from that which rows came behind the watermark, and leaves out what is not closed at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import records as RE
from ..operators import timeline as T
from ..streaming import expiry as E
from ..streaming import polling as P
from ..streaming import windows as S
from .registry import Registry, place_of_its_own, table

ADD = Registry()

#: How late a row may be, and the days between runs.
LATE, DAYS = "2 days", 8


def _arrival(time: Column) -> Column:
    """Number of the run by which a row has arrived."""
    k = F.get_json_object("props", "$.k").cast("int")
    hours = F.when((k >= 95) & (time < F.lit("2024-01-21").cast("timestamp_ntz")), 15 * 24).otherwise(k % 24)
    return F.floor(F.datediff(F.timestamp_add("HOUR", hours, time), F.lit("2024-01-01")) / DAYS)


def _runs(spark, d, plan: Callable[[DataFrame], DataFrame], settings: dict[str, str] | None = None) -> DataFrame:
    """What a stream of events gives after all runs, each of which starts it anew from its checkpoint."""
    place, events = place_of_its_own(spark, "stream"), table(spark, d, "events")
    for _ in S.arrivals(events, _arrival(F.col("ts")), f"{place}/in"):
        S.catch_up(plan(spark.readStream.schema(events.schema).parquet(f"{place}/in")), place, settings=settings)
    return spark.read.parquet(f"{place}/out")


def _clock(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# `runs` has every event and its run; `marks` the watermark under which a run's rows count as late, and the last one; `which` restricts the rows whose times move it.
_RUNS = """
runs AS (SELECT *, datediff('day', DATE '2024-01-01', (ts + INTERVAL 1 HOUR * CASE WHEN k >= 95 AND ts < TIMESTAMP '2024-01-21' THEN 360 ELSE k % 24 END)::DATE) // 8 AS run FROM (SELECT *, (props->>'k')::INT AS k FROM events)),
marks AS (SELECT run, max(high) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS mark, max(high) OVER () - INTERVAL 2 DAY AS last FROM (SELECT run, date_trunc('millisecond', {high}) AS high FROM runs GROUP BY run))"""
_ONE = _RUNS.format(high="max(ts)")


@ADD(f"""
WITH {_ONE}, w AS (SELECT *, time_bucket(INTERVAL 6 hour, ts) AS start FROM runs JOIN marks USING (run))
SELECT strftime(start, '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM w WHERE (mark IS NULL OR start + INTERVAL 6 hour > mark) AND start + INTERVAL 6 hour <= last GROUP BY ALL""")
def stream_windows(spark, d):
    out = _runs(spark, d, lambda rows: S.window_counts(rows, late=LATE, width="6 hours", by=("event_type",)))
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


@ADD(f"""
WITH {_ONE}, w AS (SELECT *, unnest([time_bucket(INTERVAL 6 hour, ts), time_bucket(INTERVAL 6 hour, ts) - INTERVAL 6 hour]) AS start FROM runs JOIN marks USING (run))
SELECT strftime(start, '%Y-%m-%d %H') AS start, count(*) AS n FROM w WHERE (mark IS NULL OR start + INTERVAL 12 hour > mark) AND start + INTERVAL 12 hour <= last GROUP BY ALL""")
def stream_sliding_windows(spark, d):
    out = _runs(spark, d, lambda rows: S.window_counts(rows, late=LATE, width="12 hours", slide="6 hours"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n")


@ADD(f"""
WITH {_ONE}, kept AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since FROM runs JOIN marks USING (run) WHERE mark IS NULL OR ts + INTERVAL 12 hour > mark),
s AS (SELECT *, count(*) FILTER (since IS NULL OR since >= INTERVAL 12 hour) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM kept)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 12 hour, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 12 hour <= any_value(last)""")
def stream_sessions(spark, d):
    out = _runs(spark, d, lambda rows: S.session_counts(rows, by=("user_id",), late=LATE, gap="12 hours"))
    return out.select("user_id", _clock("start").alias("start"), _clock("end").alias("end"), "n")


def _views_and_purchases(events: DataFrame) -> DataFrame:
    views = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("viewed"))
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought"))
    return S.follow_up(views, bought, key="user_id", first_time="viewed", then_time="bought", late=LATE, within="12 HOURS")


@ADD(f"""
WITH {_RUNS.format(high="least(max(ts) FILTER (event_type = 'view'), max(ts) FILTER (event_type = 'purchase'))")}, kept AS (SELECT * FROM runs JOIN marks USING (run) WHERE mark IS NULL OR ts > mark),
v AS (SELECT * FROM kept WHERE event_type = 'view'), p AS (SELECT * FROM kept WHERE event_type = 'purchase')
SELECT v.user_id, v.event_id AS view_id, p.event_id AS purchase_id FROM v LEFT JOIN p ON p.user_id = v.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 12 hour WHERE p.event_id IS NOT NULL OR v.ts + INTERVAL 12 hour < v.last""")
def stream_follow_up(spark, d):
    """Purchases within twelve hours of a view of the same user, and the views that none follows."""
    return _runs(spark, d, _views_and_purchases).select("user_id", "view_id", "purchase_id")


@ADD("""
WITH v AS (SELECT * FROM events WHERE event_type = 'view'), p AS (SELECT * FROM events WHERE event_type = 'purchase')
SELECT v.user_id, v.event_id AS view_id, p.event_id AS purchase_id FROM v LEFT JOIN p ON p.user_id = v.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 12 hour""")
def follow_up(spark, d):
    """The same over the whole table at once."""
    return _views_and_purchases(table(spark, d, "events")).select("user_id", "view_id", "purchase_id")


_KINDS = {"view": "documents", "error": "documents", "click": "summaries", "signup": "list", "purchase": "detail"}


def _answers(events: DataFrame) -> DataFrame:
    """Answers of four kinds; one of a value below 10 has something pending or is empty."""
    kind = F.col("event_type")
    for name, of in _KINDS.items():
        kind = F.when(F.col("event_type") == name, of).otherwise(kind)
    short = F.col("value") < 10
    return events.select("user_id", kind.alias("kind"), "event_id", "ts", RE.cache_seconds_by(kind, short).alias("kept"))


_ENDS = """
a AS (SELECT *, CASE event_type WHEN 'view' THEN 'documents' WHEN 'error' THEN 'documents' WHEN 'click' THEN 'summaries' WHEN 'signup' THEN 'list' ELSE 'detail' END AS kind FROM {rows}),
t AS (SELECT *, ts + INTERVAL 1 SECOND * CASE kind WHEN 'documents' THEN if(value < 10, 10, 300) WHEN 'summaries' THEN if(value < 10, 5, 86400) WHEN 'list' THEN 120 ELSE 300 END AS ended, lead(ts) OVER (PARTITION BY user_id, kind ORDER BY ts, event_id) AS next FROM a)
SELECT user_id, kind, event_id, strftime(ended, '%Y-%m-%d %H:%M:%S.%f') AS ended FROM t WHERE (next IS NULL OR next >= ended)"""


@ADD(f"WITH {_ONE}, kept AS (SELECT * FROM runs JOIN marks USING (run) WHERE mark IS NULL OR ts > mark), {_ENDS.format(rows='kept')} AND ended <= last")
def stream_expiries(spark, d):
    """Answers that were kept until they expired, by kind and by whether they were short."""
    plan = lambda rows: E.expiries(_answers(rows), keys=["user_id", "kind"], id="event_id", time="ts", kept="kept", late=LATE)
    out = _runs(spark, d, plan, E.STATE_STORE)
    return out.select("user_id", "kind", F.col("id").alias("event_id"), _clock("ended").alias("ended"))


_STATUS = "CASE WHEN ts = max(ts) FILTER (ts < TIMESTAMP '2024-01-25') OVER (PARTITION BY event_id % 500) OR ts >= TIMESTAMP '2024-01-25' THEN 'indexed' ELSE 'processing' END"


@ADD(f"""
WITH e AS (SELECT event_id % 500 AS document_id, event_id, ts, {_STATUS} AS status, datediff('day', DATE '2024-01-01', ts::DATE) // 6 AS run FROM events),
r AS (SELECT DISTINCT run FROM e), l AS (SELECT r.run, document_id, max_by(status, (ts, event_id)) AS status FROM r JOIN e ON e.run <= r.run GROUP BY ALL),
p AS (SELECT run, count(*) AS listed, count(*) FILTER (status = 'processing') AS pending FROM l GROUP BY run)
SELECT listed, pending, (SELECT count(*) FROM r WHERE r.run <= p.run) AS runs FROM p WHERE run = (SELECT min(run) FROM p WHERE pending = 0)""")
def polled_until_done(spark, d):
    """Statuses that arrive every six days, polled until none is pending: documents listed by then, of these pending, and runs that were needed."""
    place, events = place_of_its_own(spark, "stream"), table(spark, d, "events")
    rows = events.select((F.col("event_id") % 500).alias("document_id"), "event_id", "ts")
    done = rows.where("ts < timestamp_ntz'2024-01-25'").groupBy("document_id").agg(F.max("ts").alias("done"))
    status = F.when((F.col("ts") == F.col("done")) | (F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz")), "indexed").otherwise("processing")
    rows = rows.join(done, "document_id", "left").withColumn("status", status).drop("done")
    feed = S.arrivals(rows, F.floor(F.datediff("ts", F.lit("2024-01-01")) / 6), f"{place}/in")
    first = next(feed)
    changes = spark.readStream.schema(rows.schema).parquet(f"{place}/in")
    fed = [first]

    def steps():
        yield first
        for n in feed:
            fed.append(n)
            yield n

    seen = P.poll(changes, key="document_id", status="status", order=("ts", "event_id"), checkpoint=f"{place}/checkpoint", every="0 seconds", sources=steps())
    return spark.createDataFrame([(seen[-1][1], seen[-1][2], len(fed))], "listed long, pending long, runs long")


@ADD("""
WITH m AS (SELECT event_id AS message_id, user_id, ts FROM events WHERE event_type IN ('purchase', 'error')),
s AS (SELECT user_id, ts AS since, max_by(event_type, event_id) AS status FROM events WHERE event_type NOT IN ('purchase', 'error') GROUP BY user_id, ts)
SELECT message_id, m.user_id, status, strftime(since, '%Y-%m-%d %H:%M:%S.%f') AS since FROM m ASOF LEFT JOIN s ON s.user_id = m.user_id AND s.since <= m.ts""")
def status_at_message(spark, d):
    """What each user's status was at the time of each of their messages: views, clicks and sign-ups are statuses, purchases and errors messages."""
    events = table(spark, d, "events")
    message = F.col("event_type").isin("purchase", "error")
    messages = events.where(message).select(F.col("event_id").alias("message_id"), "user_id", "ts")
    statuses = events.where(~message).select("user_id", F.col("event_type").alias("status"), F.col("ts").alias("since"), F.col("event_id").alias("status_id"))
    found = T.as_of(messages, statuses, ["user_id"], left_time="ts", right_time="since", order="status_id")
    return found.select("message_id", "user_id", "status", _clock("since").alias("since"))


@ADD("SELECT v.event_id AS view_id, e.event_id AS error_id FROM events v JOIN events e ON e.user_id = v.user_id AND e.ts BETWEEN v.ts AND v.ts + INTERVAL 6 hour WHERE v.event_type = 'view' AND e.event_type = 'error'")
def errors_within_views(spark, d):
    """Errors of a user in the six hours that follow a view."""
    events = table(spark, d, "events")
    views = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("start"), F.timestamp_add("HOUR", F.lit(6), "ts").alias("end"))
    errors = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), "ts")
    return T.within(views, errors, "user_id", start="start", end="end", time="ts", stretch=6 * 3600).select("view_id", "error_id")
