"""Streams over several runs with restarts and failures, state that shrinks, polling, expiry, and joins by time against loops."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quireflow.operators import timeline as T
from quireflow.streaming import expiry as E
from quireflow.streaming import polling as P
from quireflow.streaming import windows as S

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).parquet(f"{folder}/in")


def test_late_rows_are_dropped_and_state_shrinks(spark, tmp_path):
    place, schema = f"file://{tmp_path}", "k string, ts timestamp"
    plan = lambda stream: S.window_counts(stream, late="10 minutes", width="10 minutes", by=("k",))
    batches = [[("a", at(1)), ("a", at(12)), ("b", at(25))], [("a", at(13)), ("a", at(3)), ("b", at(45)), (None, at(46)), ("a", None)], [("a", at(47)), ("b", at(120))]]
    told = [S.catch_up(plan(feed(spark, place, b, schema)), place) for b in batches]
    state = [p["stateOperators"][0] for run in told for p in run]
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 1 and sum(s["numRowsRemoved"] for s in state) > 0
    assert state[-1]["numRowsTotal"] == 1
    got = sorted((str(x.k), int((x.start - START).total_seconds()) // 60, x.n) for x in spark.read.parquet(f"{place}/out").collect())
    assert got == [("None", 40, 1), ("a", 0, 1), ("a", 10, 2), ("a", 40, 1), ("b", 20, 1), ("b", 40, 1)]
    assert S.catch_up(plan(spark.readStream.schema(schema).parquet(f"{place}/in")), place) == [] or len(spark.read.parquet(f"{place}/out").collect()) == len(got)


def test_a_failed_batch_is_done_again_once(spark, tmp_path):
    place, schema = f"file://{tmp_path}", "k string, ts timestamp"
    flag = tmp_path / "broken"

    @F.udf("boolean")
    def works(k):
        if k == "bad" and flag.exists():
            raise ValueError("not now")
        return True

    plan = lambda stream: S.window_counts(stream.where(works("k")), late="0 minutes", width="10 minutes")
    S.catch_up(plan(feed(spark, place, [("a", at(1)), ("a", at(15))], schema)), place)
    flag.write_text("")
    stream = plan(feed(spark, place, [("bad", at(16)), ("a", at(40))], schema))
    with pytest.raises(Exception, match="not now"):
        S.catch_up(stream, place)
    flag.unlink()
    S.catch_up(stream, place)
    assert sorted((x.start, x.n) for x in spark.read.parquet(f"{place}/out").collect()) == [(at(0), 1), (at(10), 2)]


def test_partners_are_kept_until_the_watermark_passes(spark, tmp_path):
    place, schema = f"file://{tmp_path}", "kind string, k string, id long, ts timestamp"

    def plan(stream):
        asked = stream.where("kind = 'q'").select("k", F.col("id").alias("q"), F.col("ts").alias("asked"))
        told = stream.where("kind = 'a'").select("k", F.col("id").alias("a"), F.col("ts").alias("told"))
        return S.follow_up(asked, told, key="k", first_time="asked", then_time="told", late="5 minutes", within="30 MINUTES")

    rows = [("q", "x", 1, at(0)), ("q", "x", 2, at(20)), ("a", "y", 3, at(10)), ("q", None, 4, at(6)), ("a", "x", 5, at(30)), ("a", "x", 6, at(30)), ("q", "y", 7, at(200)), ("a", "y", 8, at(231)), ("q", "z", 9, at(500)), ("a", "z", 10, at(500)), ("a", "z", 11, at(600)), ("q", "z", 12, at(600))]
    told = [S.catch_up(plan(feed(spark, place, rows[low : low + 3], schema)), place) for low in range(0, len(rows), 3)]
    got = {(x.q, x.a) for x in spark.read.parquet(f"{place}/out").collect()}
    table = plan(spark.createDataFrame(rows, schema)).select("q", "a").collect()
    assert got == {(1, 5), (1, 6), (2, 5), (2, 6), (4, None), (7, None), (9, 10), (12, 11)} == {tuple(x) for x in table}
    totals = [p["stateOperators"][0]["numRowsTotal"] for run in told for p in run]
    assert max(totals) >= 4 and totals[-1] == 2


def test_polling_stops_with_the_batch_that_leaves_nothing_pending(spark, tmp_path):
    place, schema = f"file://{tmp_path}", "id long, status string, n long"
    batches = [[(1, "uploaded", 0), (2, "processing", 0)], [(1, "indexed", 1), (3, "indexed", 1)], [(2, "failed", 2), (2, "processing", 1)], [(4, "uploaded", 3)]]

    def go(batches, folder, **how):
        fed = []

        def steps():
            for b in batches:
                fed.append(feed(spark, folder, b, schema))
                yield

        steps_ = steps()
        next(steps_)
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")

        def all_steps():
            yield
            yield from steps_

        return P.poll(stream, key="id", status="status", order=("n",), checkpoint=f"{folder}/checkpoint", every="0 seconds", sources=all_steps(), **how), len(fed)

    seen, fed = go(batches, place)
    assert [x[1:] for x in seen] == [(2, 2), (3, 1), (3, 0)] and fed == 3
    seen, fed = go(batches[:2], f"{place}/more")
    assert [x[2] for x in seen] == [2, 1] and fed == 2
    stream = feed(spark, f"{place}/slow", batches[0], schema)
    with pytest.raises(TimeoutError):
        P.poll(stream, key="id", status="status", order=("n",), checkpoint=f"{place}/slow/checkpoint", every="0 seconds", longest=4)
    assert not spark.streams.active


def test_answers_expire_whatever_their_order(spark, tmp_path):
    r, place, schema = random.Random(8), f"file://{tmp_path}", "k string, id long, ts timestamp, kept int"
    rows = [(r.choice("ab"), i, at(r.randrange(600) / 10), r.choice([5, 60, 600])) for i in range(120)]
    plan = lambda s: E.expiries(s, keys=["k"], id="id", time="ts", kept="kept", late="2 hours")
    for low in range(0, 120, 40):
        S.catch_up(plan(feed(spark, place, rows[low : low + 40], schema)), place, settings=E.STATE_STORE)
    S.catch_up(plan(feed(spark, place, [("a", 999, at(400), 5), ("b", None, at(400), 5), ("b", 1000, at(400), None)], schema)), place, settings=E.STATE_STORE)
    want = {(k, i) for k, i, t, kept in rows if not any(k2 == k and (t, i) < (t2, i2) and t2 < t + timedelta(seconds=kept) for k2, i2, t2, _ in rows)}
    assert {(x.k, x.id) for x in spark.read.parquet(f"{place}/out").collect()} == want and 20 < len(want) < 120


def test_answers_of_a_group_are_settled_at_once():
    """By one call for all keys of a group, whatever the watermark; what is held is what is open or may still replace one that comes late."""
    r = random.Random(9)
    answers = [((r.choice(["1", "2", None]),), i % 50, r.randrange(90) * 1000, 0, False) for i in range(60)]
    answers = [(k, i, t, t + r.choice([0, 1500, 9000, 40_000]), o) for k, i, t, _, o in answers]
    over = {x: any(y[0] == x[0] and (x[2], x[1]) < (y[2], y[1]) and y[2] < x[3] for y in answers) for x in answers}
    held, told = [], []
    for low, now in ((0, 0), (20, 0), (40, 0), (60, 10), (60, 45), (60, 46), (60, 200)):
        held, kept, first = E._settled(held + answers[low : low + 20], now)
        told += kept
        assert first == min((-(-x[3] // 1000) for x in held if not x[4]), default=None) and (first is None or first > now)
        assert all(not x[4] or -(-x[2] // 1000) > now for x in held)
    assert sorted(map(str, told)) == sorted(str((x[0], x[1], x[3])) for x in answers if not over[x]) and not held


def test_state_that_ends_by_itself(spark, tmp_path):
    place, schema = f"file://{tmp_path}", "k string, id long"

    def ask(folder, rows):
        kept = 1_500 if folder.endswith("short") else 600_000
        S.catch_up(E.remembered(feed(spark, folder, rows, schema), keys=["k"], id="id", ms=kept), folder, settings=E.STATE_STORE, once=True)
        return {(x.k, x.id): x.hit for x in spark.read.parquet(f"{folder}/out").collect()}

    for folder, again in ((f"{place}/short", False), (f"{place}/long", True)):
        assert ask(folder, [("a", 1), ("a", 2)]) == {("a", 1): False}
        time.sleep(2)
        assert ask(folder, [("a", 3), ("b", 4)]) == {("a", 1): False, ("a", 3): again, ("b", 4): False}


def test_joins_by_time_against_loops(spark):
    r = random.Random(6)
    key = lambda: r.choice(["hot", "hot", "hot", "x", None])
    left = [(i, key(), r.choice([None, *[at(m) for m in range(0, 9000, 37)]])) for i in range(150)]
    right = [(key(), r.choice([None, *[at(m) for m in range(0, 9000, 37)]]), i, r.choice(["p", None])) for i in range(90)]
    a, b = spark.createDataFrame(left, "id long, k string, ts timestamp"), spark.createDataFrame(right, "k string, since timestamp, n long, status string")
    for stretch in (600, 86_400, 10**8):
        got = {x.id: (x.since, x.n, x.status) for x in T.as_of(a, b, ["k"], left_time="ts", right_time="since", order="n", stretch=stretch).collect()}
        for i, k, t in left:
            before = [x for x in right if x[0] == k and k is not None and t is not None and x[1] is not None and x[1] <= t]
            best = max(before, key=lambda x: (x[1], x[2]), default=None)
            assert got[i] == (best[1:] if best else (None, None, None))
        assert len(got) == len(left)
    spans = [(i, key(), t, t and t + timedelta(minutes=r.choice([-5, 0, 100, 3000]))) for i, _, t in left]
    c = spark.createDataFrame(spans, "id long, k string, start timestamp, end timestamp")
    for stretch in (3_000, 10**7):
        got = sorted((x.id, x.n) for x in T.within(c, b, "k", start="start", end="end", time="since", stretch=stretch).collect())
        assert got == sorted((i, n) for i, k, s, e in spans for k2, t, n, _ in right if k is not None and k == k2 and s and t and s <= t <= e) and got
    assert T.as_of(a.limit(0), b, ["k"], left_time="ts", right_time="since", order="n").count() == 0
    assert T.as_of(a, b.limit(0), ["k"], left_time="ts", right_time="since", order="n").where("n IS NULL").count() == 150


def test_arrivals_number_rows_once_and_leave_out_those_without_number(spark, tmp_path):
    """Each row's number is found once, whatever the number of batches is."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def numbered(x):
        asked.add(1)
        return None if x == 7 else x % 3 - 1

    rows = spark.createDataFrame([(i, None if i == 4 else f"r{i}") for i in range(9)], "i int, s string")
    came, seen = [], 0
    for n in S.arrivals(rows, numbered("i"), f"file://{tmp_path}/in"):
        there = sorted(x.i for x in spark.read.schema(rows.schema).parquet(f"file://{tmp_path}/in").collect())
        came.append((n, len(there) - seen))
        seen = len(there)
    assert came == [(-1, 3), (0, 2), (1, 3)] and asked.value == len(rows.collect())
    assert {tuple(x) for x in spark.read.parquet(f"file://{tmp_path}/in").collect()} == {tuple(x) for x in rows.collect() if x.i != 7}
