"""Calls and their outcomes, archives read page by page, checks in one pass, and sketches against exact counts."""

from __future__ import annotations

import sys
import threading
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quireflow.operators import calls as C
from quireflow.operators import quality as Q
from quireflow.operators import sketches as K
from quireflow.plans import services
from quireflow.sources import archive as A
from quireflow.streaming import windows as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module


def client(row, n):
    """Behaves as its row says: `503 503 ok` and so on, one word for each attempt."""
    word = row["does"].split()[n - 1]
    if word.isdigit():
        raise C.Refused(int(word))
    if word == "slow":
        raise TimeoutError("read")
    if word == "broken":
        raise KeyError("x")
    return {"ok": {"label": "yes", "p": 0.5}, "part": {"label": None}, "wrong": {"label": "yes", "p": "much"}}[word]


CASES = {
    "ok": (("yes", 0.5), 1, 0.0, None), "503 ok": (("yes", 0.5), 2, 5.0, None), "503 503 ok": (("yes", 0.5), 3, 15.0, None), "503 503 503": (None, 3, 15.0, 503), "400": (None, 1, 0.0, 400), "503 400": (None, 2, 5.0, 400),
    "slow": (None, 1, 0.0, None), "broken": (None, 1, 0.0, None), "part": ((None, None), 1, 0.0, None), "wrong": (None, 1, 0.0, None), "500": (None, 1, 0.0, 500),
}


def test_outcomes_of_calls(spark, tmp_path):
    rows = spark.createDataFrame([(i, does) for i, does in enumerate(CASES)] + [(None, "ok"), (0, "ok")], "id long, does string").withColumn("other", F.array(F.lit(1)))
    place = f"file://{tmp_path}/called"
    C.call(rows, client, "label string, p double", asked=["does"], sleep=services._no_time).write.parquet(place)
    called = spark.read.parquet(place)
    got = {x.does: (tuple(x.call_answer) if x.call_answer else None, x.call_attempts, x.call_waited, x.call_status) for x in called.collect()}
    assert got == CASES and called.count() == len(CASES) + 2
    answered, failed = C.sorted_out(called)
    assert answered.count() + failed.count() == called.count() and {x.does for x in failed.collect()} == {k for k, v in CASES.items() if v[0] is None}
    errors = {x.does: x.call_error for x in failed.collect()}
    assert errors["broken"].startswith("KeyError") and errors["slow"] == "TimeoutError: read" and errors["400"] == "status 400" and all(errors.values())
    assert C.call(rows.limit(0), client, "label string, p double", asked=["does"]).count() == 0


def test_policies():
    slept: list[float] = []
    assert C.attempt({"does": "slow 500 ok"}, client, C.SUMMARIES, slept.append)[:3] == ({"label": "yes", "p": 0.5}, 3, 4.0) and slept == [2.0, 2.0]
    assert C.attempt({"does": "slow slow slow"}, client, C.SUMMARIES, slept.append)[1] == 3 and C.attempt({"does": "404 ok"}, client, C.SUMMARIES, slept.append)[1] == 1
    assert [C.SUMMARIES.wait(n) for n in (1, 2, 3, 5, 9)] == [2.0, 2.0, 4.0, 16.0, 20.0] and [C.CHECKS.wait(n) for n in (1, 2)] == [5.0, 10.0]
    assert C.summary_answer({"summary": " x "}) == {"summary": "x", "input_tokens": 0, "output_tokens": 0}
    for blank in (None, "", "  "):
        with pytest.raises(ValueError, match="blank"):
            C.summary_answer({"summary": blank})


def test_rows_of_a_batch_are_asked_for_together(spark):
    def slow(row, n):
        meet.wait(20)
        return {"x": row["id"]}

    meet = threading.Barrier(4)
    rows = [{"id": i} for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        assert [x[0] for x in pool.map(lambda r: C.attempt(r, slow, C.CHECKS, services._no_time), rows)] == [{"x": i} for i in range(4)]


def test_calls_hold_a_few_rows_of_a_batch_at_a_time(spark, tmp_path):
    """Several parts of one batch, the last of fewer rows, come back whole; texts that are but asked do not come back."""
    rows = spark.range(1000, numPartitions=1).selectExpr("id", "repeat('x', 2000) AS text", "id % 3 AS other")
    told = C.call(rows, lambda row, n: {"label": str(len(row["text"]))}, "label string", asked=["id", "text"], keep=["id", "other"], sleep=services._no_time)
    assert told.columns == ["id", "other", "call_answer", "call_attempts", "call_waited", "call_status", "call_error"]
    assert [(x.id, x.other, x.call_answer.label) for x in told.orderBy("id").collect()] == [(i, i % 3, "2000") for i in range(1000)]
    assert 1000 % C.HELD_ROWS and C.HELD_ROWS < 1000


class Noted(A.Archive):
    """Twelve pages of two rows; every fetch leaves a file behind."""

    @classmethod
    def name(cls):
        return "noted"

    def last_page(self):
        return int(Path(self.options["path"], "pages").read_text()) - 1

    def fetch(self, number):
        Path(self.options["path"], f"fetched-{number}").touch()
        yield pa.RecordBatch.from_pydict({"page": [number] * 2, "page_id": [10 * number, 10 * number + 1], "url": [f"u{number}", None], "html": ["h", None]})


def fetched(folder):
    out = sorted(int(x.name.split("-")[1]) for x in folder.glob("fetched-*"))
    for x in folder.glob("fetched-*"):
        x.unlink()
    return out


def test_only_the_pages_that_filters_leave_are_fetched(spark, tmp_path):
    A.register(spark, Noted)
    (tmp_path / "pages").write_text("12")
    pages = lambda: spark.read.format("noted").option("path", str(tmp_path)).load()
    for where, wanted in (("true", [*range(12)]), ("page = 4", [4]), ("page > 2 AND page <= 5", [3, 4, 5]), ("page IN (1, 7, 30) AND page < 7", [1]), ("page >= 10 AND url IS NOT NULL", [10, 11]), ("page = 3 AND page = 4", [])):
        rows = pages().where(where)
        assert sorted({x.page for x in rows.collect()}) == wanted and fetched(tmp_path) == wanted
        assert rows.rdd.getNumPartitions() == len(wanted)


def test_new_pages_come_as_a_stream(spark, tmp_path):
    A.register(spark, Noted)
    place = f"file://{tmp_path}/run"
    for there, new in ((3, [0, 1, 2]), (3, []), (7, [3, 4, 5, 6])):
        (tmp_path / "pages").write_text(str(there))
        S.catch_up(spark.readStream.format("noted").option("path", str(tmp_path)).load(), place)
        assert fetched(tmp_path) == new
    assert sorted(x.page_id for x in spark.read.parquet(f"{place}/out").collect()) == sorted(10 * n + k for n in range(7) for k in (0, 1))


@pytest.mark.parametrize("known", [True, False])
def test_a_table_of_many_pages_is_read_by_row_groups(spark, tmp_path, known):
    """Ids in no order, two files of three row groups each: 300 pages are six pieces at most, not 300, and each page has its rows."""
    (tmp_path / "pages.parquet").mkdir()
    ids = [*range(0, 600, 2), *range(599, 0, -2), None]
    for i, half in enumerate((ids[::2], ids[1::2])):
        rows = pa.table({"page_id": pa.array(half, pa.int64()), "url": [f"u{n}" for n in half], "html": [None if n == 7 else "h" * 50 for n in half]})
        pq.write_table(rows, tmp_path / "pages.parquet" / f"{i}.parquet", row_group_size=101, write_statistics=known)
    A.register(spark)
    pages = lambda: spark.read.format("archive").option("path", str(tmp_path / "pages.parquet")).option("size", "2").load()
    for where, wanted in (("true", range(600)), ("page = 4", (8, 9)), ("page > 2 AND page <= 5", range(6, 12)), ("page IN (1, 7, 900) AND page < 7", (2, 3)), ("page < 0", ())):
        rows = pages().where(where)
        assert sorted((x.page, x.page_id, x.url, x.html) for x in rows.collect()) == [(n // 2, n, f"u{n}", None if n == 7 else "h" * 50) for n in wanted]
        assert rows.rdd.getNumPartitions() <= 6
    place = f"file://{tmp_path}/run"
    told = S.catch_up(spark.readStream.format("archive").option("path", str(tmp_path / "pages.parquet")).option("size", "2").load(), place)
    assert sum(x["numInputRows"] for x in told) == 600 and sorted(x.page_id for x in spark.read.parquet(f"{place}/out").collect()) == [*range(600)]


def test_an_archive_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    A.register(spark)
    assert spark.read.format("archive").option("path", f"{tmp_path}/pages.parquet").load().count() == 0


def test_a_report_is_one_pass_over_each_table(spark, tmp_path):
    parents, children = f"file://{tmp_path}/parents", f"file://{tmp_path}/children"
    spark.createDataFrame([(1, "a"), (2, "a"), (None, "")], "id long, name string").write.parquet(parents)
    spark.createDataFrame([(1, 1, "x"), (2, 5, None), (3, None, ""), (4, 1, "y")], "id long, parent long, text string").write.parquet(children)
    tables = {"p": spark.read.parquet(parents), "c": spark.read.parquet(children)}
    checks = [
        Q.counted("p", "n"), Q.unique("p", "names", F.col("name"), "WARN"), Q.filled("c", "text", F.col("text")), Q.Reference("c", "parents", "parent", "p", "id"), Q.no_rows("c", "ids", F.col("id") < 0),
        Q.filled("c", "both", F.col("text"), F.col("parent"), level="WARN"),
    ]
    told = Q.report(tables, checks)
    assert [tuple(x)[2:] for x in told.orderBy("place").collect()] == [("n", 3, 3, "PASS"), ("names", 3, 1, "WARN"), ("text", 4, 2, "FAIL"), ("parents", 4, 2, "FAIL"), ("ids", 4, 0, "PASS"), ("both", 4, 2, "WARN")]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3 and plan.count("Join") == 1  # each table once, and the parent's keys
    empty = Q.report({k: t.limit(0) for k, t in tables.items()}, checks)
    assert {x.status for x in empty.collect()} == {"PASS"}


def test_sketches_of_parts_are_as_good_as_one(spark):
    rows = spark.range(40_000).selectExpr("id % 3 AS g", "id % 7 AS part", "IF(id % 10 = 0, NULL, CAST(id % 9000 AS STRING)) AS who", "IF(id % 11 = 0, NULL, (id * 7919) % 10007) AS x")
    parts = K.sketched(rows, ["g", "part"], distinct="who", values="x")
    assert parts.count() == 21
    for told in (K.estimates(K.merged(parts, ["g"])), K.estimates(K.sketched(rows, ["g"], distinct="who", values="x"))):
        exact = rows.groupBy("g").agg(F.count("*").alias("m"), F.countDistinct("who").alias("d"), F.percentile("x", F.lit(0.5)).alias("h"), F.percentile("x", F.lit(0.9)).alias("t"))
        for x in told.join(exact, "g").collect():
            assert x.n == x.m and abs(x.distinct - x.d) <= 0.05 * x.d and abs(x.q50 - x.h) <= 300 and abs(x.q90 - x.t) <= 300
    none = K.estimates(K.sketched(rows.where("who IS NULL").withColumn("x", F.lit(None)), ["g"], distinct="who", values="x")).collect()
    assert {(x.distinct, x.q50) for x in none} == {(0, None)}
