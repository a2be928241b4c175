"""Calls of a service for every row, with retries and an outcome per row; a row that fails leaves the others alone."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType, _parse_datatype_string


class Refused(Exception):
    """The service's answer is no success. status is that of HTTP; TimeoutError stands for no answer at all."""

    def __init__(self, status: int, text: str = "") -> None:
        super().__init__(text or f"status {status}")
        self.status = status


class Policy(NamedTuple):
    """Attempts at most, which statuses are tried again, whether a time-out is, and the seconds to wait after the n-th attempt."""

    attempts: int
    again: Callable[[int], bool]
    timeouts: bool
    wait: Callable[[int], float]


# How claims are checked and summaries are asked for.
CHECKS = Policy(3, lambda status: status == 503, False, lambda n: 5.0 * n)
SUMMARIES = Policy(3, lambda status: status >= 500, True, lambda n: min(20.0, max(2.0, 2.0 ** (n - 1))))


def attempt(row: dict, client: Callable[[dict, int], dict], policy: Policy, sleep: Callable[[float], None]) -> tuple[dict | None, int, float, int | None, str | None]:
    """(answer or None, attempts made, seconds waited, last status that was no success, what went wrong). Nothing is raised."""
    waited, status, error = 0.0, None, None
    for n in range(1, policy.attempts + 1):
        try:
            return client(row, n), n, waited, None, None
        except Refused as e:
            status, error, again = e.status, str(e), policy.again(e.status)
        except TimeoutError as e:
            status, error, again = None, f"TimeoutError: {e}", policy.timeouts
        except Exception as e:  # whatever it is, it is this row's own
            status, error, again = None, f"{type(e).__name__}: {e}", False
        if not again or n == policy.attempts:
            break
        sleep(policy.wait(n))
        waited += policy.wait(n)
    return None, n, waited, status, error


#: Rows of an Arrow batch that are asked for and handed on at a time: no task holds more as Python objects.
HELD_ROWS = 128


def call(rows: DataFrame, client: Callable[[dict, int], dict], answer: str, *, asked: list[str], keep: list[str] | None = None, policy: Policy = CHECKS, at_once: int = 8, sleep: Callable[[float], None] = time.sleep, prefix: str = "call") -> DataFrame:
    """rows with the columns `{prefix}_answer`, `_attempts`, `_waited`, `_status`, `_error`: what the client said for each.

    With keep only these columns of rows come back beside them: what is but asked, like a long text, need not. client(row, n) has the columns `asked` and the number of the attempt; its answer is a dict with the fields of the DDL string `answer`, of which those that are missing are null. Up to at_once
    rows of an Arrow batch are asked for at a time. The answer is null where the client failed to the end; an answer that does not fit the fields is an error of that row.
    A task that is tried again calls again: clients must bear that. Nulls are passed on as None, an empty table calls nothing, repeated rows are called for each.
    """
    kind = _parse_datatype_string(answer)
    added = [StructField(f"{prefix}_{name}", of) for name, of in (("answer", kind), ("attempts", IntegerType()), ("waited", DoubleType()), ("status", IntegerType()), ("error", StringType()))]
    kept = rows.columns if keep is None else keep
    schema = StructType([*[rows.schema[c] for c in kept], *added])
    form = to_arrow_schema(schema)

    def fits(value: dict | None) -> dict | None:
        if value is not None:
            pa.array([value], form.field(f"{prefix}_answer").type)
        return value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                for low in range(0, batch.num_rows, HELD_ROWS):
                    part = batch.slice(low, HELD_ROWS)
                    told = [*pool.map(lambda row: attempt(row, lambda r, n: fits(client(r, n)), policy, sleep), part.select(asked).to_pylist())]
                    yield pa.RecordBatch.from_arrays([*part.select(kept).columns, *[pa.array(c, form.field(f.name).type) for f, c in zip(added, zip(*told, strict=True), strict=True)]], names=form.names)

    return rows.mapInArrow(run, schema)


def sorted_out(called: DataFrame, prefix: str = "call") -> tuple[DataFrame, DataFrame]:
    """(rows with an answer, rows that failed with what went wrong), for a called table that has been written: each would call anew otherwise."""
    failed = F.col(f"{prefix}_answer").isNull()
    return called.where(~failed), called.where(failed).drop(f"{prefix}_answer")


def summary_answer(answer: dict) -> dict:
    """A summarizer's answer with its fields trimmed and defaulted; a blank summary is an error."""
    summary = str(answer.get("summary") or "").strip()
    if not summary:
        raise ValueError("blank summary")
    return {"summary": summary, "input_tokens": int(answer.get("input_tokens", 0)), "output_tokens": int(answer.get("output_tokens", 0))}


def token_totals(called: DataFrame, by: str, prefix: str = "call") -> DataFrame:
    """(by, summaries, input_tokens, output_tokens): what the answers of each group have cost; a failed call costs nothing."""
    a = f"{prefix}_answer"
    return called.groupBy(by).agg(F.count(a).alias("summaries"), *[F.coalesce(F.sum(f"{a}.{c}"), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")])
