"""Checks of tables, compiled to one pass over each and one join for each key."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import duplicates, missing


class Check(NamedTuple):
    """A measure of a table: how much is wrong, as an aggregate. level says what a table with something wrong is: FAIL, WARN, or PASS where the number only informs."""

    table: str
    name: str
    wrong: Column
    level: str = "FAIL"


class Reference(NamedTuple):
    """Values of a column that must be among those of another table's column; null counts as wrong."""

    table: str
    name: str
    column: str
    parent: str
    key: str
    level: str = "FAIL"


def counted(table: str, name: str) -> Check:
    """How many rows there are; never wrong."""
    return Check(table, name, F.count("*"), "PASS")


def no_rows(table: str, name: str, bad: Column, level: str = "FAIL") -> Check:
    """No row may be bad; a null does not count as bad."""
    return Check(table, name, F.count_if(bad), level)


def unique(table: str, name: str, column: Column, level: str = "FAIL") -> Check:
    """No value but null and the empty one may occur twice."""
    return Check(table, name, duplicates(F.nullif(column, F.lit(""))), level)


def filled(table: str, name: str, *columns: Column, level: str = "FAIL") -> Check:
    """No row may lack one of the columns: null or empty."""
    return no_rows(table, name, reduce(Column.__or__, [missing(c.cast("string")) for c in columns]), level)


def report(tables: dict[str, DataFrame], checks: list[Check | Reference]) -> DataFrame:
    """(table, place, check, rows, wrong, status): every check in the order given, its status PASS, WARN or FAIL.

    All checks of a table are one aggregation over it. A reference adds a join of the table with the distinct keys of its parent before that. An empty table passes all.
    """
    parts = []
    for name in dict.fromkeys(c.table for c in checks):
        rows, measures = tables[name], []
        for place, c in ((i, c) for i, c in enumerate(checks) if c.table == name):
            wrong = c.wrong if isinstance(c, Check) else F.count_if(F.col(f"__found{place}").isNull())
            if isinstance(c, Reference):
                keys = tables[c.parent].select(F.col(c.key).alias(f"__key{place}")).where(F.col(f"__key{place}").isNotNull()).distinct().withColumn(f"__found{place}", F.lit(True))
                rows = rows.join(keys, F.col(c.column) == F.col(f"__key{place}"), "left")
            measures.append(F.struct(F.lit(place).alias("place"), F.lit(c.name).alias("check"), wrong.cast("long").alias("wrong"), F.lit(c.level).alias("level")))
        parts.append(rows.agg(F.count("*").alias("rows"), F.array(*measures).alias("told")).select(F.lit(name).alias("table"), "rows", F.inline("told")))
    status = F.when((F.col("level") == "PASS") | (F.col("wrong") == 0), "PASS").otherwise(F.col("level"))
    return reduce(DataFrame.unionByName, parts).select("table", "place", "check", "rows", "wrong", status.alias("status"))
