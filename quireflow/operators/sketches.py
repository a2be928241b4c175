"""Counts at several levels, and summaries of parts that are stored and put together: distinct values and quantiles within a known error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def level_counts(df: DataFrame, levels: list[str]) -> DataFrame:
    """(*levels, depth, n): rows by all levels, by all but the last, and so on to all rows, in one pass; a level above depth is null, and so is a null value of a level below it."""
    depth = sum((1 - F.grouping(c) for c in levels), F.lit(0)).cast("int")
    return df.rollup(*levels).agg(F.count("*").alias("n"), depth.alias("depth")).select(*levels, "depth", "n")


def sketched(df: DataFrame, by: list[str], *, distinct: str, values: str, lg_k: int = 12, k: int = 200) -> DataFrame:
    """(*by, n, ids, spread): a part's row count, a sketch of the distinct values of one column and one of the quantiles of another, of a bounded size each.

    Sketches of parts can be stored and merged later, in any order. Nulls are in neither.
    """
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(distinct).cast("string"), lg_k).alias("ids"), F.kll_sketch_agg_double(F.col(values).cast("double"), k).alias("spread"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n, ids, spread) of several parts together."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("spread").alias("spread"))


def estimates(parts: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """parts with `distinct`, the estimated number of distinct values, and a column `q50`, `q90` and so on for every quantile, in place of the sketches. No value, no quantile."""
    some = F.kll_sketch_get_n_double("spread") > 0
    at = [F.when(some, F.kll_sketch_get_quantile_double("spread", F.lit(q))).alias(f"q{round(100 * q)}") for q in quantiles]
    return parts.select(*[c for c in parts.columns if c not in ("ids", "spread")], F.hll_sketch_estimate("ids").alias("distinct"), *at)
