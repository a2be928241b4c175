"""Where tables and documents come from: Parquet, JDBC, CSV, binary files, HTML pages and archives of issues."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; with the declared schema where the reference data model has the table and the file follows it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def declared(spark: SparkSession, path: str, name: str, form: str = "parquet") -> DataFrame:
    """A table of the data model, read with its schema instead of an inferred one."""
    return spark.read.schema(TABLES[name]).format(form).load(path)


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query's rows over JDBC; partitionColumn, lowerBound, upperBound and numPartitions read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", **options).load()


def sql(spark: SparkSession, text: str, **args) -> DataFrame:
    """Parameterised SQL over registered views."""
    return spark.sql(text, args=args)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').option("quoteAll", False).csv(path)


def write_log(df: DataFrame, path: str) -> None:
    """One JSON object per row and line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, length, content) of binary files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def upload_status(size: Column, content: Column, parsed: Column, most: int = 10 * 1024 * 1024) -> Column:
    """413 for too large, 415 for no PDF, 400 for one that cannot be parsed, else 200."""
    magic = F.hex(F.substring(content, 1, 4)) == "25504446"
    return F.when(size > most, 413).when(~F.coalesce(magic, F.lit(False)), 415).when(~parsed, 400).otherwise(200)


def text_request_ok(text: Column) -> Column:
    return F.coalesce(F.length(text).between(50, 20_000), F.lit(False))


def pdf_request_ok(name: Column, size: Column, text: Column) -> Column:
    return F.coalesce(F.lower(name).endswith(".pdf") & (size <= 20 * 1024 * 1024) & (F.length(text) >= 100), F.lit(False))


def extracted(docs: DataFrame, parsers: list[Callable[[bytes], list[str]]], separator: str = "\n", missing: str | None = None) -> DataFrame:
    """docs (path, content) with text, error: pages of the first parser that does not fail, joined.

    A parser turns bytes into pages; PDF libraries are the caller's, e.g. one for Markdown and one for plain text as a fallback. A document that all fail on gets missing as
    its text and the last error; it fails alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts, errors = [], []
            for content in frame["content"]:
                text, error = missing, None
                for parse in parsers:
                    try:
                        text, error = separator.join(p for p in parse(bytes(content)) if p.strip()), None
                        break
                    except Exception as e:  # any failure of a parser is that document's own
                        error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pd.DataFrame({"path": frame["path"], "text": texts, "error": errors})

    return docs.select("path", "content").mapInPandas(run, "path string, text string, error string")


def page_text(blocks: Column) -> Column:
    """Text of a page's blocks (structs with type and text): images dropped, texts stripped, a line each."""
    kept = F.filter(blocks, lambda b: (b["type"] == 0) & (F.trim(b["text"]) != ""))
    return F.array_join(F.transform(kept, lambda b: F.trim(b["text"])), "\n")
