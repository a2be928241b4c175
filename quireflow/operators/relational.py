"""Filters, joins, counts, orders and table changes as DataFrame to DataFrame functions. Every top-k has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip

# Fixed value: how lists of authors begin.
NAMED_AUTHORS = "các tác giả"

# --- filters and projections


def where_all(df: DataFrame, **equal) -> DataFrame:
    """Rows where every named column equals its value; None leaves a column out of the filter."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def outside_domain(column: Column, allowed: tuple[str, ...]) -> Column:
    """True where the value is not allowed; a null is not."""
    return ~F.coalesce(column.isin(*allowed), F.lit(False))


def missing(column: Column) -> Column:
    """Null or empty."""
    return F.coalesce(column, F.lit("")) == ""


def or_default(column: Column, default) -> Column:
    """The trimmed value, or the default where nothing is left."""
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(default) if isinstance(default, str) else default)


def lookup(column: Column, table: dict[str, str], default: str) -> Column:
    """A value's entry in a small fixed table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(default))


def latest(df: DataFrame, owner: str, order: str, key: str, n: int | None = None) -> DataFrame:
    """Rows of each owner, newest first, with their position from 1; the first n where n is given."""
    ranked = df.withColumn("position", F.row_number().over(W.partitionBy(owner).orderBy(F.desc(order), F.asc(key))))
    return ranked if n is None else ranked.where(F.col("position") <= n)


def take_slots(df: DataFrame, group: str, order: list[Column], free: Column) -> DataFrame:
    """The first rows of each group, as many as it has free slots."""
    return df.withColumn("slot", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("slot") <= free)


# --- joins


def without(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows whose key the other table lacks; null keys are kept."""
    return df.join(other.select(F.col(other_key or key).alias(key)).distinct(), key, "left_anti")


def owned(children: DataFrame, parents: DataFrame, key: str, condition: Column) -> DataFrame:
    """Children that have a parent fulfilling the condition (EXISTS)."""
    return children.join(parents.where(condition).select(key), key, "left_semi")


def cascade_delete(tables: dict[str, DataFrame], keys: dict[str, tuple[str, str, str]], root: str, removed: DataFrame) -> dict[str, DataFrame]:
    """Deletes rows of root and, following keys child -> (parent, parent key, child key) in order, all that refer to deleted rows."""
    gone = {root: removed}
    out = dict(tables)
    for child, (parent, parent_key, child_key) in keys.items():
        ids = gone[parent].select(F.col(parent_key).alias(child_key)).distinct()
        gone[child] = tables[child].join(ids, child_key, "left_semi")
    for name in gone:
        key = next((k[1] for k in keys.values() if k[0] == name), None) or tables[name].columns[0]
        out[name] = tables[name].join(gone[name].select(key).distinct(), key, "left_anti")
    return out


# --- changes


def insert_or_ignore(existing: DataFrame | None, new: DataFrame, key: str, arrival: str) -> DataFrame:
    """The new rows that would be inserted: the first to arrive of each key that does not exist yet. Rows with a null key never conflict."""
    first = new.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(arrival)))
    first = first.where((F.col("__n") == 1) | F.col(key).isNull()).drop("__n")
    return first if existing is None else first.join(existing.select(key).distinct(), key, "left_anti")


def update_by_id(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """df with column replaced where changes (key, column) has a row for the key; ids that df lacks change nothing."""
    new = changes.select(F.col(key), F.col(column).alias("__new"), F.lit(True).alias("__has"))
    return df.join(new, key, "left").withColumn(column, F.when(F.col("__has"), F.col("__new")).otherwise(F.col(column))).drop("__new", "__has")


def fill_from(df: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with each column taken from found unless that is null or empty."""
    new = found.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = df.join(new, key, "left")
    return out.withColumns({c: F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c)) for c in columns}).drop(*[f"__{c}" for c in columns])


def within_quota(existing: DataFrame, requests: DataFrame, key: str, most: int) -> DataFrame:
    """Requests (key, n) with what there is already and whether both fit into the quota."""
    have = existing.groupBy(key).agg(F.count("*").alias("existing"))
    out = requests.join(have, key, "left").withColumn("existing", F.coalesce("existing", F.lit(0)))
    return out.withColumn("accepted", F.col("existing") + F.col("n") <= most)


def recover_stuck(docs: DataFrame, chunks: DataFrame, *, stuck: str = "processing", done: str = "indexed", failed: str = "failed") -> DataFrame:
    """Documents with stuck ones settled: done if they have chunks, else failed."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    out = docs.join(counts, docs["id"] == counts["document_id"], "left").drop("document_id")
    settled = F.when(F.coalesce("chunks", F.lit(0)) > 0, done).otherwise(failed)
    return out.withColumn("chunks", F.coalesce("chunks", F.lit(0))).withColumn("status", F.when(F.col("status") == stuck, settled).otherwise(F.col("status")))


def reject_reason(*, path: Column, body: Column, full: Column, has_summary: Column, chunks: Column, least: int = 50) -> Column:
    """Why a document cannot be ingested, the first reason that holds; null if none does."""
    return (
        F.when(missing(path), "no file path")
        .when(missing(body), "no body")
        .when(missing(full), "no text")
        .when(F.length(F.trim(body)) < least, "body too short")
        .when(has_summary, "already summarized")
        .when(chunks == 0, "no chunks")
    )


def sql_dump(df: DataFrame, table: str, *, quote_nulls: bool = False) -> DataFrame:
    """One INSERT statement per row: control characters dropped, quotes doubled, nulls as NULL (or the quoted text, as older dumps have it)."""
    clean = lambda c: F.replace(F.regexp_replace(F.col(c).cast("string"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), F.lit("'"), F.lit("''"))
    value = lambda c: F.coalesce(F.concat(F.lit("'"), clean(c), F.lit("'")), F.lit("'NULL'" if quote_nulls else "NULL"))
    values = F.concat_ws(", ", *[value(c) for c in df.columns])
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), values, F.lit(");")).alias("statement"))


def sql_script(df: DataFrame, table: str, *, quote_nulls: bool = False) -> DataFrame:
    """(n, statement): the statements that make the table anew, in the order of n; all columns are texts."""
    make = [f"DROP TABLE IF EXISTS {table};", f"CREATE TABLE {table} ({', '.join(f'{c} TEXT' for c in df.columns)});"]
    head = df.sparkSession.createDataFrame(list(enumerate(make)), "n int, statement string")
    return head.unionByName(sql_dump(df, table, quote_nulls=quote_nulls).withColumn("n", F.lit(2)))


def script_of(df: DataFrame, table: str, key: str, authors: str | None = None) -> DataFrame:
    """(n, statement): the statements that make a table anew with a numbered key, as articles are exported. Nulls are the quoted text NULL; authors are named without the words for them, N/A where there are none."""
    if authors:
        bare = strip(F.replace(F.col(authors), F.lit(NAMED_AUTHORS), F.lit("")))
        df = df.withColumn(authors, F.when(missing(F.col(authors)), F.lit("N/A")).otherwise(bare))
    make = [f"DROP TABLE IF EXISTS {table};", f"CREATE TABLE {table} ({key} SERIAL PRIMARY KEY, {', '.join(f'{c} TEXT' for c in df.columns)});"]
    head = df.sparkSession.createDataFrame(list(enumerate(make)), "n int, statement string")
    return head.unionByName(sql_dump(df, table, quote_nulls=True).withColumn("n", F.lit(2)))


def pending(status: Column, title: Column) -> Column:
    """Whether a document is still to be waited for: it is not done, or it has no title yet."""
    return F.coalesce(status.isin("uploaded", "processing"), F.lit(False)) | missing(F.trim(title))


def cache_seconds(pending: Column) -> Column:
    """How long a list may be cached: 10 s while something is pending, else 300 s."""
    return F.when(pending, 10).otherwise(300)


# --- counts


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; null is a value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def duplicates(column: Column) -> Column:
    """Values beyond the first of each kind; null and empty ones are left out."""
    kept = F.nullif(column, F.lit(""))
    return F.count(kept) - F.count_distinct(kept)


def joined(df: DataFrame, group: str, text: Column, order: list[str], separator: str, name: str) -> DataFrame:
    """The group's texts in order, in one string."""
    rows = df.select(group, F.struct(*order, text.alias("__text")).alias("__row"))
    texts = F.transform(F.array_sort(F.collect_list("__row")), lambda r: r["__text"])
    return rows.groupBy(group).agg(F.array_join(texts, separator).alias(name))
