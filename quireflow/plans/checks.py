"""Data quality: the checks of the reference's suite as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..schemas import ROLES
from .registry import Registry, table

ADD = Registry()


@ADD("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents")
def row_counts(spark, d):
    parts = [table(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("customer", "orders", "documents")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@ADD(r"SELECT count(*) AS n, count(*) FILTER (NOT regexp_matches(e, '^[^@]+@[^@]+\.[^@]+$')) AS invalid, count(*) FILTER (NOT regexp_matches(e, '^[^\s@]+@[^\s@]+\.[^\s@]+$')) AS invalid_strict FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE c_name || '@example.org' END AS e FROM customer)")
def email_check(spark, d):
    users = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("@example.org"))).alias("e"))
    return users.agg(F.count("*").alias("n"), F.count_if(~T.is_email(F.col("e"))).alias("invalid"), F.count_if(~T.is_email(F.col("e"), strict=True)).alias("invalid_strict"))


@ADD("SELECT count(nullif(text, '')) - count(DISTINCT nullif(text, '')) AS texts, count(nullif(source, '')) - count(DISTINCT nullif(source, '')) AS sources FROM documents")
def dup_counts(spark, d):
    docs = table(spark, d, "documents").select(F.md5(F.nullif(F.col("text"), F.lit(""))).alias("text"), "source")
    return docs.agg(R.duplicates(F.col("text")).alias("texts"), R.duplicates(F.col("source")).alias("sources"))


@ADD("SELECT count(*) FILTER (o_orderdate IS NULL OR o_orderpriority IS NULL) AS incomplete, count(*) FILTER (coalesce(o_orderstatus, '') = '') AS blank FROM orders")
def null_checks(spark, d):
    rows = table(spark, d, "orders")
    return rows.agg(F.count_if(F.col("o_orderdate").isNull() | F.col("o_orderpriority").isNull()).alias("incomplete"), F.count_if(R.missing(F.col("o_orderstatus"))).alias("blank"))


@ADD("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def fk_orphan_projects(spark, d):
    return R.without(table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey")


@ADD("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def fk_orphan_chunks(spark, d):
    return R.without(table(spark, d, "embeddings").select("vec_id"), table(spark, d, "documents").where("lang = 'en'"), "vec_id", "doc_id")


@ADD("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def id_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@ADD("SELECT count(*) FILTER (o_orderstatus = 'O') AS drafts, count(*) FILTER (o_orderstatus <> 'O') AS published FROM orders")
def draft_counts(spark, d):
    return table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "O").alias("drafts"), F.count_if(F.col("o_orderstatus") != "O").alias("published"))


@ADD("SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1")
def status_histogram(spark, d):
    return R.histogram(table(spark, d, "orders"), "o_orderstatus")


@ADD("SELECT role AS value, count(*) AS n FROM conversations GROUP BY 1")
def role_histogram(spark, d):
    return R.histogram(table(spark, d, "conversations"), "role")


@ADD("SELECT count(*) FILTER (role IS NULL OR role NOT IN ('user', 'assistant', 'system')) AS invalid, count(*) FILTER (role IS NULL OR role NOT IN ('user', 'assistant')) AS invalid_two FROM conversations")
def role_domain(spark, d):
    rows = table(spark, d, "conversations")
    return rows.agg(F.count_if(R.outside_domain(F.col("role"), ROLES)).alias("invalid"), F.count_if(R.outside_domain(F.col("role"), ROLES[:2])).alias("invalid_two"))


@ADD("SELECT count(*) FILTER (coalesce(text, '') = '') AS missing, count(*) FILTER (length(text) BETWEEN 1 AND 49) AS short FROM documents")
def text_quality(spark, d):
    return table(spark, d, "documents").agg(F.count_if(R.missing(F.col("text"))).alias("missing"), F.count_if(F.length("text").between(1, 49)).alias("short"))


@ADD("SELECT count(*) FILTER (embedding IS NULL) AS missing, count(*) FILTER (len(embedding) <> 64) AS wrong_size FROM embeddings")
def embedding_check(spark, d):
    return table(spark, d, "embeddings").agg(F.count_if(F.col("embedding").isNull()).alias("missing"), F.count_if(F.size("embedding") != 64).alias("wrong_size"))


@ADD("SELECT conv_id, turn FROM conversations WHERE coalesce(text, '') = ''")
def empty_messages(spark, d):
    return table(spark, d, "conversations").where(R.missing(F.col("text"))).select("conv_id", "turn")


@ADD("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 200")
def sample_ordered(spark, d):
    """The reference's checks look at the first 200 rows."""
    return table(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(200)
