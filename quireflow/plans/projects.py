"""Projects, their documents and summaries: orders stand for projects, their lines for a project's documents, labels for summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from .registry import Registry, table

ADD = Registry()


def _projects(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("updated_at"), (F.col("o_orderstatus") == "O").alias("is_draft"), "o_orderstatus", "o_orderpriority")


def _status():
    return F.element_at(F.array(*map(F.lit, ("uploaded", "processing", "indexed", "failed"))), (F.col("doc_id") % 4 + 1).cast("int"))


_STATUS_SQL = "['uploaded', 'processing', 'indexed', 'failed'][doc_id % 4 + 1]"


@ADD("SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate::DATE AS updated, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INT AS position FROM orders")
def project_list_by_user(spark, d):
    return R.latest(_projects(spark, d), "user_id", "updated_at", "id").select("id", "user_id", F.to_date("updated_at").alias("updated"), "position")


@ADD("SELECT * FROM (SELECT o_orderkey AS id, o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INT AS position FROM orders) WHERE position <= 5")
def project_recent5(spark, d):
    return R.latest(_projects(spark, d), "user_id", "updated_at", "id", 5).select("id", "user_id", "position")


@ADD("SELECT o_orderkey AS id, o_custkey AS user_id FROM orders WHERE o_orderkey = 42")
def project_point_lookup(spark, d):
    return R.where_all(_projects(spark, d), id=42).select("id", "user_id")


@ADD("SELECT o_orderkey AS id FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'O'")
def project_nondraft(spark, d):
    return R.where_all(_projects(spark, d), user_id=7, is_draft=False).select("id")


@ADD("SELECT o_orderkey AS id, o_custkey AS user_id FROM orders WHERE o_orderstatus = 'F'")
def project_optional_filter(spark, d):
    return R.where_all(_projects(spark, d), o_orderstatus="F", user_id=None).select("id", "user_id")


@ADD("SELECT o_orderkey AS id, o_orderpriority AS name, CASE o_orderpriority WHEN '1-URGENT' THEN 'red' WHEN '2-HIGH' THEN 'orange' ELSE 'grey' END AS color FROM orders")
def project_color(spark, d):
    return _projects(spark, d).select("id", F.col("o_orderpriority").alias("name"), R.lookup(F.col("o_orderpriority"), {"1-URGENT": "red", "2-HIGH": "orange"}, "grey").alias("color"))


@ADD("SELECT o_orderkey AS project_id, m AS n, n AS existing, n + m <= 10 AS accepted FROM (SELECT o_orderkey, o_orderkey % 5 + 1 AS m FROM orders) JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def doc_quota(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project_id"))
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), (F.col("o_orderkey") % 5 + 1).alias("n"))
    return R.within_quota(lines, wanted, "project_id", 10).where("existing > 0").select("project_id", "n", "existing", "accepted")


@ADD("SELECT l_orderkey AS project_id, l_partkey AS part FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice) AS slot FROM lineitem WHERE l_quantity <= 10) WHERE slot <= 4")
def file_slots(spark, d):
    rows = table(spark, d, "lineitem").where("l_quantity <= 10")
    return R.take_slots(rows, "l_orderkey", [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")], F.lit(4)).select(F.col("l_orderkey").alias("project_id"), F.col("l_partkey").alias("part"))


@ADD("SELECT o_custkey AS user_id, count(*) AS documents FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def documents_per_user(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    return lines.join(_projects(spark, d).select("id", "user_id"), "id").groupBy("user_id").agg(F.count("*").alias("documents"))


@ADD("SELECT doc_id, n_chars FROM documents WHERE source = 'src0'")
def document_list_pruned(spark, d):
    return table(spark, d, "documents").where("source = 'src0'").select("doc_id", "n_chars")


@ADD("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src1')")
def summaries_for_owner(spark, d):
    return R.owned(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id", F.col("source") == "src1").select("doc_id", "quality")


@ADD("SELECT d.doc_id, d.source, l.quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def summaries_with_document(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", "source", "quality")


@ADD("SELECT d.doc_id, l.quality AS summary FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def document_summary_or_null(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.col("quality").alias("summary"))


@ADD("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def docs_without_summary(spark, d):
    return R.without(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


@ADD(f"""
WITH docs AS (SELECT doc_id, {_STATUS_SQL} AS status FROM documents), c AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1)
SELECT docs.doc_id AS id, CASE WHEN status = 'processing' THEN CASE WHEN n > 0 THEN 'indexed' ELSE 'failed' END ELSE status END AS status, coalesce(n, 0) AS chunks FROM docs LEFT JOIN c USING (doc_id)""")
def stuck_recovery(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), _status().alias("status"))
    return R.recover_stuck(docs, table(spark, d, "labels").withColumnRenamed("doc_id", "document_id")).select("id", "status", "chunks")


@ADD(f"SELECT source, bool_or({_STATUS_SQL} IN ('uploaded', 'processing')) AS pending, CASE WHEN bool_or({_STATUS_SQL} IN ('uploaded', 'processing')) THEN 10 ELSE 300 END::INT AS ttl FROM documents GROUP BY source")
def pending_ttl(spark, d):
    docs = table(spark, d, "documents").withColumn("status", _status())
    return docs.groupBy("source").agg(F.bool_or(F.col("status").isin("uploaded", "processing")).alias("pending")).withColumn("ttl", R.cache_seconds(F.col("pending")))


@ADD("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text HAVING md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id < 50)")
def insert_or_ignore_by_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("key"))
    return R.insert_or_ignore(docs.where("doc_id < 50"), docs, "key", "doc_id").select("doc_id")


@ADD(f"SELECT doc_id, CASE WHEN l.quality IS NOT NULL THEN 'indexed' ELSE {_STATUS_SQL} END AS status FROM documents LEFT JOIN labels l USING (doc_id)")
def status_update(spark, d):
    docs = table(spark, d, "documents").select("doc_id", _status().alias("status"))
    return R.update_by_id(docs, table(spark, d, "labels").select("doc_id", F.lit("indexed").alias("status")), "doc_id", "status")


@ADD("SELECT c_custkey AS id, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_mktsegment END, ''), c_name) AS title FROM customer")
def coalescing_update(spark, d):
    users = table(spark, d, "customer")
    found = users.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).alias("title"))
    return R.fill_from(users.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")), found, "id", ["title"])


@ADD("""
SELECT doc_id, CASE WHEN source = 'src3' THEN 'no file path' WHEN coalesce(text, '') = '' THEN 'no body' WHEN length(trim(text)) < 50 THEN 'body too short' WHEN l.doc_id IS NOT NULL THEN 'already summarized' WHEN doc_id % 7 = 0 THEN 'no chunks' END AS reason
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def ingest_guards(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    reason = R.reject_reason(path=F.when(F.col("source") != "src3", F.col("source")), body=F.col("text"), full=F.col("text"), has_summary=F.coalesce("has", F.lit(False)), chunks=F.when(F.col("doc_id") % 7 == 0, 0).otherwise(1))
    return rows.select("doc_id", reason.alias("reason"))


@ADD("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def cascade_delete(spark, d):
    tables = {n: table(spark, d, n) for n in ("customer", "orders", "lineitem")}
    keys = {"orders": ("customer", "c_custkey", "o_custkey"), "lineitem": ("orders", "o_orderkey", "l_orderkey")}
    return R.cascade_delete(tables, keys, "customer", tables["customer"].where("c_nationkey = 3"))["orders"].select("o_orderkey")


@ADD("SELECT 'INSERT INTO regions (r_regionkey, r_name) VALUES (''' || r_regionkey || ''', ' || coalesce('''' || replace(r_name, '''', '''''') || '''', 'NULL') || ');' AS statement FROM region")
def sql_dump(spark, d):
    return R.sql_dump(table(spark, d, "region").select("r_regionkey", "r_name"), "regions")


@ADD("SELECT c_custkey AS id, coalesce(nullif(split_part(c_name, '#', 1), ''), 'Researcher') AS first, coalesce(nullif(trim(c_mktsegment), ''), 'Untitled Project') AS title FROM customer")
def display_defaults(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.first_name(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("first"), R.or_default(F.col("c_mktsegment"), "Untitled Project").alias("title"))


@ADD(r"SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g') AS safe, coalesce(nullif(substr(regexp_replace(regexp_replace(url, '[\\/:*?\"<>|]', '', 'g'), '\s+', '_', 'g'), 1, 120), ''), 'summary') AS download FROM pages")
def safe_filename(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("safe"), T.download_name(F.col("url")).alias("download"))


@ADD("SELECT c_custkey AS id, CASE WHEN n <= 2 THEN 'Weak' WHEN n <= 4 THEN 'Medium' ELSE 'Strong' END AS strength FROM (SELECT c_custkey, (length(c_name) >= 8)::INT + regexp_matches(c_name, '[A-Z]')::INT + regexp_matches(c_name, '[a-z]')::INT + regexp_matches(c_name, '[0-9]')::INT + regexp_matches(c_name, '[^A-Za-z0-9]')::INT AS n FROM customer)")
def password_strength(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.password_strength(F.col("c_name")).alias("strength"))


@ADD("SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY conv_id, turn")
def chat_history_ordered(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), "lang")
    return R.owned(table(spark, d, "conversations"), docs, "conv_id", F.col("lang") == "en").orderBy("conv_id", "turn").select("conv_id", "turn", "role")


@ADD("SELECT o_custkey AS user_id, list_sort(list_distinct(list_concat(['default'], list(DISTINCT o_orderpriority)))) AS tags FROM orders GROUP BY 1")
def tags_union(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.array_sort(F.array_union(F.array(F.lit("default")), F.collect_set("o_orderpriority"))).alias("tags"))
