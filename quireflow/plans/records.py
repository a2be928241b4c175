"""New rows, chat messages, citations and lookups: what the reference's routes and screens add to tables or show of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims as C
from ..operators import records as X
from ..operators import relational as R
from ..operators import retrieval as V
from .registry import Registry, table

ADD = Registry()


def _drafts(spark, d):
    """A new project per customer; only the parts of it that are no random numbers and times can be compared."""
    users = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id"))
    return X.new_projects(users)


@ADD("SELECT c_custkey::VARCHAR AS user_id, 'Untitled Project' AS name, true AS is_draft, 36::INT AS id_size, true AS own_collection, true AS timed FROM customer")
def new_projects(spark, d):
    collection = F.col("collection_name").rlike("^[0-9]+_[0-9a-f]{32}$") & F.startswith("collection_name", F.concat("user_id", F.lit("_")))
    return _drafts(spark, d).select("user_id", "name", "is_draft", F.length("id").alias("id_size"), collection.alias("own_collection"), (F.col("created_at") == F.col("updated_at")).alias("timed"))


_FINALIZE = """
WITH p AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus = 'O' AS is_draft FROM orders),
r AS (SELECT o_orderkey AS id, o_custkey + (o_orderkey % 3 = 0)::INT AS user_id, o_orderpriority AS name FROM orders WHERE o_orderkey % 2 = 0)
"""


def _finalized(spark, d):
    orders = table(spark, d, "orders")
    projects = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.lit("Untitled Project").alias("name"), F.lit(None).cast("string").alias("domain"), (F.col("o_orderstatus") == "O").alias("is_draft"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("file_name"), F.col("l_linenumber").alias("place")))).alias("documents"))
    wanted = orders.where("o_orderkey % 2 = 0").join(lines, "o_orderkey", "left")
    requests = wanted.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).alias("user_id"), F.col("o_orderpriority").alias("name"), F.lit("x").alias("domain"), "documents")
    return X.finalize(projects, requests)


@ADD(_FINALIZE + """
SELECT p.id, coalesce(r.name, 'Untitled Project') AS name, CASE WHEN r.id IS NULL THEN p.is_draft ELSE false END AS is_draft
FROM p LEFT JOIN r ON r.id = p.id AND r.user_id = p.user_id AND p.is_draft""")
def finalized_projects(spark, d):
    return _finalized(spark, d)[0].select("id", "name", "is_draft")


@ADD(_FINALIZE + """
SELECT p.id AS project_id, p.user_id, l_partkey::VARCHAR AS file_name, 'uploaded' AS status
FROM p JOIN r ON r.id = p.id AND r.user_id = p.user_id AND p.is_draft JOIN lineitem ON l_orderkey = p.id""")
def finalized_documents(spark, d):
    return _finalized(spark, d)[1].select("project_id", "user_id", "file_name", "status")


@ADD(_FINALIZE + "SELECT r.id, p.id IS NOT NULL AS found FROM r LEFT JOIN p ON r.id = p.id AND r.user_id = p.user_id AND p.is_draft")
def finalize_status(spark, d):
    return _finalized(spark, d)[2].select("id", (F.col("status") == 200).alias("found"))


@ADD("""
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey AS id, o_custkey + (o_orderkey % 3 = 0)::INT AS user_id, o_orderkey % 5 + 1 AS m FROM orders)
SELECT r.id AS project_id, CASE WHEN o_custkey <> user_id OR o_orderstatus = 'O' THEN 404 WHEN coalesce(n, 0) + m > 10 THEN 400 ELSE 200 END::INT AS status
FROM r JOIN orders ON o_orderkey = r.id LEFT JOIN n ON l_orderkey = r.id""")
def add_documents_status(spark, d):
    orders = table(spark, d, "orders")
    projects = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderstatus") == "O").alias("is_draft"))
    requests = orders.select(F.col("o_orderkey").alias("project_id"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).alias("user_id"), (F.col("o_orderkey") % 5 + 1).alias("n"))
    return X.add_documents_status(projects, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project_id")), requests).select("project_id", "status")


@ADD("""
SELECT conv_id::VARCHAR AS thread_id, role, content, markers, label FROM (
  SELECT conv_id, 'user' AS role, max_by(text, turn) AS content, NULL AS markers, NULL AS label FROM conversations WHERE role = 'user' GROUP BY conv_id
  UNION ALL SELECT conv_id, 'assistant', 'seen [S1]', 'S1', CASE WHEN conv_id % 2 = 0 THEN 'SUPPORTED' END FROM conversations WHERE role = 'user' GROUP BY conv_id)""")
def chat_messages(spark, d):
    """A question and its answer as two rows; citations and the check of facts are structs, as the history has them."""
    asked = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    sources = F.array(*[F.struct(F.lit(n).alias("source"), F.lit("f.pdf").alias("file_name"), F.lit(0).alias("chunk_index"), F.lit("t").alias("chunk_text"), F.lit("d").alias("document_id"), F.lit(0.5).alias("score")) for n in (1, 2)])
    check = F.when(F.col("conv_id") % 2 == 0, F.struct(F.lit("SUPPORTED").alias("label"), F.lit(0.9).alias("confidence"), F.lit(2).alias("chunks_used")))
    rows = X.chat_messages(asked.select(F.col("conv_id").cast("string").alias("thread_id"), F.lit("u").alias("user_id"), F.lit("p").alias("project_id"), "question", F.lit("seen [S1]").alias("answer"), V.cited(F.lit("seen [S1]"), sources).alias("citations"), F.lit(2).alias("chunks_retrieved"), check.alias("fact_check")))
    markers = F.array_join(F.transform("citations", lambda c: c["source_marker"]), ",")
    return rows.select("thread_id", "role", "content", markers.alias("markers"), F.col("fact_check.label").alias("label"))


@ADD("SELECT conv_id AS thread_id, turn AS id, role, coalesce(text, '') AS content, 10::INT AS fields FROM conversations")
def chat_history_rows(spark, d):
    rows = table(spark, d, "conversations").select(F.col("turn").alias("id"), F.lit("u").alias("user_id"), F.lit("p").alias("project_id"), F.col("conv_id").alias("thread_id"), "role", F.coalesce("text", F.lit("")).alias("content"), F.lit(None).cast("array<string>").alias("citations"), F.lit(0).alias("chunks_retrieved"), F.lit(None).cast("string").alias("fact_check"), F.col("turn").alias("created_at"), F.lit("x").alias("internal"))
    shown = X.history_rows(rows)
    n = len(shown.schema["message"].dataType.fields)
    return shown.select(F.col("message.thread_id").alias("thread_id"), F.col("message.id").alias("id"), F.col("message.role").alias("role"), F.col("message.content").alias("content"), F.lit(n).alias("fields"))


@ADD("SELECT doc_id, CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 40 THEN 'answer' ELSE 'Tôi không tìm thấy đủ thông tin trong tài liệu để trả lời câu hỏi này.' END AS answer, CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 40 THEN 1 ELSE 0 END::INT AS citations FROM documents")
def answers_without_sources(spark, d):
    """A document asks with itself as its only chunk; one of forty characters or less is no source."""
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("query_id"), "text", F.lit(1).alias("rank"))
    kept = V.distinct_chunks(docs).select("query_id", F.array(F.struct("source", F.lit(0.5).alias("score"))).alias("sources"))
    rows = docs.join(kept, "query_id", "left")
    answer = X.answer_or_none(F.lit("answer"), F.col("sources"))
    return rows.select("doc_id", answer["answer"].alias("answer"), F.size(answer["citations"]).alias("citations"))


@ADD("SELECT conv_id, turn, unnest(CASE WHEN turn % 3 = 0 THEN [1] ELSE [1, 2] END)::INT AS source FROM conversations")
def marked_citations(spark, d):
    """Marks of an answer and the citations that they name; [S9] names none."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.lit("a [S1] b [S9]")).otherwise(F.lit("a [s2] b [S1] [S1]")).alias("answer"))
    citations = F.array(*[F.struct(F.lit(f"S{n}").alias("source_marker"), F.lit(n).alias("source")) for n in (1, 2, 3)])
    return X.marked_citations(rows.withColumn("citations", citations), ["conv_id", "turn"]).select("conv_id", "turn", "source").distinct()


@ADD("SELECT o_custkey AS user_id, list_slice(list_concat(list_sort(list(o_orderkey) FILTER (o_orderstatus = 'F')), list_sort(list(o_orderkey) FILTER (o_orderstatus <> 'F'))), 1, 4) AS files FROM orders GROUP BY 1")
def picked_files(spark, d):
    chosen = F.sort_array(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))))
    picked = F.sort_array(F.collect_list(F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey"))))
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(chosen.alias("a"), picked.alias("b"))
    return rows.select("user_id", X.add_files(F.col("a"), F.col("b"), 4).alias("files"))


@ADD("SELECT c_custkey AS id, CASE WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'bg-blue' WHEN c_mktsegment = 'Engineering' THEN 'bg-blue' WHEN c_mktsegment = 'BUILDING' THEN 'bg-green' ELSE 'bg-gray' END AS color FROM customer")
def field_colors(spark, d):
    """A sub-field has its major field's color, a major field its own, anything else the default."""
    major = {"MACHINERY": "Engineering", "AUTOMOBILE": "Engineering", "BUILDING": "Construction"}
    colors = {"Engineering": "bg-blue", "Construction": "bg-green"}
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.two_level_lookup(F.col("c_mktsegment"), major, colors, "bg-gray").alias("color"))


@ADD("""
SELECT c_custkey AS id, CASE WHEN draft THEN 'Draft' ELSE coalesce(nullif(trim(name), ''), 'Untitled Project') END AS title, coalesce(nullif(domain, ''), 'Uncategorized') AS domain,
       coalesce(name, file, 'Untitled') AS document, coalesce(about, domain, 'General research') AS about
FROM (SELECT c_custkey, c_custkey % 5 = 0 AS draft, CASE c_custkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN c_name END AS name, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN c_mktsegment END AS domain,
      CASE WHEN c_custkey % 7 > 2 THEN c_name END AS file, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS about FROM customer)""")
def card_defaults(spark, d):
    key = F.col("c_custkey")
    name, domain = F.when(key % 3 == 0, "  ").when(key % 3 == 1, F.col("c_name")), F.when(key % 4 == 0, "").when(key % 4 == 1, F.col("c_mktsegment"))
    shown = X.card(name=name, domain=domain, is_draft=key % 5 == 0, file_name=F.when(key % 7 > 2, F.col("c_name")), description=F.when(key % 2 == 0, F.col("c_mktsegment")))
    return table(spark, d, "customer").select(key.alias("id"), shown.alias("c")).select("id", "c.*")


@ADD(r"SELECT page_id, 'u1/p2/1700000000_ab12_' || regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g') AS path FROM pages")
def upload_paths(spark, d):
    return table(spark, d, "pages").select("page_id", X.upload_path(F.lit("u1"), F.lit("p2"), F.lit("1700000000"), F.lit("ab12"), F.col("url")).alias("path"))


@ADD("SELECT 'exactly one' AS kind, o_orderkey AS id FROM orders WHERE o_orderkey = 42")
def project_or_404(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return X.one_or_404(orders, id=42).select(F.lit("exactly one").alias("kind"), "id")


@ADD("SELECT source, CASE WHEN bool_or(doc_id % 4 IN (0, 1)) THEN 10 ELSE 300 END::INT AS documents, CASE WHEN count(l.quality) > 0 THEN 86400 ELSE 5 END::INT AS summaries, 120::INT AS list, 300::INT AS detail FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source")
def cache_times(spark, d):
    """How long each kind of answer may be cached."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    seen = docs.groupBy("source").agg(F.bool_or((F.col("doc_id") % 4).isin(0, 1)).alias("pending"), (F.count("quality") == 0).alias("empty"))
    return seen.select("source", *[X.cache_seconds(kind, pending=F.col("pending"), empty=F.col("empty")).alias(kind) for kind in ("documents", "summaries", "list", "detail")])


@ADD("SELECT doc_id, least(1014, n)::INT AS tokens FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS n FROM documents)")
def model_inputs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(C.model_input(T.words(F.col("text")), 10)).alias("tokens"))


@ADD("SELECT conv_id AS id, 'Sources:' || chr(10) || '[S1]' || chr(10) || 'Nguồn' || chr(10) || 'History:' || chr(10) || CASE WHEN max(turn) < 3 THEN '(Chưa có)' ELSE string_agg(upper(role) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) FILTER (back <= 5) END || chr(10) || 'Question: ' || conv_id || '?' || chr(10) || 'Answer:' AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) GROUP BY conv_id")
def chat_prompts(spark, d):
    """Sources, the history of longer conversations and a question in one prompt."""
    rows = table(spark, d, "conversations")
    long = rows.groupBy("conv_id").agg(F.max("turn").alias("last"))
    told = V.history_block(rows, "conv_id", "turn", "role", "text").join(long, "conv_id").withColumn("block", F.when(F.col("last") >= 3, F.col("block")))
    return told.select(F.col("conv_id").alias("id"), V.prompt(F.concat(F.col("conv_id").cast("string"), F.lit("?")), F.lit("[S1]\nNguồn"), F.col("block")).alias("prompt"))


@ADD("SELECT o_custkey AS id, string_agg(o_orderpriority, ' / ' ORDER BY o_orderkey) AS text FROM orders GROUP BY 1")
def joined_texts(spark, d):
    return R.joined(table(spark, d, "orders").withColumnRenamed("o_custkey", "id"), "id", F.col("o_orderpriority"), ["o_orderkey"], " / ", "text")


@ADD("""
SELECT doc_id AS document_id, 'src' AS summary_type, md5(text) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY text) AS n FROM documents) WHERE n = 1 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def new_summaries(spark, d):
    """One summary for each document that has none."""
    new = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit("src").alias("summary_type"), F.md5("text").alias("summary"), "text")
    return R.insert_or_ignore(table(spark, d, "labels").select(F.col("doc_id").alias("document_id")), new, "document_id", "text").drop("text")


@ADD("SELECT c_custkey AS user_id, 'file ' || c_custkey AS file_name, 'processing' AS status, 36::INT AS id_size FROM customer")
def saved_metadata(spark, d):
    files = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("file "), "c_custkey").alias("file_name"))
    return X.new_rows(files, status=F.lit("processing")).select("user_id", "file_name", "status", F.length("id").alias("id_size"))


@ADD("SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'orders', count(*) FROM orders JOIN customer ON c_custkey = o_custkey AND c_nationkey <> 3 UNION ALL SELECT 'lineitem', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey AND c_nationkey <> 3")
def cascade_counts(spark, d):
    """Rows that are left of each table."""
    tables = {n: table(spark, d, n) for n in ("customer", "orders", "lineitem")}
    keys = {"orders": ("customer", "c_custkey", "o_custkey"), "lineitem": ("orders", "o_orderkey", "l_orderkey")}
    left = R.cascade_delete(tables, keys, "customer", tables["customer"].where("c_nationkey = 3"))
    parts = [left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in tables]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@ADD("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def first_messages(spark, d):
    """The reference's filters by several columns, through parameterised SQL over views."""
    from ..sources import readers as S

    table(spark, d, "conversations").createOrReplaceTempView("quireflow_conversations")
    return S.sql(spark, "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM quireflow_conversations) WHERE n = :n", n=1)


@ADD("SELECT 'DROP TABLE IF EXISTS regions;' AS statement, 0::INT AS n UNION ALL SELECT 'CREATE TABLE regions (r_regionkey TEXT, r_name TEXT);', 1 UNION ALL SELECT 'INSERT INTO regions (r_regionkey, r_name) VALUES (''' || r_regionkey || ''', ' || coalesce('''' || replace(r_name, '''', '''''') || '''', 'NULL') || ');', 2 FROM region")
def sql_dump_script(spark, d):
    return R.sql_script(table(spark, d, "region").select("r_regionkey", "r_name"), "regions")
