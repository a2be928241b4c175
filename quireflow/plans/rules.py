"""Rules that the driver's rows do not trigger by themselves, each set off by a column made from them: answers that leak, blank titles, uploads of every status, dumps of articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import records as RE
from ..operators import relational as R
from ..operators import retrieval as V
from ..sources import readers as S
from .registry import Registry, table

ADD = Registry()

# Ways in which an answer may repeat the template or leak where it comes from, by the number of the message.
_LEAKS = ("(Tài liệu: a.pdf, b) ", "tài liệu: Báo cáo 1.PDF ", "chunk: #12 ", "Chunk:7 ", "đoạn #3 ", "Đoạn 45 ", "relevance: 93.5% ", "Relevance: 8 ", "[s1] ", "[S2][s10] ", "x\n\n\n\ny ", "", "Tài liệu không có đuôi ", "(Tài liệu: c.pdf)(Tài liệu: d) ")


def _answers(spark, d):
    """Messages of assistants with two of the leaks, and every third with the template repeated."""
    rows = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    leak = lambda n: F.element_at(F.array(*map(F.lit, _LEAKS)), (F.pmod(n, F.lit(len(_LEAKS))) + 1).cast("int"))
    told = F.concat(leak(F.col("conv_id") + F.col("turn")), F.coalesce("text", F.lit("")), F.lit(" "), leak(F.col("conv_id") * 3 + F.col("turn") * 5))
    return rows.select("conv_id", "turn", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("[NGUỒN] S1 [TRẢ LỜI]: again [TRẢ LỜI]: "), told)).otherwise(told).alias("answer"))


_ANSWERS = f"""
l AS (SELECT [{', '.join("'" + x.replace(chr(10), "' || chr(10) || '") + "'" for x in _LEAKS)}] AS leaks),
a AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN '[NGUỒN] S1 [TRẢ LỜI]: again [TRẢ LỜI]: ' ELSE '' END || leaks[((conv_id + turn) % {len(_LEAKS)})::INT + 1] || coalesce(text, '') || ' ' || leaks[((conv_id * 3 + turn * 5) % {len(_LEAKS)})::INT + 1] AS answer FROM conversations, l WHERE role = 'assistant'),
""" + r"""
c AS (SELECT conv_id, turn, regexp_replace(string_split(answer, '[TRẢ LỜI]:')[-1], '\[s(\d+)\]', '[S\1]', 'gi') AS answer FROM a),
k AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(answer, '\(Tài liệu:.*?\)', '', 'g'), 'Tài liệu:\s*.*?\.pdf', '', 'gi'), 'Chunk:\s*#?\d+', '', 'gi'), 'Đoạn\s*#?\d+', '', 'gi'), 'Relevance:\s*\d+(\.\d+)?%?', '', 'gi') AS answer FROM c),
t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(answer, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS answer FROM k)"""


@ADD(f"WITH {_ANSWERS} SELECT conv_id, turn, md5(answer) AS h, contains(answer, 'Relevance') OR contains(answer, 'TRẢ LỜI') AS leaks FROM t")
def answers_without_leaks(spark, d):
    cleaned = _answers(spark, d).withColumn("answer", T.clean_answer(F.col("answer")))
    return cleaned.select("conv_id", "turn", F.md5("answer").alias("h"), (F.contains("answer", F.lit("Relevance")) | F.contains("answer", F.lit("TRẢ LỜI"))).alias("leaks"))


@ADD(f"WITH {_ANSWERS} SELECT conv_id, turn, s::INT AS source, round(1 / s::DOUBLE, 4) AS relevance FROM t, range(1, 13) r(s) WHERE contains(answer, '[S' || s || ']')")
def answer_citations(spark, d):
    """The sources, of twelve for each answer, whose marks stand in it."""
    sources = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.struct(i.alias("source"), (1 / i).alias("score")))
    rows = _answers(spark, d).select("conv_id", "turn", F.explode(V.cited(T.clean_answer(F.col("answer")), sources)).alias("c"))
    return rows.select("conv_id", "turn", "c.source", F.col("c.relevance_score").alias("relevance"))


@ADD(f"WITH {_ANSWERS} SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY p) - 1 AS place, m AS marker FROM (SELECT conv_id, turn, unnest(marks) AS m, generate_subscripts(marks, 1) AS p FROM (SELECT conv_id, turn, list_transform(regexp_extract_all(answer, '\\[S(\\d+)\\]', 1), lambda x: 'S' || x) AS marks FROM t)) WHERE m IN ('S1', 'S2')")
def clicked_marks(spark, d):
    """What the marks of an answer lead to, in their order, where only two sources are given with it."""
    citations = F.array(*[F.struct(F.lit(f"S{i}").alias("source_marker"), F.lit(f"file{i}").alias("file_name")) for i in (1, 2)])
    rows = _answers(spark, d).select("conv_id", "turn", T.clean_answer(F.col("answer")).alias("answer"), citations.alias("citations"))
    found = RE.marked_citations(rows, ["conv_id", "turn"])
    numbered = F.row_number().over(V.W.partitionBy("conv_id", "turn").orderBy("place")) - 1
    return found.select("conv_id", "turn", numbered.cast("long").alias("place"), F.col("source_marker").alias("marker"))


_TITLED = "CASE WHEN doc_id % 5 = 0 THEN 'indexed' WHEN doc_id % 401 = 0 THEN 'processing' WHEN doc_id % 307 = 0 THEN NULL ELSE 'failed' END AS status, CASE WHEN doc_id % 211 = 0 THEN '  ' WHEN doc_id % 173 = 0 THEN NULL ELSE source END AS title"


@ADD(f"SELECT doc_id // 10 AS project, bool_or(coalesce(status IN ('uploaded', 'processing'), false) OR coalesce(trim(title), '') = '') AS pending, CASE WHEN bool_or(coalesce(status IN ('uploaded', 'processing'), false) OR coalesce(trim(title), '') = '') THEN 10 ELSE 300 END::INT AS ttl FROM (SELECT doc_id, {_TITLED} FROM documents) GROUP BY 1")
def pending_or_untitled(spark, d):
    """Projects of ten documents, some of which are not done or have a blank title."""
    table(spark, d, "documents").createOrReplaceTempView("documents_with_titles")
    docs = spark.sql(f"SELECT doc_id div 10 AS project, {_TITLED} FROM documents_with_titles")
    found = docs.groupBy("project").agg(F.bool_or(R.pending(F.col("status"), F.col("title"))).alias("pending"))
    return found.withColumn("ttl", RE.cache_seconds("documents", pending=F.col("pending"), empty=F.lit(False)))


@ADD("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'completed' ELSE 'failed' END ELSE 'uploaded' END AS status FROM documents")
def recovered_as_completed(spark, d):
    """The same recovery with the other service's word for a document that is done."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "processing").otherwise("uploaded").alias("status"))
    return R.recover_stuck(docs, table(spark, d, "labels").withColumnRenamed("doc_id", "document_id"), done="completed").select("id", "status")


@ADD("SELECT page_id, CASE WHEN octet_length(encode(html)) * 1000 > 10485760 THEN 413 WHEN page_id % 4 = 0 THEN 415 WHEN contains(html, '<table') THEN 400 ELSE 200 END::INT AS status FROM pages")
def upload_statuses(spark, d):
    """Pages as uploads: a thousand times as large as they are, of which every fourth is no PDF, and those with a table cannot be parsed."""
    pages = table(spark, d, "pages")
    content = F.encode(F.concat(F.when(F.col("page_id") % 4 != 0, "%PDF-1.4").otherwise("<html>"), F.col("html")), "utf-8")
    status = S.upload_status(F.octet_length("html").cast("long") * 1000, content, ~F.contains("html", F.lit("<table")))
    return pages.select("page_id", status.alias("status"))


_ARTICLE = "source AS title, CASE WHEN doc_id % 3 = 0 THEN concat('các tác giả ', lang) WHEN doc_id % 3 = 1 THEN concat(lang, chr(39), 's') WHEN doc_id % 2 = 0 THEN '' END AS author, CASE WHEN doc_id % 4 > 0 THEN text END AS content"


@ADD(f"""
WITH a AS (SELECT doc_id, {_ARTICLE} FROM documents),
q AS (SELECT coalesce(replace(title, '''', ''''''), 'NULL') AS title, replace(CASE WHEN coalesce(author, '') = '' THEN 'N/A' ELSE trim(replace(author, 'các tác giả', '')) END, '''', '''''') AS author, coalesce(replace(regexp_replace(content, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '''', ''''''), 'NULL') AS content FROM a)
SELECT 2::INT AS n, md5('INSERT INTO articles (title, author, content) VALUES (''' || title || ''', ''' || author || ''', ''' || content || ''');') AS h FROM q
UNION ALL SELECT 0, md5('DROP TABLE IF EXISTS articles;') UNION ALL SELECT 1, md5('CREATE TABLE articles (id SERIAL PRIMARY KEY, title TEXT, author TEXT, content TEXT);')""")
def articles_script(spark, d):
    """Documents as articles of a dump, with a numbered key and authors without the words that name them so."""
    table(spark, d, "documents").createOrReplaceTempView("documents_as_articles")
    articles = spark.sql(f"SELECT {_ARTICLE} FROM documents_as_articles")
    return R.script_of(articles, "articles", "id", "author").select("n", F.md5("statement").alias("h"))


@ADD()
def chunk_table_function(spark, d):
    """Chunks by the table function: as chunk_recursive has them, but for empty documents, which have none either way."""
    spark.udtf.register("split_chunks", V.SplitChunks)
    table(spark, d, "documents").createOrReplaceTempView("documents_to_split")
    return spark.sql("SELECT doc_id, c.chunk_index, c.chunk_text FROM documents_to_split, LATERAL split_chunks(text, 400, 120) c")


@ADD(r"""
WITH c AS (SELECT doc_id, i // 280 AS chunk_index, substr(text, i + 1, 400) AS t FROM (SELECT doc_id, text, unnest(range(0, length(text), 280)) AS i FROM documents))
SELECT doc_id, chunk_index::INT AS chunk_index, 64 AS dim, true AS unit FROM c""")
def unit_embeddings(spark, d):
    """Vectors of all chunks: as many numbers as asked for, and of length 1, as the prefix of a chunk alone has words already."""
    rows = V.number_chunks(table(spark, d, "documents"), V.fixed_windows(F.col("text")), ["doc_id"])
    vectors = rows.select("doc_id", "chunk_index", V.hashing_embedder(prefix="passage: ")(F.col("chunk_text")).alias("v"))
    return vectors.select("doc_id", "chunk_index", F.size("v").alias("dim"), (F.abs(V.dot(F.col("v"), F.col("v")) - 1) < 1e-5).alias("unit"))
