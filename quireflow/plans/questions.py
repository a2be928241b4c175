"""Chunks, retrieval, answers, verification and summaries over `documents`, `embeddings`, `conversations` and `lineitem`."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims as C
from ..operators import retrieval as V
from .registry import Registry, place_of_its_own, table

ADD = Registry()

_SCORED = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE vec_id % 20 = 0),
c AS (SELECT vec_id AS chunk_id, source, embedding::DOUBLE[] AS b, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS m FROM embeddings JOIN documents ON doc_id = vec_id),
s AS (SELECT query_id, chunk_id, source, round(list_dot_product(a, b) / (n * m), 9) AS score FROM q, c WHERE query_id <> chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM s)
SELECT query_id, chunk_id, source, rank FROM r WHERE rank <= 5 AND """


def _retrieved(spark, d, fallback: bool, threshold: float | None = 0.38, k: int = 5):
    """Every vector whose id 20 divides asks, all chunks of documents answer; an entry does not answer itself."""
    vectors = table(spark, d, "embeddings")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    chunks = vectors.join(docs, "vec_id").select(F.col("vec_id").alias("chunk_id"), "source", F.col("embedding").alias("vec"))
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    found = V.top_k(queries, chunks, k=k, threshold=threshold, fallback=fallback, others=True, digits=9)
    return found.select("query_id", "chunk_id", "source", "rank")


@ADD(_SCORED + "(score >= 0.38 OR best < 0.38)")
def vec_topk_fallback(spark, d):
    return _retrieved(spark, d, True)


@ADD(_SCORED + "score >= 0.38")
def vec_topk_threshold(spark, d):
    return _retrieved(spark, d, False)


@ADD(_SCORED + "true")
def vec_topk_exact(spark, d):
    return _retrieved(spark, d, False, None)


_BY_PROJECT = _SCORED.replace("AS query_id, embedding", "AS query_id, source, embedding").replace("FROM embeddings WHERE vec_id % 20 = 0", "FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 20 = 0").replace("SELECT query_id, chunk_id, source, round", "SELECT query_id, chunk_id, c.source AS project_id, round").replace("FROM q, c WHERE", "FROM q JOIN c ON c.source = q.source WHERE").replace("SELECT query_id, chunk_id, source, rank", "SELECT query_id, chunk_id, project_id, rank")


@ADD(_BY_PROJECT + "(score >= 0.38 OR best < 0.38)")
def project_search(spark, d):
    """The source of a document is its project: chunks are stored by it, every question looks at its own project's."""
    place = place_of_its_own(spark, "chunks")
    vectors = table(spark, d, "embeddings").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("project_id")), "vec_id")
    V.store_chunks(vectors.select("project_id", F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec")), place)
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "project_id", F.col("embedding").alias("vec"))
    found = V.search_projects(spark.read.parquet(place), queries, k=5, threshold=0.38, others=True, digits=9)
    return found.select("query_id", "chunk_id", "project_id", "rank")


@ADD("SELECT vec_id, CASE WHEN len(embedding) = 64 THEN len(embedding) END AS size, vec_id % 3 = 0 AS again FROM embeddings")
def retyped_vectors(spark, d):
    """Vectors of which a third come from a model of another size, after the column's type has changed: those have to be embedded anew."""
    vectors = table(spark, d, "embeddings")
    other = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 48)).otherwise(F.col("embedding"))
    kept = V.retyped(vectors.withColumn("embedding", other), 64)
    whole = kept.join(vectors.select("vec_id", F.col("embedding").alias("__new")), "vec_id").withColumn("again", F.col("embedding").isNull())
    return whole.select("vec_id", F.size(F.coalesce("embedding", "__new")).alias("size"), "again")


@ADD("SELECT doc_id, (i // 280)::INT AS chunk_index, md5(substr(text, i + 1, 400)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text), 280)) AS i FROM documents)")
def chunk_fixed_windows(spark, d):
    rows = V.number_chunks(table(spark, d, "documents"), V.fixed_windows(F.col("text")), ["doc_id"])
    return rows.select("doc_id", "chunk_index", F.md5("chunk_text").alias("h"))


@ADD()
def chunk_recursive(spark, d):
    return V.number_chunks(table(spark, d, "documents"), V.recursive_chunks()(F.col("text")), ["doc_id"])


@ADD()
def chunk_embeddings(spark, d):
    rows = V.number_chunks(table(spark, d, "documents"), V.fixed_windows(F.col("text")), ["doc_id"])
    return rows.select("doc_id", "chunk_index", F.size(V.hashing_embedder(prefix="passage: ")(F.col("chunk_text"))).alias("dim"))


_TOKENS = r"len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> ''))"


@ADD(f"SELECT doc_id, i::INT AS position, least(100, n - i * 90)::INT AS tokens FROM (SELECT doc_id, n, unnest(range(0, greatest(0, ceil((n - 100) / 90))::BIGINT + 1)) AS i FROM (SELECT doc_id, {_TOKENS} AS n FROM documents) WHERE n > 0)")
def token_windows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(V.token_windows(T.words(F.col("text")), 100, 10)).alias("position", "w"))
    return rows.select("doc_id", "position", F.size("w").alias("tokens"))


@ADD("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 10")
def history_last_n(spark, d):
    last = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, d, "conversations").withColumn("n", last).where("n <= 10").select("conv_id", "turn", "role")


@ADD("SELECT conv_id, string_agg(upper(role) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS block FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 5 GROUP BY conv_id")
def history_block(spark, d):
    return V.history_block(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


def _found(spark, d):
    """The documents that were found for each query, best first."""
    return _retrieved(spark, d, True, k=20).select("query_id", F.col("chunk_id").alias("doc_id"), "rank")


def _distinct(spark, d, found):
    """The sources among what was found: texts are told apart by their names, and stay where they are."""
    named = table(spark, d, "documents").select("doc_id", V.text_name(F.col("text")).alias("name")).where(F.col("name").isNotNull())
    return V.distinct_chunks(found.join(named, "doc_id"))


_SOURCES = _SCORED.replace("SELECT query_id, chunk_id, source, rank FROM r WHERE rank <= 5 AND ", r"""
f AS (SELECT query_id, chunk_id AS doc_id, rank FROM r WHERE rank <= 20 AND (score >= 0.38 OR best < 0.38)),
t AS (SELECT query_id, doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, rank FROM f JOIN documents USING (doc_id)),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY rank) AS n FROM t WHERE length(text) > 40),
s AS (SELECT query_id, doc_id, text, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS source FROM u WHERE n = 1)
""").replace("AS best FROM s)", "AS best FROM s),").replace("s AS (SELECT query_id, chunk_id, source, round", "p AS (SELECT query_id, chunk_id, source, round").replace("AS best FROM s)", "AS best FROM p)")


@ADD(_SOURCES + "SELECT query_id, doc_id, source FROM s")
def dedup_chunks(spark, d):
    return _distinct(spark, d, _found(spark, d)).select("query_id", "doc_id", "source")


@ADD(_SOURCES + "SELECT query_id, string_agg('[S' || source || ']' || chr(10) || text || chr(10) || chr(10), '' ORDER BY source) AS block FROM s GROUP BY query_id")
def sources_block(spark, d):
    """What was found is written, a few numbers a row: the texts of these documents alone move."""
    place = place_of_its_own(spark, "found")
    found = _found(spark, d)
    found.write.parquet(place)
    found = spark.read.schema(found.schema).parquet(place)
    docs = table(spark, d, "documents").select("doc_id", "text")
    return V.sources_block(V.with_texts(_distinct(spark, d, found), docs, found.select("doc_id").distinct()))


@ADD("SELECT doc_id, unnest(list_filter(range(1, 11), lambda s: contains('See [S' || doc_id % 10 || '] and [S' || doc_id % 7 || '].', '[S' || s || ']')))::INT AS source FROM documents")
def citations(spark, d):
    answer = F.format_string("See [s%d] and [S%d].", F.col("doc_id") % 10, F.col("doc_id") % 7)
    sources = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.struct(i.alias("source"), F.lit(0.5).alias("score")))
    rows = table(spark, d, "documents").select("doc_id", F.explode(V.cited(T.clean_answer(answer), sources)).alias("c"))
    return rows.select("doc_id", F.col("c.source").alias("source"))


@ADD("SELECT doc_id, (doc_id % 10)::INT AS mark FROM documents UNION ALL SELECT doc_id, (doc_id % 7)::INT FROM documents")
def citation_marks(spark, d):
    answer = F.format_string("See [s%d] and [S%d].", F.col("doc_id") % 10, F.col("doc_id") % 7)
    return table(spark, d, "documents").select("doc_id", F.explode(V.marks(answer)).alias("mark"))


@ADD("SELECT conv_id, CASE WHEN count(*) > 3 THEN 'long' ELSE 'short' END AS answer FROM conversations GROUP BY 1")
def canned_answer(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.when(F.count("*") > 3, "long").otherwise("short").alias("answer"))


def _pairs(spark, d):
    """Discounts and taxes of an order's lines in hundredths as scores against and for it."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim"), (cents("l_discount") * 8).alias("refuted"), (cents("l_tax") * 8).alias("supported"), (100 - cents("l_discount") - cents("l_tax")).alias("nei"))


_NLI = """
WITH p AS (SELECT l_orderkey AS claim, round(l_discount * 100)::BIGINT * 8 AS r, round(l_tax * 100)::BIGINT * 8 AS s, 100 - round(l_discount * 100)::BIGINT - round(l_tax * 100)::BIGINT AS n FROM lineitem),
a AS (SELECT claim, max(r) AS r, max(s) AS s, sum(n)::BIGINT AS n, count(*) AS k FROM p GROUP BY claim),
w AS (SELECT claim, k, r * k AS r, s * k AS s, n, r * k + s * k + n AS whole FROM a),
f AS (SELECT claim, k, CASE WHEN whole > 0 THEN r::DOUBLE / whole ELSE 0 END AS r, CASE WHEN whole > 0 THEN s::DOUBLE / whole ELSE 0 END AS s, CASE WHEN whole > 0 THEN n::DOUBLE / whole ELSE 0 END AS n FROM w),
l AS (SELECT *, CASE WHEN r >= s AND r >= n THEN 'REFUTED' WHEN s >= n THEN 'SUPPORTED' ELSE 'NEI' END AS first, round(greatest(r, s, n), 4) AS score FROM f),
t AS (SELECT *, CASE first WHEN 'REFUTED' THEN 0.8e0 WHEN 'SUPPORTED' THEN 0.65e0 ELSE 0.6e0 END AS threshold FROM l)
SELECT claim, CASE WHEN score < threshold THEN 'NEI' ELSE first END AS label, threshold, k::INT AS chunks_used,
       (CASE WHEN score < threshold THEN round(n, 4) ELSE score END) < 0.7e0 OR score < threshold OR first = 'NEI' AS needs_stage2 FROM t"""


@ADD(_NLI)
def nli_aggregate(spark, d):
    return C.verdict(C.label_scores(_pairs(spark, d), "claim")).select("claim", "label", "threshold", "chunks_used", "needs_stage2")


@ADD("SELECT o_orderkey AS claim, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) THEN true ELSE false END AS has_evidence FROM orders")
def verify_all_claims(spark, d):
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim"))
    pairs = _pairs(spark, d).join(table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("claim")).distinct(), "claim", "left_semi")
    return C.verify(claims, pairs, "claim").select("claim", (F.col("chunks_used") > 0).alias("has_evidence"))


@ADD("SELECT l_orderkey, l_partkey, l_suppkey, position FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice)::INT AS position FROM lineitem) WHERE position <= 10")
def evidence_pairs(spark, d):
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    return C.pair_evidence(claims, lines, "l_orderkey", ["l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_partkey", "l_suppkey", "position")


@ADD("SELECT doc_id, CASE quality WHEN 0 THEN 'REFUTED' ELSE 'SUPPORTED' END AS label, CASE quality WHEN 0 THEN 'warning' END AS notice, format('{:.1f}%', 100 * (doc_id % 8) / 8) AS confidence FROM labels")
def answer_labels(spark, d):
    label = C.normal_label(F.when(F.col("quality") == 0, "refuted").otherwise("SUPORTED"))
    return table(spark, d, "labels").select("doc_id", label.alias("label"), C.notice(label).alias("notice"), C.percent((F.col("doc_id") % 8) / 8).alias("confidence"))


@ADD(f"SELECT doc_id, n::INT AS tokens, CASE WHEN n <= 874 THEN 'single' WHEN ceil((n - 874) / 824) + 1 <= 5 THEN 'flat' ELSE 'hierarchical' END AS strategy FROM (SELECT doc_id, {_TOKENS} AS n FROM documents)")
def summary_strategy(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.words(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("tokens"), F.size(V.token_windows(F.col("t"))).alias("w"))
    return rows.select("doc_id", "tokens", C.strategy(F.col("tokens"), F.col("w")).alias("strategy"))


@ADD("SELECT conv_id, (turn // 4)::INT AS turn, string_agg(role, ' ' ORDER BY turn) AS role FROM conversations GROUP BY conv_id, turn // 4")
def map_reduce_groups(spark, d):
    return C.reduce_groups(table(spark, d, "conversations"), "conv_id", "turn", "role")


@ADD()
def summarize(spark, d):
    return C.summarize(table(spark, d, "documents"), "doc_id", "text")


@ADD("SELECT conv_id, 'Q: ' || max_by(text, turn) || ' | ' || count(*) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id")
def prompts(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("q"), F.count("*").cast("string").alias("n"))
    return asked.select("conv_id", F.concat(F.lit("Q: "), F.col("q"), F.lit(" | "), F.col("n")).alias("prompt"))
