"""Calls with retries, archives, checks in one pass, counts at several levels and stored sketches, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import calls as C
from ..operators import quality as Q
from ..operators import sketches as K
from ..schemas import ROLES
from ..sources import archive
from ..streaming.windows import catch_up
from .registry import Registry, place_of_its_own, table

ADD = Registry()


def checker(row: dict, n: int) -> dict:
    """Stands for the service that checks claims: it is starting for a while, and refuses some claims for good."""
    claim = row["o_orderkey"]
    if claim % 11 == 0:
        raise C.Refused(400)
    if n <= claim % 5:
        raise C.Refused(503)
    return {"label": "SUPPORTED" if row["o_orderstatus"] == "F" else "NEI", "confidence": claim % 100 / 100}


def _called(spark, d):
    place = place_of_its_own(spark, "checked")
    claims = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    C.call(claims, checker, "label string, confidence double", asked=["o_orderkey", "o_orderstatus"], sleep=_no_time).write.parquet(place)
    return C.sorted_out(spark.read.parquet(place))


def _no_time(seconds: float) -> None:
    """A clock on which waiting takes no time."""


@ADD("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'SUPPORTED' ELSE 'NEI' END AS label, (o_orderkey % 100) / 100e0 AS confidence, (o_orderkey % 5 + 1)::INT AS attempts, [0e0, 5e0, 15e0][(o_orderkey % 5 + 1)::INT] AS waited
FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 5 < 3""")
def checked_claims(spark, d):
    """Claims that the service has answered, after how many attempts and how much waiting."""
    answered, _ = _called(spark, d)
    return answered.select("o_orderkey", "call_answer.label", "call_answer.confidence", F.col("call_attempts").alias("attempts"), F.col("call_waited").alias("waited"))


@ADD("""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 400 ELSE 503 END::INT AS status, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 3 END::INT AS attempts, CASE WHEN o_orderkey % 11 = 0 THEN 0e0 ELSE 15e0 END AS waited
FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 5 >= 3""")
def unchecked_claims(spark, d):
    """Claims that it has not, in a table of their own."""
    _, failed = _called(spark, d)
    return failed.select("o_orderkey", F.col("call_status").alias("status"), F.col("call_attempts").alias("attempts"), F.col("call_waited").alias("waited"))


def summarizer(row: dict, n: int) -> dict:
    """Stands for the service that summarizes: it gives the first words, times out at first for some texts, and says nothing of short ones."""
    if row["doc_id"] % 7 >= n:
        raise TimeoutError("read")
    words = [w for w in (row["text"] or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return C.summary_answer({"summary": " ".join(words[:8]) if len(words) > 20 else " ", "output_tokens": min(len(words), 8)})


@ADD(r"""
WITH w AS (SELECT source, doc_id % 7 < 3 AND len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '')) > 20 AS told FROM documents)
SELECT source, count(*) FILTER (told) AS summaries, 0::BIGINT AS input_tokens, 8 * count(*) FILTER (told) AS output_tokens FROM w GROUP BY source""")
def summary_tokens(spark, d):
    """What summaries of each source have cost in tokens; the service never says how many it has read."""
    place = place_of_its_own(spark, "summaries")
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    C.call(docs, summarizer, "summary string, input_tokens long, output_tokens long", asked=["doc_id", "text"], keep=["source"], policy=C.SUMMARIES, sleep=_no_time).write.parquet(place)
    return C.token_totals(spark.read.parquet(place), "source")


def _archive(spark, d, form):
    archive.register(spark)
    return form.format("archive").option("path", f"{d}/pages.parquet").option("size", "20")


@ADD("SELECT page_id // 20 AS page, page_id, url, md5(html) AS h FROM pages")
def archive_pages(spark, d):
    return _archive(spark, d, spark.read).load().select("page", "page_id", "url", F.md5("html").alias("h"))


@ADD("SELECT page_id // 20 AS page, page_id, url FROM pages WHERE page_id // 20 >= 1 AND page_id // 20 < (SELECT max(page_id) // 20 FROM pages) AND contains(url, '/en/')")
def archive_range(spark, d):
    """Pages of a range alone are fetched; what else is asked of them is Spark's to check."""
    last = table(spark, d, "pages").agg(F.floor(F.max("page_id") / 20)).first()[0]
    pages = _archive(spark, d, spark.read).load()
    return pages.where((F.col("page") >= 1) & (F.col("page") < last) & F.contains("url", F.lit("/en/"))).select("page", "page_id", "url")


@ADD("SELECT page_id // 20 AS page, count(*) AS n, count(*) FILTER (contains(html, '<table')) AS tables FROM pages GROUP BY 1")
def archive_stream(spark, d):
    """The archive as a stream, page by page, from its checkpoint until there is no more."""
    place = place_of_its_own(spark, "archive")
    rows = _archive(spark, d, spark.readStream).load().select("page", "page_id", F.contains("html", F.lit("<table")).alias("tables"))
    catch_up(rows, place)
    return spark.read.parquet(f"{place}/out").groupBy("page").agg(F.count("*").alias("n"), F.count_if("tables").alias("tables"))


def quality_checks() -> list[Q.Check | Q.Reference]:
    """The reference's checks, over the driver's tables that stand for its own."""
    c = F.col
    email = F.when(c("c_custkey") % 50 == 0, c("c_name")).otherwise(F.concat("c_name", F.lit("@example.org")))
    return [
        Q.counted("customer", "users"), Q.no_rows("customer", "email", ~T.is_email(email)), Q.unique("customer", "email_unique", email), Q.no_rows("customer", "created_at", c("c_acctbal").isNull()),
        Q.counted("orders", "projects"), Q.unique("orders", "collection_name", F.concat_ws("_", "o_orderkey", "o_custkey")), Q.Reference("orders", "owner", "o_custkey", "customer", "c_custkey"),
        Q.filled("orders", "times", c("o_orderdate"), c("o_orderpriority")), Q.Check("orders", "drafts", F.count_if(c("o_orderstatus") == "O"), "PASS"), Q.Check("orders", "published", F.count_if(c("o_orderstatus") != "O"), "PASS"),
        Q.counted("documents", "documents"), Q.filled("documents", "title", c("source")), Q.filled("documents", "content", c("text")), Q.no_rows("documents", "status", ~F.coalesce(c("lang").isin("en", "de", "fr"), F.lit(False))),
        Q.Reference("documents", "owner", "doc_id", "labels", "doc_id", "WARN"), Q.no_rows("documents", "abstract_short", F.length("text").between(1, 49), "WARN"), Q.unique("documents", "text_unique", F.md5("text"), "WARN"),
        Q.no_rows("embeddings", "embedding", c("embedding").isNull(), "WARN"), Q.no_rows("embeddings", "size", F.size("embedding") != 64), Q.Reference("embeddings", "orphan", "vec_id", "documents", "doc_id"),
        Q.filled("labels", "summary", c("quality")), Q.no_rows("conversations", "role", ~F.coalesce(c("role").isin(*ROLES[:2]), F.lit(False))), Q.filled("conversations", "message", c("text")),
    ]


@ADD(r"""
WITH u AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN c_name ELSE c_name || '@example.org' END AS e, c_acctbal FROM customer),
r(place, "table", "check", level, rows, wrong) AS (
SELECT 0, 'customer', 'users', 'PASS', count(*), count(*) FROM u UNION ALL SELECT 1, 'customer', 'email', 'FAIL', count(*), count(*) FILTER (NOT regexp_matches(e, '^[^@]+@[^@]+\.[^@]+$')) FROM u
UNION ALL SELECT 2, 'customer', 'email_unique', 'FAIL', count(*), count(e) - count(DISTINCT e) FROM u UNION ALL SELECT 3, 'customer', 'created_at', 'FAIL', count(*), count(*) - count(c_acctbal) FROM u
UNION ALL SELECT 4, 'orders', 'projects', 'PASS', count(*), count(*) FROM orders UNION ALL SELECT 5, 'orders', 'collection_name', 'FAIL', count(*), count(*) - count(DISTINCT (o_orderkey, o_custkey)) FROM orders
UNION ALL SELECT 6, 'orders', 'owner', 'FAIL', count(*), count(*) FILTER (o_custkey IS NULL OR o_custkey NOT IN (SELECT c_custkey FROM customer)) FROM orders
UNION ALL SELECT 7, 'orders', 'times', 'FAIL', count(*), count(*) FILTER (o_orderdate IS NULL OR coalesce(o_orderpriority, '') = '') FROM orders
UNION ALL SELECT 8, 'orders', 'drafts', 'PASS', count(*), count(*) FILTER (o_orderstatus = 'O') FROM orders UNION ALL SELECT 9, 'orders', 'published', 'PASS', count(*), count(*) FILTER (o_orderstatus <> 'O') FROM orders
UNION ALL SELECT 10, 'documents', 'documents', 'PASS', count(*), count(*) FROM documents UNION ALL SELECT 11, 'documents', 'title', 'FAIL', count(*), count(*) FILTER (coalesce(source, '') = '') FROM documents
UNION ALL SELECT 12, 'documents', 'content', 'FAIL', count(*), count(*) FILTER (coalesce(text, '') = '') FROM documents UNION ALL SELECT 13, 'documents', 'status', 'FAIL', count(*), count(*) FILTER (lang IS NULL OR lang NOT IN ('en', 'de', 'fr')) FROM documents
UNION ALL SELECT 14, 'documents', 'owner', 'WARN', count(*), count(*) FILTER (doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels)) FROM documents
UNION ALL SELECT 15, 'documents', 'abstract_short', 'WARN', count(*), count(*) FILTER (length(text) BETWEEN 1 AND 49) FROM documents UNION ALL SELECT 16, 'documents', 'text_unique', 'WARN', count(*), count(text) - count(DISTINCT text) FROM documents
UNION ALL SELECT 17, 'embeddings', 'embedding', 'WARN', count(*), count(*) FILTER (embedding IS NULL) FROM embeddings UNION ALL SELECT 18, 'embeddings', 'size', 'FAIL', count(*), count(*) FILTER (len(embedding) <> 64) FROM embeddings
UNION ALL SELECT 19, 'embeddings', 'orphan', 'FAIL', count(*), count(*) FILTER (vec_id IS NULL OR vec_id NOT IN (SELECT doc_id FROM documents)) FROM embeddings
UNION ALL SELECT 20, 'labels', 'summary', 'FAIL', count(*), count(*) FILTER (quality IS NULL) FROM labels
UNION ALL SELECT 21, 'conversations', 'role', 'FAIL', count(*), count(*) FILTER (role IS NULL OR role NOT IN ('user', 'assistant')) FROM conversations UNION ALL SELECT 22, 'conversations', 'message', 'FAIL', count(*), count(*) FILTER (coalesce(text, '') = '') FROM conversations)
SELECT "table", place::INT AS place, "check", rows, wrong, CASE WHEN level = 'PASS' OR wrong = 0 THEN 'PASS' ELSE level END AS status FROM r""")
def quality_report(spark, d):
    checks = quality_checks()
    names = {c.table for c in checks} | {c.parent for c in checks if isinstance(c, Q.Reference)}
    return Q.report({n: table(spark, d, n) for n in names}, checks)


@ADD("SELECT lang, source, CASE WHEN grouping(lang) = 1 THEN 0 WHEN grouping(source) = 1 THEN 1 ELSE 2 END::INT AS depth, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def level_counts(spark, d):
    return K.level_counts(table(spark, d, "documents"), ["lang", "source"])


def _sketches(spark, d):
    """Sketches of every day's events, stored, and read again."""
    place = place_of_its_own(spark, "sketches")
    days = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    K.sketched(days, ["event_type", "day"], distinct="user_id", values="value").write.parquet(place)
    return spark.read.parquet(place)


@ADD("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY event_type")
def users_by_sketch(spark, d):
    """Users of each kind of event, counted, and whether days' sketches put together are within 5 % of that."""
    told = K.estimates(K.merged(_sketches(spark, d), ["event_type"])).select("event_type", "n", "distinct")
    exact = table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    return told.join(exact, "event_type").select("event_type", "n", "users", (F.abs(F.col("distinct") - F.col("users")) <= 0.05 * F.col("users")).alias("close"))


@ADD("SELECT event_type, count(value) AS n, true AS half, true AS most FROM events GROUP BY event_type")
def quantiles_by_sketch(spark, d):
    """Whether the quantiles that days' sketches give together have a rank within 0.03 of what was asked for."""
    told = K.estimates(K.merged(_sketches(spark, d), ["event_type"])).select("event_type", "q50", "q90")
    ranks = table(spark, d, "events").join(F.broadcast(told), "event_type").groupBy("event_type").agg(F.count("value").alias("n"), *[F.avg((F.col("value") <= F.col(q)).cast("int")).alias(q) for q in ("q50", "q90")])
    return ranks.select("event_type", "n", (F.abs(F.col("q50") - 0.5) <= 0.03).alias("half"), (F.abs(F.col("q90") - 0.9) <= 0.03).alias("most"))
