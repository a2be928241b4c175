"""Cleaning of texts, lines and pages: `documents` and `pages` stand for papers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import lines as L
from ..functions import text as T
from ..sources import readers as S
from .registry import Registry, table

ADD = Registry()


def _docs(spark, d):
    return table(spark, d, "documents")


@ADD(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> ''))::INT AS words, length(text)::INT AS chars, len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_matches(x, '\S')))::INT AS paragraphs FROM documents")
def text_stats(spark, d):
    s = _docs(spark, d).select("doc_id", T.text_stats(F.col("text")).alias("s"))
    return s.select("doc_id", F.col("s.word_count").alias("words"), F.col("s.char_count").alias("chars"), F.col("s.paragraph_count").alias("paragraphs"))


#: Unicode white space, which DuckDB's \s is not.
_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@ADD(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]+', ' ', 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS h FROM documents")
def whitespace_normalised(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.normalize_whitespace(T.drop_control(F.col("text")))).alias("h"))


@ADD(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\[\d+(?:[,\-–]\s*\d+)*\](\[\d+(?:[,\-–]\s*\d+)*\])*', '', 'g'), '\(\d+(?:,\s*\d+)*\)', '', 'g')) AS h FROM documents")
def citations_dropped(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.drop_citations(F.col("text"))).alias("h"))


@ADD("SELECT doc_id, md5(replace(text, '''', '''''')) AS h FROM documents")
def sql_escaped(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.escape_sql(F.col("text"))).alias("h"))


@ADD("SELECT page_id, replace(url, '/view/', '/download/') AS url FROM pages")
def download_urls(spark, d):
    return table(spark, d, "pages").select("page_id", T.download_url(F.col("url")).alias("url"))


@ADD(rf"SELECT doc_id, md5(coalesce(regexp_replace(replace('Tóm tắt' || text, 'Tóm tắt', ''), '^{_SPACE}+|{_SPACE}+$', '', 'g'), 'N/A')) AS h FROM documents")
def crawl_abstract(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.crawl_abstract(F.concat(F.lit("Tóm tắt"), "text"))).alias("h"))


_COMPOSED = r"regexp_replace(nfc_normalize(coalesce(text, '')), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"


@ADD(rf"""
WITH t AS (SELECT doc_id, string_split({_COMPOSED}, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM t),
k AS (SELECT *, trim(lower(line)) AS key FROM l), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM k)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (key <> '' AND length(key) <= 100 AND n >= 2)), '') AS text FROM c GROUP BY doc_id""")
def drop_repeated_lines(spark, d):
    """The operator with a key that SQL has too; the default key is tested on literals."""
    return L.drop_repeated(_docs(spark, d), "doc_id", "text", lambda x: F.trim(F.lower(x)))


@ADD(rf"""
WITH t AS (SELECT doc_id, string_split({_COMPOSED}, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM t),
m AS (SELECT *, min(CASE WHEN contains(line, ' the ') THEN pos END) OVER (PARTITION BY doc_id) AS stop FROM l)
SELECT doc_id, count(*) FILTER (stop IS NULL OR pos < stop) AS lines, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stop IS NULL OR pos < stop), '')) AS h FROM m GROUP BY doc_id""")
def truncate_at_marker(spark, d):
    return L.truncate(_docs(spark, d), "doc_id", "text", lambda x: F.contains(x, F.lit(" the "))).select("doc_id", "lines", F.md5("text").alias("h"))


@ADD(r"""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9)) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l),
n AS (SELECT *, CASE WHEN line = '' OR length(line) >= 60 OR before IS NULL OR before = '' OR regexp_matches(before, '[.:?!;]$') THEN 1 ELSE 0 END AS new FROM p),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM n),
m AS (SELECT doc_id, g, string_agg(line, ' ' ORDER BY pos) AS line FROM g GROUP BY doc_id, g)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY g)) AS h FROM m GROUP BY doc_id""")
def line_merge(spark, d):
    merged = F.array_join(T.merge_lines(F.split("text", "\n", -1)), "\n")
    return _docs(spark, d).select("doc_id", F.md5(merged).alias("h"))


#: Lines of each kind, and which flags hold of them; %s is a name.
SAMPLES = {
    "| %s | b |": "table section_boundary artifact early_artifact", "|---|---|": "table section_boundary artifact early_artifact junk", "![%s](x.png)": "image section_boundary artifact early_artifact", "==> picture %s intentionally omitted <==": "image section_boundary artifact early_artifact",
    "-----": "section_boundary artifact early_artifact junk", "12 3 - x": "section_boundary junk", "## References": "section_boundary body_stop", "Lời cảm ơn": "section_boundary body_stop", "1. Introduction": "section_boundary body_start_term body_start",
    "2.1 Đánh giá mô hình": "section_boundary body_start", "Keywords: %s, data": "section_boundary publication_metadata front_matter artifact", "Received: 1 May 2020": "section_boundary publication_metadata front_matter artifact early_artifact",
    "%s mails a.b@example.org": "section_boundary publication_metadata front_matter artifact early_artifact", "Hình 2: %s": "section_boundary artifact early_artifact", "Nguyen Van An": "section_boundary author_name", "nguyen van an": "section_boundary",
    "an ordinary sentence of %s that is much too long to be taken for a heading since it just goes on and on": "",
}


@ADD("WITH s(line, flags) AS (VALUES " + ", ".join("('" + k.replace("'", "''") + f"', '{v}')" for k, v in SAMPLES.items()) + ") SELECT n_nationkey, line, " + ", ".join(f"list_contains(string_split(flags, ' '), '{f}') AS \"{f}\"" for f in L.FLAGS) + " FROM nation, s")
def line_kinds(spark, d):
    """Every flag on lines of every kind, with a nation's key as name."""
    names = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("name"), "n_nationkey").alias("name"))
    rows = names.select("n_nationkey", "name", F.explode(F.array(*map(F.lit, SAMPLES))).alias("kind"))
    rows = L.describe(rows.withColumn("line", F.replace("kind", F.lit("%s"), F.col("name"))))
    return rows.select("n_nationkey", F.col("kind").alias("line"), *L.FLAGS)


@ADD("SELECT page_id, 2::BIGINT AS tables FROM pages")
def table_lines(spark, d):
    """Tables around the lines of a page's url: one row, one rule."""
    text = F.concat(F.lit("| a | "), "url", F.lit(" |\n|---|---|\n| one bar\nplain "), "url")
    rows = L.describe(L.lines_of(table(spark, d, "pages").withColumn("text", text), "page_id", "text"))
    return rows.groupBy("page_id").agg(F.count_if("table").alias("tables"))


@ADD(r"SELECT doc_id, md5(strip_accents(text)) AS key FROM documents")
def accents_stripped(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.strip_accents(F.col("text"))).alias("key"))


@ADD(r"SELECT doc_id, length(text) BETWEEN 50 AND 20000 AS accepted FROM documents")
def summary_requests(spark, d):
    return _docs(spark, d).select("doc_id", S.text_request_ok(F.col("text")).alias("accepted"))


@ADD("SELECT page_id, CASE WHEN octet_length(encode(html)) > 3000 THEN 413 WHEN substr(html, 1, 4) <> '%PDF' THEN 415 ELSE 200 END::INT AS status FROM pages")
def upload_status(spark, d):
    return table(spark, d, "pages").select("page_id", S.upload_status(F.octet_length("html"), F.encode("html", "utf-8"), F.lit(True), most=3000).alias("status"))


@ADD()
def strong_clean(spark, d):
    return _docs(spark, d).select("doc_id", T.strong_clean(F.col("text")).alias("text"))


@ADD()
def academic_clean(spark, d):
    return _docs(spark, d).select("doc_id", T.clean_academic_text(F.col("text")).alias("text"))


@ADD()
def preclean(spark, d):
    return L.preclean(_docs(spark, d), "doc_id", "text")


@ADD()
def clean_body(spark, d):
    return L.clean_body(_docs(spark, d), "doc_id", "text")


@ADD()
def line_flags(spark, d):
    """Numbers of lines of each kind over all lines of all documents."""
    return L.describe(L.lines_of(_docs(spark, d), "doc_id", "text")).agg(*[F.count_if(name).alias(name) for name in L.FLAGS])


@ADD("SELECT doc_id, md5(nfc_normalize(text)) AS h FROM documents")
def composed(spark, d):
    """Texts are taken apart and put together again."""
    return _docs(spark, d).select("doc_id", F.md5(T.nfc(T.nfd(F.col("text")))).alias("h"))


@ADD()
def html_metadata(spark, d):
    return H.metadata(table(spark, d, "pages"), "page_id", F.col("html"))


@ADD()
def html_body(spark, d):
    return H.body_text(table(spark, d, "pages"), "page_id", "html")


@ADD()
def page_record(spark, d):
    return H.record(table(spark, d, "pages"), "page_id", "html")


@ADD()
def page_raw_text(spark, d):
    return H.raw_text(table(spark, d, "pages"), "page_id", "html")


@ADD(r"""
SELECT c_custkey AS id, c_name || ' A,' || c_mktsegment || ',B' AS author FROM (SELECT c_custkey, replace(c_name, '#', ',') AS c_name, c_mktsegment FROM customer)""")
def author_column(spark, d):
    raw = F.concat(F.lit(";"), "c_name", F.lit(" A*  ,Các Tác Giả\n"), "c_mktsegment", F.lit(" ;; B,"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.clean_author_column(raw).alias("author"))


@ADD(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[^\P{{C}}\n\t]', '', 'g'), '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g')) AS h FROM documents")
def question_texts(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.clean_question_text(F.concat(F.col("text"), F.lit("\x00")))).alias("h"))


@ADD("SELECT conv_id, turn, 'See [S' || turn || '], then' || chr(127) || ' more.' AS shown, 'a' || chr(127) AS legal, 'ab' AS whole FROM conversations")
def shown_answers(spark, d):
    answer = F.concat(F.lit("See [s"), "turn", F.lit("] , then\x7f more .\n"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.clean_shown_answer(answer).alias("shown"), T.drop_illegal(F.lit("a\x7f\x02")).alias("legal"), T.drop_null_bytes(F.lit("a\x00b")).alias("whole"))


@ADD("SELECT page_id, lower(url) LIKE '%.pdf' AND octet_length(encode(html)) <= 20 * 1024 * 1024 AND length(html) >= 100 AS accepted FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '.PDF' ELSE url END AS url, html FROM pages)")
def pdf_requests(spark, d):
    name = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit(".PDF"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", S.pdf_request_ok(name, F.octet_length("html"), F.col("html")).alias("accepted"))


@ADD(r"""
SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def page_links(spark, d):
    return H.links(table(spark, d, "pages"), "page_id", "html").select("page_id", "href")


@ADD("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 10")
def crawl_quota(spark, d):
    """Candidates are counted, not successes."""
    return _docs(spark, d).withColumn("n", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where("n <= 10").select("source", "doc_id")
