"""Every query over the reference's operators, against SQL where there is some; cases on literals where there is none."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quireflow.functions import html, lines, text
from quireflow.operators import records, retrieval
from quireflow.plans import catalogue
from quireflow.sources import readers
from quireflow.streaming import ingest


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(same_as_sql, name):
    same_as_sql(catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs_without_sql(spark, name):
    df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns and df.count() > 0


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns


@pytest.fixture
def papers(spark, tmp_path):
    texts = [" \tends in white space \n", "a  b\t\tc", "\u00a0wide\u3000", "One line\ngoes on\n\nNew. \nAfter a stop\n" + "x" * 60 + "\nend ", "\n \n", "", "x\x07y"]
    rows = [(i, texts[i % len(texts)], "odd" if i % 4 == 1 else f"s{i % 4}", 10) for i in range(21)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    return f"file://{tmp_path}", rows


def test_whole_tables(spark, papers):
    """No row is left out: each against plain Python."""
    place, rows = papers
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    got = lambda name: {tuple(r) for r in catalogue.QUERIES[name](spark, place).collect()}

    def merged(text):
        out, before = [], ""
        for line in (x.strip() for x in text.split("\n")):
            if not out or line == "" or len(line) >= 60 or before == "" or before[-1] in ".:?!;":
                out.append(line)
            else:
                out[-1] += " " + line
            before = line
        return "\n".join(out)

    assert got("whitespace_normalised") == {(i, md5(re.sub(r"[ \t]+", " ", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t)).strip())) for i, t, _, _ in rows}
    assert got("line_merge") == {(i, md5(merged(t))) for i, t, _, _ in rows}
    assert got("pending_ttl") == {("s0", True, 10), ("odd", True, 10), ("s2", False, 300), ("s3", False, 300)}


@pytest.mark.parametrize(
    ("f", "value", "wanted"),
    [
        (text.strip_markdown, "## **Bold** and `code` _it_", "Bold and  it"),
        (text.match_key, "# Phương  pháp—Đo", "phuong phap do"),
        (text.clean_authors, "Nguyễn An [1], Trần Bình 2; An, Nguyễn An", "Nguyễn An, Trần Bình"),
        (text.strip_accents, "đặt Vấn ĐỀ", "dat Van DE"),
        (text.clean_paragraph, "seg- mentation works [1, 2] well", "segmentation works well"),
        (text.strong_clean, "head INTRODUCTION a\n\nb REFERENCES c", "INTRODUCTION a b"),
        (text.strong_clean, None, ""),
    ],
)
def test_on_literals(spark, f, value, wanted):
    got = one(spark, value, f)
    assert " ".join(got.split(" ")) == wanted if isinstance(got, str) else got == wanted


def of(spark, value, f, **how):
    df = f(spark.createDataFrame([(1, value)], "id long, x string"), "id", "x", **how).drop("id")
    rows = df.collect()
    return (rows[0] if len(df.columns) > 1 else rows[0][0]) if rows else None


@pytest.mark.parametrize(
    ("f", "value", "wanted"),
    [
        (lines.preclean, "Head\nsame\nbody of it\nsame\n```\ncode\n```\nend", "Head\nbody of it\nend"),
        (lines.preclean, None, ""),
        (lines.preclean, "a\n| t | u |\nBảng 1. x\n\nb\n---\nHình 2: y\nc", "a\n\nb\nc"),
        (lines.clean_body, "A first line of the body\n## References\n[1] gone", "A first line of the body"),
        (lines.clean_body, "## **Head** [1,2]\nsome  text (3) .\n12 3 - x\nmore", "Head\nsome text.\nmore"),
        (lines.clean_body, "same\nsame\n", ""),
        (lines.clean_body, None, ""),
    ],
)
@pytest.mark.parametrize("form", ["NFC", "NFD"])
def test_documents_as_lines(spark, f, value, wanted, form):
    """Composed and decomposed letters make no difference."""
    assert of(spark, value and unicodedata.normalize(form, value), f) == wanted


def test_captions_as_read_line_by_line(spark):
    """Against the rule as a loop over lines, with long captions that could go on from others."""
    r = random.Random(5)
    kinds = {"cap": "Hình 1. " + "dài hơn " * 17, "short": "Bảng 2: x", "long": "dòng chữ " * 17, "blank": "", "table": "| a |", "plain": "ngắn"}
    docs = [[r.choice(list(kinds)) for _ in range(r.randrange(1, 25))] for _ in range(60)]
    rows = [(i, "\n".join(kinds[k] + (f" {n}" if k not in ("blank", "table") else "") for n, k in enumerate(d))) for i, d in enumerate(docs)]
    marked = lines.mark_captions(lines.describe(lines.lines_of(spark.createDataFrame(rows, "id long, x string"), "id", "x")).withColumn("live", F.lit(True)))
    got: dict = {}
    for x in marked.orderBy("id", "pos").collect():
        got.setdefault(x.id, []).append(x)
    for i in range(len(docs)):
        left, want = 0, []
        for x in got[i]:
            goes_on = left > 0 and x.bare != "" and len(x.bare) <= 170 and not x.section_boundary
            if x.table:
                want.append(False)
                continue
            want.append(not goes_on and not x.caption)
            left = left - 1 if goes_on else 2 if x.caption else 0
        assert [x.live for x in got[i]] == want


def test_page_metadata(spark):
    page = "<h1>A title of a paper</h1><p>Nguyen Van An, Tran Thi Binh</p><p>Tóm tắt: What it says. Từ khóa: one, two</p>"
    for form in ("NFC", "NFD"):
        got = html.metadata(spark.createDataFrame([(1, unicodedata.normalize(form, page))], "id long, x string"), "id", F.col("x")).first()
        assert (got.title, got.authors, got.abstract, got.keywords) == ("A title of a paper", "Nguyen Van An, Tran Thi Binh", "What it says", "one, two")
    assert tuple(html.metadata(spark.createDataFrame([(1, None), (2, "no tags")], "id long, x string"), "id", F.col("x")).orderBy("id").collect()[1])[1:] == ("", "", "", "")


PAPER = (
    "<h1>A title of a paper</h1><p>Nguyen Van An, Tran Thi Binh</p><p>Abstract: said before. Keywords: one, two</p><h2>1. Introduction</h2><p>The text of the intro- duction [1, 2] is here .</p>"
    "<table><tr><td><div><p>cell that is hidden</p></div></td></tr></table><ol start='3'><li>third thing</li><li>fourth<table><tr><td>no</td></tr></table> thing</li></ol><ul><li>dotted</li></ul>"
    "<pre><p>code</p></pre><h2>References</h2><p>[1] A book that is left out of the body</p>"
)


def test_bodies_of_pages(spark):
    assert of(spark, PAPER, html.body_text) == "1. Introduction\n\nThe text of the introduction is here.\n\n3. third thing\n4. fourth thing\n\n- dotted"
    assert of(spark, "<p>short</p>", html.body_text) is None and of(spark, None, html.body_text) is None
    got = of(spark, PAPER, html.record)
    assert (got.title, got.authors, got.content[:15]) == ("A title of a paper", "Nguyen Van An, Tran Thi Binh", "1. Introduction")
    assert tuple(of(spark, None, html.record)) == ("",) * 5
    raw = of(spark, PAPER, html.raw_text)
    assert raw.startswith("Tiêu đề: A title of a paper\nTác giả: Nguyen Van An, Tran Thi Binh\n\n") and "hidden" not in raw and "#" not in raw and raw.count("A title of a paper") == 1
    late = "<h3>Alpha beta</h3>" + "<p>Received: 1 May 2020</p>" + "<h3>Gamma delta</h3><p>Words of the body that go on for quite a while and then for some more of it.</p>"
    assert of(spark, late, html.body_text).startswith("Gamma delta")


def _late(n):
    """A page whose title, authors, abstract and keywords begin after n characters of a long lead."""
    lead = "<ul>" + "<li>an entry of a long list that stands before the paper</li>" * (n // 60 + 1) + "</ul>"
    return lead + "<h1>A title of a paper</h1><p>Nguyen Van An, Tran Thi Binh</p><p>Tóm tắt: What it says. Từ khóa: one, two</p><h2>1. Introduction</h2><p>The text of the introduction is here.</p>"


@pytest.mark.parametrize("n", [6_000, 70_000])
def test_records_read_whole_pages(spark, n):
    got = of(spark, _late(n), html.record)
    assert tuple(got)[:4] == ("A title of a paper", "Nguyen Van An, Tran Thi Binh", "What it says", "one, two") and got.content.endswith("The text of the introduction is here.")


@pytest.mark.parametrize("n", [6_000, 70_000])
def test_raw_texts_read_whole_pages(spark, n):
    raw = of(spark, _late(n), html.raw_text)
    assert raw.startswith("Tiêu đề: A title of a paper\nTác giả: Nguyen Van An, Tran Thi Binh\n\n") and raw.count("A title of a paper") == 1 and raw.endswith("The text of the introduction is here.")


def test_every_page_has_its_own_record(spark):
    """Pages of one id, of none, and the same page twice."""
    other = PAPER.replace("A title of a paper", "Another title")
    pages = [(7, PAPER), (7, other), (None, PAPER), (None, None), (8, ""), (9, PAPER), (9, PAPER)]
    df = spark.createDataFrame(pages, "id long, x string").repartition(3)
    alone = {html_: (of(spark, html_, html.record), of(spark, html_, html.raw_text)) for html_ in {x for _, x in pages}}
    got = sorted(tuple(x) for x in html.record(df, "id", "x").fillna(-1, ["id"]).collect())
    assert got == sorted((-1 if i is None else i, *alone[x][0]) for i, x in pages)
    texts = sorted(tuple(x) for x in html.raw_text(df, "id", "x").fillna(-1, ["id"]).collect())
    assert texts == sorted((-1 if i is None else i, alone[x][1]) for i, x in pages) and "Another title" in "".join(x for _, x in texts)


def test_crawl_follows_archive_issues_and_articles(spark):
    pages = [
        ("http://j/archive/1", "<a class='title' href='http://j/issue/view/1'>I1</a><a href='http://j/issue/view/9'>no</a><a class='title' href='http://j/about'>no</a>"),
        ("http://j/issue/view/1", "<div class='obj_article_summary'><h3 class='title'><a href='http://j/a1'> One </a></h3></div><div class='obj_article_summary'><div class='title'><a href='http://j/a2'>Two</a></div></div><div class='obj_article_summary'><p>none</p></div>"),
        ("http://j/a1", "<section class='item abstract'>Tóm tắt It says</section><section class='item authors'>An</section><a class='obj_galley_link pdf' href='http://j/article/view/1'>PDF</a>"),
    ]
    got = html.crawl(spark.createDataFrame(pages, "url string, html string"), "http://j/archive").orderBy("n").collect()
    assert [(r.n, r.title, r.author, r.abstract, r.pdf_url) for r in got] == [(1, "One", "An", "It says", "http://j/article/download/1"), (2, "Two", "N/A", "N/A", None)]
    assert html.crawl(spark.createDataFrame(pages, "url string, html string"), "http://j/archive", wanted=1).count() == 1


def test_files_in_and_out(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted"\nline'), (2, None)], "id long, x string")
    place = f"file://{tmp_path}"
    readers.write_csv(rows, f"{place}/csv")
    assert sorted(map(tuple, readers.csv(spark, f"{place}/csv", "id long, x string").collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    readers.write_log(rows, f"{place}/log")
    assert {x.value for x in spark.read.text(f"{place}/log").collect()} == {'{"id":1,"x":"a \\"quoted\\"\\nline"}', '{"id":2}'}
    (tmp_path / "docs").mkdir()
    for name, body in (("a.pdf", b"%PDF one|two| "), ("b.pdf", b"bad"), ("c.txt", b"no")):
        (tmp_path / "docs" / name).write_bytes(body)

    def strict(content: bytes) -> list[str]:
        if not content.startswith(b"%PDF"):
            raise ValueError("no PDF")
        return content[5:].decode().split("|")

    found = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in readers.extracted(readers.files(spark, f"{place}/docs"), [strict], missing="N/A").collect()}
    assert found == {"a.pdf": ("one\ntwo", None), "b.pdf": ("N/A", "ValueError: no PDF")}
    kept = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(x).alias("text")) for t, x in ((0, " a "), (1, "image"), (0, " "), (0, "b"))])
    assert spark.range(1).select(readers.page_text(kept).alias("t")).first().t == "a\nb"
    spark.createDataFrame([("u", "a@b.c")], "id string, email string").write.parquet(f"{place}/users.parquet")
    assert readers.declared(spark, f"{place}/users.parquet", "users").columns[:3] == ["id", "email", "full_name"]
    with pytest.raises(LookupError):
        records.one_or_404(rows, id=9)
    with pytest.raises(ValueError, match="several"):
        records.one_or_404(rows.union(rows), id=1)


def test_streams_read_a_folder(spark, tmp_path):
    place = f"file://{tmp_path}"
    for n in range(3):
        spark.range(n * 10, n * 10 + 10).write.parquet(f"{place}/in/{n}.parquet")
    seen = lambda: spark.read.parquet(f"{place}/out").count()
    stream = lambda: ingest.read_folder(spark, f"{place}/in/*.parquet", "id long", files=1)
    run = lambda: ingest.run_available(stream(), lambda batch, n: batch.write.mode("append").parquet(f"{place}/out"), f"{place}/check")
    run()
    assert seen() == 30
    spark.range(100, 105).write.parquet(f"{place}/in/9.parquet")
    run()  # after a restart only what is new is read
    assert seen() == 35


def test_searches_ask_with_every_twentieth_vector(spark):
    small = "/root/testdata/sf0.001"
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    ids = {r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()} & set(rows)
    cos = lambda a, b: round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 9)
    exact, above, either = set(), set(), set()
    for q in (q for q in rows if q % 20 == 0):
        best = sorted((-cos(rows[q], rows[c]), c) for c in ids - {q})[:5]
        own = {(q, c, i) for i, (_, c) in enumerate(best, 1)}
        over = {(q, c, i) for i, (s, c) in enumerate(best, 1) if -s >= 0.38}
        exact, above, either = exact | own, above | over, either | (over or own)
    for name, wanted in (("vec_topk_exact", exact), ("vec_topk_threshold", above), ("vec_topk_fallback", either)):
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in catalogue.QUERIES[name](spark, small).collect()} == wanted


def test_what_a_search_holds_is_bounded():
    """A block's vectors, and its scores with the copies that rounding, partition and comparison make of them, in bytes, for each of a task's Python processes."""
    assert 8 * (2 * retrieval.BLOCK_NUMBERS + 4 * retrieval.HELD_SCORES) <= 64_000_000



def test_top_k_answers_all_queries(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id long, vec array<double>")
    many = spark.range(10_050).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("vec"))
    got = retrieval.top_k(many, chunks, k=1)
    assert got.count() == 10_050 and got.select("chunk_id").distinct().collect() == [(1,)]
    monkeypatch.setattr(retrieval, "BLOCK_NUMBERS", 14)
    monkeypatch.setattr(retrieval, "HELD_SCORES", 5)
    few = retrieval.top_k(many.limit(40), chunks, k=2, threshold=None)
    assert few.count() == 80 and few.select("query_id").distinct().count() == 40


def test_top_k_by_scope_against_a_loop(spark):
    r = random.Random(4)
    vector = lambda: r.choice([None, [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, float("nan"), 0.0], [1.0, 2.0], *[[r.choice([-1.0, 0.5, 2.0]) for _ in range(3)] for _ in range(9)]])
    chunks = [(i, r.choice(["a", "a", "b", None]), vector(), f"c{i}") for i in range(80)] + [(79, "a", [1.0, 1.0, 1.0], "again")]
    asked = [(i, r.choice(["a", "b", "none", None]), vector()) for i in range(30)] + [(99, "a", [1.0, 1.0, 1.0])]
    good = lambda v: v is not None and len(v) == 3 and None not in v and np.isfinite(v).all() and any(v)
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    c = spark.createDataFrame(chunks, "chunk_id long, project string, vec array<double>, name string").repartition(3)
    q = spark.createDataFrame(asked, "query_id long, project string, vec array<double>")
    for others, scope in ((False, "project"), (True, "project"), (False, None)):
        want = set()
        for i, p, v in asked:
            if good(v):
                scores = [(-round(float(unit(v) @ unit(w)), 9), n, name) for n, p2, w, name in chunks if good(w) and (scope is None or p == p2 and p is not None) and not (others and n == i)]
                best = sorted(scores)[:4]
                kept = [x for x in best if -x[0] >= 0.9] or best
                want |= {(i, n, name) for _, n, name in kept}
        got = {(x.query_id, x.chunk_id, x.name) for x in retrieval.top_k(q, c, k=4, threshold=0.9, scope=scope, others=others, digits=9).collect()}
        assert got == want and len(got) > 30
    assert retrieval.top_k(q.limit(0), c, k=4).count() == 0 and retrieval.top_k(q, c.limit(0), k=4).count() == 0


def test_tasks_send_their_best_chunks_alone(spark, monkeypatch):
    """However many batches a task reads, and however many chunks are alike: k rows for each query, ties to the smaller chunk."""
    monkeypatch.setattr(retrieval, "HELD_SCORES", 60)
    r = random.Random(9)
    of_ = {i: r.choice([[1.0, 0.0], [1.0, 0.5], [r.random(), r.random()]]) for i in r.sample(range(1000), 300)}
    chunks = spark.createDataFrame([*of_.items()], "chunk_id long, vec array<double>").repartition(1)
    queries = spark.createDataFrame([(i, [1.0, i / 8]) for i in range(9)], "query_id long, vec array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sent = retrieval._scored(chunks, queries.toArrow(), 2, 5, None, False, 9).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = {(q, n) for q in range(9) for _, n in sorted((-round(float(unit([1.0, q / 8]) @ unit(v)), 9), n) for n, v in of_.items())[:5]}
    assert len(sent) == 45 and {(x.query_id, x.chunk_id) for x in sent} == want


def test_sources_move_no_other_texts(spark):
    """Texts are told apart by names: dedup_chunks moves none, sources_block those that were found; a document that is there twice is one source."""
    small = "/root/testdata/sf0.001"
    plan = catalogue.QUERIES["dedup_chunks"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.split("\n") if "Join" in line or "Window" in line]
    assert joined and not any("text#" in line for line in joined)
    docs = spark.createDataFrame([(1, " " + "a" * 50), (1, " " + "a" * 50), (2, "a" * 50 + "\n"), (3, "b" * 41), (4, "short"), (5, None), (6, "c" * 60)], "doc_id long, text string")
    found = spark.createDataFrame([(1, n, n) for n in range(1, 6)] + [(2, 3, 1), (2, 1, 2)], "query_id long, doc_id long, rank int")
    named = docs.select("doc_id", retrieval.text_name(F.col("text")).alias("name"))
    told = retrieval.distinct_chunks(found.join(named, "doc_id"))
    got = retrieval.sources_block(retrieval.with_texts(told, docs, found.select("doc_id").distinct()))
    a, b = "a" * 50, "b" * 41
    assert dict(map(tuple, got.collect())) == {1: f"[S1]\n{a}\n\n[S2]\n{b}\n\n", 2: f"[S1]\n{b}\n\n[S2]\n{a}\n\n"}


def test_stored_chunks_are_read_by_shelf(spark, tmp_path):
    place = f"file://{tmp_path}/store"
    chunks = spark.range(200).selectExpr("'p' || id % 20 AS project_id", "id AS chunk_id", "array(1.0D, CAST(id AS DOUBLE)) AS vec")
    retrieval.store_chunks(chunks, place)
    queries = spark.createDataFrame([(1, "p3", [1.0, 50.0]), (2, None, [1.0, 1.0])], "query_id long, project_id string, vec array<double>")
    opened = retrieval.stored_chunks(spark.read.parquet(place), queries)
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shelf" in plan.split("PartitionFilters: [")[1].split("]")[0]
    found = retrieval.search_projects(spark.read.parquet(place), queries, k=3)
    assert {(x.query_id, x.project_id) for x in found.collect()} == {(1, "p3")} and found.count() == 3
