"""Pages against the rules written as loops over blocks and tags: where a body starts and ends, how it is written down, and what the page says of itself."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quireflow.functions import html, lines
from quireflow.functions import text as T
from quireflow.functions.lines import clean_body

TEXTS = (
    "Giới thiệu", "1. Introduction", "Introduction", "2. Methods and data", "A Title of some Paper", "Kết quả nghiên cứu", "References", "Tài liệu tham khảo", "Tóm tắt: nội dung của bài", "Abstract", "Keywords: one, two",
    "Received: 1 May 2020", "Nguyen Van An, Tran Thi Binh", "Department of Physics, University of X", "an@example.org", "Hình 1. Một hình", "Some words of a paragraph that goes on for long enough to be text of a body.",
    "Đoạn văn tiếng Việt đủ dài để được coi là nội dung chính của bài báo này.", "short", "12", "DOI: 10.1000/1", "* * *", "Conclusion", "II. Kết luận", "Table of Contents",
)


def page(r):
    out = []
    for _ in range(r.randrange(1, 14)):
        text = r.choice(TEXTS)
        kind = r.choice(["h1", "h2", "h3", "p", "p", "p", "ul", "ol", "pre", "div"])
        if kind in ("ul", "ol"):
            items = "".join(f"<li>{r.choice(TEXTS)}</li>" for _ in range(r.randrange(1, 4)))
            out.append(f"<{kind}{r.choice(['', ' start=' + chr(34) + '4' + chr(34)]) if kind == 'ol' else ''}>{items}</{kind}>")
        else:
            out.append(f"<{kind}>{text}</{kind}>")
    return "".join(out)


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(17)
    found = [page(r) for _ in range(220)]
    return spark.createDataFrame([*enumerate(found)], "id long, x string"), found


@pytest.fixture(scope="module")
def blocks(pages):
    """Blocks of each page in order, with what describe() says of them."""
    df, found = pages
    out: dict[int, list] = {i: [] for i in range(len(found))}
    text = F.col("text")
    rows = html._with_start(html._block_rows(df, "id", F.col("x")))
    vietnamese = {"v_text": html.has_vietnamese(text), "v_plain": html.has_vietnamese(F.col("plain")), "numbered_text": text.rlike(html.NUMBERED)}
    for x in rows.withColumns(vietnamese).orderBy("id", "index").collect():
        out[x.id].append(x)
    return out


def body_start(rows):
    """The cascade, one rule after the other."""

    def outside(x):
        return not (x.body_stop or x.front_matter or x.artifact)

    def head(x):
        return x.heading and outside(x) and x.bounded and (x.v_plain or x.numbered or x.words <= 14)

    def meaningful(x):
        if not outside(x):
            return False
        if x.body_start:
            return True
        if x.section_boundary:
            return x.v_text or x.numbered_text
        return len(x.text) >= 50 and (x.v_text or x.all_words >= 10)

    front = False  # within front matter: it lasts until a heading or a short block that is none
    fronts, named, first_named = [], None, None
    for x in rows:
        if x.front_matter:
            front = True
        elif x.heading or x.section_boundary:
            front = False
        if x.body_start_term and (x.heading or x.numbered):
            first_named = x["index"] if first_named is None else first_named
            if not front and named is None:
                named = x["index"]
        fronts.append(front)
    if named is not None:
        return named
    before = [x["index"] for x, f in zip(rows, fronts, strict=True) if f and x["index"] < 80 and (first_named is None or x["index"] < first_named)]
    if before:
        after = [x for x in rows if x["index"] > max(before)]
        for rule in (head, meaningful):
            for x in after:
                if rule(x):
                    return x["index"]
    heads = [x for x in rows if head(x)]
    if len(heads) > 1 and heads[0]["index"] <= 2 and heads[0].tag in ("h1", "h2") and not heads[0].numbered:
        heads = heads[1:]
    if heads:
        return heads[0]["index"]
    for x in rows:
        if x.numbered and meaningful(x):
            return x["index"]
    for x in rows:
        if meaningful(x) and not (x["index"] < 3 and x.tag in ("h1", "h2", "h3")):
            return x["index"]
    return None


def test_where_bodies_start(blocks):
    starts = {i: body_start(rows) for i, rows in blocks.items() if rows}
    assert starts == {i: rows[0].begin for i, rows in blocks.items() if rows}
    assert sum(s is None for s in starts.values()) > 3 and len({*starts.values()}) > 5


def test_bodies_are_the_blocks_between(spark, pages, blocks):
    df, _ = pages
    raws = []
    for i, rows in blocks.items():
        begin, parts = body_start(rows), []
        if begin is None:
            continue
        for x in rows:
            if x["index"] < begin:
                continue
            if x.body_stop:
                break
            if x.artifact or x.publication_metadata or x.front_matter:
                continue
            parts.append(x)
        raws.append((i, parts))
    got = {x.id: x.body for x in html.body_text(df, "id", "x").collect()}
    # Blocks as Markdown, each line cleaned as the operator cleans it, then the whole as a body.
    lines = [(i, k, n, line, x.tag, x.start) for i, parts in raws for k, x in enumerate(parts) for n, line in enumerate(x["items"] or [x.text])]
    said = spark.createDataFrame([(j, *x[:4], x[4]) for j, x in enumerate(lines)], "j long, i long, k int, n int, text string, tag string")
    cleaned = html.describe(said.withColumn("said", F.when(F.col("tag").isin(*html.HEADINGS), html.clean_line(F.col("text"))).otherwise(html.clean_paragraph(F.col("text")))), "said")
    told = {x.j: (x.said, x.artifact or x.front_matter) for x in cleaned.collect()}
    written: dict[int, list[list[str]]] = {}
    for j, (i, k, n, _, tag, start) in enumerate(lines):
        text, gone = told[j]
        parts = written.setdefault(i, [])
        while len(parts) <= k:
            parts.append([])
        if not text or (gone and tag in ("ul", "ol")):
            continue
        mark = "- " if tag == "ul" else f"{start + n}. " if tag == "ol" else "#" * int(tag[1]) + " " if re.fullmatch(r"h\d", tag) else ""
        parts[k].append(mark + text)
    raw = [(i, "\n\n".join("\n".join(p) for p in parts if p)) for i, parts in written.items()]
    want = {x.id: x.text for x in clean_body(spark.createDataFrame(raw, "id long, raw string"), "id", "raw").collect()}
    assert {i: t for i, t in got.items() if t} == {i: t for i, t in want.items() if t} and len(want) > 100


def test_what_pages_say_of_themselves(spark, pages):
    df, found = pages
    rows: dict[int, list] = {}
    parts = F.filter(F.split("text", "[,;]"), lambda p: html.strip(p) != "")
    names = F.size(parts).between(1, 8) & F.forall(parts, html.is_author_name) & ~html.has_term(F.col("key"), html.AFFILIATION_TERMS) & ~F.col("publication_metadata")
    tags = html.describe(html.tag_rows(df, "id", F.col("x")).withColumn("said", html.clean_metadata(F.col("text"))), "text")
    for x in tags.withColumns({"names": names, "cleaned": html.clean_authors(F.col("text")), "k_stop": html.has_term(F.col("key"), html.KEYWORD_TERMS)}).orderBy("id", "pos").collect():
        rows.setdefault(x.id, []).append(x)
    got = {x.id: x for x in html.metadata(df, "id", F.col("x")).collect()}
    label = {"abstract": re.compile(html.ABSTRACT_LABEL.replace("(?ius)", ""), re.I | re.S), "keywords": re.compile(html.KEYWORD_LABEL.replace("(?ius)", ""), re.I | re.S)}
    seen = {"title": 0, "authors": 0, "abstract": 0}
    for i in range(len(found)):
        own = [x for x in rows.get(i, []) if x.pos is not None]
        heads = [x for x in own if x.tag in ("h1", "h2")]
        title = heads[0].text if heads else ""
        authors = ""
        for x in [x for x in own if heads and x.pos > heads[0].pos]:
            if not x.text or x.tag in (*html.NO_TEXT, *html.SILENT):
                continue
            if x.body_start:
                break
            if x.names:
                authors = x.cleaned
                break
        assert (got[i].title, got[i].authors) == (title, authors), found[i]

        def follows(x, kind):
            """What stands after a label that has a colon or starts the tag, up to the keywords; None without such a label."""
            m = label[kind].search(x.said)
            if not m or not (":" in m[0] or not x.said[: m.start()].strip()):
                return None
            rest = x.said[m.end() :]
            return (label["keywords"].split(rest, maxsplit=1)[0] if kind == "abstract" else rest).strip(" :.-–—"), rest.strip(" :.-–—")

        for kind in ("abstract", "keywords"):
            best, alone = "", None
            for x in own:
                if not x.text or x.tag in html.SILENT:
                    continue
                told = follows(x, kind)
                if told is None:
                    continue
                if not told[1] and alone is None:
                    alone = x.pos
                if told[0] and len(x.text.split()) <= 220:
                    best = told[0]  # later tags lie further inside
            if not best and alone is not None:
                for x in own:
                    if x.pos > alone and x.text and x.tag not in html.SILENT and follows(x, kind) is None:
                        best = "" if kind == "abstract" and x.k_stop else x.said
                        break
            assert got[i][kind] == best, (kind, found[i])
            seen[kind] = seen.get(kind, 0) + bool(best)
        seen["title"] += bool(title)
        seen["authors"] += bool(authors)
    assert min(seen["title"], seen["abstract"]) > 20 and seen["authors"] > 3


def test_rows_of_pages_are_dealt_to_all_tasks(spark):
    """More pages than a worker holds at a time, in one batch; few bytes of them are not merged into one task."""
    n = 2 * html.HELD_PAGES + 5
    pages = spark.createDataFrame([(i, f"<p>p<a href='/{i}'>t</a>" if i % 3 else None) for i in range(n)], "id long, html string").coalesce(1)
    rows = html.tag_rows(pages, "id", F.col("html"))
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((x.id, x.href) for x in html.links(pages, "id", "html").collect()) == [(i, f"/{i}") for i in range(n) if i % 3]
    assert rows.select("id").distinct().count() == n


def test_long_lines_are_read_as_far_as_rules_compare(spark):
    """Counts stop and keys are empty where no rule looks at more; what the rules find is the same, at the end of long lines as well."""
    long = "dài hơn một dòng " * 40
    found = {"long": long, "mail": long + "a@example.org", "web": long + "WWW.x", "heading": "2.1 " + long + "abstract", "mark": "† " + long + "university", "few": "x" * 101, "many": "a " * 30}
    rows = {x.i: x for x in lines.describe(spark.createDataFrame([*found.items()], "i string, line string")).collect()}
    assert {i for i, x in rows.items() if not x.key} == {"long", "mail", "web"}
    assert {i: x.words for i, x in rows.items() if i in ("long", "few", "many")} == {"long": lines.MANY + 1, "few": 1, "many": lines.MANY + 1}
    assert {i for i, x in rows.items() if x.publication_metadata and x.artifact} == {"mail", "web", "mark"}
    assert {i for i, x in rows.items() if x.front_matter} == {"mail", "web", "heading", "mark"}
    tags = "<div><h1>A Title</h1><p>Nguyen Van An, Tran Binh</p><h2>Introduction</h2><p>" + long + "</p></div>"
    page = html.metadata(spark.createDataFrame([(1, tags), (2, "<div>" + tags + "</div>")], "id long, x string"), "id", F.col("x")).collect()
    assert {(x.title, x.authors) for x in page} == {("A Title", "Nguyen Van An, Tran Binh")}


def test_white_space_is_what_patterns_take_for_it(spark):
    all_ = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    assert {x.c for x in all_.where(F.col("c").rlike(r"(?U)\s")).collect()} == set(T.WHITE)
