"""HTML pages as rows of tags, with the standard library's parser over Arrow batches, and what papers say of themselves in them.

A page is parsed once into rows (page, position, tag, text). All rules are flat columns over these (lines.describe); what must look at other
tags of the page is a window over its positions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .lines import AFFILIATION_TERMS, NUMBERED, SHORT, clean_body, dealt, describe, has_term, has_vietnamese, is_author_name
from .text import clean_authors, clean_line, clean_metadata, clean_paragraph, crawl_abstract, download_url, match_key, strip, strip_markdown, word_count

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style"}
# Tags that hold no body text.
NO_TEXT = ("table", "thead", "tbody", "tr", "td", "th", "img", "figure", "figcaption", "pre", "code")
#: A tag that begins ends an open tag of these kinds, which pages often leave open.
ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_KINDS = {"pos": IntegerType(), "last": IntegerType(), "parent": IntegerType(), "start": IntegerType(), "hidden": BooleanType()}
TAG = StructType([StructField(n, _KINDS.get(n, StringType())) for n in ("pos", "last", "tag", "parent", "cls", "href", "text")])
BLOCK = StructType([StructField("tag", StringType()), StructField("text", StringType()), StructField("items", ArrayType(StringType())), StructField("start", IntegerType())])


class Tags(HTMLParser):
    """Every tag in document order, with its parent, the last tag inside it, and the run of text pieces inside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.pieces: list[str] = []
        self.shown: list[bool] = []  # whether a piece stands outside of tags without body text

    def _end(self, n: int) -> None:
        for i in self.open[n:]:
            self.rows[i] |= {"last": len(self.rows) - 1, "to": len(self.pieces)}
        del self.open[n:]

    def handle_starttag(self, tag, attrs) -> None:
        inside = self.rows[self.open[-1]]["tag"] if self.open else None
        if inside in ENDS.get(tag, ()) or (inside == "p" and tag in (*HEADINGS, "ul", "ol", "div", "section", "table")):
            self._end(len(self.open) - 1)
        named, n = dict(attrs), len(self.rows)
        hidden = tag in NO_TEXT or any(self.rows[i]["hidden"] for i in self.open[-1:])
        start = named.get("start") or "1"
        self.rows.append({"pos": n, "last": n, "tag": tag, "parent": self.open[-1] if self.open else -1, "cls": named.get("class") or "", "href": named.get("href") or "", "hidden": hidden, "start": int(start) if start.lstrip("-").isdecimal() and len(start) < 9 else 1, "from": len(self.pieces), "to": len(self.pieces)})
        if tag not in VOID:
            self.open.append(n)

    def handle_endtag(self, tag) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.rows[self.open[i]]["tag"] == tag), None)
        if at is not None:
            self._end(at)

    def handle_data(self, data) -> None:
        if data.strip() and not (self.open and self.rows[self.open[-1]]["tag"] in SILENT):
            self.pieces.append(data.strip())
            self.shown.append(not (self.open and self.rows[self.open[-1]]["hidden"]))

    def text(self, row: dict, all_: bool = True) -> str:
        return " ".join(p for p, s in zip(self.pieces[row["from"] : row["to"]], self.shown[row["from"] : row["to"]], strict=True) if all_ or s)


def _parsed(page: str | None) -> Tags:
    parser = Tags()
    parser.feed(unicodedata.normalize("NFC", page or ""))
    parser.close()
    parser._end(0)
    return parser


def tags(page: str | None) -> list[dict]:
    """All tags of a page, with the whole text inside each, its pieces joined by single spaces; none for null."""
    parser = _parsed(page)
    return [{n: r[n] for n in ("pos", "last", "tag", "parent", "cls", "href")} | {"text": parser.text(r)} for r in parser.rows]


def blocks(page: str | None) -> list[dict]:
    """Headings, paragraphs and lists of a page with text, without what stands in tables, figures and code; of lists the items, and the first number."""
    parser, out = _parsed(page), []
    for r in parser.rows:
        if r["hidden"] or r["tag"] not in (*HEADINGS, "p", "ul", "ol") or not (text := parser.text(r, False)):
            continue
        items = None
        if r["tag"] in ("ul", "ol"):
            inner = [x for x in parser.rows[r["pos"] + 1 : r["last"] + 1] if x["tag"] == "li" and not x["hidden"]]
            items = [parser.text(x, False) for x in [x for x in inner if x["parent"] == r["pos"]] or inner]
        out.append({"tag": r["tag"], "text": text, "items": items, "start": r["start"]})
    return out


#: Pages that a worker holds parsed at a time.
HELD_PAGES = 64


def _read(pages: DataFrame, key: str, html: Column, parse: Callable[[str | None], list[dict]], kind: StructType) -> DataFrame:
    """(row, key, found): what parse finds in every page, a few pages at a time."""
    rows = pages.select(F.monotonically_increasing_id().alias(_ROW), F.col(key), html.cast("string").alias("__html"))
    schema = StructType([*rows.schema.fields[:2], StructField("found", ArrayType(kind))])
    form = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, HELD_PAGES):
                part = batch.slice(low, HELD_PAGES)
                found = pa.array([parse(page) for page in part.column(2).to_pylist()], form.field("found").type)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], names=form.names)

    return rows.mapInArrow(run, schema)


_ROW = "__row"


def tag_rows(pages: DataFrame, key: str, html: Column) -> DataFrame:
    """(row, key, pos, last, tag, parent, cls, href, text) of every tag; a page without tags has a row of nulls."""
    found = _read(pages, key, html, tags, TAG)
    return dealt(found.select(_ROW, key, F.inline_outer("found")))  # before what is added to each: windows need no other exchange


# Labels of abstract and keywords.
ABSTRACT_LABEL, KEYWORD_LABEL = r"(?ius)T[oó]m\s*t[aăắ]t\s*:?\s*", r"(?ius)T(?:ừ|u)\s*kh(?:[oó]a|oá)\s*:?\s*"
ABSTRACT_TERMS, KEYWORD_TERMS = ("tom tat",), ("tu khoa",)


#: A word that begins with no capital: what it stands in are no names.
NO_NAME = r"(?U)(?:^|[\s,;])[^\s,;\p{Lu}]"


def label_end(clean: Column, label: str, terms: tuple[str, ...]) -> Column:
    """Where a label in cleaned text ends, counted from 1; null unless it has a colon or starts the text."""
    at, found = F.regexp_instr(clean, F.lit(label)), F.regexp_substr(clean, F.lit(label))
    fits = (at > 0) & (F.contains(found, F.lit(":")) | (F.trim(F.substring(clean, F.lit(1), at - 1)) == "")) & has_term(match_key(clean), terms)
    return F.when(fits, at + F.length(found))


def labelled(clean: Column, end: Column, stop: str | None = None) -> Column:
    """What follows a label that ends there, up to the stop label; empty without label."""
    out = F.when(end.isNotNull(), F.substr(clean, end)).otherwise(F.lit(""))
    if stop:
        out = F.element_at(F.split(out, stop, 2), 1)
    return F.btrim(out, F.lit(" :.-–—"))


def metadata(pages: DataFrame, key: str, html: Column) -> DataFrame:
    """(key, title, authors, abstract, keywords): a row per page, empty where nothing is found.

    title is the first h1 or h2. authors are the names of the first tag after it, before the body, all of whose one to eight parts look like names. abstract
    and keywords are what follows their label in a tag of at most 220 words, innermost tags first; where a label stands alone, the next tag that has none.
    """
    rows = tag_rows(pages, key, html).withColumns({"said": clean_metadata(F.col("text")), "__plain": strip_markdown(F.col("text"))})
    # Only what is short or numbered starts a body, and only capitalised words are names: the texts of outer tags, a page long each, are asked nothing else.
    asked = (F.length("__plain") <= SHORT) | F.col("__plain").rlike(NUMBERED) | ~F.col("text").rlike(NO_NAME)
    rows = describe(rows.withColumn("__asked", F.when(asked, F.col("text"))), "__asked")
    page = W.partitionBy(_ROW)
    title = F.min(F.when(F.col("tag").isin("h1", "h2"), F.col("pos"))).over(page)
    spoken = (F.col("text") != "") & ~F.col("tag").isin(*SILENT)
    ends = {"a_end": label_end(F.col("said"), ABSTRACT_LABEL, ABSTRACT_TERMS), "k_end": label_end(F.col("said"), KEYWORD_LABEL, KEYWORD_TERMS)}
    rows = rows.withColumns({**ends, "title_at": title, "spoken": spoken})
    after = (F.col("pos") > F.col("title_at")) & (F.col("text") != "") & ~F.col("tag").isin(*NO_TEXT, *SILENT)
    alone = lambda end: F.min(F.when(F.col("spoken") & F.col(end).isNotNull() & (labelled(F.col("said"), F.col(end)) == ""), F.col("pos"))).over(page)
    rows = rows.withColumns({"after": after, "body_at": F.min(F.when(after & F.col("body_start"), F.col("pos"))).over(page), "a_alone": alone("a_end"), "k_alone": alone("k_end")})
    parts = F.filter(F.split("text", "[,;]"), lambda p: strip(p) != "")
    named = ~F.col("text").rlike(NO_NAME) & F.size(parts).between(1, 8) & F.forall(parts, is_author_name) & ~has_term(match_key(F.col("text")), AFFILIATION_TERMS) & ~F.col("publication_metadata")
    names = F.col("after") & (F.col("body_at").isNull() | (F.col("pos") < F.col("body_at"))) & named
    first = lambda c: F.min_by("text", F.when(c, F.col("pos")))

    def value(end: str, alone_at: str, stop: str | None, stop_terms: tuple[str, ...]) -> Column:
        own = labelled(F.col("said"), F.col(end), stop)
        best = F.max_by(own, F.when(F.col("spoken") & F.col(end).isNotNull() & (word_count(F.col("text")) <= 220) & (own != ""), F.col("pos")))
        next_ = F.col("spoken") & F.col(end).isNull() & (F.col("pos") > F.col(alone_at))
        stopped = F.when(next_, has_term(match_key(F.col("text")), stop_terms)) if stop_terms else F.lit(False)
        near = F.min_by(F.struct(F.col("said").alias("said"), stopped.alias("stopped")), F.when(next_, F.col("pos")))
        return F.coalesce(best, F.when(~near["stopped"], near["said"]), F.lit(""))

    out = rows.groupBy(_ROW, key).agg(
        F.coalesce(first(F.col("pos") == F.col("title_at")), F.lit("")).alias("title"), F.coalesce(clean_authors(first(names)), F.lit("")).alias("authors"),
        value("a_end", "a_alone", KEYWORD_LABEL, KEYWORD_TERMS).alias("abstract"), value("k_end", "k_alone", None, ()).alias("keywords"),
    )
    return out.drop(_ROW)


def _block_rows(pages: DataFrame, key: str, html: Column) -> DataFrame:
    """(row, key, index, tag, items, start, text, ...) of every block, described."""
    found = _read(pages, key, html, blocks, BLOCK)
    rows = found.select(_ROW, key, F.posexplode("found").alias("index", "b")).select(_ROW, key, "index", "b.*")
    return describe(dealt(rows), "text").withColumn("heading", F.col("tag").isin(*HEADINGS))


def _with_start(rows: DataFrame) -> DataFrame:
    """rows with `begin`, the index of the block where the body starts; null if there is none. The first that is found counts:

    1. a heading or numbered block with a body term, outside of front matter, which a heading or a short block ends;
    2. after the last front matter of the first 80 blocks before such a one: a heading, else a block of text;
    3. a heading, the second if the first looks like a title; 4. a numbered block of text; 5. a block of text, but for h1 to h3 of the first three.
    """
    text, index = F.col("text"), F.col("index")
    numbered = text.rlike(NUMBERED)
    outside = ~F.col("body_stop") & ~F.col("front_matter") & ~F.col("artifact")
    long = (F.length(text) >= 50) & (has_vietnamese(text) | (F.col("all_words") >= 10))
    rows = rows.withColumns({
        "__named": F.col("body_start_term") & (F.col("heading") | F.col("numbered")),
        "__head": F.col("heading") & outside & F.col("bounded") & (has_vietnamese(F.col("plain")) | F.col("numbered") | (F.col("words") <= 14)),
        "__text": outside & (F.col("body_start") | F.when(F.col("section_boundary"), has_vietnamese(text) | numbered).otherwise(long)),
        "__break": ~F.col("front_matter") & (F.col("heading") | F.col("section_boundary")),
    })
    so_far, page = W.partitionBy(_ROW).orderBy("index"), W.partitionBy(_ROW)
    last = lambda c: F.coalesce(F.max(F.when(c, index)).over(so_far), F.lit(-1))
    first = lambda c: F.min(F.when(c, index)).over(page)
    rows = rows.withColumns({"__front_at": last(F.col("front_matter")), "__break_at": last(F.col("__break")), "__named_at": first(F.col("__named"))})
    within = F.col("__front_at") > F.col("__break_at")
    front_end = F.max(F.when(within & (index < 80) & (F.col("__named_at").isNull() | (index < F.col("__named_at"))), index)).over(page)
    rows = rows.withColumns({"__front_end": front_end, "__heads": F.sum(F.col("__head").cast("int")).over(so_far), "__all_heads": F.sum(F.col("__head").cast("int")).over(page)})
    title = F.col("__head") & (F.col("__heads") == 1) & (index <= 2) & F.col("tag").isin("h1", "h2") & ~F.col("numbered") & (F.col("__all_heads") > 1)
    after = index > F.col("__front_end")
    begin = F.coalesce(first(F.col("__named") & ~within), first(after & F.col("__head")), first(after & F.col("__text")), first(F.col("__head") & ~title), first(F.col("numbered") & F.col("__text")), first(F.col("__text") & ~((index < 3) & F.col("tag").isin("h1", "h2", "h3"))))
    return rows.withColumn("begin", begin)


def _rendered(rows: DataFrame, key: str, marks: bool, keep_front: bool) -> DataFrame:
    """(key, raw) of blocks: headings, with their marks if asked for, paragraphs, and lists with a line per item, numbered from the list's start."""
    level = F.coalesce(F.substring("tag", 2, 1).try_cast("int"), F.lit(0))
    rows = rows.select(_ROW, key, "index", "tag", "start", F.posexplode(F.coalesce("items", F.array("text"))).alias("item", "text"))
    plain = clean_paragraph(F.col("text"))
    listed = F.col("tag").isin("ul", "ol")
    rows = rows.withColumn("said", F.when(F.col("tag").isin(*HEADINGS), clean_line(F.col("text"))).otherwise(plain))
    rows = describe(rows.withColumn("__item", F.when(listed, F.col("said"))), "__item")  # only of items it is asked
    gone = F.col("artifact") if keep_front else F.col("artifact") | F.col("front_matter")
    mark = F.when(F.col("tag") == "ul", "- ").when(F.col("tag") == "ol", F.concat((F.col("start") + F.col("item")).cast("string"), F.lit(". ")))
    mark = mark.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "))) if marks else mark
    order = lambda c: F.array_sort(F.collect_list(c))
    # What is left out is left out of the lists: a filter would be pushed below describe() and repeat all that it adds.
    item = F.when((F.col("said") != "") & ~(listed & gone), F.struct("item", F.concat(F.coalesce(mark, F.lit("")), F.col("said")).alias("said")))
    rows = rows.groupBy(_ROW, key, "index").agg(order(item).alias("items"))
    rows = rows.withColumn("part", F.array_join(F.transform("items", lambda r: r["said"]), "\n\n" if keep_front else "\n"))
    part = F.when(F.col("part") != "", F.struct("index", "part"))
    return rows.groupBy(_ROW, key).agg(F.array_join(F.transform(order(part), lambda r: r["part"]), "\n\n").alias("raw")).drop(_ROW)


def body_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, body): Markdown of a page from its body start to its first stop heading, cleaned; pages without body get no row."""
    rows = _with_start(_block_rows(pages, key, F.col(html))).where(F.col("index") >= F.col("begin"))
    stop = F.min(F.when(F.col("body_stop"), F.col("index"))).over(W.partitionBy(_ROW))
    rows = rows.withColumn("stop", stop).where((F.col("stop").isNull() | (F.col("index") < F.col("stop"))) & ~F.col("artifact") & ~F.col("publication_metadata") & ~F.col("front_matter"))
    return clean_body(_rendered(rows, key, True, False), key, "raw").withColumnRenamed("text", "body")


def _each_once(pages: DataFrame, html: str) -> tuple[DataFrame, DataFrame]:
    """(pages with `__page`, a name of what they hold; (__page, __html) of what is held, once): what is read off a page depends on nothing else. Null counts as empty."""
    named = pages.withColumn("__page", F.sha2(F.coalesce(F.col(html), F.lit("")), 256))
    return named, named.groupBy("__page").agg(F.first(F.coalesce(F.col(html), F.lit(""))).alias("__html"))


def record(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, authors, abstract, keywords, content): the body, and what the whole page says of it; empty where nothing is found.

    Every row of pages gets its own, once, be its key null or that of other rows as well.
    """
    named, once = _each_once(pages, html)
    said = metadata(once, "__page", F.col("__html"))
    told = said.join(body_text(once, "__page", "__html"), "__page", "left").select(*said.columns, F.coalesce("body", F.lit("")).alias("content"))
    return named.select(key, "__page").join(told, "__page").drop("__page")


def raw_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text): all text of a page without headings' marks, front matter and references included, under the title and the authors that the whole page names.

    The first heading that equals the title is left out, as the title stands above. Every row of pages gets its own, once, be its key null or that of other rows as well.
    """
    named, once = _each_once(pages, html)
    said = metadata(once, "__page", F.col("__html")).select("__page", "title", "authors")
    rows = _block_rows(once, "__page", F.col("__html")).join(said.select("__page", match_key(F.col("title")).alias("__title")), "__page", "left")
    same = F.col("heading") & ~F.col("artifact") & (F.col("__title") != "") & (match_key(F.col("text")) == F.col("__title"))
    first = F.min(F.when(same, F.col("index"))).over(W.partitionBy(_ROW))
    rows = rows.withColumn("__skip", first).where(~F.col("artifact") & (F.col("__skip").isNull() | (F.col("index") != F.col("__skip"))))
    body = clean_body(_rendered(rows, "__page", False, True), "__page", "raw")
    line = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c)))
    out = said.join(body, "__page", "left").withColumn("__head", F.concat_ws("\n", line("Tiêu đề: ", "title"), line("Tác giả: ", "authors")))
    text = F.coalesce("text", F.lit(""))
    told = out.select("__page", F.when(F.col("__head") != "", F.concat("__head", F.lit("\n\n"), text)).otherwise(text).alias("text"))
    return named.select(key, "__page").join(told, "__page").drop("__page")


# --- pages of a journal's archive


def links(pages: DataFrame, key: str, html: str, contains: str = "", cls: str | None = None) -> DataFrame:
    """(key, n, href, text) of the links of each page, in order, whose target contains a string, and of a class if one is given."""
    rows = tag_rows(pages, key, F.col(html)).where((F.col("tag") == "a") & F.contains("href", F.lit(contains)))
    if cls is not None:
        rows = rows.where(_has_class(cls))
    return rows.select(key, F.col("pos").alias("n"), "href", "text")


def _has_class(name: str) -> Column:
    return F.array_contains(F.split("cls", r"\s+"), name)


def articles(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n, title, link) of the articles of an issue's page: the first link within a title of each summary block."""
    rows = tag_rows(pages, key, F.col(html))
    box = rows.where(_has_class("obj_article_summary")).select(_ROW, F.col("pos").alias("box"), F.col("last").alias("box_last"))
    titles = rows.where(_has_class("title")).select(_ROW, F.col("pos").alias("t"), F.col("last").alias("t_last"))
    anchors = rows.where(F.col("tag") == "a")
    found = anchors.join(titles, _ROW).where((F.col("pos") > F.col("t")) & (F.col("pos") <= F.col("t_last"))).join(box, _ROW).where((F.col("t") > F.col("box")) & (F.col("pos") <= F.col("box_last")))
    found = found.groupBy(_ROW, key, "box").agg(F.min_by(F.struct("text", "href"), "pos").alias("a"))
    return found.select(key, F.col("box").alias("n"), strip(F.col("a.text")).alias("title"), F.col("a.href").alias("link"))


def article_details(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, author, abstract, pdf_url) of article pages; N/A where author or abstract are absent, null without a link to a file."""
    rows = tag_rows(pages, key, F.col(html))
    first = lambda c, x: F.min_by(x, F.when(c, F.col("pos")))
    out = rows.groupBy(_ROW, key).agg(first(_has_class("authors"), "text").alias("author"), first(_has_class("abstract"), "text").alias("abstract"), first((F.col("tag") == "a") & _has_class("obj_galley_link") & _has_class("pdf"), "href").alias("pdf"))
    return out.select(key, F.coalesce(strip(F.col("author")), F.lit("N/A")).alias("author"), crawl_abstract(F.col("abstract")).alias("abstract"), download_url(F.col("pdf")).alias("pdf_url"))


def crawl(pages: DataFrame, archive: str, *, url: str = "url", html: str = "html", wanted: int = 1000, category: str = "Khoa học Công nghệ") -> DataFrame:
    """(n, title, author, abstract, pdf_url, url, category) of the first articles that an archive leads to, by issue and place.

    pages has (url, html). The archive's pages have urls that start with `archive`; their issue links lead to issues, whose blocks lead to articles.
    Articles whose page is absent have N/A and count all the same.
    """
    issues = links(pages.where(F.col(url).startswith(archive)), url, html, "issue/view", "title").select(F.col(url).alias("page"), F.col("n").alias("issue_n"), F.col("href").alias("issue"))
    found = articles(pages.join(issues.select(F.col("issue").alias(url)).distinct(), url, "left_semi"), url, html)
    listed = issues.join(found.withColumnRenamed(url, "issue"), "issue").select("page", "issue_n", "n", "title", "link")
    first = listed.orderBy("page", "issue_n", "n", "link").limit(wanted)  # at most as many as are wanted
    first = first.withColumn("n", F.row_number().over(W.orderBy("page", "issue_n", "n", "link")))
    details = article_details(pages.join(first.select(F.col("link").alias(url)).distinct(), url, "left_semi"), url, html).withColumnRenamed(url, "link")
    out = first.join(details, "link", "left")
    return out.select("n", "title", F.coalesce("author", F.lit("N/A")).alias("author"), F.coalesce("abstract", F.lit("N/A")).alias("abstract"), "pdf_url", F.col("link").alias("url"), F.lit(category).alias("category"))
