"""What a line of a converted paper is, and operators on the lines of documents.

Lines are rows (document, position, line). describe() adds what all rules look at, as flat columns, so that each is computed once and in generated
code; FLAGS are conditions on these. What must look at neighbouring lines is a window over the document's positions: documents are
dealt once, by row, and every window uses that. Texts are composed (NFC) whole before they are split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import clean_line, drop_citations, drop_control, fold, nfc, normalize_whitespace, strip, strip_markdown, trim_white, word_count

# Terms that mark lines, as match keys.
BODY_START_TERMS = (
    "mo dau", "dat van de", "gioi thieu", "tong quan", "boi canh", "co so", "ly thuyet", "muc tieu", "van de", "phuong phap", "vat lieu", "doi tuong", "noi dung",
    "nghien cuu lien quan", "cong trinh lien quan", "introduction", "background", "overview", "problem", "objective", "method", "methodology", "materials", "related work", "literature review",
)
BODY_STOP_TERMS = (
    "tai lieu tham khao", "references", "bibliography", "loi cam on", "loi cam ta", "acknowledg", "phu luc", "appendix", "funding", "kinh phi", "xung dot loi ich",
    "conflict of interest", "declaration", "tuyen bo", "supplement", "author contribution", "dong gop cua tac gia",
)
FRONT_MATTER_TERMS = (
    "tom tat", "abstract", "tu khoa", "keywords", "keyword", "classification", "phan loai", "ma so", "issn", "received", "accepted", "published", "ngay nhan", "ngay chap nhan", "ngay dang",
    "tac gia lien he", "corresponding author",
)
AFFILIATION_TERMS = ("truong dai hoc", "hoc vien", "khoa ", "vien ", "trung tam", "phong thi nghiem", "university", "faculty", "institute", "department", "laboratory", "school of")

# Patterns of lines.
CAPTION = r"(?iuU)^\s*(?:#{1,6}\s*)?(?:(?:Hình|Bảng|Figure|Fig\.?|Table|Chart|Biểu\s*đồ|Sơ\s*đồ|Ảnh)\s*(?:\d+(?:\.\d+)*|[IVXLCDM]+)?\s*(?:[.:)\-–]|$)|(?:Nguồn|Source)\s*[:.])"
IMAGE = r"^!\[[^\]]*\]\([^)]+\)\z"
IMAGE_REST = r"(?iuU)^(?:\*{0,2})?(?:==>\s*)?(?:picture|image|figure|graphic|formula|ảnh|hình)\b.*(?:omitted|placeholder|block|intentionally|\[[0-9]+\s*x\s*[0-9]+\]|<==|\))"
TABLE_ROW, TABLE_GRID = r"^\|.*\|\z", r"(?U)^\+[-=+:|\s]+\+\z"
TABLE_RULE = r"(?U)^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\z"
RULE_LINE = r"^[-–—_=*·•]{3,}\z"
NUMBERED = r"(?iuU)^\s*(?:#{1,6}\s*)?(?:\d+(?:\.\d+)*\.?|[IVXLCDM]+\.?|[A-Z]\.|(?:Chương|Phần|Mục|Chapter|Part|Section)\s+\d+(?:\.\d+)*)\s+"
PUBLICATION = (
    r"(?iuU)^\s*(?:#{1,6}\s*)?(?:(?:ngày\s+(?:nhận|gửi|sửa|duyệt|chấp\s*nhận|đăng|công\s*bố))\b|(?:received|revised|accepted|published|available\s+online|submitted)\b"
    r"|(?:doi|issn|e-issn|isbn|udc|msc|jel|pacs)\s*[:/]|(?:classification|classified|mã\s+số|chỉ\s*số\s*phân\s*loại)\b|(?:copyright|©|bản\s+quyền|all\s+rights\s+reserved)\b"
    r"|(?:corresponding\s+author|tác\s+giả\s+liên\s+hệ|email\s*:|e-mail\s*:)|(?:vol(?:ume)?\.?\s*\d+|no\.?\s*\d+|số\s+\d+|tập\s+\d+)\b)"
)
EMAIL_OR_URL = r"(?iU)(?:[\w.+-]+@[\w-]+(?:\.[\w-]+)+|https?://|www\.)"
VIETNAMESE = "àáạảãăắặẳẵâấậẩẫèéẹẻẽêếệểễìíịỉĩòóọỏõôốộổỗơớợởỡùúụủũưứựửữỳýỵỷỹđ"
AFFILIATION_MARK = r"(?U)^\s*(?:\[\d+\]|\d+[,.\s]|[*†‡])"
HEADING = r"(?U)^\s*#{1,6}\s"


def has_term(key: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(key, F.lit(t)) for t in terms])


def has_vietnamese(text: Column) -> Column:
    """Whether there is any of the letters in either case: dropping them changes the text. A class of as many letters is slow as a pattern."""
    return F.translate(text, VIETNAMESE + VIETNAMESE.upper(), "") != text


def without_number(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, NUMBERED, ""), F.lit(" .:-–—"))


def is_author_name(token: Column) -> Column:
    """Two to five words, each with a capital first and no digit, of four characters or more in all."""
    return (F.length(strip(token)) >= 4) & strip(token).rlike(r"(?U)^\p{Lu}[^\s\p{Nd}]*(?:\s+\p{Lu}[^\s\p{Nd}]*){1,4}\z")


#: What rules look at: the line stripped, without Markdown, its match key, that of what follows a number in a line that may be a heading, and counts of words.
#: Rules compare words with MANY at most, and keys of short lines, of what begins like a heading or an affiliation, and of LONG characters at most: counts
#: stop beyond MANY, and the keys of all other lines are left empty.
VIEWS = ("bare", "plain", "key", "head", "words", "all_words")
MANY, LONG = 28, 100
SHORT = 140  # characters of a line that may be a heading without number
_MANY_WORDS = rf"(?U)^\W*+(?:\w++\W++){{{MANY}}}\w"
_LONG_KEY = rf"^(?:[^\p{{L}}\p{{Nd}}]*+[\p{{L}}\p{{Nd}}]){{{LONG + 1}}}"  # each letter or digit leaves one in the key


def _few_words(text: Column) -> Column:
    """The number of words, MANY + 1 if there are more: of long lines the beginning is read."""
    return F.when(text.rlike(_MANY_WORDS), MANY + 1).otherwise(word_count(text))


def describe(rows: DataFrame, line: str = "line") -> DataFrame:
    """rows with the columns of VIEWS and one for each of FLAGS."""
    text = F.col(line)
    rows = rows.withColumns({"bare": trim_white(text), "plain": strip_markdown(text)})
    plain = F.col("plain")
    details = plain.rlike(PUBLICATION) | ((F.contains(plain, F.lit("@")) | F.contains(plain, F.lit("://")) | plain.rlike("(?i)www")) & plain.rlike(EMAIL_OR_URL))
    rows = rows.withColumns({"words": _few_words(plain), "__numbered": plain.rlike(NUMBERED), "__headed": F.contains(text, F.lit("#")) & text.rlike(HEADING), "__marked": plain.rlike(AFFILIATION_MARK), "__details": details})
    rows = rows.withColumn("all_words", F.when(plain == text, F.col("words")).otherwise(_few_words(text)))
    keyed = (F.col("words") <= MANY) | (F.col("all_words") <= MANY) | F.col("__numbered") | F.col("__headed") | F.col("__marked") | ~plain.rlike(_LONG_KEY)
    rows = rows.withColumn("__keyed", keyed).withColumn("key", F.when(F.col("__keyed"), fold(plain)).when(~F.col("__keyed"), F.lit("")))
    terms = {"__front": has_term(F.col("key"), FRONT_MATTER_TERMS), "__affiliated": F.col("__marked") & has_term(F.col("key"), AFFILIATION_TERMS)}
    rows = rows.withColumns({**terms, "__ruled": F.col("bare").rlike(RULE_LINE), "caption": (F.col("bare") != "") & text.rlike(CAPTION), "table": _table(F.col("bare")), "image": _image(F.col("bare"))})
    some, short = plain != "", (F.col("words") <= 14) & (F.length("plain") <= SHORT)
    publication = some & (F.col("__details") | (F.col("__front") & (F.col("words") <= 20)) | F.col("__affiliated"))
    rows = rows.withColumns({"section_boundary": some & (F.col("__numbered") | F.col("__headed") | short), "bounded": some & (F.col("__numbered") | short), "publication_metadata": publication})
    rows = rows.withColumn("head", F.when(F.col("bounded"), fold(without_number(plain))).otherwise(F.lit("")))  # only such lines can be headings
    front = lambda words, bounded: (~F.col("__keyed") | (F.col("key") != "")) & ((F.col("__front") & ((F.col(words) <= 28) | F.col(bounded))) | F.col("publication_metadata"))
    rows = rows.withColumns({"front_matter": front("all_words", "section_boundary"), "__front_plain": front("words", "bounded"), "body_stop": F.col("bounded") & has_term(F.col("head"), BODY_STOP_TERMS), "__start": F.col("bounded") & has_term(F.col("head"), BODY_START_TERMS)})
    inside = some & ~F.col("__front_plain") & ~F.col("body_stop")
    numbered = F.col("__numbered") & has_vietnamese(plain) & (F.col("words") <= 16)
    plainly = F.col("__ruled") | F.col("caption") | F.col("table") | F.col("image")
    flags = {"body_start_term": inside & F.col("__start"), "body_start": inside & (F.col("__start") | numbered), "author_name": is_author_name(text), "artifact": (F.col("bare") != "") & (plainly | F.col("publication_metadata")), "early_artifact": plainly | F.col("__details"), "junk": _junk(text)}
    return rows.withColumns({**flags, "numbered": F.col("__numbered")}).drop("__front", "__numbered", "__headed", "__marked", "__keyed", "__details", "__affiliated", "__ruled", "__front_plain", "__start")


def _table(bare: Column) -> Column:
    return (F.contains(bare, F.lit("---")) & bare.rlike(TABLE_RULE)) | (bare.startswith("+") & bare.rlike(TABLE_GRID)) | (bare.startswith("|") & bare.rlike(TABLE_ROW) & (F.length(bare) >= 2))


def _image(bare: Column) -> Column:
    start = F.lower(F.substring(bare, 1, 8))
    inside = (F.contains(bare, F.lit("/")) | F.contains(bare, F.lit("<"))) & bare.rlike("(?i)data:image/|<img")
    return (bare.startswith("![") & bare.rlike(IMAGE)) | bare.rlike(IMAGE_REST) | start.startswith("(picture") | start.startswith("[image") | inside


def _junk(line: Column) -> Column:
    """Only numbers, marks and one- or two-letter rests, and nothing Vietnamese; or under ten characters without a letter.

    A token is such a rest if it is one to four digits and full stops, has no letter or digit, or has one or two characters that are not all digits.
    """
    text = drop_control(line)
    other = r"(?U)(?<!\S)(?!(?:[0-9]{1,4}\.*|[^\s\p{L}\p{N}]+|(?!\p{Nd}+(?!\S))\S{1,2})(?!\S))\S"  # the start of a token that is no such rest
    tight = F.replace(text, F.lit(" "), F.lit(""))
    return text.rlike(r"(?U)\S") & (~text.rlike(other) | ((F.length(tight) < 10) & ~tight.rlike(r"\p{L}"))) & ~has_vietnamese(text)


FLAGS = ("table", "image", "section_boundary", "publication_metadata", "front_matter", "body_stop", "body_start_term", "body_start", "author_name", "artifact", "early_artifact", "junk")


# --- documents as rows of lines

_ROW = "__row"


def split_lines(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1)


def dealt(rows: DataFrame) -> DataFrame:
    """rows dealt by document to spark.sql.shuffle.partitions tasks. Without a number Spark merges tasks by their bytes, which are few beside the work that follows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(_ROW))


#: Characters below these marks are composed as they are.
_TO_COMPOSE = r"[^\x00-\x{2ff}]"


def lines_of(docs: DataFrame, key: str, text: str, split=split_lines) -> DataFrame:
    """(row, key, pos, line): the lines of every document, composed and without control characters; null counts as empty.

    Lines are dealt by document here, before anything is added to them: windows over a document need no other exchange.
    """
    whole = docs.select(F.monotonically_increasing_id().alias(_ROW), F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    open_ = F.when(F.col("__text").rlike(_TO_COMPOSE), F.col("__text"))  # other texts do not go to Python
    composed = whole.withColumn("__text", F.coalesce(nfc(open_), F.col("__text")))
    return dealt(composed.select(_ROW, key, F.posexplode(split(drop_control(F.col("__text")))).alias("pos", "line")))


def _place() -> object:
    return W.partitionBy(_ROW).orderBy("pos")


def mark_repeated(rows: DataFrame, key: Column, stays: Column, live: str = "live") -> DataFrame:
    """live becomes false for lines whose key, of 100 characters at most, occurs at least twice in the document, but for those that stay."""
    rows = rows.withColumn("__key", key)
    counted = rows.withColumn("__n", F.count("*").over(W.partitionBy(_ROW, "__key")))
    again = (F.col("__key") != "") & (F.length("__key") <= 100) & (F.col("__n") >= 2)
    return counted.withColumn(live, F.col(live) & ~(again & ~stays)).drop("__key", "__n")


def mark_fenced(rows: DataFrame, live: str = "live") -> DataFrame:
    """live becomes false for the marks of fenced blocks and all between them: an odd number of marks stands before it."""
    fence = F.col(live) & F.col("bare").rlike("^(```|~~~)")
    rows = rows.withColumn("__fence", fence).withColumn("__marks", F.sum(F.col("__fence").cast("int")).over(_place()))
    return rows.withColumn(live, F.col(live) & ~F.col("__fence") & (F.col("__marks") % 2 == 0)).drop("__fence", "__marks")


def mark_captions(rows: DataFrame, live: str = "live") -> DataFrame:
    """live becomes false for tables, captions and up to two lines that go on from a caption; a blank line or a section boundary ends it.

    Tables do not count. Among the other lines, one that cannot go on settles the state: after a caption two may follow, else none. Between such lines, a
    line that could go on does so within two lines of the last caption; if it is a caption itself and too far away, it is the last one from there.
    """
    counts = F.col(live) & ~F.col("table")
    goes_on = (F.col("bare") != "") & (F.length("bare") <= 170) & ~F.col("section_boundary")
    rows = rows.withColumns({"__counts": counts, "__goes": goes_on}).withColumn("__settles", F.col("__counts") & ~F.col("__goes"))
    rows = rows.withColumns({"__i": F.sum(F.col("__counts").cast("int")).over(_place()), "__part": F.sum(F.col("__settles").cast("int")).over(_place())})
    # A part begins with the line that settles it. A caption more than two lines after the one before is the last one from there: what may depend on each other are runs of captions without such a gap.
    settled = F.last(F.when(F.col("__settles"), F.when(F.col("caption"), F.col("__i")).otherwise(F.lit(-9))), ignorenulls=True).over(_place())
    could = F.when(F.col("__counts") & F.col("__goes") & F.col("caption"), F.col("__i"))
    gap = could - F.coalesce(F.max(could).over(_place().rowsBetween(W.unboundedPreceding, -1)), F.lit(-9)) > 2
    rows = rows.withColumns({"__first": F.coalesce(settled, F.lit(-9)), "__could": could, "__gap": F.coalesce(gap, F.lit(False)).cast("int")})
    rows = rows.withColumn("__run", F.sum("__gap").over(_place()))
    rows = rows.withColumn("__both", F.collect_list("__could").over(W.partitionBy(_ROW, "__part", "__run").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    fired = F.aggregate("__both", F.array(F.col("__first")), lambda done, i: F.when(i - F.element_at(done, -1) > 2, F.concat(done, F.array(i))).otherwise(done))
    gone = F.exists(fired, lambda f: (F.col("__i") - f).between(0, 2)) & (F.col("__goes") | F.col("caption"))
    return rows.withColumn(live, F.col("__counts") & ~gone).drop("__counts", "__goes", "__settles", "__i", "__part", "__first", "__both", "__could", "__gap", "__run")


def mark_from(rows: DataFrame, stop: Column, live: str = "live") -> DataFrame:
    """live becomes false from the first live line on that stop holds for."""
    first = F.min(F.when(F.col(live) & stop, F.col("pos"))).over(W.partitionBy(_ROW))
    return rows.withColumn("__stop", first).withColumn(live, F.col(live) & (F.col("__stop").isNull() | (F.col("pos") < F.col("__stop")))).drop("__stop")


def joined_lines(rows: DataFrame, key: str, line: Column, name: str = "text") -> DataFrame:
    """(key, text): the live lines of every document in order; empty where none is left."""
    row = F.when(F.col("live"), F.struct("pos", line.alias("line")))
    out = rows.groupBy(_ROW, key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["line"]), "\n").alias(name))
    return out.drop(_ROW)


def _repeated_noise(rows: DataFrame) -> DataFrame:
    return mark_repeated(describe(rows.withColumn("live", F.lit(True))), F.col("key"), F.col("body_start") | F.col("numbered"))


def preclean(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): Markdown without repeated lines, fenced blocks, tables, captions and other artifacts; headings and order stay."""
    rows = mark_captions(mark_fenced(_repeated_noise(lines_of(docs, key, text))))
    rows = rows.withColumn("live", F.col("live") & ~F.col("early_artifact"))
    out = joined_lines(rows, key, F.regexp_replace("line", r"(?U)\s+\z", ""))
    return out.withColumn("text", strip(F.regexp_replace("text", r"\n{3,}", "\n\n")))


def clean_body(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): body text up to the first stop heading, without artifacts, junk lines, citations and heading marks."""
    rows = _repeated_noise(lines_of(docs, key, text, lambda x: F.split(x, "\n", -1)))
    rows = mark_captions(mark_from(rows, F.col("body_stop")))
    rows = rows.withColumn("live", F.col("live") & ~F.col("artifact") & ~F.col("junk")).withColumn("__said", drop_citations(F.col("line")))
    said = F.col("__said")
    tidy = F.when(said.rlike(HEADING), clean_line(F.regexp_replace(said, r"(?U)^\s*#{1,6}\s+", ""))).otherwise(normalize_whitespace(said))
    out = joined_lines(rows, key, tidy)
    return out.withColumn("text", strip(F.regexp_replace(F.regexp_replace("text", r"(?U)\s+([.,;:!?])", "$1"), r"\n{3,}", "\n\n")))


def drop_repeated(docs: DataFrame, key: str, text: str, match=None) -> DataFrame:
    """(key, text): texts without lines that are repeated within the document; match gives the key that lines are compared by, else their match key."""
    rows = lines_of(docs, key, text, lambda x: F.split(x, "\n", -1)).withColumn("live", F.lit(True))
    if match is None:
        return joined_lines(_repeated_noise(rows.drop("live")), key, F.col("line"))
    return joined_lines(mark_repeated(rows, match(F.col("line")), F.lit(False)), key, F.col("line"))


def truncate(docs: DataFrame, key: str, text: str, stop) -> DataFrame:
    """(key, text, lines): lines up to the first that stop holds for, and their number."""
    rows = mark_from(lines_of(docs, key, text, lambda x: F.split(x, "\n", -1)).withColumn("live", F.lit(True)), stop(F.col("line")))
    rows = rows.withColumn("__left", F.count_if("live").over(W.partitionBy(_ROW)))
    return joined_lines(rows.withColumn(key, F.struct(key, "__left")), key, F.col("line")).select(F.col(f"{key}.{key}").alias(key), "text", F.col(f"{key}.__left").alias("lines"))
