"""Text functions as Column expressions; only Unicode composition, which Spark lacks, is a vectorised UDF.

Regular expressions are Java's: (?U) makes \\w and \\s mean Unicode's, (?iu) ignores case of all letters.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: Characters without which a text is no Markdown and has no control characters.
MARKED = r"[#`*_\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: Unicode's white space, as (?U)\s has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition."""
    return text.str.normalize("NFC")


@F.pandas_udf(StringType())
def nfd(text: pd.Series) -> pd.Series:
    """Unicode decomposition."""
    return text.str.normalize("NFD")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once: inside lambdas Spark computes an expression as often as it is written."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _accented() -> tuple[str, str]:
    """All characters of the basic plane that decompose into one character and marks, and those characters."""
    out = {"đ": "d", "Đ": "D"}
    for c in map(chr, range(0xC0, min(0xFFFF, sys.maxunicode))):
        if unicodedata.decomposition(c) and not 0xD800 <= ord(c) < 0xE000:
            bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            if len(bare) == 1 and bare != c:
                out[c] = bare
    return "".join(out), "".join(out.values())


_FROM, _TO = _accented()


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _FROM, _TO), r"\p{Mn}", "")


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def trim_white(text: Column) -> Column:
    """strip(), without reading what stands between the ends as a pattern: for long texts."""
    return F.btrim(text, F.lit(WHITE))


def drop_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def drop_illegal(text: Column) -> Column:
    """Control characters that spreadsheets refuse; DEL stays."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def normalize_whitespace(text: Column) -> Column:
    return trim_white(F.regexp_replace(text, r"[ \t]{2,}|\t", " "))


def strip_markdown(text: Column) -> Column:
    """Without heading marks, inline code and emphasis; emphasis is undone up to three levels deep."""
    out = drop_control(text)
    out = F.regexp_replace(out, r"(?U)^\s*#{1,6}\s*", "")
    out = F.regexp_replace(out, "`[^`]*`", "")
    for _ in range(3):
        out = F.regexp_replace(out, r"[_*]{1,3}(.*?)[_*]{1,3}", "$1")
    return F.when(text.rlike(MARKED), trim_white(F.regexp_replace(out, "[*_]", ""))).otherwise(trim_white(text))


def clean_line(text: Column) -> Column:
    return normalize_whitespace(strip_markdown(text))


def fold(plain: Column) -> Column:
    """Letters and digits without accents or case, single spaces."""
    return normalize_whitespace(F.regexp_replace(F.lower(strip_accents(plain)), r"(?U)[\W_]+", " "))


def match_key(text: Column) -> Column:
    """What two lines must share to count as the same. Composed letters or decomposed ones make no difference."""
    return fold(strip_markdown(text))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\w+"))


def clean_authors(text: Column) -> Column:
    """Names between commas or semicolons, without bracketed marks and trailing numbers; short or letterless ones and repeats go."""
    names = F.transform(F.split(strip_markdown(text), "[,;]"), lambda n: strip(F.regexp_replace(strip(F.regexp_replace(strip(n), r"\[[^\]]*\]", "")), r"(?U)[\d,\s]+\z", "")))
    return F.array_join(F.array_distinct(F.filter(names, lambda n: (F.length(n) >= 4) & n.rlike(r"\p{L}"))), ", ")


def clean_author_column(text: Column) -> Column:
    """Names separated by single commas: stars and the words for `the authors` go, other marks and line breaks become commas."""
    out = F.regexp_replace(text, "(?iu)các tác giả", "")
    out = F.replace(F.replace(out, F.lit("*"), F.lit("")), F.lit("\n"), F.lit(","))
    out = F.regexp_replace(out, r"(?U)[^\wÀ-ỹ\s]+", ",")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)\s*,\s*", ","), ",+", ",")
    return strip(F.btrim(out, F.lit(",")))


def escape_sql(text: Column) -> Column:
    """Control characters dropped (DEL stays), quotes doubled; NULL for null."""
    return F.coalesce(F.replace(drop_illegal(text), F.lit("'"), F.lit("''")), F.lit("NULL"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def text_stats(text: Column) -> Column:
    """Words between white space, characters, and non-blank pieces between empty lines; 0 for null."""
    text = F.coalesce(text, F.lit(""))
    paragraphs = F.filter(F.split(text, "\n\n"), lambda p: strip(p) != "")
    return F.struct(F.size(words(text)).alias("word_count"), F.length(text).alias("char_count"), F.size(paragraphs).alias("paragraph_count"))


def download_url(url: Column) -> Column:
    return F.replace(url, F.lit("/view/"), F.lit("/download/"))


def crawl_abstract(text: Column) -> Column:
    return F.coalesce(strip(F.replace(text, F.lit("Tóm tắt"), F.lit(""))), F.lit("N/A"))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9._-]", "_")


def download_name(name: Column, longest: int = 120, fallback: str = "summary") -> Column:
    """A name for saving: without characters that some systems reserve, white space as underscores."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r'[\\/:*?"<>|]', ""), r"(?U)\s+", "_")
    return F.coalesce(F.nullif(F.substring(out, 1, longest), F.lit("")), F.lit(fallback))


def first_name(name: Column, fallback: str = "Researcher") -> Column:
    return F.coalesce(F.nullif(F.split_part(name, F.lit(" "), F.lit(1)), F.lit("")), F.lit(fallback))


def password_strength(text: Column) -> Column:
    """Weak, Medium or Strong, by how many of five checks hold: length 8, upper and lower case, digit, other."""
    checks = [F.length(text) >= 8, text.rlike("[A-Z]"), text.rlike("[a-z]"), text.rlike("[0-9]"), text.rlike("[^A-Za-z0-9]")]
    n = sum((c.cast("int") for c in checks[1:]), checks[0].cast("int"))
    return F.when(n <= 2, "Weak").when(n <= 4, "Medium").otherwise("Strong")


def is_email(text: Column, strict: bool = False) -> Column:
    return text.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+\z" if strict else r"^[^@]+@[^@]+\.[^@]+\z")


# Numbered citations in brackets and parentheses.
CITATION_BRACKET = r"\[\d+(?:[,\-–]\s*\d+)*\](\[\d+(?:[,\-–]\s*\d+)*\])*"
CITATION_PAREN = r"\(\d+(?:,\s*\d+)*\)"


def drop_citations(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, CITATION_BRACKET, ""), CITATION_PAREN, "")


def clean_paragraph(text: Column) -> Column:
    """A paragraph with words joined that were hyphenated over a line end, without citations."""
    out = drop_control(text)
    joined = F.when(out.rlike(r"(?U)-\s"), F.regexp_replace(out, r"(?U)(\w)-\s+(\w)", "$1$2")).otherwise(out)
    return normalize_whitespace(drop_citations(joined))


def clean_metadata(text: Column) -> Column:
    return normalize_whitespace(F.regexp_replace(strip_markdown(text), r"(?U)\s+([,.;:!?])", "$1"))


def clean_question_text(text: Column) -> Column:
    """Composed, without unprintable characters, white space single."""
    return strip(F.regexp_replace(F.regexp_replace(nfc(text), r"[\p{C}&&[^\n\t]]", ""), r"(?U)\s+", " "))


def drop_null_bytes(text: Column) -> Column:
    return F.regexp_replace(text, r"\x00", "")


# Running heads and sections of the journal's articles that are no body text, in the order in which they go.
ARTICLE_NOISE = (
    r"(?iuU)Khoa học\s+[^/]+/[^;]+;\s*Khoa học\s+[^\n]+\d+\s+\d+\(\d+\)\s+\d+\.\d{4}",
    r"(?iuU)/Hóa học;\s*/Kỹ thuật vật liệu và luyện kim.*?\d+\.\d{4}",
    r"(?iu)khoa học tự nhiên|khoa học kỹ thuật và công nghệ|khoa học y - dược|khoa học nông nghiệp|khoa học xã hội và nhân văn",
    r"(?U)DOI:\s*10\.\d+/[^\n]+\n?\s*\d+\s*\n",
    r"(?iusU)abstract\s*:.*?(?:key\s*words?|keywords?)\s*:[^\n]+",
    r"(?iusU)tóm\s*tắt\s*:.*?(?:từ\s*khóa|từ khóa)\s*:[^\n]+",
    r"(?iudmU)^.*?(?:tác\s*giả\s*liên\s*hệ|corresponding\s*author).*?$",
    r"(?iudmU)^.*?email\s*:\s*[\w\.-]+@[\w\.-]+\.\w+.*?$",
)
ARTICLE_START = r"(?iusU)(đặt\s*vấn\s*đề|mở\s*đầu|giới\s*thiệu|introduction)"
ARTICLE_END = (r"(?ius)\n*TÀI LIỆU THAM KHẢO.*", r"(?ius)\n*REFERENCES.*")


def strong_clean(text: Column, *, normalize_first: bool = False, compose: bool = True) -> Column:
    """An article's body from its first body heading to its references, on one line; empty for null.

    Composition comes last by default, so decomposed letters do not match the headings; normalize_first composes before.
    """
    out = nfc(text) if normalize_first else text
    for pattern in ARTICLE_NOISE:
        out = F.regexp_replace(out, pattern, "")
    at = F.regexp_instr(out, F.lit(ARTICLE_START))
    out = F.when(at > 0, F.substr(out, at)).otherwise(out)
    for pattern in ARTICLE_END:
        out = F.regexp_replace(out, pattern, "")
    out = F.replace(F.replace(out, F.lit("\\*"), F.lit("")), F.lit("\\|"), F.lit(""))
    out = strip(F.regexp_replace(drop_control(out), r"(?U)\s+", " "))
    return F.coalesce(nfc(out) if compose and not normalize_first else out, F.lit(""))


def merge_lines(lines: Column, shortest: int = 60) -> Column:
    """Lines with short ones appended to the line before, unless that is empty or ends a sentence; lines are stripped.

    Whether a line is appended depends on it and the one before alone, so each is written with what stands before it and all are joined once. Stripped lines are computed once, not for every line.
    """

    def merged(bare: Column) -> Column:
        before = lambda i: F.coalesce(F.get(bare, i - 1), F.lit(""))
        starts = lambda line, i: (line == "") | (F.length(line) >= shortest) | (before(i) == "") | before(i).rlike(r"[.:?!;]\z")
        parts = F.transform(bare, lambda line, i: F.concat(F.when(i == 0, F.lit("")).when(starts(line, i), F.lit("\n")).otherwise(F.lit(" ")), line))
        return F.array_join(parts, "")

    return F.split(let(F.transform(lines, strip), merged), "\n", -1)


def clean_academic_text(text: Column) -> Column:
    """Text of a paper for summaries: cut at its own-line reference heading, without page numbers and formula rests, wrapped lines joined."""
    at = F.regexp_instr(text, F.lit(r"(?iuU)\n(references|TÀI LIỆU THAM KHẢO|Tài liệu tham khảo|bibliography|danh mục tài liệu)\s*\n"))
    out = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    out = F.regexp_replace(out, r"(?dmU)^\s*\d+\s*$", "")
    out = F.regexp_replace(out, r"(?dmU)^\s*[^a-zA-ZÀ-ỹ\d\s]{3,}\s*$", "")
    out = F.regexp_replace(out, r"[^\x09\x0A\x0D\x20-\x7E\u00C0-\u024F\u1E00-\u1EFF\u0300-\u036F]+", " ")
    out = F.array_join(merge_lines(F.split(out, "\n", -1)), "\n")
    return strip(F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), " {2,}", " "))


def clean_answer(text: Column) -> Column:
    """A model's answer without a repeated template and leaked source details; source marks in upper case."""
    out = strip(F.element_at(F.split(text, r"\[TRẢ LỜI\]:", -1), -1))
    for pattern in (r"\(Tài liệu:.*?\)", r"(?iu)Tài liệu:\s*.*?\.pdf", r"(?i)Chunk:\s*#?\d+", r"(?iu)Đoạn\s*#?\d+", r"(?i)Relevance:\s*\d+(\.\d+)?%?"):
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, r"(?i)\[s(\d+)\]", "[S$1]")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def clean_shown_answer(text: Column) -> Column:
    """What a client shows: source marks in upper case, no white space before punctuation."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?i)\[s(\d+)\]", "[S$1]"), r"(?U)\s+([.,!?;:])", "$1"))
