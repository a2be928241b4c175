"""Chunks, cleaning and summaries against Python written from the rules, and a database over JDBC."""

from __future__ import annotations

import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quireflow.functions import text as T
from quireflow.operators import claims as C
from quireflow.operators import retrieval as V
from quireflow.sources import readers


def letters(r, n):
    return "".join(r.choices("abcdefghijklmnop", k=n))


def random_text(r, n):
    words = ["a", "word", "naïve", "số", letters(r, 30), letters(r, 500), "end."]
    gaps = [" ", " ", " ", "\n", "\n\n", "  ", "\n\n\n", "\t"]
    return "".join(r.choice(words) + str(r.randrange(10**9)) + r.choice(gaps) for _ in range(n))


@pytest.fixture(scope="module")
def chunked(spark):
    r = random.Random(1)
    texts = [random_text(r, r.randrange(1, 200)) for _ in range(40)] + [None, "", "   ", letters(r, 2000), "short", "\n\n" * 50, letters(r, 400), letters(r, 401)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    rows = V.number_chunks(df, V.recursive_chunks()(F.col("text")), ["doc_id"]).collect()
    return df, texts, [[x.chunk_text for x in sorted(rows, key=lambda x: x.chunk_index) if x.doc_id == i] for i in range(len(texts))], rows


def test_chunks_are_short_share_little_and_miss_nothing(chunked):
    _, texts, chunks, rows = chunked
    for i, (text, own) in enumerate(zip(texts, chunks, strict=True)):
        assert [x.chunk_index for x in sorted(rows, key=lambda x: x.chunk_index) if x.doc_id == i] == [*range(len(own))]
        at, covered = 0, np.zeros(len(text or ""), bool)
        for n, chunk in enumerate(own):
            assert 20 < len(chunk.strip()) and len(chunk) <= 400 and chunk == chunk.strip()
            start = text.find(chunk, max(0, at - 120 - 60) if n else 0)
            assert start >= 0
            covered[start : start + len(chunk)] = True
            at = start + len(chunk)
        whole = [c for c in V.split_text(text, 400, 120, V.SEPARATORS)] if text else []
        assert [c for c in whole if len(c.strip()) > 20] == own
        if len(whole) == len(own):  # no chunk was left out: all that is no white space is in one
            assert not [c for c, x in zip(text or "", covered, strict=True) if not x and not c.isspace()]


def test_neighbouring_chunks_overlap_as_much_as_is_allowed():
    text = " ".join(f"w{i:03}" for i in range(400))
    chunks = V.split_text(text, 100, 40, V.SEPARATORS)
    for a, b in zip(chunks, chunks[1:], strict=False):
        shared = next(k for k in range(100, -1, -1) if b.startswith(a[len(a) - k :]) or k == 0)
        assert 30 <= shared <= 40 and len(b) <= 100
    assert V.split_text("aaa bbb\n\nccc", 7, 0, V.SEPARATORS) == ["aaa bbb", "ccc"]
    assert V.split_text("abcdefghij", 4, 0, V.SEPARATORS) == ["abcd", "efgh", "ij"]


def test_the_table_function_gives_the_same_chunks(spark, chunked):
    df, _, _, rows = chunked
    df.createOrReplaceTempView("texts_to_split")
    spark.udtf.register("split_chunks", V.SplitChunks)
    got = spark.sql("SELECT doc_id, c.* FROM texts_to_split, LATERAL split_chunks(text, 400, 120) c").collect()
    assert sorted(map(tuple, got)) == sorted((x.doc_id, x.chunk_index, x.chunk_text) for x in rows)


def academic(text):
    """The rules of cleaning a paper for summaries, one after the other."""
    for m in re.finditer(r"\n(references|tài liệu tham khảo|bibliography|danh mục tài liệu)[^\S]*\n", text, re.I):
        text = text[: m.start()]
        break
    lines = ["" if re.fullmatch(r"\s*\d+\s*", x) or re.fullmatch(r"\s*[^a-zA-ZÀ-ỹ\d\s]{3,}\s*", x) else x for x in text.split("\n")]
    text = re.sub(r"[^\t\n\r\x20-\x7EÀ-ɏḀ-ỿ̀-ͯ]+", " ", "\n".join(lines))
    out, before = [], ""
    for line in (x.strip() for x in text.split("\n")):
        if out and line and before and len(line) < 60 and before[-1] not in ".:?!;":
            out[-1] += " " + line
        else:
            out.append(line)
        before = line
    return re.sub(" {2,}", " ", re.sub(r"\n{3,}", "\n\n", "\n".join(out))).strip()


def test_papers_are_cleaned_as_the_rules_say(spark):
    r = random.Random(9)
    lines = ["A sentence that ends here.", "wraps over", "12", " 7 ", "***", "— • —", "Công thức ∑ x²", "", "", "x" * 70, "References", "Tài liệu tham khảo ", "BIBLIOGRAPHY", "References are many", "tab\there", "two  spaces", "số 5:", "日本 kanji", "1.2.3"]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randrange(1, 14))) for _ in range(150)] + ["", "References\nx", "\nReferences\n", "a\nreferences\nb\nreferences\nc"]
    df = spark.createDataFrame([*enumerate(texts)], "id long, x string")
    got = dict(map(tuple, df.select("id", T.clean_academic_text(F.col("x"))).collect()))
    for i, text in enumerate(texts):
        assert got[i] == academic(unicodedata.normalize("NFC", text)), text


def test_summaries_are_mapped_and_reduced(spark):
    def scripted(mark):
        @F.pandas_udf("string")
        def summarize(text: pd.Series) -> pd.Series:
            return text.map(lambda t: f"{mark}<{t[:3]}|{len(t.split())}>")

        return summarize

    sizes = [0, 1, 874, 875, 874 + 824 * 4, 874 + 824 * 4 + 1, 874 + 824 * 9 + 5]
    df = spark.createDataFrame([(i, " ".join(f"t{k}" for k in range(n))) for i, n in enumerate(sizes)], "id long, text string")
    got = {x.id: (x.strategy, x.summary) for x in C.summarize(df, "id", "text", mapper=scripted("m"), reducer=scripted("r"), final=scripted("f")).collect()}
    for i, n in enumerate(sizes):
        tokens = [f"t{k}" for k in range(n)]
        windows = [tokens[a : a + 874] for a in range(0, max(1, n - 50), 824)] if n else []
        parts = [f"m<{' '.join(w)[:3]}|{len(w)}>" for w in windows]
        kind = "single" if n <= 874 else "flat" if len(parts) <= 5 else "hierarchical"
        if kind == "hierarchical":
            groups = [" ".join(parts[k : k + 4]) for k in range(0, len(parts), 4)]
            parts = [f"r<{g[:3]}|{len(g.split())}>" for g in groups]
        joined = " ".join(parts)
        assert got[i] == (kind, f"f<{joined[:3]}|{len(joined.split())}>" if n else "")


def test_hashed_vectors(spark):
    import zlib

    texts = ["One two two", "", None, "x"]
    df = spark.createDataFrame([*enumerate(texts)], "id long, text string")
    got = {x.id: x.v for x in df.select("id", V.hashing_embedder(8, "query: ")(F.col("text")).alias("v")).collect()}
    for i, text in enumerate(texts):
        want = np.zeros(8)
        for w in ("query: " + (text or "")).lower().split():
            h = zlib.crc32(w.encode())
            want[h % 8] += 1 if h >> 31 else -1
        want = want / (np.linalg.norm(want) or 1)
        assert np.allclose(got[i], want, atol=1e-6)


def test_tables_over_jdbc_in_parts(spark):
    url = "jdbc:derby:memory:papers;create=true"
    rows = spark.range(50).selectExpr("CAST(id AS INT) AS id", "'name ' || id AS name")
    rows.write.jdbc(url, "papers", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    found = readers.jdbc(spark, url, 'SELECT "id", "name" FROM papers WHERE "id" < 40', driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", partitionColumn="id", lowerBound="0", upperBound="40", numPartitions="4")
    assert found.rdd.getNumPartitions() == 4 and sorted(map(tuple, found.collect())) == [(i, f"name {i}") for i in range(40)]


def test_words_that_cancel_each_other_have_a_vector(spark):
    """`at!!` hashes to where `passage:` does, with the other sign."""
    df = spark.createDataFrame([("AT!!",), ("itte.",), ("",), ("a b",)], "text string")
    got = df.select(V.hashing_embedder(64, "passage: ")(F.col("text")).alias("v"), V.hashing_embedder(64)(F.col("text")).alias("bare")).collect()
    assert [round(float(np.linalg.norm(x.v)), 6) for x in got] == [1, 1, 1, 1]
    assert [round(float(np.linalg.norm(x.bare)), 6) for x in got] == [1, 1, 0, 1]


def test_merged_lines_are_stripped_once(spark):
    """Within a function over an array an expression is computed as often as it is written: the stripped lines have to be a variable there."""
    lines = ["  Head ", "goes on", "", "x" * 70, "short", "Ends.", "next"] * 300
    df = spark.createDataFrame([(lines,)], "x array<string>").select(T.merge_lines(F.col("x")).alias("y"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count(r"(?U)^\s+|\s+\z") == 1
    got = df.first().y
    assert got[:4] == ["Head goes on", "", "x" * 70 + " short Ends.", "next Head goes on"] and len(got) == 3 * 300 + 1
