"""Token alignment against a loop with two pointers over the tokens' bytes."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quireflow.llm import token_alignment as T

from .test_brute_force import docs

SPECIAL = "<|endoftext|> <s> </s> <0x41> ok"


def brute(texts):
    """Rows of the query, by one token at a time and without numpy."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(T.BYTE_LEVEL)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=T.PIECES)
    letters = {chr(n): n for n in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    for n in range(256):
        if n not in letters.values():
            letters[chr(256 + len(letters) - 188)] = n
    rows, held = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = []
        for i in second.encode(text) if text else []:
            piece = second.id_to_piece(i)
            b.append((i, bytes.fromhex(piece[3:5]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a = b = []
        links, groups, i, j, end_a, end_b, at = [], [], 0, 0, 0, 0, (0, 0)
        while i < len(a) and j < len(b):
            links.append((a[i][0], b[j][0]))
            if end_a + len(a[i][1]) == end_b + len(b[j][1]):
                end_a, end_b, i, j = end_a + len(a[i][1]), end_b + len(b[j][1]), i + 1, j + 1
                groups.append(",".join(str(x) for x, _ in a[at[0] : i]) + "|" + ",".join(str(x) for x, _ in b[at[1] : j]))
                at = (i, j)
            elif end_a + len(a[i][1]) < end_b + len(b[j][1]):
                end_a, i = end_a + len(a[i][1]), i + 1
            else:
                end_b, j = end_b + len(b[j][1]), j + 1
        held.update(set(links))
        rows.append((len(a), len(b), links, groups))
    best = Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [(n_a, n_b, len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for n_a, n_b, links, groups in rows]


def found(spark, rows, tmp_path):
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return [(x.doc_id, tuple(x)[1:]) for x in T.op11_token_alignment(spark, str(tmp_path)).collect()]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = ["the", "tokenizer", "Überraschung", "naïve", "日本語", "😀😀", "x" * 40, "  ", "\n\n", "\t", "12345", "don't", "é", " ", "​", "I'll", "0x41"]
    some = [" ".join(r.choices(words, k=r.randrange(1, 30))) for _ in range(40)]
    return [*some, some[0], some[0], None, "", " ", SPECIAL, "a▁b", "\x00", "a" * 30_000, "﻿bom", "é" * 5_000]


def test_rows_are_those_of_two_pointers(spark, texts, tmp_path):
    got = dict(found(spark, [(i, t, "l", "s") for i, t in enumerate(texts)], tmp_path))
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert want[texts.index(SPECIAL)][0] > 3 and want[texts.index("a▁b")] == (0, 0, 0, 0, 0, 0, "")


def test_chunks_are_forgotten_and_learnt_anew(spark, texts, monkeypatch):
    c, some = T.coder(*(open(x, "rb").read() for x in (T.BYTE_LEVEL, T.PIECES))), [x or "" for x in texts]
    want = brute(some)
    assert c.splits and len(T.SPLIT.split("a b\u00a0 c  d e\n f")) == 3
    monkeypatch.setattr(T, "KNOWN_CHUNKS", 3)
    for step in (1, 2, 7, len(some)):
        rows = [T._aligned(c, some[low : low + step], False) for low in range(0, len(some), step)]
        assert [x for r in rows for x in zip(*(list(r[k]) for k in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")), strict=True)] == [(*x[:4], x[6]) for x in want]
    c.splits = False
    c.forget()
    assert list(T._aligned(c, some, False)["groups_sha256"]) == [x[6] for x in want]
    c.splits = True
    c.forget()


def test_cold_pairs_give_the_same(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "HOT", 20)
    got = dict(found(spark, [(i, t, "l", "s") for i, t in enumerate(texts)], tmp_path))
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_null_and_repeated_ids_and_empty_tables(spark, tmp_path):
    rows = [(None, "one two", "l", "s"), (7, "one two", "l", "s"), (7, "three", "l", "s"), (7, "three", "l", "s")]
    got = found(spark, rows, tmp_path)
    want = brute([x[1] for x in rows])
    assert sorted(got, key=str) == sorted([(i, w) for (i, *_), w in zip(rows, want, strict=True)], key=str)
    assert found(spark, [], tmp_path / "none") == []


def test_groups_and_links_hold_all_tokens(spark):
    text = "Übergroße tokens, naïvely 日本語"
    clash = docs(spark, [(1, text, "l", "s")]).withColumn("n_a", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("row", F.lit(2))
    x = T.align(clash).first()
    assert x.groups_sha256 == hashlib.sha256(x.groups.encode()).hexdigest() and sum(x.times) == x.n_links == x.n_a + x.n_b - x.n_groups
    assert len(x.groups.split(";")) == x.n_groups and sum(len(g.split("|")[0].split(",")) for g in x.groups.split(";")) == x.n_a
    rated = T.pair_counts(T.align(clash)).collect()
    assert all(p.n == 1 and p.best_a and p.best_b for p in rated) and len(rated) == len(x.times)
