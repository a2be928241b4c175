"""What is done beyond the bounds of operators: as much as below them."""

from __future__ import annotations

import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quireflow.llm import decontaminate, language_id, nearest, quality, url_reputation, warc

from .test_brute_force import docs


def test_languages_in_blocks_are_scored_as_in_one(spark, monkeypatch):
    r = random.Random(7)
    alphabets = {f"l{k:02}": "".join(r.sample("abcdefghijklmnopqrstuvwxyzäöü", 9)) for k in range(11)}
    rows = [(i, " ".join("".join(r.choices(alphabets[lang], k=5)) for _ in range(r.randrange(1, 25))), lang, "s") for i in range(260) for lang in [r.choice(list(alphabets))]]
    rows += [(900, None, "l01", "s"), (901, "123 !", "l02", "s"), (None, "abc", None, "s"), (902, "abc abc", "l03", "s"), (902, "abc abc", "l03", "s")]
    table = docs(spark, rows)
    told = lambda: sorted((str(x.doc_id), x.held_out, x.lang_pred, round(x.score, 7)) for x in language_id.identify(table).collect())
    whole = told()
    for most in (1, 4):
        monkeypatch.setattr(language_id, "MOST_LANGS", most)
        assert len(language_id.train(table, "doc_id", "text", "lang")[1]) == -(-11 // most)
        assert told() == whole
    assert len({x[2] for x in whole}) > 8 and language_id.identify(table.limit(0)).count() == 0


def test_more_languages_than_a_matrix_holds(spark):
    rows = [(i, f"{chr(0x4E00 + i % 230)} " * 12, f"lang{i % 230:03}", "s") for i in range(1150)]
    got = language_id.identify(docs(spark, rows)).where("held_out").collect()
    assert len(got) > 60 and sum(x.lang_pred == f"lang{x.doc_id % 230:03}" for x in got) >= 0.9 * len([x for x in got if x.doc_id])


def test_vectors_without_a_fitting_layout_are_searched_exactly(spark, monkeypatch):
    g = np.random.Generator(np.random.PCG64(3))
    x = g.normal(size=(160, 8)).astype(np.float32)
    x[20] = x[3]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"))
    monkeypatch.setattr(nearest, "fitted", lambda *_: None)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest.search(vectors, queries, k=5).collect()}
    y = x.astype(float)
    for q in range(0, 160, 10):
        best = sorted((-float(y[q] @ y[c]), c) for c in range(160) if c != q)[:5]
        for rank, (score, c) in enumerate(best, 1):
            assert got[q, rank][0] == c and got[q, rank][1] == pytest.approx(-score, abs=1e-9)
    assert len(got) == 80


def test_benchmarks_of_several_blocks(spark):
    r = random.Random(2)
    items = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(r.randrange(3, 30)))) for i in range(30)]
    texts = [(i, " ".join([*(f"x{r.randrange(500)}" for _ in range(r.randrange(20))), items[r.randrange(30)][1], "end"]), "l", "s") for i in range(50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [sorted(map(tuple, decontaminate.decontaminate(docs(spark, texts), bench, block_words=n).collect())) for n in (decontaminate.BLOCK_WORDS, 60)]
    assert found[0] == found[1] and len(found[0]) >= 40


@pytest.mark.parametrize("module, names", [(quality, ("BROADCAST_LABELS", "BROADCAST_SITES")), (url_reputation, ("BROADCAST_HOSTS",)), (warc, tuple(n for n in dir(warc) if n.startswith("BROADCAST_")))])
def test_joins_beyond_what_is_broadcast(spark, monkeypatch, module, names):
    small = "/root/testdata/sf0.001"
    query = next(iter(module.QUERIES.values()))
    rows = lambda: sorted(map(str, query(spark, small).collect()))
    whole = rows()
    assert names and whole
    for n in names:
        monkeypatch.setattr(module, n, 0)
    assert rows() == whole


def test_a_task_that_fills_several_bundles(monkeypatch, tmp_path):
    """Frames and bundles are closed when they are full; each bundle's seek table finds its own frames, and every record its place."""
    monkeypatch.setattr(warc, "FRAME_BYTES", 3_000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 4_000)
    g = np.random.Generator(np.random.PCG64(1))
    out = warc.Bundler(f"file://{tmp_path}/bundles", 3, "try")
    payloads = [g.bytes(int(n)) for n in g.integers(0, 2_500, 40)] + [g.bytes(20_000)]
    for i, payload in enumerate(payloads):
        out.add(i, "response", f"urn:{i}", warc.record("response", f"urn:{i}", i, None, payload, "0", None, "1970-01-01T00:00:00Z"))
    out.end_bundle()
    assert len({r[3] for r in out.rows}) > 5 and len(out.rows) == 41
    for page, _, _, bundle, number, at, size, start, length in out.rows:
        data = (tmp_path / "bundles" / bundle).read_bytes()
        with (tmp_path / "bundles" / bundle).open("rb") as f:
            table = warc.read_seek_table(f, len(data))
        assert table[number][:2] == (at, size)
        frame = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=table[number][2])
        head, block, _ = warc.parse(frame[start : start + length], 0)
        assert head["x-page-id"] == str(page) and block == payloads[page]
