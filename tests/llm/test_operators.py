"""Operators against SQL, brute force, exact round trips and held-out accuracy, with nulls, empty texts, repeats and clashing names."""

from __future__ import annotations

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quireflow.llm import decontaminate, language_id, mixing, nearest, quality, queries, token_counts, url_reputation

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string, lang string, score double, item_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, lang, 0.0, "x") for i, t, s, lang in rows], DOCS)


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - {"op10_jaccard_join"}))
def test_same_as_sql(same_as_sql, name):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])


def test_decontaminate_finds_copies_and_edits_only(spark):
    r = random.Random(4)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    item = words(40)
    edited = [w if i % 9 else "other" for i, w in enumerate(item)]
    rows = [(1, " ".join(words(300) + item + words(300)), "s", "l"), (2, " ".join(words(50) + edited + words(9)), "s", "l"), (2, " ".join(item).upper(), "s", "l"), (3, " ".join(words(400)), "s", "l"), (4, None, None, None), (5, "", "s", "l"), (None, " ".join(item), "s", "l")]
    items = spark.createDataFrame([("a", " ".join(item), 1), ("b", "too short", 2), ("c", None, 3)], "item_id string, text string, doc_id long")
    got = decontaminate.decontaminate(docs(spark, rows), items).collect()
    assert sorted(((x.doc_id, x.item_id) for x in got), key=str) == sorted([(1, "a"), (2, "a"), (2, "a"), (None, "a")], key=str)
    assert {x.score for x in got if x.doc_id == 1} == {1.0}
    assert decontaminate.decontaminate(docs(spark, rows).where(F.lit(False)), items).count() == 0
    assert decontaminate.decontaminate(docs(spark, rows), items.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("copies", [1, 60])
def test_decontaminate_finds_edited_copies_without_whole_ones(spark, copies):
    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    texts = {f"{n}/{step}": words(n) for n in (20, 30, 40, 59) for step in (7, 8)}
    rows, wanted = [(0, " ".join(words(200)), "s", "l")], set()
    for name, item in texts.items():
        edited = ["other" if i % int(name.split("/")[1]) == int(name.split("/")[1]) - 1 else w for i, w in enumerate(item)]
        for _ in range(copies):
            rows.append((len(rows), " ".join(words(30) + edited + words(30)), "s", "l"))
            wanted.add((rows[-1][0], name))
    items = spark.createDataFrame([(name, " ".join(item)) for name, item in texts.items()], "item_id string, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.decontaminate(docs(spark, rows), items).collect()} == wanted


def test_alignment_is_smith_waterman():
    r = np.random.default_rng(3)
    for _ in range(60):
        a, b = (r.integers(0, 6, n).astype(np.uint64) for n in r.integers(1, 14, 2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align([(a, b)])[0] == pytest.approx(h.max() / (2 * len(a)))


def test_language_held_out(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet").where("lang is not null")
    got = language_id.identify(table).where("held_out").join(table.select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got > 0.9
    rows = [(1, None, "s", "en"), (2, "", "s", None), (3, "123 !", None, "en"), (None, "letters", "s", "en"), (4, "letters", "s", "en")]
    pred = {r.doc_id: (r.lang_pred, r.held_out) for r in language_id.identify(docs(spark, rows)).collect()}
    assert [pred[i][0] for i in (1, 2, 3)] == ["und"] * 3 and pred[None][1] is False
    assert language_id.identify(docs(spark, rows).where(F.lit(False))).count() == 0


def test_mix_comes_near_targets(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" * r.randrange(1, 60)), r.choice(["a", "b", "b", "b", None]), "l") for i in range(1500)] + [(None, "x y", "a", "l"), (9, None, "c", "l"), (9, "", "c", "l"), (9, "x", "a", "l")]
    out = mixing.mix(docs(spark, rows).repartition(3)).collect()
    again = mixing.mix(docs(spark, rows).repartition(5)).collect()
    key = lambda x: (str(x.doc_id), x.size, x.taken)
    assert len(out) == len(rows) and sorted(map(key, out)) == sorted(map(key, again))
    for source in {x.source for x in out}:
        own = [x for x in out if x.source == source]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 0.02 * own[0].target + 60
    assert all(x.taken <= 2 * x.size for x in out)
    assert mixing.mix(docs(spark, rows).where(F.lit(False))).count() == 0


def test_nearest_recall(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [r for r in table.collect() if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got: dict = {}
    for r in nearest.op5_nearest(spark, DATA).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = n = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        own = sorted(got[q])
        assert [a for a, _, _ in own] == list(range(1, len(order) + 1))
        assert all(s == pytest.approx(score[ids == v][0]) for _, v, s in own)
        hits, n = hits + len({v for _, v, _ in own} & set(ids[order])), n + len(order)
    assert hits >= 0.9 * n


def test_nearest_leaves_out_bad_vectors(spark):
    rows = [(0, [1.0, 0.0], "x"), (1, [0.5, 0.5], "x"), (2, None, "x"), (3, [0.0, 0.0], "x"), (4, [float("nan"), 1.0], "x"), (5, [1.0, None], "x"), (6, [1.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = [(r.rank, r.vec_id) for r in nearest.search(df, spark.createDataFrame([(0,), (2,)], "query_id long")).orderBy("query_id", "rank").collect()]
    assert got == [(1, 6), (2, 1)]


def test_tokens_add_up_to_whole_documents(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(token_counts.VOCABULARY, "rb").read().splitlines() if x)}
    coding = tiktoken.Encoding("test", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "One line\nand another, tiếng Việt\n\nlast", "s", "l"), (2, None, "s", "l"), (3, "", "s", "l"), (4, "x " * 30_000, "s", "l"), (None, "same\nrow", "s", "l")]
    got: dict = {}
    for r in token_counts.count_tokens(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.n_tokens, r.doc_tokens))
    for i, text, _, _ in rows:
        total = len(coding.encode_ordinary(text or ""))
        assert sum(n for _, n, _ in got[i]) == total and {d for _, _, d in got[i]} == {total}


def test_quality_tells_labels_apart_and_holds_edge_cases(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scored = quality.op7_quality(spark, DATA).join(labels, "doc_id").where("quality is not null").select("score", "quality").collect()
    good, bad = ([r.score for r in scored if r.quality == q] for q in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) > 0.8
    rows = [(1, None, None, None), (1, "", "s", None), (None, "a b c", "s", "l")]
    named = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, quality int")
    assert quality.classify(docs(spark, rows), named).count() == 3
    assert quality.classify(docs(spark, rows).where(F.lit(False)), named).count() == 0


def test_pipeline_stages_take_effect(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, kept, "/root/testdata/sf0.001")
        assert new.columns == table.columns and new.join(kept, "doc_id", "left_anti").count() == 0
        kept = new
    assert 0 < kept.count() < table.count()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_hosts_without_labels_have_posteriors_of_what_is_above(spark):
    r = random.Random(8)
    urls = [(i, f"http://h{i % 5}.evil.com/") for i in range(100)] + [(i, f"http://h{i % 7}.d{i % 40}.org/") for i in range(100, 500)]
    urls += [(900, "http://new.evil.com/"), (901, "http://new.unseen.org/"), (902, "http://a.b.unheard/"), (903, None), (None, "http://new.d1.org/")]
    outcomes = spark.createDataFrame([(i, int(i < 100 or r.random() < 0.1)) for i in range(500)] + [(901, None), (None, 1)], "page_id long, bad int")
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {x.page_id: x for x in url_reputation.judge_urls(pages, outcomes, rules=()).collect()}
    assert len(got) == len(urls) and got[903].bad_share is None
    assert got[900].verdict == "block" and {got[i].verdict for i in (901, 902, 903, None)} == {"allow"}
    assert got[900].bad_share > 0.9 and got[901].bad_share < 0.2 < got[902].bad_share < 0.5 and got[None].bad_share < 0.3
    one = url_reputation.judge_urls(pages, outcomes.where("page_id is null or page_id = 0 or page_id >= 100"), rules=()).where("page_id = 900").first()
    assert one.verdict == "allow"  # a single bad page of its domain
    assert url_reputation.judge_urls(pages, outcomes.where("page_id < 0"), rules=()).where("verdict = 'block'").count() == 0


def test_strengths_fit_the_spread_between_sites(spark):
    r = np.random.default_rng(6)
    sites = lambda shares: spark.createDataFrame([(200, int(r.binomial(200, p))) for p in shares], "n long, bad long")
    assert url_reputation.strength(sites(r.beta(3, 7, 300)), F.lit(0)) == pytest.approx(10, rel=0.3)
    assert url_reputation.strength(sites([0.3] * 300), F.lit(0)) > 300
