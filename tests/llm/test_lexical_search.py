"""Lexical search against a loop over all documents, and block boundaries against all ways to cut."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.llm import lexical_search as S

from .test_brute_force import docs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(rows, items, k=50):
    """[(item place, rank, doc_id, score)] by scoring every document."""
    held = [(i, terms(t)) for i, t in rows if terms(t)]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = Counter(t for _, x in held for t in set(x))
    out = []
    for place, (_, text) in enumerate(items):
        scored = []
        for i, x in held:
            m, tf, score = 100 - 50 + (50 * len(x) * n_docs) // n_terms, Counter(x), 0
            for t in set(terms(text)) & set(x):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(place, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def corpus():
    r = random.Random(3)
    word = lambda: f"w{min(r.randrange(1, 400), r.randrange(1, 400), r.randrange(1, 400))}"
    rows = [(i, " ".join(word() for _ in range(r.choice([1, 3, 20, 60])))) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(90)] + [(None, rows[5][1]), (2000, None), (2001, ""), (2002, " ,;!"), (2003, "W5—w6 É_é\x00x w7"), (2004, "w1 " * 5000), (3, "w2 w3"), (3, "w2 w3")]
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 8, 30])))) for i in range(25)]
    items += [(100, rows[5][1]), (101, None), (102, "neverseen"), (103, ""), (None, "w2 W3 w2"), (5, "w1"), (5, "w1"), (104, "É x"), (105, "é—w6")]
    return rows, items


def run(spark, rows, items, parts=2):
    corpus_ = S.index(docs(spark, [(i, t, "l", "s") for i, t in rows]).repartition(parts))
    return corpus_, S.search(corpus_, spark.createDataFrame(items, "item_id long, text string"))


def same(found, want, items):
    return sorted((str(x.item_id), x.rank, str(x.doc_id), x.score) for x in found.collect()) == sorted((str(items[p][0]), rank, str(d), score) for p, rank, d, score in want)


@pytest.mark.parametrize("parts, query_terms", [(1, S.QUERY_TERMS), (9, 40)])
def test_results_are_those_of_a_loop_over_all_documents(spark, monkeypatch, parts, query_terms):
    monkeypatch.setattr(S, "QUERY_TERMS", query_terms)
    rows, items = corpus()
    index, found = run(spark, rows, items, parts)
    assert same(found, brute(rows, items), items)
    assert (index.n_docs, index.n_terms) == (sum(bool(terms(t)) for _, t in rows), sum(len(terms(t)) for _, t in rows))
    lists = index.postings.where("term IS NOT NULL").agg(F.sum("df"), F.countDistinct("shard")).first()
    assert lists[0] == sum(len(set(terms(t))) for _, t in rows) and lists[1] == parts


def test_terms_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_TERMS", 0)
    rows, items = corpus()
    assert same(run(spark, rows[:100], items)[1], brute(rows[:100], items), items)


def test_blocks_not_opened_hold_no_result(monkeypatch):
    r = np.random.Generator(np.random.PCG64(1))
    lists = S.Lists(list(range(5000)), np.arange(5000, dtype=np.int32).tobytes())
    for term in range(12):
        docs_ = np.sort(r.choice(5000, 3000 // (term + 1), replace=False)).astype(np.int32)
        impacts = (r.pareto(2, len(docs_)) * 50_000).clip(1, 999_999).astype(np.int64)
        last = S.cut_blocks(docs_, impacts, np.array([0, len(docs_)]), 100_000)
        ends = np.flatnonzero(last) + 1
        lists.add(term, *(x.astype(np.int32).tobytes() for x in (docs_, impacts, ends, np.maximum.reduceat(impacts, np.append(0, ends[:-1])))))
    query = [(t, 100 * (t + 1)) for t in range(12)]
    whole = lists.scores(query, np.ones(5000, bool))
    assert (whole <= lists.bounds(query)).all()
    opened, plain = [], lists.scores
    monkeypatch.setattr(lists, "scores", lambda q, wanted: opened.append(wanted.sum()) or plain(q, wanted))
    want = sorted(((-s, d) for d, s in enumerate(whole.tolist()) if s))[:50]
    assert [(-s, d) for s, d in lists.best(query, 50, 0)] == want and sum(opened) < 2500
    assert [(-s, d) for s, d in lists.best(query, 50, -want[10][0])] == [x for x in want if x[0] <= want[10][0]]


def test_no_other_way_to_cut_has_a_smaller_error():
    r = random.Random(9)
    for _ in range(60):
        sizes = [r.randrange(1, 11) for _ in range(4)]
        impacts = np.array([r.choice([1, 5, 9, 40, 41]) for _ in range(sum(sizes))], np.int64)
        offsets, cost, longest = np.cumsum([0, *sizes]), r.choice([0, 3, 30]), r.choice([3, 20])
        docs_ = np.concatenate([np.sort(np.array(r.sample(range(30), n))) for n in sizes])
        last = S.cut_blocks(docs_, impacts, offsets, cost, 16, longest)
        for low, high in zip(offsets[:-1], offsets[1:], strict=True):
            assert last[high - 1]
            errors = []
            for cuts in product([False, True], repeat=high - low - 1):
                ends = [i + 1 for i, x in enumerate([*cuts, True]) if x]
                blocks = [(low + a, low + b) for a, b in zip([0, *ends], ends, strict=False)]
                if all(b - a <= longest for a, b in blocks):
                    over = sum((docs_[b - 1] + 1 - docs_[a]) * impacts[a:b].max() - impacts[a:b].sum() + cost for a, b in blocks)
                    errors.append((int(over), tuple([*cuts, True])))
            assert min(errors)[0] == dict((c, e) for e, c in errors)[tuple(last[low:high].tolist())]


def test_long_lists_are_cut_in_runs():
    impacts = np.arange(2000, dtype=np.int64)
    last = S.cut_blocks(np.append(np.arange(1500), np.arange(500)), impacts, np.array([0, 0, 1500, 2000]), 100, 512, 128)
    ends = np.flatnonzero(last) + 1
    assert {512, 1024, 1500, 2000} <= set(ends.tolist()) and np.diff(np.append(0, ends)).max() <= 128


def test_clashing_columns_and_empty_tables(spark):
    rows, items = [(1, "a b"), (2, "b c")], [(7, "b"), (8, "c")]
    index = S.index(docs(spark, [(i, t, "l", "s") for i, t in rows]).withColumns({"term": F.lit(1), "shard": F.lit(1), "a.b": F.lit(2)}))
    queries = spark.createDataFrame(items, "item_id long, text string").withColumns({"item": F.lit(0), "rank": F.lit(0), "score": F.lit(0)})
    assert same(S.search(index, queries), brute(rows, items), items)
    assert S.search(index, queries.limit(0)).count() == 0
    assert run(spark, [], items)[1].count() == 0
    assert run(spark, [(1, None)], items)[1].count() == 0
    named = S.index(docs(spark, [(i, t, "l", "s") for i, t in rows]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert [tuple(x)[:3] for x in S.search(named, spark.createDataFrame([(7, "b")], "item_id long, text string")).orderBy("rank").collect()] == [(7, 1, "d1"), (7, 2, "d2")]


def test_query_is_its_sql(same_as_sql):
    same_as_sql(S.op12_lexical_search, S.ORACLES["op12_lexical_search"])
