from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.llm import jaccard_join as jaccard
from quireflow.llm.jaccard_join import classes, jaccard_join, tokens

SCHEMA = "doc_id long, text string, source string, token string, component string"


def brute(rows, n, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                ra, rb = a, b
                while root[ra] != ra:
                    ra = root[ra]
                while root[rb] != rb:
                    rb = root[rb]
                root[max(ra, rb)] = min(ra, rb)
    out = {}
    for i in ids:
        r = i
        while root[r] != r:
            r = root[r]
        out[i] = (len(sets[i]), r)
    return out


def family(seed, count, words, edits, vocabulary=400):
    """Copies of one text with so many words replaced, at most."""
    r = random.Random(seed)
    base = [f"w{r.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(count):
        t = list(base)
        for _ in range(r.randrange(edits + 1)):
            t[r.randrange(len(t))] = f"x{r.randrange(10_000)}"
        if r.random() < 0.3:
            t = t[: len(t) - r.randrange(max(1, words // 12))]
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 70)])
def test_same_components_as_brute_force(spark, n, percent):
    texts = family(1, 120, 60, 6) + family(2, 60, 300, 20) + family(3, 60, 12, 2) + family(4, 20, 9, 1) + family(5, 10, 2, 1) + [" ".join(f"u{i}-{j}" for j in range(40)) for i in range(20)]
    texts += ["", None, " \t\n", "One", "one", "A b", "a  B", "a b c"]
    random.Random(9).shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "s", "t", "c") for i, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df, shingle_words=n, percent=percent).collect()}
    assert got == brute(rows, n, percent)


def test_null_ids_repeats_and_empty_table(spark):
    text = " ".join(map(str, range(50)))
    df = spark.createDataFrame([(None, text, "s", "t", "c"), (7, text, "s", "t", "c"), (7, text, "s", "t", "c"), (3, text, None, None, None), (5, None, "s", "t", "c")], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(df, shingle_words=3, percent=90).collect()), key=str)
    assert got == sorted([(None, 48, None), (7, 48, 3), (7, 48, 3), (3, 48, 3), (5, 0, 5)], key=str)
    empty = jaccard_join(df.where(F.lit(False)), shingle_words=3, percent=90)
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_size_classes_reach_every_linked_size(percent):
    low, _, _ = classes(3000, percent)
    of = lambda n: int((low <= n).sum()) - 1
    for n in range(1, 2000):
        assert of(n * 100 // percent) - of(n) <= 1


def test_largest_set_of_a_piece_shares_a_token_with_a_larger_one_elsewhere():
    r = np.random.default_rng(1)
    for n in range(20, 400, 7):
        large = np.sort(r.integers(0, 2**63, n * 10 // 9, dtype=np.uint64))
        small = np.sort(large[r.permutation(len(large))[:n]])
        found = [set(tokens(x, np.array([0, len(x)]), 90)[0].tolist()) for x in (small, large)]
        assert found[0] & found[1]


def test_a_hot_token_is_split_in_rounds(spark, monkeypatch):
    """Documents of one template, most of them linked with none: parts of parts, and no link is lost."""
    monkeypatch.setattr(jaccard, "ROWS_AT_ONCE", 70)
    r = random.Random(21)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(330):
        own = base[:70] + [f"x{i}y{k}" for k in range(r.choice([3, 25, 40]))]
        rows.append((i, " ".join(own)))
    rows += [(400 + i, " ".join([*base[:70], *(f"x{i}y{k}" for k in range(3)), "more"])) for i in range(0, 330, 9)]
    df = spark.createDataFrame([(i, t, "s", "t", "c") for i, t in rows], SCHEMA).repartition(5)
    for words, percent in ((1, 80), (3, 90)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join(df, shingle_words=words, percent=percent).collect()}
        assert got == brute(rows, words, percent)
        assert len({c for _, c in got.values()}) > 20


def test_close_pairs_connect_all_that_is_close():
    g = np.random.Generator(np.random.PCG64(4))
    base = g.integers(0, 2**63, 90, dtype=np.uint64)
    sets_ = [np.unique(np.concatenate([base[g.random(90) < 0.95], g.integers(0, 2**63, int(n), dtype=np.uint64)])) for n in g.choice([0, 2, 10, 60], 150)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets_])])
    bits = jaccard.sketches(np.concatenate(sets_), offsets)
    for steps in (1, 3, 27):
        a, b, leaders = jaccard.close_pairs(np.zeros(150, np.int64), np.arange(150), np.diff(offsets), bits, 80, steps)
        part = np.arange(150)
        for x, y in zip(a, b, strict=True):
            part[part == part[y]] = part[x]
        for x in range(150):
            for y in range(x):
                both = len(np.intersect1d(sets_[x], sets_[y]))
                if 100 * both >= 80 * (len(sets_[x]) + len(sets_[y]) - both):
                    assert part[x] == part[y]
        assert steps == 1 or len(leaders) == 1


def test_tokens_are_listed_and_groups_meet_in_turns(spark, monkeypatch):
    """Each token has one turn, copies list none, and no link is lost; before, all tokens of all documents were on disk at once."""
    rows = [(100 * k + i, t) for k, (edits, count) in enumerate([(14, 90), (25, 60), (9, 40)]) for i, t in enumerate(family(k, count, 90, edits))]
    rows += [(1000 + i, t) for i, t in rows[:150]]
    df = spark.createDataFrame([(i, t, "s", "t", "c") for i, t in rows], SCHEMA).repartition(4)
    docs = df.select("doc_id", "text")
    parts = [{x.token for x in jaccard._listed(docs, 2, 80, turn, 3).select("token").distinct().collect()} for turn in range(3)]
    whole = {x.token for x in jaccard._listed(docs, 2, 80).select("token").distinct().collect()}
    assert set().union(*parts) == whole and sum(map(len, parts)) == len(whole) and max(map(len, parts)) < len(whole) / 2
    monkeypatch.setattr(jaccard, "GROUP", 5)
    monkeypatch.setattr(jaccard, "TURN_SHINGLES", 4_000)
    listed, asked = jaccard._listed, []
    monkeypatch.setattr(jaccard, "_listed", lambda docs, n, percent, *turn: asked.append((docs.count(), *turn)) or listed(docs, n, percent, *turn))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join(df, shingle_words=2, percent=80).collect()}
    assert got == brute(rows, 2, 80) and [x[1:] for x in asked] == [(i, 4) for i in range(4)] and asked[0][0] == len({t for _, t in rows})


@pytest.mark.parametrize("meet", [1, 2, 8])
def test_groups_meet_in_blocks(spark, monkeypatch, meet):
    """Families of many small groups that are not one component: no link between groups is lost."""
    monkeypatch.setattr(jaccard, "GROUP", 5)
    monkeypatch.setattr(jaccard, "MEET", meet)
    opened = []
    links = jaccard._across
    monkeypatch.setattr(jaccard, "_across", lambda *how: opened.append(1) or links(*how))
    rows = [(100 * k + i, t) for k, (edits, count) in enumerate([(14, 90), (25, 60), (9, 40)]) for i, t in enumerate(family(k, count, 90, edits))]
    df = spark.createDataFrame([(i, t, "s", "t", "c") for i, t in rows], SCHEMA).repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join(df, shingle_words=2, percent=80).collect()}
    assert got == brute(rows, 2, 80) and opened and 3 < len({c for _, c in got.values()}) < 180
