from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.llm import katz

SCHEMA = "doc_id long, text string, source string, word string, n long"


def split(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)}).split(" ") if text and text.strip(" ") else []


def brute(rows, held, order=3, times=1):
    """Every probability from its definition, every training text counted so many times; asserts that each history's sum to 1."""
    tokens = lambda t: [w for w in split(t) if w] + ["</s>"]
    grams = lambda t, n: [tuple(x) for x in zip(*[(["<s>"] * (n - 1) + tokens(t))[i:] for i in range(n)], strict=False)]
    counts = {n: Counter(g for i, t in rows if not held(i) for g in grams(t, n)) for n in range(1, order + 1)}
    counts = {n: Counter({g: c * times for g, c in x.items()}) for n, x in counts.items()}
    one, total = counts[1], sum(counts[1].values())
    after = {n: defaultdict(list) for n in counts}
    for n, seen in counts.items():
        for g in seen:
            after[n][g[:-1]].append(g[-1])
    tables = {n: katz.discounts(dict(Counter(c.values()))) for n, c in counts.items()}
    d = lambda n, c: c - katz.EPSILON if c > katz.KEPT else tables[n][c]
    of = {n: {h: sum(counts[n][(*h, w)] for w in ws) for h, ws in after[n].items()} for n in counts}
    lost = lambda n, c: c - tables[n][c] if c <= katz.KEPT else katz.EPSILON
    left = sum(lost(1, c) for c in one.values()) / total if total else 1
    alphas = {}

    def p(g):
        n = len(g)
        if n == 1:
            return d(1, one[g]) / total if one[g] else left
        if counts[n][g]:
            return d(n, counts[n][g]) / of[n][g[:-1]]
        return alpha(g[:-1]) * p(g[1:])

    def alpha(h):
        n = len(h) + 1
        if h not in alphas:
            ws = after[n].get(h, [])
            shorter = [counts[n - 1][(*h, w)[1:]] for w in ws]
            whole = of[n - 1][h[1:]] if ws else 1
            rest = (whole - sum(shorter) + sum(lost(n - 1, c) for c in shorter)) / whole
            alphas[h] = sum(lost(n, counts[n][(*h, w)]) for w in ws) / of[n][h] / rest if ws else 1.0
        return alphas[h]

    for n in range(2, order + 1):
        for h in list(after[n])[:5]:
            assert sum(p((*h, w[0])) for w in one) + p((*h, "never seen")) == pytest.approx(1, abs=1e-9)
    out = []
    for i, t in rows:
        w = tokens(t)
        s = sum(math.log10(p(g)) for g in grams(t, order)) if total else 0.0
        out.append((i, held(i), len(w), sum(one[(x,)] > 0 for x in w), total, sum(math.log10((one[(x,)] + 1) / (total + len(one) + 1)) for x in w), s))
    return out


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def compare(spark, rows, order=3):
    df = spark.createDataFrame([(i, t, "s", "w", 1) for i, t in rows], SCHEMA).repartition(3)
    model, scored = katz.fit_and_score(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, order=order)
    got = scored.collect()
    key = lambda r: (str(r[0]), r[2], round(r[6], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(brute(rows, is_held, order), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-6)


@pytest.mark.parametrize(("order", "target", "part"), [(3, 1_500_000, 1_000_000), (3, 500, 800), (2, 300, 200), (4, 2_000, 700)])
def test_same_scores_as_brute_force(spark, monkeypatch, order, target, part):
    for name, value in (("TARGET_TOKENS", target), ("PART_TOKENS", part)):
        monkeypatch.setattr(katz, name, value)
    r = random.Random(order + target)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[min(299, int(r.expovariate(0.02)))] for _ in range(r.randrange(120)))) for i in range(150)]
    rows += [(150, None), (151, ""), (152, "  \t".replace("\t", " ")), (153, "the end " * 400), (153, "the end " * 400), (None, "W1 w2 never-seen"), (154, "Only here"), (155, "w1  W2")]
    compare(spark, rows, order)


def test_tables_score_another_corpus(spark, monkeypatch):
    monkeypatch.setattr(katz, "TARGET_TOKENS", 400)
    monkeypatch.setattr(katz, "PART_TOKENS", 300)
    r = random.Random(3)
    rows = [(i, " ".join(f"w{min(80, int(r.expovariate(0.05)))}" for _ in range(r.randrange(60)))) for i in range(80)]
    df = spark.createDataFrame([(i, t, "s", "w", 1) for i, t in rows], SCHEMA)
    other = lambda i: i >= 50
    model, scored = katz.fit_and_score(df, F.col("doc_id") >= 50)
    want = {x[0]: x for x in brute(rows, other)}
    got = {x.doc_id: x for x in katz.score(df, model).collect()}
    joint = {x.doc_id: x for x in scored.collect()}
    assert set(got) == set(joint) == set(want)
    for i, x in got.items():
        assert (x.n_tokens, x.n_known, x.train_tokens) == want[i][2:5] and x.held_out
        assert x.base_score == pytest.approx(want[i][5], abs=1e-6) and x.score == pytest.approx(want[i][6], abs=1e-4) and joint[i].score == pytest.approx(want[i][6], abs=1e-6)
    levels = {r.level: r.n for r in model.counts.groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert set(levels) == {1, 2, 3} and min(levels.values()) > 1 and {r.level for r in model.weights.select("level").distinct().collect()} == {2, 3}


def test_nothing_to_learn_and_empty_table(spark):
    held = next(i for i in range(100) if is_held(i))
    compare(spark, [(held, "a b c")])
    df = spark.createDataFrame([], SCHEMA)
    assert katz.fit_and_score(df, F.lit(False))[1].count() == 0


def test_counts_beyond_32_bits(spark, monkeypatch):
    """Every training text stands for 2**33 of its kind."""
    times, encoded, counted = 2**33, katz.encoded, katz.counted
    monkeypatch.setattr(katz, "TARGET_TOKENS", 300)
    monkeypatch.setattr(katz, "PART_TOKENS", 200)
    # Sums that the driver is told, and answers and stored counts, as if each had been counted that often.
    monkeypatch.setattr(katz, "encoded", lambda docs: encoded(docs).withColumns({c: F.col(c) * times for c in ("docs", "learnt")}))

    def often(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for x in rows:
                values = list(katz.unpack(x["body"]))
                if x["kind"] == katz.ANSWER:
                    values[0] = values[0] // 2 * 2 * times + values[0] % 2
                else:
                    values[1] = values[1].astype("int64") * times
                    x["types"] = [0] * (katz.KEPT + 2) + [sum(x["types"][:-1]), x["types"][-1] * times]
                x["body"] = katz.pack(*values)
            yield katz._batch([tuple(x[f.split()[0]] for f in katz._ROWS.split(", ")) for x in rows])

    columns = [f.split()[0] for f in katz._ROWS.split(", ")]
    monkeypatch.setattr(katz, "counted", lambda *how: counted(*how).select(columns).mapInArrow(often, katz._ROWS))
    r = random.Random(12)
    rows = [(i, " ".join(f"w{min(40, int(r.expovariate(0.1)))}" for _ in range(r.randrange(40)))) for i in range(60)]
    df = spark.createDataFrame([(i, t, "s", "w", 1) for i, t in rows], SCHEMA)
    got = {x.doc_id: x for x in katz.fit_and_score(df, F.col("doc_id") >= 40)[1].collect()}
    for i, _, n, known, total, base, score in brute(rows, lambda i: i >= 40, times=times):
        x = got[i]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (n, known, total) and total > 2**40
        assert x.base_score == pytest.approx(base, abs=1e-6) and x.score == pytest.approx(score, abs=1e-6)


def test_few_distinct_fractions_take_a_byte_at_most():
    """Bit for bit, be they few, many, none or negative zeros."""
    r = np.random.default_rng(3)
    few = r.choice(np.array([0.37, 0.61, 1e-3, 0.98, 1.35, -0.0, 0.0]), 4000)
    for a in (few, np.round(r.random(4000), 2) + 0.1, np.concatenate([np.arange(300) / 7] * 9), r.random(50), np.zeros(0), np.ones(1)):
        got = katz.unpack(katz.pack(a, np.arange(3), "x"))
        assert got[0].dtype == np.float64 and got[0].tobytes() == a.tobytes() and got[1].tolist() == [0, 1, 2] and got[2] == "x"
    assert len(katz.pack(few)) < len(few) / 2


@pytest.mark.parametrize(("order", "target", "part"), [(3, 1_500_000, 1_000_000), (2, 300, 200), (3, 400, 250), (4, 700, 900)])
def test_messages_of_one_level_at_a_time_and_of_wanted_weights_alone(spark, monkeypatch, order, target, part):
    """Scores are as by definition where weights are those of histories alone from which held-out texts back off."""
    for name, value in (("TARGET_TOKENS", target), ("PART_TOKENS", part)):
        monkeypatch.setattr(katz, name, value)
    written, delete, names, asked = katz.tables.written, katz.tables.delete, [], []
    monkeypatch.setattr(katz.tables, "written", lambda df, name, by=(): names.append(name) or written(df, name, by))

    def deleted(session, path):
        asked.append(session.read.parquet(path).agg(F.sum(F.length("body"))).first()[0])
        delete(session, path)

    monkeypatch.setattr(katz.tables, "delete", deleted)
    r = random.Random(order * target)
    rows = [(i, " ".join(f"w{min(299, int(r.expovariate(0.03)))}" for _ in range(r.randrange(90)))) for i in range(160)] + [(160, None), (161, "w1 w2 never-seen w3"), (None, "W1 w2")]
    df = spark.createDataFrame([(i, t, "s", "w", 1) for i, t in rows], SCHEMA).repartition(3)
    weights = []
    for whole in (True, False):
        model, scored = katz.fit_and_score(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, order=order, whole=whole)
        assert names == ["parts", *["counts"] * order, *["asked"] * katz.ROUNDS, "weights"] and len(asked) == katz.ROUNDS
        weights.append((sum(asked), {}))
        for x in model.weights.collect():
            keys, alpha = katz.unpack(x.body)
            weights[-1][1].update({(x.level, x.target, k): a for k, a in zip(keys.cumsum(dtype="uint64").tolist(), alpha.tolist(), strict=True)})
        key = lambda x: (str(x[0]), x[2])
        for a, b in zip(sorted(map(tuple, scored.collect()), key=key), sorted(brute(rows, is_held, order), key=key), strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-6)
        names.clear()
        asked.clear()
    (all_bytes, all_weights), (few_bytes, few_weights) = weights
    assert few_bytes < all_bytes and 0 < len(few_weights) < len(all_weights)
    assert {k: all_weights[k] for k in few_weights} == pytest.approx(few_weights)
