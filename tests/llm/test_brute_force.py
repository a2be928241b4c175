"""Operators and stages against plain Python written from their definitions, and the cases that their docstrings define."""

from __future__ import annotations

import base64
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quireflow.llm import decontaminate, jaccard_join, language_id, mixing, nearest, quality, token_counts, url_reputation, warc

from .test_jaccard_join import brute as components_of
from .test_jaccard_join import family

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)


# --- 1: decontamination


def whole_alignment(item, text):
    """Smith-Waterman of two lists of words, as a share of the item's own score."""
    last, best = [0] * (len(text) + 1), 0
    for a in item:
        row = [0]
        for j, b in enumerate(text):
            row.append(max(0, last[j] + (2 if a == b else -1), last[j + 1] - 1, row[j] - 1))
        best, last = max(best, *row), row
    return best / (2 * len(item))


def test_decontaminate_finds_what_whole_alignment_finds(spark):
    r = random.Random(11)
    words = lambda n, v=400: [f"w{r.randrange(v)}" for _ in range(n)]
    items = [words(r.randrange(8, 40)) for _ in range(12)]
    texts = [words(r.randrange(120)) for _ in range(30)]
    for _ in range(60):
        item = list(r.choice(items))
        for _ in range(r.randrange(len(item) // 3)):
            at = r.randrange(len(item))
            item[at : at + 1] = r.choice([[], ["x"], ["x", "y"]])
        texts.append(words(r.randrange(30)) + item + words(r.randrange(30)))
    grams = lambda w: {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    want = {(d, i): whole_alignment(item, t) for d, t in enumerate(texts) for i, item in enumerate(items) if grams(t) & grams(item)}
    want = {k: v for k, v in want.items() if v >= 0.5}
    found = decontaminate.decontaminate(docs(spark, [(d, " ".join(t), "l", "s") for d, t in enumerate(texts)]), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"))
    got = {(x.doc_id, x.item_id): x.score for x in found.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_decontaminate_short_and_long_items(spark):
    r = random.Random(1)
    book = [f"w{r.randrange(9000)}" for _ in range(6500)]
    rows = [(1, "Yes no maybe.", "l", "s"), (2, "yes no maybe not", "l", "s"), (3, " ".join(book[100:4600]), "l", "s"), (4, " ".join(["pad"] * 50 + book), "l", "s"), (5, " ".join(book[:1500]), "l", "s")]
    items = spark.createDataFrame([("short", "yes, NO maybe"), ("book", " ".join(book)), ("none", "?!")], "item_id string, text string")
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.decontaminate(docs(spark, rows), items).collect()}
    assert set(got) == {(1, "short"), (3, "book"), (4, "book")} and got[1, "short"] == got[4, "book"] == 1 and got[3, "book"] == pytest.approx(4500 / 6500, abs=0.01)


# --- 3: language


def test_language_is_naive_bayes(spark):
    r = random.Random(2)
    alphabet = {"aa": "abcde ", "bb": "cdefg ", "cc": "ghijk "}
    rows = [(i, "".join(r.choice(alphabet[lang]) for _ in range(r.randrange(1, 80))), lang, "s") for i, lang in enumerate(r.choices(list(alphabet), k=120))]
    rows += [(500, "äbc " * 20_000, "aa", "s"), (501, "ghi", None, "s")]
    got = {x.doc_id: x for x in language_id.identify(docs(spark, rows)).collect()}
    # Buckets of n-grams from the operator, everything else from the definition.
    grams = lambda t: [int(g) for found in [language_id.grams(language_id.pa.array([t]))] for per in found[0] for g in per[found[1][0] : found[1][1]]]
    import zlib

    train = [(t, lang) for i, t, lang, _ in rows if lang and zlib.crc32(str(i).encode()) % 5]
    counts, n = defaultdict(Counter), Counter(lang for _, lang in train)
    for t, lang in train:
        counts[lang].update(grams(t))
    for i, t, _, _ in rows:
        own = grams(t)
        score = {lang: (math.log(n[lang] / len(train)) + sum(math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * language_id.BUCKETS)) for g in own)) / math.sqrt(len(own)) for lang, c in counts.items()}
        best = min(score, key=lambda x: (-score[x], x))
        assert got[i].lang_pred == best and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].score == pytest.approx(1 / sum(math.exp(v - score[best]) for v in score.values()), abs=1e-3)


def test_language_ties_go_to_the_first_by_name(spark):
    rows = [(1, "abc", "bb", "s"), (2, "abc", "aa", "s"), (3, "abc", None, "s")]
    assert {x.lang_pred for x in language_id.identify(docs(spark, rows), folds=1 << 40).collect()} == {"aa"}


# --- 4: mixing


def test_draw_gives_rows_as_often_as_they_are_taken(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randrange(9)), "l", r.choice("abc")) for i in range(200)] + [(7, "x y", "l", "a")] * 5 + [(None, "x", None, None)] * 4
    taken = Counter()
    for x in mixing.mix(docs(spark, rows)).collect():
        taken[x.doc_id, x.source, x.size] += x.copies
    out = mixing.draw(docs(spark, rows)).collect()
    got = Counter((x.doc_id, x.source, len((x.text or "").split())) for x in out)
    assert got == +taken and out[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "copy"}
    assert Counter((x.doc_id, x.source, x.text, x.copy) for x in out).most_common(1)[0][1] == 1
    assert mixing.draw(docs(spark, rows).where(F.lit(False))).count() == 0


# --- 5: nearest neighbours


def nearest_of(spark, x, ids=None, k=20, every=20):
    ids = np.arange(len(x)) if ids is None else ids
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    out: dict = {}
    for r in nearest.search(df, df.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id")), k=k).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("kind", ["even", "clustered", "norms"])
def test_nearest_recall_and_share(spark, kind, monkeypatch):
    g = np.random.default_rng(4)
    n = 20_000 if kind == "even" else 4_000
    x = g.normal(size=(n, 32))
    if kind == "clustered":
        x = g.normal(size=(40, 32))[g.integers(0, 40, n)] * 3 + 0.3 * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "norms":
        x *= g.uniform(0.1, 3, n)[:, None]
    layouts = []
    fitted = nearest.fitted
    monkeypatch.setattr(nearest, "fitted", lambda *a: layouts.append(fitted(*a)) or layouts[-1])
    got = nearest_of(spark, x, every=100)
    hits = total = 0
    for q in range(0, n, 100):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.argsort(-score, kind="stable")[:20]
        assert [a for a, _, _ in got[q]] == list(range(1, 21)) and all(s == pytest.approx(score[v]) for _, v, s in got[q])
        hits, total = hits + len(set(best.tolist()) & {v for _, v, _ in got[q]}), total + 20
    assert hits >= 0.9 * total
    if kind == "even":  # far from all is opened
        assert nearest.TABLES * layouts[0][1] / np.prod(layouts[0][0]) < 0.5


def test_nearest_ties_repeats_and_several_vectors(spark):
    a, b, c = [1.0, 0.0], [0.8, 0.1], [0.0, 1.0]
    x = np.array([a, a, a, b, b, c, a, c])
    got = nearest_of(spark, x, np.array([0, 5, 3, 7, 2, 9, 5, 2]), k=3)
    assert [(r, v) for r, v, _ in got[0]] == [(1, 3), (2, 5), (3, 2)] and got[0][2][2] == pytest.approx(0.8)
    few = nearest_of(spark, x[:2], np.array([0, 1]), k=3)
    assert [(r, v) for r, v, _ in few[0]] == [(1, 1)] and nearest_of(spark, x[:1], np.array([0]), k=3) == {}
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.search(df, df.select(F.col("vec_id").alias("query_id"))).count() == 0


def test_nearest_in_parts_and_exactly(spark, monkeypatch):
    """Slots that are split, and queries for which the tables find too little, give the same as brute force."""
    g = np.random.default_rng(5)
    x = g.normal(size=(600, 8))
    for name, value in (("BLOCK", 16), ("GROUP", 64), ("DEALT", 50)):
        monkeypatch.setattr(nearest, name, value)
    monkeypatch.setattr(nearest, "fitted", lambda *a: ((4,), 4))  # all buckets: nothing may be lost
    split = nearest_of(spark, x)
    monkeypatch.setattr(nearest, "fitted", lambda *a: ((32, 32), 1))
    monkeypatch.setattr(nearest, "EXACT_BLOCK", 7)
    sparse = nearest_of(spark, x, k=590)
    for q in range(0, 600, 20):
        order = [v for v in np.argsort(-(x @ x[q]), kind="stable").tolist() if v != q]
        assert [v for _, v, _ in split[q]] == order[:20] and [v for _, v, _ in sparse[q]] == order[:590]


# --- 6: token counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_go_to_sections_by_the_rule(spark, rule):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(token_counts.VOCABULARY, "rb").read().splitlines() if x)}
    coding = tiktoken.Encoding("test", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "One line\n\n\n  and another, tiếng Việt\n", "head  ", "s"), (2, None, "only", "s"), (3, "x" * 5000 + "\n" + "y " * 50, "", "s"), (4, "", None, "s"), (5, "a\n b\n  c", "z\n", "s")]
    for by_line in (True, False):
        out = token_counts.count_tokens(docs(spark, rows), fields=("lang", "text"), joint="\n", by_line=by_line, rule=rule).collect()
        for i, text, lang, _ in rows:
            whole = (lang or "") + "\n" + (text or "")
            own = sorted((x for x in out if x.doc_id == i), key=lambda x: x.section)
            assert own[0].start_char == 0 and own[-1].end_char == len(whole) and all(a.end_char == b.start_char for a, b in zip(own, own[1:], strict=False))
            bounds = [(len(whole[: x.start_char].encode()), len(whole[: x.end_char].encode())) for x in own]
            want, at = [0.0] * len(own), 0
            for token in coding.encode_ordinary(whole):
                end = at + len(coding.decode_single_token_bytes(token))
                shares = [max(0, min(end, b) - max(at, a)) for a, b in bounds]
                if rule == "first":
                    want[next(k for k, s in enumerate(shares) if s)] += 1
                elif rule == "last":
                    want[max(k for k, s in enumerate(shares) if s)] += 1
                elif rule == "most":
                    want[shares.index(max(shares))] += 1
                else:
                    want = [w + s / (end - at) for w, s in zip(want, shares, strict=True)]
                at = end
            assert [x.n_tokens for x in own] == pytest.approx(want) and {x.doc_tokens for x in own} == {len(coding.encode_ordinary(whole))}


# --- 7: quality


def test_posteriors_are_those_of_the_site_without_the_document(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["good", "words", "here", "!!", "##"]) for _ in range(r.randrange(40))), r.choice(["x", "y", None]), r.choice("abcd")) for i in range(300)] + [(7, "repeated id", "x", "a"), (None, "no id", "x", "a")]
    labels = [(i, int("!!" not in rows[i][1])) for i in range(0, 300, 3)] + [(0, 1), (3, None), (None, 1)]
    got = quality.classify(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"), keep=("text", "source", "lang")).collect()
    assert len(got) == len(rows)
    told = defaultdict(list)
    for i, y in labels:
        if i is not None and y is not None:
            told[i].append(y)
    y = [np.mean(told[x.doc_id]) if x.doc_id in told else x.own_score for x in got]
    path, host = defaultdict(list), defaultdict(list)
    for x, v in zip(got, y, strict=True):
        path[x.source, x.lang].append(v)
        host[x.source].append(v)
    n, s = len(y), sum(y)

    def strength(sites):
        m = s / n
        total, squares = sum(map(len, sites)), sum(len(v) ** 2 for v in sites)
        between = sum(len(v) * (np.mean(v) - m) ** 2 for v in sites)
        spread = (between - (len(sites) - 1) * m * (1 - m)) / (total - squares / total)
        return min(1e4, max(1, m * (1 - m) / spread - 1)) if spread > 0 else 1e4

    of_host, of_path = strength(list(host.values())), strength(list(path.values()))
    odds = lambda p: math.log(p / (1 - p))
    for x, v in zip(got, y, strict=True):
        mean = (s - v) / (n - 1)
        h = (sum(host[x.source]) - v + of_host * mean) / (len(host[x.source]) - 1 + of_host)
        p = (sum(path[x.source, x.lang]) - v + of_path * h) / (len(path[x.source, x.lang]) - 1 + of_path)
        assert (x.host_posterior, x.path_posterior) == pytest.approx((h, p), abs=2e-4)
        assert x.score == pytest.approx(1 / (1 + math.exp(-(odds(x.own_score) + odds(p) - odds(mean)))), abs=1e-3) and x.good == (x.score >= 0.5)


def test_quality_of_labels_that_were_held_out(spark):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet").where("quality is not null")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    table = spark.read.parquet(f"{data}/documents.parquet")
    out = quality.classify(table, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    good, bad = ([x.score for x in out if x.quality == q] for q in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) > 0.8
    long = [(1, "word " * 300_000, "l", "s"), (2, None, None, None)]
    assert quality.classify(docs(spark, long), labels).count() == 2


# --- 8: archives


def test_records_of_repeated_pages_have_ids_of_their_own(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 200)] * 3 + [(2, None, "x" * 200), (None, "u", None)], "page_id long, url string, html string").repartition(2)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", date="2024-05-06T07:08:09Z")
    rows = manifest.collect()
    assert len({r.record_id for r in rows}) == 5 and all(r.record_id.startswith("urn:uuid:") for r in rows)
    back = warc.read_archives(manifest, f"file://{tmp_path}/w").collect()
    assert sorted((str(x.page_id), x.record_type, x.refers_to) for x in back if x.page_id == 2) == [("2", "revisit", 1)]
    record = warc.fetch(spark, manifest, f"file://{tmp_path}/w", spark.createDataFrame([(2,)], "page_id long")).first().record
    assert b"WARC-Date: 2024-05-06T07:08:09Z" in record


# --- 9: urls


def test_judged_urls_of_every_form(spark):
    urls = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.NET/en/x?y#z"), (4, "x://sub.example.com/de/"), (5, "http://example.com"), (6, "http://net/"), (7, "http://evilnet/"), (8, "http://a.org/fr/?q"), (8, "http://a.org/fr/?q"), (9, "a://b://c/d"), (None, "http://h.net?x"), (10, "")]
    pages = spark.createDataFrame([(i, u, "l", "v") for i, u in urls], "page_id long, url string, label string, verdict string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = [(x.page_id, x.host, x.path, x.rule, x.verdict) for x in url_reputation.judge_urls(pages, none).collect()]
    assert Counter(got) == Counter([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.net", "/en/x", "example.net/en/", "allow"), (4, "sub.example.com", "/de/", "example.com/de/", "block"), (5, "example.com", "", None, "allow"),
        (6, "net", "/", "net/", "block"), (7, "evilnet", "/", None, "allow"), (8, "a.org", "/fr/", "org/fr/", "allow"), (8, "a.org", "/fr/", "org/fr/", "allow"), (9, "b:", "//c/d", None, "allow"), (None, "h.net", "", None, "allow"), (10, "", "", None, "allow"),
    ])
    assert url_reputation.judge_urls(pages.where(F.lit(False)), none).count() == 0
    tied = url_reputation.judge_urls(pages.where("page_id = 8"), none, rules=(("block", "org", "/fr/"), ("allow", "a.org", "/f"))).first()
    assert tied.rule in ("org/fr/", "a.org/f") and len(tied.rule) == 7


def test_public_suffixes_part_owners(spark):
    bad = [(i, f"http://h{i % 3}.a.co.uk/", 1) for i in range(30)] + [(30, "http://b.co.uk/", 0)] + [(100 + i, f"http://d{i}.org.uk/", i % 2) for i in range(40)] + [(200 + i, f"http://e{i}.co.uk/", 0) for i in range(20)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in bad], "page_id long, url string")
    found = url_reputation.judge_urls(pages, spark.createDataFrame([(i, b) for i, _, b in bad], "page_id long, bad int"), rules=())
    got = {x.host: x for x in found.collect()}
    assert got["h1.a.co.uk"].verdict == "block" and got["b.co.uk"].verdict == "allow" and got["b.co.uk"].bad_share < 0.5
    split = spark.createDataFrame([("x.y.co.uk",), ("co.uk",), ("uk",), ("a.b.c.com",), ("myco.uk",)], "host string").select("host", *[c.alias(n) for c, n in zip(url_reputation.sites(F.col("host"), url_reputation.PUBLIC_SUFFIXES), ("domain", "suffix"), strict=True)])
    assert {x.host: (x.domain, x.suffix) for x in split.collect()} == {"x.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "uk": ("uk", "uk"), "a.b.c.com": ("c.com", "com"), "myco.uk": ("myco.uk", "uk")}


@pytest.mark.parametrize(("a", "b", "limit"), [(8, 2, 0.5), (0.4, 0.7, 0.5), (300, 280, 0.5), (3, 40, 0.1), (0.05, 5, 0.5)])
def test_beta_tail(spark, a, b, limit):
    x = np.random.default_rng(1).beta(a, b, 400_000)
    mean, var = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
    got = spark.range(1).select(url_reputation.above(F.lit(float(mean)), F.lit(float(var)), limit).alias("p")).first().p
    assert got == pytest.approx((x > limit).mean(), abs=4e-3)


# --- 10: Jaccard join


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_unrelated_sets_share_no_token(percent):
    g = np.random.default_rng(7)
    for n in (5, 20, 100, 600):
        grams = np.concatenate([np.unique(g.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(300)])
        token, _ = jaccard_join.tokens(grams, np.arange(301) * n, percent)
        assert len(np.unique(token)) == len(token)


def test_hot_tokens_and_large_families_lose_no_link(spark, monkeypatch):
    for name, value in (("ROWS_AT_ONCE", 20), ("GROUP", 8), ("LISTED", 15)):
        monkeypatch.setattr(jaccard_join, name, value)
    texts = family(1, 150, 80, 5) + family(2, 90, 40, 3) + [" ".join(f"u{i}-{j}" for j in range(30)) for i in range(20)] + ["word " * 50_000, "word " * 50_000 + "end"]
    rows = list(enumerate(texts))
    random.Random(2).shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs(spark, [(i, t, "l", "s") for i, t in rows]).repartition(4), shingle_words=5, percent=80).collect()}
    assert got == components_of(rows, 5, 80)


def test_an_id_with_several_texts_keeps_all_its_links(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    rows = [(1, one, "l", "s"), (5, one, "l", "s"), (5, two, "l", "s"), (9, two + " more", "l", "s"), (3, three, "l", "s")]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_join(docs(spark, rows), shingle_words=5, percent=80).collect()}
    assert got == {(1, 1), (5, 1), (9, 1), (3, 3)}


# --- pipeline


def tables_at(spark, place, rows, labels=(), items=()):
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    docs(spark, rows).write.parquet(f"{place}/documents.parquet")
    return spark.read.parquet(f"{place}/documents.parquet")


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(9)
    place = f"file://{tmp_path}"
    words = lambda n: " ".join(f"word{r.randrange(3000)}" for _ in range(n))
    texts = family(3, 20, 70, 3) + [words(60) for _ in range(40)] + ["", None, "!!! ???"]
    item = words(30)
    texts += [words(20) + " " + item + " " + words(20), item]
    rows = [(i, t, "en", r.choice("ab")) for i, t in enumerate(texts)] + [(0, words(60), "en", "a"), (None, words(60), "en", "a"), (None, None, None, None)]
    table = tables_at(spark, place, rows, [(i, 1) for i in range(0, 40, 3)] + [(i, 0) for i in (1, 4)], [(1, item)])
    stages = dict(corpus_pipeline.STAGES)
    key = lambda x: (str(x.doc_id), x.text)
    whole = Counter(map(key, table.collect()))
    # near duplicates: one of each component, every row of its own text
    kept = Counter(map(key, stages["near_duplicates"](spark, table, place).collect()))
    of = components_of(list(enumerate(t for _, t, _, _ in rows)), 5, 80)
    groups = defaultdict(set)
    for n, (_, group) in of.items():
        groups[group].add((str(rows[n][0]), rows[n][1]))
    assert not kept - whole and sum(kept.values()) == len(groups) and all(sum(kept[k] for k in g) == 1 for g in groups.values())
    # contamination: rows whose id has a passage go
    kept = stages["decontaminate"](spark, table, place).collect()
    assert {x.doc_id for x in kept} == {i for i, t, _, _ in rows if item not in (t or "")} | {None} and len(kept) == len(rows) - 2
    # language and quality: by their operators' own decisions
    langs, matrix = language_id.train(table, "doc_id", "text", "lang")
    told = {x.text: x for x in language_id.predict(table, langs, matrix, "doc_id", "text", text=True).collect()}
    kept = Counter(map(key, stages["language"](spark, table, place).collect()))
    assert kept == Counter({k: n for k, n in whole.items() if told[k[1]].lang_pred != "und" and told[k[1]].score >= corpus_pipeline.LEAST_LANGUAGE_SCORE})
    judged = quality.classify(table, spark.read.parquet(f"{place}/labels.parquet"), keep=("text",)).where("good").collect()
    assert Counter(map(key, stages["quality"](spark, table, place).collect())) == Counter(map(key, judged))
    # the mix: rows as often as they are taken
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    out = stages["mix"](spark, table, place).collect()
    want = Counter()
    for x in mixing.mix(table).collect():
        want[str(x.doc_id), x.size] += x.copies
    assert Counter((str(x.doc_id), size(x.text)) for x in out) == +want


def test_pipeline_over_empty_tables(spark, tmp_path):
    place = f"file://{tmp_path}"
    tables_at(spark, place, [])
    out = corpus_pipeline.run(spark, place)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
