"""Quality classifier: evidence of a document's own text, and hierarchical empirical-Bayes posteriors of its host and path.

A logistic regression on a few measures of the text gives each document a probability of being good. What is known of a site's documents, their
labels or else these probabilities, is summed per path, host and in all; beta posteriors shrink a path toward its host and a host toward the whole, by
strengths that fit the spread between sites (method of moments). A document is left out of the sums that it is judged by, so its own evidence counts
once: the odds of its path, relative to the whole's, multiply its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .words import buffers, pieces, words

#: About as many labelled rows are fetched at most to fit the regression, chosen by a hash of the id.
MOST_TRAINING_ROWS = 50_000
#: Labels and sites (some 20 and 60 bytes each) that may be broadcast; more are joined by shuffle.
BROADCAST_LABELS, BROADCAST_SITES = 500_000, 200_000
MEASURES = ("log_words", "distinct", "repeated", "word_bytes", "symbols", "digits", "capitals", "lines", "top_word", "bare_marks")
_KIND = np.zeros(256, np.int64)
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_KIND[[ord(c) for c in ".,'-"]] = 0
_KIND[48:58], _KIND[65:91], _KIND[10] = 2, 3, 4


def measures(texts: pa.Array) -> np.ndarray:
    """A row of MEASURES per text, from the whole of it; all 0 for null, empty and blank texts."""
    data, bounds = buffers(texts)
    hashes, offsets, starts, ends = words(texts)
    n, size = np.diff(offsets), np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), len(MEASURES)))
    some, many = np.maximum(n, 1), np.maximum(size, 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[1:] != doc[:-1])
    runs = np.flatnonzero(new)
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, doc[runs], np.diff(np.append(runs, len(order))))
    kinds = [np.concatenate([[0], np.cumsum(_KIND[data] == k)]) for k in range(1, 5)]
    share = [(k[bounds[1:]] - k[bounds[:-1]]) / many for k in kinds]
    marks = kinds[0][ends] - kinds[0][starts] == ends - starts
    out[:, 0] = np.log1p(n)
    out[:, 1] = np.bincount(doc[runs], minlength=len(n)) / some
    out[:, 2] = np.bincount(doc, same, len(n)) / some
    out[:, 3] = np.bincount(doc, ends - starts, len(n)) / some
    out[:, 4], out[:, 5], out[:, 6], out[:, 7] = share
    out[:, 8] = longest / some
    out[:, 9] = np.bincount(doc, marks, len(n)) / some
    out[n == 0] = 0
    return out


def measured(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with a column __m, array of MEASURES."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in pieces(batch.column(text_col)):
                rows = batch.slice(low, high - low)
                m = measures(rows.column(text_col))
                arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * len(MEASURES)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([*rows.columns, arrays], names=[*rows.schema.names, "__m"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(add, f"{fields}, __m array<double>")


def fit(rows: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the constant first) of a ridge logistic regression by Newton's method."""
    mean, scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-9)
    x = np.hstack([np.ones((len(rows), 1)), np.clip((rows - mean) / scale, -8, 8)])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[1.0] * rows.shape[1]])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (good - p) - ridge @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def probability(model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Column:
    """The document's own probability, as an expression on __m."""
    mean, scale, w = (x.tolist() for x in model)
    total = F.lit(w[0])
    for i in range(len(mean)):
        total = total + F.lit(w[i + 1]) * F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col("__m")[i] - mean[i]) / scale[i]))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def strength(sums: DataFrame, mean: float) -> float:
    """Pseudo-documents that the level above lends, from the spread of the means of (n, s) between sites; between 1 and 10,000."""
    k, total, squares, between = sums.agg(F.count("*"), F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n")), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2))).first()
    noise = mean * (1 - mean)
    if not k or k < 2 or total - squares / total <= 0:
        return 10_000.0
    spread = (between - (k - 1) * noise) / (total - squares / total)
    return float(min(10_000.0, max(1.0, noise / spread - 1))) if spread > 0 else 10_000.0


def site_sums(known: DataFrame) -> tuple[DataFrame, float, float, float, float]:
    """((host, path, n, s of the path, host_n, host_s), n and s of the whole, strengths of host and path) from rows (host, path, y), by partial aggregation."""
    paths = tables.written(known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    n, s = paths.agg(F.sum("n"), F.sum("s")).first()
    n, s = float(n or 0), float(s or 0)
    mean = min(1 - 1e-6, max(1e-6, s / n)) if n else 0.5
    of_host, of_path = strength(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s")), mean), strength(paths, mean)
    out = paths.alias("x").join(hosts.alias("y"), F.col("x.host").eqNullSafe(F.col("y.host"))).select("x.host", "path", "n", "s", "host_n", "host_s")
    return out, n, s, of_host, of_path


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_id: str = "doc_id", label_col: str = "quality", keep: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """A row per document: (doc_id, *keep, own_score, host_posterior, path_posterior, score, good).

    label_col is 1 for good documents, 0 for others; null labels and unlabelled documents are not learnt from; of repeated labels of a document
    all are learnt from, and their mean is what its site knows of it. Without two classes of labels every document has the same own score, the share
    of good labels (0.5 without labels). Posteriors are those of the document's site without the document. Null hosts and paths are sites of
    their own. Null, empty and blank texts measure as 0 throughout. Repeated documents count and are returned each. An empty table gives an empty
    result. score >= threshold is good. Extra columns are ignored, whatever their names.

    Whole texts are measured once; the measures, with the columns to keep, are a table in the shared folder.
    """
    text = f"__k{keep.index(text_col)}" if text_col in keep else "__text"
    own = [F.col(id_col).alias("__id"), F.col(host_col).alias("__host"), F.col(path_col).alias("__path"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)]]
    chosen = docs.select(*own, *([] if text_col in keep else [F.col(text_col).alias("__text")]))
    measured_ = measured(chosen, text)
    measured_ = tables.written(measured_ if text_col in keep else measured_.drop("__text"), "measures")
    known = labels.select(F.col(label_id).alias("__id"), F.col(label_col).cast("int").alias("good")).where("__id is not null and good is not null")
    train = measured_.join(known, "__id").select("__id", "__m", "good")
    part = min(1.0, MOST_TRAINING_ROWS / max(1, known.count()))
    sample = train.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < math.ceil(part * (1 << 20))).orderBy("__id", "good", "__m").limit(2 * MOST_TRAINING_ROWS).toArrow()
    good = sample.column("good").to_numpy().astype(float)
    if 0 < good.sum() < len(good):
        model = fit(np.array(sample.column("__m").to_pylist(), float), good)
    else:
        base = good.mean() if len(good) else 0.5
        model = (np.zeros(len(MEASURES)), np.ones(len(MEASURES)), np.array([math.log(max(base, 1e-6) / max(1 - base, 1e-6)), *[0.0] * len(MEASURES)]))
    told = tables.small_or_not(tables.written(known.groupBy("__id").agg(F.avg("good").alias("__label")), "labels"), BROADCAST_LABELS)
    scored = measured_.join(told, "__id", "left").withColumn("own_score", probability(model)).withColumn("__y", F.coalesce("__label", "own_score"))
    sites, n, s, of_host, of_path = site_sums(scored.select(F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__y").alias("y")))
    sites = tables.small_or_not(tables.written(sites, "sites"), BROADCAST_SITES)
    same = F.col("__host").eqNullSafe(F.col("host")) & F.col("__path").eqNullSafe(F.col("path"))
    y, one = F.col("__y"), F.lit(1.0)
    mean = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), (F.lit(s) - y) / (n - 1))) if n > 1 else F.lit(0.5)
    host = (F.col("host_s") - y + of_host * mean) / (F.col("host_n") - one + of_host)
    path = (F.col("s") - y + of_path * F.col("host_posterior")) / (F.col("n") - one + of_path)
    odds = lambda p: F.log(F.greatest(F.lit(1e-9), p) / F.greatest(F.lit(1e-9), 1 - p))
    total = odds(F.col("own_score")) + odds(F.col("path_posterior")) - odds(mean)
    out = scored.join(sites, same, "left").withColumn("host_posterior", host).withColumn("path_posterior", path).withColumn("score", F.round(1 / (1 + F.exp(-total)), 6))
    kept = [F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(F.col("__id").alias(id_col), *kept, *[F.round(c, 6).alias(c) for c in ("own_score", "host_posterior", "path_posterior")], "score", (F.col("score") >= threshold).alias("good"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents; the source stands for the host, the language for the path."""
    return classify(tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "labels"))


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
