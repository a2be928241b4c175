"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every labelled text, per task in numpy and then by key in Spark; what is gathered has at most one number per
language and bucket. The log-probability matrix (buckets x languages) is broadcast, and whole texts are scored a batch at a time. Many languages are learnt and
scored in blocks, each with a matrix of its own, one after the other; a text carries on what it had so far, so the result is that of one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .words import pieces

#: A matrix has BUCKETS x languages 4-byte numbers, for MOST_LANGS languages at most.
BUCKETS, ORDERS, MOST_LANGS = 1 << 16, (1, 2, 3), 200
_FOLD: dict[int, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower-case form, or a space unless it is a letter; and whether it is a letter."""
    if not _FOLD:
        fold, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
                fold[c], letter[c] = ord(s.lower()) if len(s.lower()) == 1 else c, True
        _FOLD.update({0: fold, 1: letter})
    return _FOLD[0], _FOLD[1]


def grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(bucket of the n-gram that ends at each character, for each order; offsets of the texts in these; letters in each text).

    Letters count in lower case, all else as a space. Each text is read as if it stood between spaces, two of which end it, so n-grams never span two texts.
    """
    fold, letter = _tables()
    rows = texts.fill_null("").to_pylist()
    codes = np.frombuffer("  ".join(["", *rows, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(r) for r in rows], np.int64)
    starts = 2 + np.concatenate([[0], np.cumsum(sizes + 2)])[:-1]
    letters = np.concatenate([[0], np.cumsum(letter[codes])])
    offsets = np.append(starts, len(codes))
    low = fold[codes].astype(np.uint64)
    out, key = [], np.zeros(len(codes), np.uint64)
    for n in ORDERS:
        key = key * np.uint64(0x100000001B3) + (low if n == 1 else np.concatenate([np.full(n - 1, 32, np.uint64), low[: 1 - n]]))
        out.append((((key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1))
    return out, offsets, letters[starts + sizes] - letters[starts]


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], list[np.ndarray]]:
    """(languages by name; for each block of them, a matrix of log probabilities of buckets and, in its last row, of the languages themselves)."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    named = sorted(labelled.groupBy("lang").agg(F.count("*").alias("n")).collect())  # a row per language
    langs, share = [r.lang for r in named], np.array([r.n for r in named], float)
    blocks = [slice(a, a + MOST_LANGS) for a in range(0, len(langs), MOST_LANGS)]
    return langs, [_learnt(labelled if len(blocks) == 1 else labelled.where(F.col("lang").isin(langs[b])), langs[b], share[b] / share.sum()) for b in blocks]


def _learnt(labelled: DataFrame, langs: list[str], share: np.ndarray) -> np.ndarray:
    """The matrix of some languages, from their texts; share is that of each among all."""
    index = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(langs) * BUCKETS, np.int64)
        for batch in batches:
            for low, high in pieces(batch.column("text")):
                found, offsets, _ = grams(batch.column("text").slice(low, high - low))
                of = np.repeat([index[x] for x in batch.column("lang").slice(low, high - low).to_pylist()], np.diff(offsets)) * BUCKETS
                for g in found:
                    total += np.bincount(g[offsets[0] : offsets[-1]] + of, minlength=len(total))
        at = np.flatnonzero(total)
        for a in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 100_000]), pa.array(total[at[a : a + 100_000]])], names=["cell", "n"])

    counts = np.zeros(len(langs) * BUCKETS)
    gathered = labelled.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # languages x BUCKETS rows at most
    counts[gathered.column("cell").to_numpy()] = gathered.column("n").to_numpy()
    counts = counts.reshape(len(langs), BUCKETS).T + 0.5
    return np.vstack([np.log(counts / counts.sum(axis=0)), np.log(share)]).astype(np.float32)


def _sums(matrix: np.ndarray, found: list[np.ndarray], offsets: np.ndarray) -> np.ndarray:
    """What speaks for each language in each text, over the root of the number of its n-grams."""
    sums = np.tile(matrix[-1].astype(float), (len(offsets) - 1, 1))
    for g in found:
        for k in range(matrix.shape[1]):
            sums[:, k] += np.add.reduceat(matrix[:-1, k][g[: offsets[-1]]].astype(float), offsets[:-1])
    return sums / np.sqrt(np.maximum(1, np.diff(offsets)) * len(ORDERS))[:, None]


def _in_blocks(kept: DataFrame, langs: list[str], matrices: list[np.ndarray], shown: int) -> DataFrame:
    """predict() for several blocks of languages: a text has, after each, the best language so far, what speaks for it, and the sum of all so far as a multiple of its own."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    names, state = kept.columns, ["__place", "__most", "__sum", "__letters"]

    def carried(b: int):
        sent, first = kept.sparkSession.sparkContext.broadcast(matrices[b]), b * MOST_LANGS

        def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, high in pieces(batch.column("text")):
                    rows = batch.slice(low, high - low)
                    found, offsets, letters = grams(rows.column("text"))
                    sums = _sums(sent.value, found, offsets)
                    place, most = sums.argmax(axis=1) + first, sums.max(axis=1)
                    total = np.exp(sums - most[:, None]).sum(axis=1)
                    if b:
                        before, was, had = (rows.column(c).to_numpy() for c in state[:3])
                        top = np.maximum(was, most)
                        total, place, most = had * np.exp(was - top) + total * np.exp(most - top), np.where(most > was, place, before), top
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(place, pa.int64()), pa.array(most), pa.array(total), pa.array(letters, pa.int64())], names=[*names, *state])

        return carry

    for b in range(len(matrices)):
        kept = kept.mapInArrow(carried(b), f"{fields}, __place long, __most double, __sum double, __letters long")
    known = F.col("__letters") > 0
    pred = F.when(known, F.element_at(F.array(*map(F.lit, langs)), (F.col("__place") + 1).cast("int"))).otherwise("und")
    return kept.select(*[f"`{c}`" for c in names[:shown]], pred.alias("lang_pred"), F.when(known, F.round(1 / F.col("__sum"), 9)).otherwise(0.0).alias("score"))


def predict(docs: DataFrame, langs: list[str], matrices: list[np.ndarray], id_col: str, text_col: str, keep: tuple[str, ...] = (), text: bool = False) -> DataFrame:
    """(doc_id, *keep, text if asked for, lang_pred, score). score is the posterior under mean log probability per n-gram times the root of their number."""
    kept = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    shown = len(kept.columns) - (not text)
    if len(matrices) > 1:
        return _in_blocks(kept, langs, matrices, shown)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:shown])
    sent = docs.sparkSession.sparkContext.broadcast(matrices[0] if matrices else np.zeros((BUCKETS + 1, 0), np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = sent.value
        for batch in batches:
            for low, high in pieces(batch.column("text")):
                found, offsets, letters = grams(batch.column("text").slice(low, high - low))
                sums = _sums(matrix, found, offsets)
                part = np.exp(sums - sums.max(axis=1, initial=-np.inf, keepdims=True)) if langs else np.zeros((high - low, 0))
                best = part.argmax(axis=1) if langs else np.zeros(high - low, int)
                known = (letters > 0) & bool(langs)
                top = part[np.arange(high - low), best] / part.sum(axis=1) if langs else np.zeros(high - low)
                rows = batch.slice(low, high - low)
                pred = pa.array([langs[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns[:shown], pred, pa.array(np.where(known, np.round(top, 9), 0.0))], names=[*rows.schema.names[:shown], "lang_pred", "score"])

    return kept.mapInArrow(score, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """A row per document: (doc_id, held_out, lang_pred, score), learnt from the labelled documents that are not held out.

    Held out is who has crc32(id as text) mod folds = 0; ids, sources and labels are no input of a prediction. lang_pred is `und` with score 0 for null
    texts, texts without a letter, and where nothing could be learnt. Null labels are not learnt from; a null id is not held out and learnt from.
    Equal posteriors go to the language first by name. Repeated rows each count and get a row. Other columns are ignored, whatever their names.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held.alias("held_out"))
    langs, matrices = train(docs.where(~F.col("held_out")), "doc_id", "text", "lang")
    return predict(docs, langs, matrices, "doc_id", "text", ("held_out",))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(tables.read(spark, sf_dir, "documents"))


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
