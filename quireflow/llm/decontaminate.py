"""Benchmark decontamination: n-gram seeds find training passages, Smith-Waterman alignment scores them.

Two passes over the documents, neither of which shuffles text. The first counts how often every benchmark n-gram occurs in the corpus. The
second finds n-grams in each document, opens the passage around them and aligns it with the item word by word. Every n-gram is a seed: an
edited copy may have kept none but frequent ones. Passages without a rare n-gram are only aligned if they have enough of the item's words to
reach the least score at all, which loses none. Items of more than SEGMENT words are aligned segment by segment, so the work grows with their
length and not with its square. Items too short for a seed are looked for as whole documents.

The benchmark is the query set: it is dealt into blocks of a bounded number of words, and each block is sent to the executors and held
against all documents. A larger benchmark means more blocks, never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .words import MARKS, pieces, shingles, words

#: Words of benchmark text sent to the executors at once (8 bytes each, and as much again for the n-grams).
BLOCK_WORDS = 1_000_000
MATCH, MISS = 2, 1
#: Words of an item that are aligned in one piece; longer items are split evenly.
SEGMENT = 2_000


class Block:
    """Some benchmark items as word hashes, in segments, with the n-grams of these sorted; rare marks those that are rare in the corpus."""

    def __init__(self, texts: list[str], n: int):
        self.n = n
        self.words, bounds, _, _ = words(pa.array(texts, pa.large_string()), MARKS)
        self.sizes = np.diff(bounds)
        parts = np.maximum(1, -(-self.sizes // SEGMENT))
        self.item = np.repeat(np.arange(len(texts)), parts)
        number = np.arange(len(self.item)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.offsets = np.append(bounds[:-1][self.item] + self.sizes[self.item] * number // parts[self.item], bounds[-1])
        grams, offsets = shingles(self.words, self.offsets, n)
        order = np.argsort(grams, kind="stable")
        self.grams = grams[order]
        self.segment = np.repeat(np.arange(len(self.item)), np.diff(offsets))[order]
        self.place = (np.arange(len(grams)) - np.repeat(offsets[:-1], np.diff(offsets)))[order]
        self.unique, self.first = np.unique(self.grams, return_index=True)
        self.first = np.append(self.first, len(self.grams))
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.unique >> np.uint64(42)).astype(np.int64)] = True
        self.rare = np.ones(len(self.grams), bool)
        self.short: dict[bytes, list[int]] = {}
        for i in np.flatnonzero((self.sizes > 0) & (self.sizes < n)).tolist():
            self.short.setdefault(self.words[bounds[i] : bounds[i + 1]].tobytes(), []).append(i)

    def found(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in grams, index in unique) of those that the block has."""
        at = np.flatnonzero(self.filter[(grams >> np.uint64(42)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.unique, grams[at]), max(0, len(self.unique) - 1))
        same = self.unique[k] == grams[at] if len(self.unique) else np.zeros(len(at), bool)
        return at[same], k[same]

    def mark_rare(self, counts: np.ndarray, most: float) -> None:
        """Rare n-grams have at most so many occurrences in the corpus."""
        self.rare = counts[np.searchsorted(self.unique, self.grams)] <= most if len(self.unique) else np.zeros(0, bool)


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smith-Waterman over words (match 2, mismatch and gap -1) of (item, passage) pairs, as a share of the item's best possible score."""
    out = np.zeros(len(pairs))
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    low = 0
    while low < len(order):
        high, wide = low + 1, len(pairs[order[low]][1])
        while high < len(order) and (high - low + 1) * max(wide, len(pairs[order[high]][1])) <= 1 << 18 and len(pairs[order[high]][0]) <= 1.3 * len(pairs[order[low]][0]) + 8:
            wide = max(wide, len(pairs[order[high]][1]))
            high += 1
        chosen = [pairs[i] for i in order[low:high]]
        item = np.zeros((len(chosen), max(len(a) for a, _ in chosen)), np.uint64)
        has = np.zeros(item.shape, bool)
        text = np.zeros((len(chosen), wide), np.uint64)
        there = np.zeros(text.shape, bool)
        for r, (a, b) in enumerate(chosen):
            item[r, : len(a)], has[r, : len(a)], text[r, : len(b)], there[r, : len(b)] = a, True, b, True
        column = np.arange(wide, dtype=np.int32)
        last = np.zeros((len(chosen), wide + 1), np.int32)
        best = np.zeros(len(chosen), np.int32)
        for i in range(item.shape[1]):
            same = (item[:, i, None] == text) & there & has[:, i, None]
            row = np.maximum(last[:, :-1] + np.where(same, MATCH, -MISS), last[:, 1:] - MISS)
            row = np.maximum.accumulate(np.maximum(row, 0) + column * MISS, axis=1) - column * MISS
            best = np.maximum(best, row.max(axis=1))
            last[:, 1:] = row
        out[order[low:high]] = best / (MATCH * np.array([max(1, len(a)) for a, _ in chosen]))
        low = high
    return out


def passages(block: Block, hashes: np.ndarray, offsets: np.ndarray, least: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, segment, first and last word of the passage within the document, seeds in it) around seeds on about one diagonal.

    An alignment scores at most the share of the item's words that the passage has; passages without rare seeds where this is under least are left
    out. A segment of a longer item says nothing of the whole, so none of these is.
    """
    grams, gram_offsets = shingles(hashes, offsets, block.n)
    at, k = block.found(grams)
    counts = block.first[k + 1] - block.first[k]
    entry = np.repeat(block.first[k] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    at = np.repeat(at, counts)
    doc = np.searchsorted(gram_offsets, at, "right") - 1
    segment, diagonal = block.segment[entry], at - gram_offsets[doc] - block.place[entry]
    order = np.lexsort((diagonal, segment, doc))
    doc, segment, diagonal, rare = doc[order], segment[order], diagonal[order], block.rare[entry[order]]
    size = np.diff(block.offsets)[segment]
    apart = np.ones(len(doc), bool)
    apart[1:] = (doc[1:] != doc[:-1]) | (segment[1:] != segment[:-1]) | (diagonal[1:] - diagonal[:-1] > size[1:] // 4 + 2)
    starts = np.flatnonzero(apart)
    sure = np.logical_or.reduceat(rare, starts) if len(starts) else starts
    for a, b, some in zip(starts, np.append(starts, len(doc))[1:], sure, strict=True):
        slack = int(size[a]) // 3 + 4
        low, high = max(0, int(diagonal[a]) - slack), int(diagonal[b - 1] + size[a]) + slack
        if not some and size[a] == block.sizes[block.item[segment[a]]]:
            own = block.words[block.offsets[segment[a]] : block.offsets[segment[a] + 1]]
            if np.isin(own, hashes[offsets[doc[a]] : offsets[doc[a] + 1]][low:high]).sum() / len(own) < least:
                continue
        yield int(doc[a]), int(segment[a]), low, high, int(b - a)


def matches(block: Block, hashes: np.ndarray, offsets: np.ndarray, least: float) -> list[tuple[int, int, float, int, int, int]]:
    """(document, item, score, seeds, first and last word of the passage) of all that reach the least score, by document and item."""
    found = list(passages(block, hashes, offsets, least))
    scores = align([(block.words[block.offsets[g] : block.offsets[g + 1]], hashes[offsets[d] : offsets[d + 1]][f:t]) for d, g, f, t, _ in found])
    best: dict = {}
    for (d, g, f, t, seeds), score in zip(found, scores, strict=True):
        if (-score, f) < best.get((d, g), (1, 0))[:2]:
            best[d, g] = (-score, f, min(t, int(offsets[d + 1] - offsets[d])), seeds)
    whole: dict = {}
    for (d, g), (score, f, t, seeds) in sorted(best.items()):
        i = int(block.item[g])
        share = -score * int(block.offsets[g + 1] - block.offsets[g]) / int(block.sizes[i])
        s, n, low, high = whole.get((d, i), (0.0, 0, f, t))
        whole[d, i] = (s + share, n + seeds, min(low, f), max(high, t))
    if block.short:
        few = np.diff(offsets)
        for d in np.flatnonzero((few > 0) & (few < block.n)).tolist():
            for i in block.short.get(hashes[offsets[d] : offsets[d + 1]].tobytes(), ()):
                whole[d, i] = (1.0, 0, 0, int(few[d]))
    return [(d, i, round(s, 6), n, f, t) for (d, i), (s, n, f, t) in sorted(whole.items()) if s >= least]


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", seed_words: int = 4, rare_share: float = 1e-3, min_score: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per document and benchmark item with an aligned passage: (doc_id, item_id, score, seeds, passage_from, passage_to).

    score is the best local alignment's share of the item's own score (1: the whole item stands there word for word); rows under min_score
    are left out. Of an item of more than SEGMENT words, it is the sum over its segments. Words are maximal runs other than ASCII white space and
    punctuation, A-Z as a-z. seeds counts the n-grams that led to the passage; passage_from and passage_to are its bounds in words. Several
    passages of an item in a document give the best one, of equally good ones the first.

    Null and empty texts match nothing. Items of fewer than seed_words words match documents that consist of them alone, with score 1 and no seed. A
    passage that has not kept seed_words words of the item in a row matches nothing, as one with every fourth word changed, though it may score 0.6.
    Repeated documents or items each get their rows; null ids stay null. Empty tables give no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, score double, seeds int, passage_from int, passage_to int"
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sized = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"), F.size(F.split(F.col(item_text), r"\s+")).cast("long").alias("n")).where(F.col("text").isNotNull())
    total, n_docs = sized.agg(F.sum("n")).first()[0] or 0, None
    n_blocks = -(-total // block_words)
    out = None
    for b in range(n_blocks):
        part = sized.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == b) if n_blocks > 1 else sized
        rows = part.select("item_id", "text").orderBy("text", "item_id").collect()  # about block_words words, by the number of blocks
        block = Block([r.text for r in rows], seed_words)
        ids = [r.item_id for r in rows]
        sent = spark.sparkContext.broadcast(block)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(sent.value.unique), np.int64)
            for batch in batches:
                for low, high in pieces(batch.column("text")):
                    hashes, offsets, _, _ = words(batch.column("text").slice(low, high - low), MARKS)
                    total += np.bincount(sent.value.found(shingles(hashes, offsets, sent.value.n)[0])[1], minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(at, pa.int64()), "n": pa.array(total[at])})

        counted = chosen.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        counts = np.zeros(len(block.unique), np.int64)
        for r in counted.toLocalIterator():  # at most a row for each n-gram of the block
            counts[r.gram] = r.n
        n_docs = chosen.count() if n_docs is None else n_docs
        block.mark_rare(counts, rare_share * n_docs)
        sent = spark.sparkContext.broadcast((block, ids))

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block, ids = sent.value
            for batch in batches:
                for low, high in pieces(batch.column("text")):
                    hashes, offsets, _, _ = words(batch.column("text").slice(low, high - low), MARKS)
                    found = matches(block, hashes, offsets, min_score)
                    if found:
                        d, i, score, seeds, first, last = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([low + x for x in d])), pa.array([ids[x] for x in i], ITEM), pa.array(score), *(pa.array(x, pa.int32()) for x in (seeds, first, last))], names=["doc_id", "item_id", "score", "seeds", "passage_from", "passage_to"])

        from pyspark.sql.pandas.types import to_arrow_type

        ITEM = to_arrow_type(items.schema[item_id].dataType)
        found = chosen.mapInArrow(match, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES: dict[str, str] = {}
