"""Alignment of the tokens of two tokenizers over the same bytes.

Neither tokenizer has a token that goes on past a single space between two other characters than white space, so both sides' tokens end before each such
space, and what lies between two of them is encoded alike wherever it stands. Such chunks are encoded once for many documents. The cumulative byte ends of a
chunk's two token rows are merged as by two pointers, many chunks at a time: every distinct end is one step, at which the token of either side that covers
the bytes before it are linked, and an end that both share closes a group. Documents are put together from their chunks. Spark counts in how many
documents each pair of ids is linked and joins the counts, and each side's highest, back to the links.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters encoded at a time; a longer text is taken alone, whole.
PIECE = 1 << 20
#: Pairs of ids that hold more than one of so many of all rows are broadcast; there cannot be more of them than this. Others are joined by shuffle.
HOT = 100_000
#: Distinct chunks, and characters of these, that a worker remembers before it begins anew.
KNOWN_CHUNKS, KNOWN_CHARACTERS = 300_000, 1 << 24
#: Bytes of new chunks that are encoded together.
TOGETHER = 1 << 16
SPLIT = re.compile(r"(?<=\S) (?=\S)")
_coders: dict[int, Coder] = {}


class Coder:
    """Both tokenizers with the bytes of every id, made once per Python worker."""

    def __init__(self, byte_level: bytes, pieces: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        own = byte_letters()
        entries = {i: x for x, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [b"".join(own.get(c) or c.encode() for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for x in [self.b.id_to_piece(i)]]
        self.size_a, self.size_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        # An id of A within a group, A's last, an id of B within a group, B's last: as written in `groups`.
        self.shown = [f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for end in ends for i in range(n)]
        # A token that goes on past a space after another character than white space would forbid to split there.
        self.splits = not any(re.search(r"\S ", x.decode(errors="replace")) for x in [*self.bytes_a, *self.bytes_b])
        self.forget()

    def forget(self) -> None:
        """Chunks known so far, by number: their groups as written, numbers of A tokens, B tokens and groups, and links from offset to offset."""
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 3), np.int64)
        self.offsets, self.left, self.right, self.characters = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.fresh: list[tuple] = []

    def chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the chunks of all texts on end, n + 1 offsets of the texts in these); new chunks are encoded, merged and remembered."""
        if len(self.known) > KNOWN_CHUNKS or self.characters > KNOWN_CHARACTERS:
            self.forget()
        rows = [(SPLIT.split(t) if self.splits else [t]) if t else [] for t in texts]
        parts, offsets = [x for row in rows for x in row], np.zeros(len(rows) + 1, np.int64)
        np.cumsum([*map(len, rows)], out=offsets[1:])
        new = [x for x in dict.fromkeys(parts) if x not in self.known]
        if new:
            self._learn(new)
            counts, links, left, right = zip(*self.fresh, strict=True)
            self.counts, self.left, self.right = np.concatenate([self.counts, *counts]), np.concatenate([self.left, *left]), np.concatenate([self.right, *right])
            self.offsets, self.fresh = np.append(self.offsets, self.offsets[-1] + np.cumsum(np.concatenate(links))), []
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts)), offsets

    def _learn(self, new: list[str]) -> None:
        alone = [x for x in new if x[0].isspace() or x[-1].isspace()] if self.splits else new
        joined = [x for x in new if not (x[0].isspace() or x[-1].isspace())] if self.splits else []
        self.known.update(zip([*joined, *alone], range(len(self.groups), len(self.groups) + len(new)), strict=True))
        self.characters += sum(map(len, new))
        sizes = np.fromiter((len(x.encode()) + 1 for x in joined), np.int64, len(joined))
        some = np.searchsorted(np.cumsum(sizes), np.arange(TOGETHER, sizes.sum() + TOGETHER, TOGETHER)).tolist() if joined else []
        for low, high in pairwise([0, *some]):
            if low < high:
                self._merge(joined[low:high], sizes[low:high])
        for x in alone:
            self._merge([x], np.array([len(x.encode()) + 1]))

    def _merge(self, new: list[str], sizes: np.ndarray) -> None:
        """Remembers chunks that are encoded together; one by one where some bytes differ, and a chunk whose own differ has no tokens."""
        a, b = self.encode(" ".join(new))
        if not len(a) and len(new) > 1:
            for x, size in zip(new, sizes, strict=True):
                self._merge([x], np.array([size]))
            return
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts, at_a, at_b, shared = merged(ends_a, ends_b)
        closed, bounds = cuts[shared], np.append(0, np.cumsum(sizes)) if len(a) else np.zeros(len(new) + 1, np.int64)
        of_a, of_b, of_link, of_group = (np.searchsorted(x, bounds, "right") for x in (ends_a, ends_b, cuts, closed))
        self.groups += _groups(self, a, b, np.searchsorted(closed, ends_a), np.searchsorted(closed, ends_b), of_a + of_b)
        self.fresh.append((np.diff([of_a, of_b, of_group]).T, np.diff(of_link), a[at_a], b[at_b]))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides, none where the bytes of either side are not those of space + text."""
        whole = f" {text}"
        sides = self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids, self.b.encode(text, num_threads=1)
        if not all(b"".join(map(own.__getitem__, ids)) == whole.encode() for own, ids in zip((self.bytes_a, self.bytes_b), sides, strict=True)):
            sides = [], []
        return np.array(sides[0], np.int64), np.array(sides[1], np.int64)


def byte_letters() -> dict[str, bytes]:
    """The letter by which a byte-level vocabulary writes each byte: printable Latin-1 as itself, the others from U+0100 in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in printable]
    return {chr(x): bytes([x]) for x in printable} | {chr(0x100 + k): bytes([x]) for k, x in enumerate(others)}


def coder(byte_level: bytes, pieces: bytes) -> Coder:
    key = hash((byte_level, pieces))
    if key not in _coders:
        _coders[key] = Coder(byte_level, pieces)
    return _coders[key]


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct ends of both sides in order, number of the A token and of the B token that cover the byte before each, whether both end there)."""
    ends = np.concatenate([ends_a, ends_b])
    ends.sort(kind="stable")  # two sorted runs: a merge
    first = np.ones(len(ends), bool)
    first[1:] = ends[1:] != ends[:-1]
    at = np.flatnonzero(first)
    cuts = ends[at]
    return cuts, np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts), np.diff(np.append(at, len(ends))) == 2


def _groups(c: Coder, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, offsets: np.ndarray) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` for each document, offsets counting the tokens of both sides."""
    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True)[: len(a)], np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
    kind = np.concatenate([a + len(c.bytes_a) * last_a, 2 * len(c.bytes_a) + b + len(c.bytes_b) * last_b])
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    parts = [*map(c.shown.__getitem__, kind[order].tolist())]
    return ["".join(parts[low:high])[:-1] for low, high in pairwise(offsets.tolist())]


def _aligned(c: Coder, texts: list[str], groups: bool) -> dict[str, list | np.ndarray]:
    """Columns of a row per text; pairs are distinct within a text, with the times that they are linked."""
    chunk, of = c.chunks(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(of))
    failed = np.zeros(n, bool)  # a chunk without tokens is one whose bytes differ, and so do the text's
    failed[doc[c.counts[chunk, 0] == 0]] = True
    chunk, doc = chunk[~failed[doc]], doc[~failed[doc]]
    of = np.searchsorted(doc, np.arange(n + 1))
    sums = np.stack([np.bincount(doc, c.counts[chunk, k], n) for k in range(3)]).astype(np.int64)
    shown = [";".join(map(c.groups.__getitem__, chunk[low:high].tolist())) for low, high in pairwise(of.tolist())]
    pair, times = np.unique(doc * len(c.groups) + chunk, return_counts=True)
    doc, chunk = pair // max(1, len(c.groups)), pair % max(1, len(c.groups))
    size = c.offsets[chunk + 1] - c.offsets[chunk]
    at = np.arange(size.sum()) + np.repeat(c.offsets[chunk] - (np.cumsum(size) - size), size)
    doc, times, left, right = np.repeat(doc, size), np.repeat(times, size), c.left[at], c.right[at]
    order = np.lexsort((right, left, doc))
    doc, times, left, right = doc[order], times[order], left[order], right[order]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    first = np.flatnonzero(new)
    n_links = np.bincount(doc, times, n).astype(np.int64)
    times = np.add.reduceat(times, first) if len(first) else times
    split = np.searchsorted(doc[first], np.arange(1, n))
    out = {
        "n_a": sums[0], "n_b": sums[1], "n_groups": sums[2], "n_links": n_links, "groups_sha256": [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in shown],
        "pair_a": np.split(left[first].astype(np.int32), split), "pair_b": np.split(right[first].astype(np.int32), split), "times": np.split(times.astype(np.int32), split),
    }
    return out | ({"groups": shown} if groups else {})


def align(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", groups: bool = True, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """A row per document: (doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pair_a, pair_b, times) and, if asked for, groups.

    groups has the ids of both sides between ends that both share, as `a1,a2|b1;a3|b2,b3`; groups_sha256 is its SHA-256, or empty. pair_a, pair_b and
    times are the distinct pairs of ids whose byte ranges overlap, and how often. Special tokens' strings in a text are plain text. A text that is null
    or empty, or whose bytes are not those of its tokens, has no tokens and zeros. Null and repeated ids and repeated rows keep a row each. An empty
    table gives no rows; extra columns are ignored. The two vocabulary files, some MB, must lie where the driver runs; they are sent to the executors.
    """
    sent = docs.sparkSession.sparkContext.broadcast((Path(byte_level).read_bytes(), Path(pieces).read_bytes()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(*sent.value)
        for frame in frames:
            texts = ["" if x is None else x for x in frame["text"]]
            low, sizes = 0, np.cumsum([0, *map(len, texts)])
            while low < len(texts):
                high = max(low + 1, int(np.searchsorted(sizes, sizes[low] + PIECE, "right")) - 1)
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[low:high].array} | _aligned(c, texts[low:high], groups))
                low = high

    kept = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ids = kept.schema["doc_id"].dataType.simpleString()
    if ids in ("tinyint", "smallint", "int", "bigint"):  # pandas would make floats of ids beside nulls
        kept = kept.withColumn("doc_id", F.col("doc_id").cast("string"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair_a array<int>, pair_b array<int>, times array<int>{', groups string' if groups else ''}"
    return kept.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(ids))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best_a, best_b): in how many documents a pair of ids is linked, and whether this is the highest count of its A id or of its B id, ties included."""
    pairs = aligned.select(F.inline(F.arrays_zip(F.col("pair_a").alias("a"), F.col("pair_b").alias("b"))))
    counts = tables.written(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), "pair-counts")
    most_a, most_b = (counts.groupBy(x).agg(F.max("n").alias(f"most_{x}")) for x in ("a", "b"))
    return counts.join(most_a, "a").join(most_b, "b").select("a", "b", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b"))


def link_scores(aligned: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """(key, n_best, count_sum) of documents with links: links whose count is the highest of their A id, and the sum of counts over links.

    Pairs that hold more than one in HOT of all rows, fewer than HOT by that, are broadcast. The others' rows are joined by shuffle, so that none of
    their pairs brings more than that share to one task.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * HOT > total)
    links = aligned.select(key, F.inline(F.arrays_zip(F.col("pair_a").alias("a"), F.col("pair_b").alias("b"), F.col("times"))))
    sums = lambda rows: rows.groupBy(key).agg(F.sum(F.when(F.col("best_a"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    rated = sums(links.join(F.broadcast(hot), ["a", "b"]))
    cold = counts.where(F.col("n") * HOT <= total)
    if not cold.isEmpty():
        rest = links.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti")
        rated = rated.unionByName(sums(rest.join(cold.hint("merge"), ["a", "b"])))
    return rated.groupBy(key).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the byte-level vocabulary of 50k entries (A) and the piece vocabulary of 32k (B)."""
    aligned = align(tables.read(spark, sf_dir, "documents"), groups=False).withColumn("row", F.monotonically_increasing_id())
    aligned = tables.written(aligned, "aligned")
    counts = tables.written(pair_counts(aligned), "pairs")
    scores = link_scores(aligned, counts, "row")
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return aligned.drop("pair_a", "pair_b", "times").join(scores, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256")


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLES: dict[str, str] = {}
