"""Katz backoff language model of any order, with Good-Turing discounts and exactly normalised backoff weights, in stored tables.

P(w | h) = d(c) c / C(h) where the n-gram (h, w) was seen c times in training and its history h C(h) times, else alpha(h) P(w | shorter h), down to single
words. Discounts are Good-Turing's for counts up to KEPT; above, a count loses EPSILON, so that every history leaves something. What discounted words
leave is the probability of any unknown word. alpha(h) = (1 - sum of P(w | h) over the seen w) / (1 - sum of P(w | shorter h) over them).

An n-gram is a 64-bit hash of its history's hash and its word. Texts are encoded once, in parts of about PART_TOKENS tokens, those that are learnt from
and those that are held out apart. For each question that a part has, it sends every distinct n-gram once, to the target that owns its hash, and is
answered in the same order:

1. Counts, the longest n-grams first, a level at a time, so that only one level's messages are on their way. A target adds up what parts have counted in
   training, answers with the sums, and keeps them: the table of counts (level, hashes, counts). One of the parts that saw an n-gram is told to speak
   for it. A held-out part that was told that it has an unseen n-gram says so when it asks for its history, and all parts are told that this is wanted.
2. Weights. A part that speaks for n-grams sends what they add to their histories, to all or to those that are wanted. A target adds up, and keeps the
   table of weights (level, hashes of histories, log alpha). It answers where a text backs off.
3. Scores. Every token's probability is evaluated from the shortest history to the longest.

A frequent n-gram is one entry a part, so it is no more work for its target than a rare one. Targets grow in number with the tokens. The tables are partitioned
by kind and level, a row per target, sorted by hash; score() evaluates any other corpus from them in the same way.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .words import mix, pieces, words

#: Words of an n-gram; counts up to KEPT are discounted by Good-Turing; tokens of a target and of a part.
ORDER, KEPT, EPSILON, TARGET_TOKENS, PART_TOKENS = 3, 5, 1e-3, 1_500_000, 1_000_000
#: Parts move to their answers in so many rounds when they send what weights are made of.
ROUNDS = 2
#: Bits of an n-gram's hash that an entry carries beside those that name its target; a single word's is whole. Of TARGET_TOKENS n-grams any two share them with a chance of about 0.06.
BITS = 44
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: Kinds of rows: what a part asks, what it is answered, and what a target keeps.
ASK, ANSWER, KEEP = range(3)
_ROWS = "level int, target long, part long, kind int, body binary, types array<long>"
_PARTS = "part long, body binary, docs long, learnt long, tokens long"


def _planes(a: np.ndarray) -> tuple[str, bytes]:
    return a.dtype.str, np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes()


def _numbers(kind: str, value: bytes) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(value, np.uint8).reshape(wide, -1).T).reshape(-1).view(kind)


def _packed(a) -> tuple:
    if not isinstance(a, np.ndarray):
        return "", a
    if a.dtype == np.float64 and len(a):  # sums of a few discounts: every byte of a number would repeat which of them it is
        bits, codes = np.unique(np.ascontiguousarray(a).view(np.uint64), return_inverse=True)
        if len(bits) <= min(1 << 16, len(a) // 4):
            return "codes", (bits.tobytes(), *_planes(codes.astype(np.uint8 if len(bits) <= 256 else np.uint16)))
    return _planes(a)


def pack(*arrays) -> bytes:
    """Arrays of numbers, each as its lowest bytes, then its second lowest and so on, which compresses best; anything else as it is.

    Of fractions few of which are distinct, the distinct ones and a code for each.
    """
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps([_packed(a) for a in arrays], protocol=5))


def unpack(body: bytes) -> tuple:
    out = []
    for kind, value in pickle.loads(zstandard.ZstdDecompressor().decompress(body)):
        if kind == "codes":
            distinct, *codes = value
            value = np.frombuffer(distinct, np.float64)[_numbers(*codes)]
        elif kind:
            value = _numbers(kind, value)
        out.append(value)
    return tuple(out)


def discounts(of: dict[int, int]) -> np.ndarray:
    """Discounted counts of 0 to KEPT, from the number of types with each count; where Good-Turing's is no proper discount, count - 1/2."""
    out = np.arange(KEPT + 1, dtype=float)
    top = (KEPT + 1) * of.get(KEPT + 1, 0) / max(1, of.get(1, 0))
    for r in range(1, KEPT + 1):
        d = -1.0
        if of.get(r) and top < 1:
            d = ((r + 1) * of.get(r + 1, 0) / (of[r] * r) - top) / (1 - top)
        out[r] = d * r if 0 < d < 1 else r - 0.5
    return out


def discounted(counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.where(counts > KEPT, counts - EPSILON, table[np.minimum(counts, KEPT)])


def lost(counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What discounting takes from counts."""
    few = np.minimum(counts, KEPT)
    return np.where(counts > KEPT, EPSILON, few - table[few])


@dataclass
class Totals:
    """What is known of the training texts as a whole; a few numbers for each level."""

    docs: int
    tokens: int
    types: int
    tables: list[np.ndarray]  # discounted counts of each level
    unknown: float  # probability of all unknown words
    bits: int  # targets are 2**bits


class Part:
    """Some texts on end: words as places in a list of distinct ones (of which it is given the differences), a start before and an end after each text."""

    def __init__(self, ids: list, held: np.ndarray, sizes: np.ndarray, place: np.ndarray, distinct: np.ndarray):
        self.ids, self.held, self.sizes = ids, held, sizes
        self.words = np.cumsum(distinct, dtype=np.uint64)[place]
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.first = np.cumsum(sizes) - sizes

    def after(self, values: np.ndarray, start) -> np.ndarray:
        """The value of the token before each, or that of a text's start."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = start
        return out

    def levels(self, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(hashes of the n-grams that end at each token, those of their histories), for n = 1 to order; a single word's history is empty."""
        grams, histories, start = [mix(self.words)], [np.zeros(len(self.words), np.uint64)], np.uint64(0)
        for _ in range(1, order):
            start = mix(np.array([start]) * np.uint64(0x9E3779B97F4A7C15) + START)[0]
            histories.append(self.after(grams[-1], start))
            grams.append(mix(histories[-1] * np.uint64(0x9E3779B97F4A7C15) + self.words))
        return grams, histories


def encoded(docs: DataFrame) -> DataFrame:
    """Parts of (doc_id, held_out, text), as a written table. All texts of a part are held out, or none; the numbers of parts that are held out are odd."""
    part_tokens = PART_TOKENS

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        gathered: dict[bool, list[tuple]] = {False: [], True: []}
        tokens = {False: 0, True: 0}

        def flush(held: bool) -> pa.RecordBatch:
            nonlocal number
            ids, (out, sizes, all_words) = [x for h in gathered[held] for x in h[0]], (np.concatenate([h[i] for h in gathered[held]]) for i in (1, 2, 3))
            distinct, place, often = np.unique(all_words, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # frequent words have small numbers; equally frequent ones ascend
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            distinct, place = distinct[order], rank[place]
            learnt = int(sizes[~out].sum())
            body = pack(ids, out, sizes.astype(np.int64), place, np.diff(distinct, prepend=np.uint64(0)))
            row = pa.RecordBatch.from_arrays([pa.array([number + held], pa.int64()), pa.array([body], pa.binary()), pa.array([int((~out).sum())], pa.int64()), pa.array([learnt], pa.int64()), pa.array([len(all_words)], pa.int64())], names=["part", "body", "docs", "learnt", "tokens"])
            gathered[held], tokens[held], number = [], 0, number + 2
            return row

        for batch in batches:
            for low, high in pieces(batch.column("text")):
                rows = batch.slice(low, high - low)
                hashes, offsets, _, _ = words(rows.column("text"))
                sizes = np.diff(offsets) + 1
                with_ends = np.full(len(hashes) + high - low, END)
                inner = np.ones(len(with_ends), bool)
                inner[np.cumsum(sizes) - 1] = False
                with_ends[inner] = hashes
                ids, out = rows.column("doc_id"), rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                for held in (False, True):
                    own = out == held
                    if own.any():
                        gathered[held].append((ids.filter(pa.array(own)).to_pylist(), out[own], sizes[own], with_ends[np.repeat(own, sizes)]))
                        tokens[held] += len(gathered[held][-1][3])
                    if tokens[held] >= part_tokens:
                        yield flush(held)
        for held in (False, True):
            if gathered[held]:
                yield flush(held)

    return tables.written(docs.select("doc_id", "held_out", "text").mapInArrow(encode, _PARTS), "parts")


def _dealt(level: int, part: int, bits: int, keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """Rows of what a part asks of each target about sorted distinct hashes, with a value of each kind for every hash. There are 2**bits targets."""
    cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
    cuts = [0, *cuts, len(keys)]
    low = _low(keys, bits, 64 if level == 1 else BITS)
    for target, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            yield level, target, part, ASK, pack(np.diff(low[a:b], prepend=np.uint64(0)), *(v[a:b] for v in values)), None


def _low(keys: np.ndarray, bits: int, most: int) -> np.ndarray:
    """The bits of a hash below those that name its target, so many of them at most."""
    return (keys << np.uint64(bits) if bits else keys) >> np.uint64(max(bits, 64 - most))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _ROWS.split(", ")])


def _gathered(rows: pa.Table) -> tuple[list[tuple], np.ndarray, np.ndarray, list[np.ndarray]]:
    """(part, kind and number of entries of each row by part, distinct hashes, place of every entry among these, values of every entry)."""
    rows = rows.sort_by([("part", "ascending")])
    bodies = [unpack(b) for b in rows.column("body").to_pylist()]
    heads = list(zip(rows.column("part").to_pylist(), rows.column("kind").to_pylist(), [len(b[0]) for b in bodies], strict=True))
    keys, place = np.unique(np.concatenate([np.cumsum(b[0], dtype=np.uint64) for b in bodies]), return_inverse=True)
    return heads, keys, place, [np.concatenate(v) for v in zip(*[b[1:] for b in bodies], strict=True)]


def _answered(rows: pa.Table, values: list[np.ndarray], heads: list[tuple], chosen: np.ndarray | None = None) -> Iterator[tuple]:
    """A row for each part that asked, with its entries' values of each kind (of the chosen ones) in the order in which it asked."""
    level, target, at = rows.column("level")[0].as_py(), rows.column("target")[0].as_py(), 0
    for part, kind, n in heads:
        if kind == ASK:
            own = [v[at : at + n] for v in values]
            yield level, target, part, ANSWER, pack(*(v if chosen is None else v[chosen[at : at + n]] for v in own)), None
        at += n


def counted(parts: DataFrame, order: int, bits: int, stored: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """Answers with twice the training count of every n-gram of a part, and one more where the part speaks for it; and the table of counts.

    If not whole, answers say besides which n-grams are wanted, as a held-out text backs off from them. With stored counts, nothing is learnt from the parts.
    """
    learn = stored is None
    whole = whole or not learn
    held = F.col("part") % 2 == 1

    def asked(level: int, number: int, part: Part, after: np.ndarray | None) -> pa.Table:
        """after: how often the n-grams of the next level that end at each token were counted."""
        grams = part.levels(level)[0][-1]
        if number % 2:
            keys, place = np.unique(grams, return_inverse=True)
            n, wanted = np.zeros(len(keys), np.uint32), np.zeros(len(keys), bool)
            if after is not None:
                wanted[place[np.setdiff1d(np.flatnonzero(after == 0), part.first, assume_unique=True) - 1]] = True
        else:
            keys, n = np.unique(grams, return_counts=True)
            n, wanted = n.astype(np.uint32) if learn else np.zeros(len(keys), np.uint32), np.zeros(len(keys), bool)
        return pa.Table.from_batches([_batch(list(_dealt(level, number, bits, keys, n, *([] if whole else [wanted]))))])

    def ask(level: int):
        def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, body in zip(batch.column("part").to_pylist(), batch.column("body"), strict=True):
                    yield from asked(level, number, Part(*unpack(body.as_py())), None).to_batches()

        return of_parts

    def ask_after(level: int):
        def of_part(rows: pa.Table) -> pa.Table:
            number, part, told, _ = _opened(rows)
            place = np.unique(part.levels(level + 1)[0][-1], return_inverse=True)[1]
            return asked(level, number, part, (told[level + 1][0] // 2)[place])

        return of_part

    def count(rows: pa.Table) -> pa.Table:
        heads, keys, place, (n, *wanted) = _gathered(rows)
        total = np.bincount(place, n, len(keys)).astype(np.int64)
        seen = np.flatnonzero(n > 0)
        speaks = np.zeros(len(n), np.int64)
        if learn:
            speaks[seen[np.unique(place[seen], return_index=True)[1]]] = 1
        out = list(_answered(rows, [(2 * total[place] + speaks).astype(np.uint64), *((np.bincount(place, w, len(keys)) > 0)[place] for w in wanted)], heads))
        if learn:
            known = total > 0
            types = np.bincount(np.minimum(total[known], KEPT + 2), minlength=KEPT + 3).tolist()
            body = pack(np.diff(keys[known], prepend=np.uint64(0)), total[known])
            out.append((rows.column("level")[0].as_py(), rows.column("target")[0].as_py(), -1, KEEP, body, [*types, int(total.sum())]))
        return pa.Table.from_batches([_batch(out)])

    levels: list[DataFrame] = []
    for level in range(order, 0, -1):
        told_first = not whole and level < order
        asks = (parts.where(~held) if told_first else parts).select("part", "body").mapInArrow(ask(level), _ROWS)
        if told_first:
            asks = asks.unionByName(_by_part(parts.where(held), levels[-1].where(held)).applyInArrow(ask_after(level), _ROWS))
        if not learn:
            asks = asks.unionByName(stored.where(F.col("level") == level).select(asks.columns))
        levels.append(tables.written(asks.groupBy("level", "target").applyInArrow(count, _ROWS), "counts", ("kind", "level")))
    return reduce(DataFrame.unionByName, levels)


class Told:
    """A part with the counts that it was answered: of the n-gram that ends at each token, and of its history."""

    def __init__(self, part: Part, answers: dict[int, list[np.ndarray]], totals: Totals):
        self.part, self.totals, self.order = part, totals, len(totals.tables)
        self.grams, self.histories = part.levels(self.order)
        self.counts, self.of, self.speaks, self.at, self.wanted = [], [np.full(len(part.words), totals.tokens)], [], [], []
        for level in range(1, self.order + 1):
            _, first, place = np.unique(self.grams[level - 1], return_index=True, return_inverse=True)
            answer, *wanted = answers[level]
            answer = answer.astype(np.int64)
            self.counts.append((answer // 2)[place])
            self.at.append(first)
            self.speaks.append(answer % 2 == 1)
            self.of.append(part.after(self.counts[-1], totals.docs))
            self.wanted.append(part.after(wanted[0][place], True) if wanted else np.ones(len(part.words), bool))  # whether the token's history is

    def probability(self, level: int) -> np.ndarray:
        """Of every token by its own level's count; 0 where the n-gram is unseen."""
        return discounted(self.counts[level - 1], self.totals.tables[level - 1]) / np.maximum(1, self.of[level - 1])

    def unseen(self, level: int) -> np.ndarray:
        """Tokens of texts that may back off at a level from a history that was seen."""
        return (self.counts[level - 1] == 0) & (self.of[level - 1] > 0)


def _answers(rows: list[tuple]) -> dict[int, list[np.ndarray]]:
    """What a part was answered at each level, values of each kind in the order of its hashes, from rows (level, target, body)."""
    out: dict[int, list] = {}
    for level, _, body in sorted(rows, key=lambda r: r[:2]):
        out.setdefault(level, []).append(unpack(body))
    return {level: [np.concatenate(v) for v in zip(*x, strict=True)] for level, x in out.items()}


def _by_part(parts: DataFrame, *answers: DataFrame) -> DataFrame:
    """Rows of a part and of what it was answered, under the number of the question; a part itself is question 0."""
    out = parts.select("part", F.lit(0).alias("question"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("target"), "body")
    for i, a in enumerate(answers, 1):
        out = out.unionByName(a.where(F.col("kind") == ANSWER).select("part", F.lit(i).alias("question"), "level", "target", "body"))
    return out.groupBy("part")


def _opened(rows: pa.Table) -> tuple[int, Part, dict[int, list[np.ndarray]], dict[int, list[np.ndarray]]]:
    """A part's number, the part, and what it was answered to its first and second question."""
    found: list[list] = [[], [], []]
    for question, *row in zip(*(rows.column(c).to_pylist() for c in ("question", "level", "target", "body")), strict=True):
        found[question].append(tuple(row))
    return rows.column("part")[0].as_py(), Part(*unpack(found[0][0][2])), _answers(found[1]), _answers(found[2])


def weighed(parts: DataFrame, counts: DataFrame, totals: Totals, stored: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """Answers with log10 alpha of the histories from which a part's texts back off, by hash, and the table of weights of all histories, or of all wanted ones."""
    learn = stored is None

    def ask(rows: pa.Table) -> pa.Table:
        number, part, answers, _ = _opened(rows)
        told = Told(part, answers, totals)
        out = []
        for level in range(2, told.order + 1):
            histories = told.histories[level - 1]
            at = told.at[level - 1][told.speaks[level - 1]] if learn else np.zeros(0, np.int64)
            at = at[told.wanted[level - 2][at]]
            wanted = np.flatnonzero(told.unseen(level))
            keys, first, place = np.unique(np.concatenate([histories[at], histories[wanted]]), return_index=True, return_inverse=True)
            own = np.concatenate([at, wanted])[first]
            own_count, shorter_count = told.counts[level - 1][at], told.counts[level - 2][at]
            gone, shorter_gone = (np.bincount(place[: len(at)], lost(c, totals.tables[level - i]), len(keys)) for i, c in ((1, own_count), (2, shorter_count)))
            covered = np.zeros(len(keys), np.int64)
            np.add.at(covered, place[: len(at)], shorter_count)
            needed = np.zeros(len(keys), bool)
            needed[place[len(at) :]] = True
            of, shorter_of = told.of[level - 1][own], told.of[level - 2][own]
            if not whole:  # whoever wants a weight knows how often its history was counted; a start's is always told
                untold = ~needed & ~np.isin(own, told.part.first)
                of[untold] = shorter_of[untold] = 0
            out += _dealt(level, number, totals.bits, keys, gone, of, covered, shorter_gone, shorter_of, needed)
        return pa.Table.from_batches([_batch(out)])

    def weigh(rows: pa.Table) -> pa.Table:
        heads, keys, place, values = _gathered(rows)
        gone, of, covered, shorter_gone, shorter_of, needed = values
        if learn:  # what is left of whole counts is small beside them: counts are subtracted as such
            all_, shorter = np.zeros((2, len(keys)), np.int64)
            for known, told in ((all_, of), (shorter, shorter_of)):
                known[place[told > 0]] = told[told > 0]
            uncovered = shorter.copy()
            np.subtract.at(uncovered, place, covered)
            left = np.where(all_ > 0, np.bincount(place, gone, len(keys)) / np.maximum(1, all_), 1.0)
            rest = np.where(shorter > 0, (uncovered + np.bincount(place, shorter_gone, len(keys))) / np.maximum(1, shorter), 1.0)
            alpha = np.log10(np.maximum(left, 1e-300) / np.maximum(rest, 1e-300))
        else:  # stored weights stand in the place of what was lost
            alpha = np.bincount(place, gone, len(keys))
        out = list(_answered(rows, [alpha[place]], heads, needed))
        if learn:
            out.append((rows.column("level")[0].as_py(), rows.column("target")[0].as_py(), -1, KEEP, pack(np.diff(keys, prepend=np.uint64(0)), alpha.astype(np.float32)), None))
        return pa.Table.from_batches([_batch(out)])

    def made() -> DataFrame:
        own = [F.shiftright("part", 1) % ROUNDS == i for i in range(ROUNDS)]
        asked = reduce(DataFrame.unionByName, [tables.written(_by_part(parts.where(x), counts.where(x)).applyInArrow(ask, _ROWS), "asked") for x in own])
        if not learn:
            asked = asked.unionByName(stored.select(asked.columns))
        return asked.groupBy("level", "target").applyInArrow(weigh, _ROWS)

    return tables.finished(parts.sparkSession, "weights", made, ("kind", "level"))


def evaluated(parts: DataFrame, counts: DataFrame, weights: DataFrame, totals: Totals, kind) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text of the parts."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)

    def score(rows: pa.Table) -> pa.Table:
        _, part, answers, alphas = _opened(rows)
        told, n = Told(part, answers, totals), len(part.sizes)
        known = told.counts[0] > 0
        p = np.log10(np.where(known, np.maximum(told.probability(1), 1e-300), max(totals.unknown, 1e-300))) if totals.tokens else np.zeros(len(part.words))
        for level in range(2, told.order + 1):
            alpha = np.zeros(len(part.words))
            unseen = told.unseen(level)
            if unseen.any():
                _, place = np.unique(told.histories[level - 1][unseen], return_inverse=True)
                alpha[unseen] = alphas[level][0][place]
            seen = told.counts[level - 1] > 0
            p = np.where(seen, np.log10(np.maximum(told.probability(level), 1e-300)), alpha + p)
        base = np.log10((told.counts[0] + 1) / (totals.tokens + totals.types + 1))
        sums = [np.bincount(part.doc, x, n) for x in (known, base, p)]
        return pa.table([pa.array(part.ids, id_type), pa.array(part.held), pa.array(part.sizes, pa.int64()), pa.array(np.rint(sums[0]).astype(np.int64)), pa.array(np.full(n, totals.tokens)), pa.array(np.round(sums[1], 9)), pa.array(np.round(sums[2], 9))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _by_part(parts, counts, weights).applyInArrow(score, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@dataclass
class Model:
    """A fitted model: the tables of counts and weights (rows of kind KEEP, partitioned by level) and the totals."""

    counts: DataFrame
    weights: DataFrame
    totals: Totals


def _chosen(docs: DataFrame, held_out, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))


def fit_and_score(docs: DataFrame, held_out, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, whole: bool = True) -> tuple[Model, DataFrame]:
    """(the model learnt from the documents that are not held out, a row per document with its scores): see score().

    What is learnt and what is scored is encoded, sent and counted once. If not whole, the model has the weights of those histories alone from which
    these documents back off, whose scores are the same: other documents cannot be scored from it.
    """
    chosen = _chosen(docs, held_out, id_col, text_col)
    parts = encoded(chosen)
    docs_, tokens, all_tokens = parts.agg(F.sum("docs"), F.sum("learnt"), F.sum("tokens")).first()
    bits = max(0, math.ceil(math.log2(max(1, all_tokens or 0) / TARGET_TOKENS)))
    counts = counted(parts, order, bits, None, whole)
    # Types with each count up to KEPT + 1, those with more, and the sum of all counts.
    sums = F.array(*[F.sum(F.col("types")[i]) for i in range(KEPT + 4)])
    types = {r.level: r.types for r in counts.where(F.col("kind") == KEEP).groupBy("level").agg(sums.alias("types")).collect()}
    none = [0] * (KEPT + 4)
    tables_ = [discounts(dict(enumerate(types.get(level, none)[: KEPT + 2]))) for level in range(1, order + 1)]
    single = types.get(1, none)
    often, all_ = single[KEPT + 1] + single[KEPT + 2], single[KEPT + 3]
    gone = sum((r - float(tables_[0][r])) * single[r] for r in range(1, KEPT + 1)) + EPSILON * often
    totals = Totals(docs_ or 0, tokens or 0, sum(single[: KEPT + 3]), tables_, gone / all_ if all_ else 1.0, bits)
    weights = weighed(parts, counts, totals, None, whole)
    keep = F.col("kind") == KEEP
    return Model(counts.where(keep), weights.where(keep), totals), evaluated(parts, counts, weights, totals, chosen.schema["doc_id"].dataType)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), all held out, evaluated from the model's tables.

    Tokens are the words of the whole text, A-Z as a-z, and one end; n_known counts those that training has. base_score is the add-one unigram
    model's log10 probability, score this model's. A null, empty or blank text is its end alone. A null id is returned as it is. Rows are scored each
    for itself, so repeated ones count in training each time and each get a row. If nothing was learnt, every token has probability 1. An empty table
    gives an empty result. Extra columns are ignored.
    """
    chosen = _chosen(docs, F.lit(True), id_col, text_col)
    parts = encoded(chosen)
    # Stored rows look like a part's questions: hashes with a value of each kind.
    none = np.zeros(0)

    def as_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, alpha = unpack(row["body"])
                zero = np.zeros(len(keys))
                yield _batch([(row["level"], row["target"], -1, KEEP, pack(keys, alpha.astype(float), zero.astype(np.int64), zero.astype(np.int64), zero, zero.astype(np.int64), np.zeros(len(keys), bool)), none.tolist())])

    columns = [f.split()[0] for f in _ROWS.split(", ")]
    counts = counted(parts, len(model.totals.tables), model.totals.bits, model.counts.select(columns))
    weights = weighed(parts, counts, model.totals, model.weights.select(columns).mapInArrow(as_weights, _ROWS))
    return evaluated(parts, counts, weights, model.totals, chosen.schema["doc_id"].dataType)


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return tables.finished(spark, "scores", lambda: fit_and_score(tables.read(spark, sf_dir, "documents"), held_out, whole=False)[1])


QUERIES = {"op2_katz": op2_katz}
ORACLES: dict[str, str] = {}
