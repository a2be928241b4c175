"""Ranked lexical search by block maxima over posting lists whose blocks have variable lengths.

An index has shards of a bounded number of terms, each with posting lists of its own, so that a frequent term's list is spread over all shards. A posting
holds the number of a document within the shard and its impact, the whole part of a score that is the same for any query. Dynamic
programming cuts every list into blocks: the sum over the documents that a block spans of (highest impact of the block - own impact, 0 without a posting), which is
what its bound promises too much, plus a cost for each block is least. A query sums, over its terms, weight times highest impact of the block that spans a document. This
is WAND's pivot test, made for all documents of a shard at once. Only blocks that span a document whose bound reaches the k-th best score so far are
opened and scored; the rest cannot hold a result, so what comes out is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables
from .words import buffers, pieces, words

#: Terms of a shard, at which it is closed; one document may have more. Postings that dynamic programming cuts at a time, and the longest block.
SHARD_TERMS, RUN, LONGEST = 2_000_000, 512, 128
#: What a block costs, in units of impact: an impact is below 1,000,000.
BLOCK_COST = 1_000_000
#: Query terms held against all shards at once; more are searched in blocks of queries, one after the other.
QUERY_TERMS = 200_000
#: Distinct query terms up to which they are broadcast, 8 bytes each.
BROADCAST_TERMS = 500_000
# What separates terms.
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


class Index(NamedTuple):
    """postings: (shard, term, df, docs, impacts, block_ends, block_max, ids); a row without term has the ids of a shard's documents by their numbers and, as docs, their ranks by id. n_docs and n_terms count the corpus."""

    postings: DataFrame
    n_docs: int
    n_terms: int


def impacts_of(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of a posting's score that is to be multiplied with the term's weight: below 1,000,000."""
    m = 100 - 50 + (50 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def cut_blocks(docs: np.ndarray, impacts: np.ndarray, lists: np.ndarray, cost: int = BLOCK_COST, run: int = RUN, longest: int = LONGEST) -> np.ndarray:
    """Whether each posting is the last of its block, for lists that begin at the n + 1 offsets `lists`.

    Every run of so many postings of a list is cut into blocks of at most `longest`, so that the sum of the blocks' spanned documents times highest impact plus cost is least.
    Runs of about the same length are cut together, a step for each posting of the longest.
    """
    last = np.zeros(len(impacts), bool)
    lengths = np.diff(lists)
    runs = -(-lengths // run)
    nth = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = np.repeat(lists[:-1], runs) + nth * run
    sizes = np.minimum(np.repeat(lengths, runs) - nth * run, run)
    last[starts[sizes == 1]] = True
    width = 2
    while width < 2 * run:
        some = np.flatnonzero((sizes > width // 2) & (sizes <= width))
        for low in range(0, len(some), step := max(16, (1 << 18) // width)):
            _cut(docs, impacts, starts[some[low : low + step]], sizes[some[low : low + step]], last, cost, longest)
        width *= 2
    return last


def _cut(docs: np.ndarray, impacts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, last: np.ndarray, cost: int, longest: int) -> None:
    """Marks the last postings of blocks of runs that begin at starts; row p of every array is about the first p postings of each run."""
    width, n = int(sizes.max()), len(starts)
    least, origin, high, place = np.zeros((width + 1, n)), np.zeros((width + 1, n), np.int32), np.zeros((width, n)), np.zeros((width, n))
    for i in range(width):
        at = np.minimum(starts + i, len(impacts) - 1)
        place[i], own = docs[at], impacts[at]
        low = max(0, i + 1 - longest)
        np.maximum(high[low : i + 1], own, out=high[low : i + 1])
        total = high[low : i + 1] * (place[i] + 1 - place[low : i + 1])
        total += least[low : i + 1]
        at = total.argmin(axis=0)
        origin[i + 1] = at + low
        least[i + 1] = total[at, np.arange(n)] + cost
    end, run = sizes.copy(), np.arange(n)
    while len(run):
        last[starts[run] + end - 1] = True
        end = origin[end, run]
        run, end = run[end > 0], end[end > 0]


def _shard(ids: pa.Array, hashes: np.ndarray, counts: np.ndarray, shard: int, n_docs: int, n_terms: int, cost: int, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of one shard: its documents by length, since impacts fall with it and blocks of like impacts promise little too much, and a posting list for each term."""
    by_id = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    order = by_id[np.argsort(counts[by_id], kind="stable")]
    number, rank = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    number[order] = rank[by_id] = np.arange(len(order))
    doc = np.repeat(number, counts)
    by = np.lexsort((doc, hashes))
    term, doc = hashes[by], doc[by]
    new = np.ones(len(by), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(by)))
    term, doc = term[first], doc[first]
    impacts = impacts_of(tf, counts[order][doc], n_docs, n_terms)
    head = np.ones(len(term), bool)
    head[1:] = term[1:] != term[:-1]
    lists = np.append(np.flatnonzero(head), len(term))
    ends = np.flatnonzero(cut_blocks(doc, impacts, lists, cost)) + 1
    blocks = np.append(0, np.searchsorted(ends, lists[1:], "right"))
    high = np.maximum.reduceat(impacts, np.append(0, ends[:-1])) if len(ends) else impacts
    relative = ends - np.repeat(lists[:-1], np.diff(blocks))
    n = len(lists) - 1
    ranks = pa.array([rank[order].astype(np.int32).tobytes()], pa.binary())
    binary = lambda values, offsets, head=pa.array([None], pa.binary()): pa.concat_arrays([head, pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(values.astype(np.int32))])])
    none = pa.array([None], pa.int64())
    columns = [
        pa.array(np.full(n + 1, shard), pa.int64()), pa.concat_arrays([none, pa.array(term[lists[:-1]].view(np.int64))]), pa.concat_arrays([none, pa.array(np.diff(lists), pa.int64())]), binary(doc, lists, ranks), binary(impacts, lists), binary(relative, blocks), binary(high, blocks),
        pa.array([ids.take(pa.array(order)), *[None] * n], schema.field("ids").type),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS, block_cost: int = BLOCK_COST) -> Index:
    """Posting lists of all documents with a term, in shards, as a table in the shared folder.

    Terms are runs of ASCII letters and digits and of all other characters but ASCII, A-Z as a-z, known by 64-bit hashes. Texts that are null or have no
    term are in no list and are not counted. Null and repeated ids and repeated rows are documents of their own. An empty table gives no shard; extra columns are ignored.
    """
    kept = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for low, high in pieces(texts):
                data, offsets = buffers(texts[low:high])
                first = np.append(True, BETWEEN[data[:-1]])[: len(data)]
                first[offsets[:-1][offsets[:-1] < len(data)]] = True
                starts = np.searchsorted(np.flatnonzero(first & ~BETWEEN[data]), offsets)
                yield pa.RecordBatch.from_pydict({"n_docs": [int((np.diff(starts) > 0).sum())], "n_terms": [int(starts[-1])]})

    n_docs, n_terms = (x or 0 for x in kept.select("text").mapInArrow(count, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first())
    schema = f"shard long, term long, df long, docs binary, impacts binary, block_ends binary, block_max binary, ids array<{kept.schema['doc_id'].dataType.simpleString()}>"

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ids, size = TaskContext.get().partitionId() << 32, [], [], 0
        form = None

        def close() -> pa.RecordBatch:
            counts = np.concatenate([c for _, c in held])
            return _shard(pa.concat_arrays(ids), np.concatenate([h for h, _ in held]), counts, number, n_docs, n_terms, block_cost, form)

        for batch in batches:
            names = ["shard", "term", "df", "docs", "impacts", "block_ends", "block_max"]
            form = form or pa.schema([*zip(names, [*[pa.int64()] * 3, *[pa.binary()] * 4], strict=True), ("ids", pa.list_(batch.schema.field(0).type))])
            for low, high in pieces(batch.column(1)):
                hashes, offsets, _, _ = words(batch.column(1)[low:high], BETWEEN)
                some = np.flatnonzero(np.diff(offsets))
                if not len(some):
                    continue
                held.append((hashes, np.diff(offsets)[some]))
                ids.append(batch.column(0)[low:high].take(pa.array(some)))
                size += len(hashes)
                if size >= shard_terms:
                    yield close()
                    number, held, ids, size = number + 1, [], [], 0
        if held:
            yield close()

    return Index(tables.written(kept.mapInArrow(shards, schema), "postings"), n_docs, n_terms)


class Lists:
    """Posting lists of one shard by term, for the terms of a block of queries."""

    def __init__(self, ids: list, ranks: bytes) -> None:
        self.ids, self.ranks, self.of = ids, np.frombuffer(ranks, np.int32), {}

    def add(self, term: int, *parts: bytes) -> None:
        docs, impacts, ends, high = (np.frombuffer(x, np.int32) for x in parts)
        starts = np.append(0, ends[:-1])
        self.of[term] = docs, impacts, starts, ends, high.astype(np.int64), docs[starts], docs[ends - 1] + 1

    def bounds(self, query: list[tuple[int, int]]) -> np.ndarray:
        """For every document the most that its score can be: weight times highest impact of the blocks that span it."""
        change = np.zeros(len(self.ids) + 1, np.int64)
        for term, weight in query:
            _, _, _, _, high, low, past = self.of[term]
            change[low] += weight * high  # blocks of a list do not overlap, so no place is named twice
            change[past] -= weight * high
        return np.cumsum(change[:-1])

    def scores(self, query: list[tuple[int, int]], wanted: np.ndarray) -> np.ndarray:
        """Scores of all documents that are wanted, from the blocks that span one of them; the others' numbers mean nothing."""
        out = np.zeros(len(wanted), np.int64)
        before = np.append(0, np.cumsum(wanted))
        for term, weight in query:
            docs, impacts, starts, ends, _, low, past = self.of[term]
            opened = before[past] > before[low]
            if opened.all():
                out[docs] += weight * impacts.astype(np.int64)
            elif opened.any():
                at = np.repeat(opened, ends - starts)
                out[docs[at]] += weight * impacts[at].astype(np.int64)
        return out

    def best(self, query: list[tuple[int, int]], k: int, least: int) -> list[tuple[int, int]]:
        """(score, document) of the k best with scores of at least `least`, a score of 1 being the lowest that counts; ties to smaller ids."""
        query = [x for x in query if x[0] in self.of]
        if not query:
            return []
        bound, least = self.bounds(query), max(least, 1)
        live = bound >= least
        if live.sum() > 4 * k:  # the most promising first, for a score that the others have to reach
            first = live & (bound >= -np.partition(-bound, 2 * k)[2 * k])
            tried = self.scores(query, first)[first]
            least = max(least, int(np.partition(tried, len(tried) - k)[len(tried) - k]))
            live = bound >= least
        total = np.where(live, self.scores(query, live), 0)
        found = np.flatnonzero(total >= least)
        found = found[np.lexsort((self.ranks[found], -total[found]))[:k]]
        return [*zip(total[found].tolist(), found.tolist(), strict=True)]


def _searched(postings: DataFrame, terms: pa.Table, k: int, sent) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item that a task has met, for one block of queries."""
    ids = postings.schema["ids"].dataType.elementType.simpleString()
    wanted = postings.join(F.broadcast(postings.sparkSession.createDataFrame(terms.select(["term"]).group_by("term").aggregate([]))), "term", "left_semi")
    rows = wanted.unionByName(postings.where("term IS NULL")).repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, list[tuple[int, int]]] = {}
        for item, term, weight in zip(*sent.value, strict=True):
            queries.setdefault(item, []).append((term, weight))
        best: dict[int, list[tuple]] = {item: [] for item in queries}
        lists, kind = None, None

        def close() -> None:
            if not lists.of:
                return
            for item, query in queries.items():
                found = lists.best(query, k, best[item][-1][0] if len(best[item]) == k else 0)
                if found:
                    more = best[item] + [(score, lists.ids[d]) for score, d in found]
                    best[item] = sorted(more, key=lambda x: (-x[0], x[1] is None, x[1] or 0 if x[1] is None else x[1]))[:k]

        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            columns = [batch.column(c).to_pylist() for c in ("term", "docs", "impacts", "block_ends", "block_max")]
            for r, (term, *parts) in enumerate(zip(*columns, strict=True)):
                if term is None:
                    if lists is not None:
                        close()
                    lists = Lists(batch.column("ids")[r].as_py(), parts[0])
                else:
                    lists.add(term, *parts)
        if lists is not None:
            close()
            found = [(item, d, score) for item, rows in best.items() for score, d in rows]
            item, doc, score = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, kind), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return rows.select("term", "docs", "impacts", "block_ends", "block_max", "ids").mapInArrow(run, f"item long, doc_id {ids}, score long")


def search(corpus: Index, queries: DataFrame, *, id_col: str = "item_id", text_col: str = "text", k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for each query; equal scores by ascending doc_id, null last.

    Each distinct term of a query counts once. A query without a term that is in the corpus has no rows, be its text null, empty or new; repeated rows and null ids are
    queries of their own. No documents or no queries give no rows; extra columns are ignored.
    """
    spark = queries.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in pieces(batch.column(1)):
                hashes, offsets, _, _ = words(batch.column(1)[low:high], BETWEEN)
                row = np.repeat(np.arange(high - low), np.diff(offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high].take(pa.array(row)), pa.array(hashes.view(np.int64))], names=["item", "term"])

    items = tables.written(queries.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")), "items")
    terms = tables.written(items.select("item", "text").mapInArrow(split, "item long, term long").distinct(), "item-terms")
    distinct = tables.small_or_not(terms.select("term").distinct(), BROADCAST_TERMS)
    df = corpus.postings.where("term IS NOT NULL").select("term", "df").join(distinct, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(corpus.n_docs).cast("double") + 2) / (2 * F.col("df") + 1)))
    weighted = tables.written(terms.join(df.select("term", weight.alias("weight")), "term").where("weight > 0").select("item", "term", "weight"), "weighted-terms")
    found, blocks = None, max(1, -(-weighted.count() // QUERY_TERMS))
    for block in range(blocks):
        part = weighted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()
        sent = spark.sparkContext.broadcast(tuple(part.column(c).to_pylist() for c in ("item", "term", "weight")))
        rows = _searched(corpus.postings, part, k, sent)
        found = rows if found is None else found.unionByName(rows)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each item of the benchmark."""
    return search(index(tables.read(spark, sf_dir, "documents")), tables.read(spark, sf_dir, "benchmark"))


QUERIES = {"op12_lexical_search": op12_lexical_search}
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES = {
    "op12_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT r, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
c AS (SELECT count(*)::BIGINT AS N, sum(n)::BIGINT AS L FROM s),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS terms FROM benchmark),
q AS (SELECT q, unnest(terms) AS term FROM i),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(c.N) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term),
t AS (SELECT q.q, p.r, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + ((50 * s.n * c.N) // c.L)))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN s USING (r), c GROUP BY q.q, p.r),
o AS (SELECT q, r, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, s.doc_id) AS rank FROM t JOIN s USING (r) WHERE score > 0)
SELECT i.item_id, o.rank::INTEGER AS rank, s.doc_id, o.score FROM o JOIN i USING (q) JOIN s USING (r) WHERE o.rank <= 50"""
}
