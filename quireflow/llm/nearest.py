"""Approximate nearest neighbours by largest inner product: cross-polytope hashing with multiprobe tables, then exact reranking.

A vector is divided by the largest norm and given one more coordinate that makes it a unit vector, so that the nearest by angle is the nearest
by inner product. A polytope hash turns it by three rounds of random signs and a fast Hadamard transform and takes the nearest signed axis. A
table's bucket is the product of several such hashes; a query opens the buckets whose axes it lies nearest to, best first.

Buckets grow in number with the vectors. How many axes a bucket has and how many a query opens is measured: CALIBRATION queries are held against
all vectors, and of all shapes the one is taken whose probes find TARGET of their true neighbours at the least number of products.

Vectors travel once to their bucket in each table, queries to the groups of buckets that they open, and meet in one sorted stream per group, of bounded
size. Two rounds: the best FIRST of the probes give every query a lower bound of its k-th score; the others return only what is not below it,
which loses nothing. Equal vectors are one entry with their smallest ids, as many as can come into a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tables

TABLES, SEED = 12, 77
#: Queries that the shape is measured on, the share of true neighbours that they must find, the most probes a table, and the share of probes of the first round.
CALIBRATION, TARGET, MOST_PROBES, FIRST = 64, 0.95, 1024, 0.1
#: Vectors a bucket on average, of the shapes that are tried.
SIZES = (4, 16, 64, 256)
#: What a probe costs beside the products in its bucket, in products.
PROBE_COST = 2
#: Entries that a task turns at a time; of a group of buckets, on average and at most in one task; pairs multiplied at a time.
DEALT, GROUP, BLOCK, PAIRS = 4_096, 8_192, 32_768, 131_072
#: Queries that are held against all rows at once where the tables find too few.
EXACT_BLOCK = 4_096
#: Hot groups (12 bytes each) that may be broadcast.
BROADCAST_GROUPS = 200_000


@lru_cache(maxsize=4096)
def _signs(table: int, part: int, wide: int) -> np.ndarray:
    """Three rows of random signs of one pseudo-rotation."""
    return np.random.Generator(np.random.PCG64([SEED, table, part])).choice([-1.0, 1.0], (3, wide))


@lru_cache(maxsize=16)
def _hadamard(wide: int) -> np.ndarray:
    out = np.ones((1, 1))
    while len(out) < wide:
        out = np.block([[out, out], [out, -out]])
    return out / np.sqrt(wide)


def rotated(x: np.ndarray, table: int, part: int = 0) -> np.ndarray:
    """Rows turned by a pseudo-rotation of a table; their length must be a power of two.

    A Hadamard transform is the product of two of about the root of its length, taken over rows and columns; the order in which this leaves the
    coordinates makes no difference to what is turned at random.
    """
    n, wide = x.shape
    b = 1 << (wide.bit_length() - 1) // 2
    for signs in _signs(table, part, wide):
        x = (x * signs).reshape(n * (wide // b), b) @ _hadamard(b)
        x = np.ascontiguousarray(x.reshape(n, wide // b, b).transpose(0, 2, 1)).reshape(n * b, wide // b) @ _hadamard(wide // b)
        x = x.reshape(n, wide)
    return x


def unit(x: np.ndarray, largest: float | None) -> np.ndarray:
    """Unit vectors, padded to a power of two: divided by the largest norm and completed, or for queries by their own norm."""
    wide = 1 << int(x.shape[1]).bit_length()
    out = np.zeros((len(x), wide))
    norm = np.sqrt((x * x).sum(axis=1))
    out[:, : x.shape[1]] = x / (norm[:, None] if largest is None else largest)
    if largest is not None:
        out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm / largest) ** 2))
    return out


def shapes(n: int, wide: int) -> list[tuple[int, ...]]:
    """Signed axes of each hash of a bucket, for about n / size buckets of every size that is tried; from fine to coarse."""
    out: list[tuple[int, ...]] = []
    for size in SIZES:
        left, shape = max(2.0, n / size), []
        while left >= 2:
            shape.append(min(2 * wide, 1 << round(np.log2(left))))
            left /= shape[-1]
        if tuple(shape) not in out:
            out.append(tuple(shape))
    return out


def axes(turned: np.ndarray, table: int, shape: tuple[int, ...]) -> list[np.ndarray]:
    """For each hash of a table's bucket, how near every vector lies to the signed axes."""
    out = []
    for part, size in enumerate(shape):
        y = rotated(turned, table, part)[:, : size // 2]
        out.append(np.concatenate([y, -y], axis=1))
    return out


def buckets(turned: np.ndarray, table: int, shape: tuple[int, ...]) -> np.ndarray:
    code = np.zeros(len(turned), np.int64)
    for near, size in zip(axes(turned, table, shape), shape, strict=True):
        code = code * size + near.argmax(axis=1)
    return code


def probes(turned: np.ndarray, table: int, shape: tuple[int, ...], most: int) -> np.ndarray:
    """The `most` buckets with the largest sums over their axes, best first, a row per vector.

    The sum of the i-th and the j-th best can only be among the `most` best where (i + 1)(j + 1) is not above it.
    """
    code, total = np.zeros((len(turned), 1), np.int64), np.zeros((len(turned), 1))
    for near, size in zip(axes(turned, table, shape), shape, strict=True):
        order = np.argsort(-near, axis=1, kind="stable")[:, :most]
        value = np.take_along_axis(near, order, axis=1)
        i, j = (np.concatenate(x) for x in zip(*[(np.full(min(order.shape[1], most // (r + 1)), r), np.arange(min(order.shape[1], most // (r + 1)))) for r in range(total.shape[1])], strict=True))
        total, code = total[:, i] + value[:, j], code[:, i] * size + order[:, j]
        best = np.argpartition(-total, most - 1, axis=1)[:, :most] if total.shape[1] > most else np.tile(np.arange(total.shape[1]), (len(total), 1))
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(total, best, axis=1), axis=1, kind="stable"), axis=1)
        total, code = np.take_along_axis(total, best, axis=1), np.take_along_axis(code, best, axis=1)
    return code


def fitted(query: np.ndarray, near: np.ndarray, of: np.ndarray, n: int, largest: float) -> tuple[tuple[int, ...], int]:
    """(shape, probes a table) that find TARGET of the true neighbours `near` of queries `of` at the least cost; None if none does with MOST_PROBES."""
    q, x = unit(query, None), unit(near, largest)
    best = None
    for shape in shapes(n, q.shape[1]):
        total = int(np.prod(shape))
        place = np.full(len(x), np.inf)  # of the neighbour's bucket among its query's probes, in the table where it comes first
        for t in range(TABLES):
            mine, listed = buckets(x, t, shape), probes(q, t, shape, min(MOST_PROBES, total))
            hit = listed[of] == mine[:, None]
            place = np.minimum(place, np.where(hit.any(axis=1), hit.argmax(axis=1), np.inf))
        wanted = np.sort(place)[max(0, int(np.ceil(TARGET * len(place))) - 1)] if len(place) else 0
        if np.isfinite(wanted) and (best is None or (wanted + 1) * (n / total + PROBE_COST) < best[0]):
            best = (wanted + 1) * (n / total + PROBE_COST), shape, int(wanted) + 1
    return best[1:] if best else None


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best(query: np.ndarray, rep: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, repeated pairs once; ties to the smaller rep."""
    order = np.lexsort((rep, -score, query))
    query, rep, score = query[order], rep[order], score[order]
    fresh = np.ones(len(query), bool)
    fresh[1:] = (query[1:] != query[:-1]) | (rep[1:] != rep[:-1])
    query, rep, score = query[fresh], rep[fresh], score[fresh]
    starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(query)))
    keep = np.arange(len(query)) - np.repeat(starts, sizes) < k
    return query[keep], rep[keep], score[keep]


def products(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score) of each query's k best and all that tie with the last; each score summed by itself, so it depends on the pair alone."""
    rough = q @ x.T
    if k < x.shape[0]:
        last = -np.partition(-rough, k - 1, axis=1)[:, k - 1 : k]
        r, c = np.nonzero(rough >= last - 1e-9 * np.maximum(1, np.abs(last)))
    else:
        r, c = (a.ravel() for a in np.indices(rough.shape))
    return r, c, np.concatenate([(q[r[a : a + 65536]] * x[c[a : a + 65536]]).sum(axis=1) for a in range(0, len(r), 65536)] or [np.zeros(0)])


_FOUND = "query long, rep long, score double"
_DEALT = "slot long, kind int, ids binary, vectors binary, bounds binary, codes binary, counts binary"


def _told(query, rep, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(rep, pa.int64()), pa.array(score, pa.float64())], names=["query", "rep", "score"])


def _batched(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], dim: int) -> Iterator[tuple]:
    """(vectors, *other columns) of about DEALT rows at a time."""
    held, n = [], 0

    def joined() -> tuple:
        table = pa.Table.from_batches(held).combine_chunks()
        return matrix(table.column("vec").combine_chunks(), dim), *(table.column(c).to_numpy() for c in columns)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= DEALT:
            yield joined()
            held, n = [], 0
    if n:
        yield joined()


class Layout:
    """Where vectors and queries meet: buckets of TABLES tables in groups of about GROUP entries; a slot is a table and a group."""

    def __init__(self, n: int, dim: int, largest: float, kind: type, shape: tuple[int, ...], probes_: int):
        self.dim, self.largest, self.kind, self.shape, self.probes = dim, largest, kind, shape, probes_
        self.wide = max(1, int(np.prod(shape)) * GROUP // max(1, n))  # buckets of a group
        self.groups = -(-int(np.prod(shape)) // self.wide)

    def rows(self, slot: np.ndarray, row: np.ndarray, code: np.ndarray, kind: int, ids: np.ndarray, x: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        """A row per slot from (slot, row, code) entries: its vectors once, with the codes of each."""
        order = np.lexsort((code, row, slot) if kind else (row, code, slot))
        slot, row, code = slot[order], row[order], code[order]
        cuts = np.flatnonzero(np.diff(slot, prepend=-1))
        columns: list[list] = [[], [], [], [], []]
        for a, b in zip(cuts, np.append(cuts, len(slot))[1:], strict=True):
            new = np.flatnonzero(np.diff(row[a:b], prepend=-1)) if kind else np.arange(b - a)
            own = row[a:b][new]
            counts = np.diff(np.append(new, b - a)).astype(np.int32)
            for column, value in zip(columns, (ids[own], x[own].astype(self.kind), bounds[own] if kind else bounds[:0], code[a:b], counts), strict=True):
                column.append(value.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(slot[cuts]), pa.array(np.full(len(cuts), kind, np.int32)), *(pa.array(c, pa.binary()) for c in columns)], names=[f.split()[0] for f in _DEALT.split(", ")])

    def coded(self, entries: DataFrame) -> DataFrame:
        """(rep, vec, codes): the buckets of every entry, one of each table."""

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, DEALT):
                    rows = batch.slice(at, DEALT)
                    turned = unit(matrix(rows.column("vec"), self.dim), self.largest)
                    codes = np.stack([buckets(turned, t, self.shape) for t in range(TABLES)], axis=1)
                    yield pa.RecordBatch.from_arrays([rows.column("rep"), rows.column("vec"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["rep", "vec", "codes"])

        return entries.select("rep", "vec").mapInArrow(code, "rep long, vec array<double>, codes binary")

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return np.arange(TABLES) * self.groups + codes // self.wide

    def points(self, coded: DataFrame) -> DataFrame:
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, ids, codes in _batched(batches, ("rep", "codes"), self.dim):
                codes = np.frombuffer(b"".join(codes), np.int64).reshape(-1, TABLES)
                slots = self._slots(codes)
                for t in range(TABLES):
                    yield self.rows(slots[:, t], np.arange(len(x)), codes[:, t], 0, ids, x, np.zeros(0))

        return coded.mapInArrow(deal, _DEALT)

    def queries(self, queries: DataFrame, low: int, high: int) -> DataFrame:
        """Queries (rep, vec, bound) with their probes from low to high."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, ids, bounds in _batched(batches, ("rep", "bound"), self.dim):
                for a in range(0, len(x), 256):
                    turned = unit(x[a : a + 256], None)
                    for t in range(TABLES):
                        code = probes(turned, t, self.shape, self.probes)[:, low:high]
                        if code.size:
                            row = np.repeat(np.arange(len(code)), code.shape[1])
                            yield self.rows(t * self.groups + code.ravel() // self.wide, row, code.ravel(), 1, ids[a : a + 256], x[a : a + 256], bounds[a : a + 256])

        return queries.select("rep", "vec", "bound").mapInArrow(deal, _DEALT)

    def hot(self, coded: DataFrame) -> DataFrame:
        """(slot, parts) of the slots that are too large for one task."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.int64).reshape(-1, TABLES)
                slot, n = np.unique(self._slots(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], names=["slot", "n"])

        sums = coded.select("codes").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        return sums.where(F.col("n") > BLOCK).select("slot", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))

    def found(self, points: DataFrame, queries: DataFrame, hot: DataFrame | None, k: int) -> DataFrame:
        """(query, rep, score) of pairs that meet in a bucket: per group and query the k best that are not below its bound.

        Points of a slot stand before its queries in the stream; a hot slot's are dealt to parts, and its queries go to each.
        """
        if hot is None:
            parted = [d.withColumn("part", F.lit(0)) for d in (points, queries)]
        else:
            with_parts = [d.join(hot, "slot", "left").withColumn("parts", F.coalesce("parts", F.lit(1))) for d in (points, queries)]
            parted = [with_parts[0].withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int")), with_parts[1].withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))]
            parted = [d.drop("parts") for d in parted]
        columns = ["slot", "part", "kind", "ids", "vectors", "bounds", "codes", "counts"]
        stream = parted[0].select(columns).unionByName(parted[1].select(columns)).repartition("slot", "part").sortWithinPartitions("slot", "part", "kind")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, ready = None, [], None
            for batch in batches:
                for i in range(batch.num_rows):
                    slot, part, kind = (batch.column(c)[i].as_py() for c in ("slot", "part", "kind"))
                    ids, bounds, codes, counts = (np.frombuffer(batch.column(c)[i].as_buffer(), d) for c, d in (("ids", np.int64), ("bounds", np.float64), ("codes", np.int64), ("counts", np.int32)))
                    x = np.frombuffer(batch.column("vectors")[i].as_buffer(), self.kind).reshape(-1, self.dim)
                    if (slot, part) != at:
                        at, held, ready = (slot, part), [], None
                    if kind == 0:
                        held.append((codes.copy(), ids.copy(), x.copy()))
                        continue
                    if ready is None and held:
                        all_codes, all_ids, all_x = (np.concatenate(z) for z in zip(*held, strict=True))
                        order, held = np.argsort(all_codes, kind="stable"), []
                        ready = all_codes[order], all_ids[order], all_x[order]
                    if ready is not None:
                        yield from self.meet(*ready, ids, x, bounds, codes, counts, k)

        return stream.mapInArrow(search, _FOUND)

    def meet(self, codes, ids, x, q_ids, q, bounds, wanted, counts, k: int) -> Iterator[pa.RecordBatch]:
        low, high = np.searchsorted(codes, wanted, "left"), np.searchsorted(codes, wanted, "right")
        of, size = np.repeat(np.arange(len(q)), counts), high - low
        ends = np.cumsum(size)
        out = []
        a = 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            n = size[a:b]
            r = np.repeat(of[a:b], n)
            c = np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            score = (q[r].astype(np.float64) * x[c].astype(np.float64)).sum(axis=1)
            keep = score >= bounds[r]
            out.append((q_ids[r[keep]], ids[c[keep]], score[keep]))
            a = b
        found = best(*(np.concatenate(z) for z in zip(*out, strict=True)), k) if out else ()
        if len(found) and len(found[0]):
            yield _told(*found)


def _exact(entries: DataFrame, wanted: DataFrame, dim: int, k: int) -> DataFrame | None:
    """The k best of all entries for each wanted query (rep, vec), in blocks of at most about EXACT_BLOCK queries."""
    n, out = wanted.count(), None
    blocks = -(-n // EXACT_BLOCK)
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("rep"), F.lit(blocks)) == b).toArrow()
        sent = wanted.sparkSession.sparkContext.broadcast((rows.column("rep").to_numpy(), matrix(rows.column("vec").combine_chunks(), dim)))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for batch in batches:
                rep, x = batch.column("rep").to_numpy(), matrix(batch.column("vec"), dim)
                for a in range(0, len(x), 2048):
                    r, c, score = products(q, x[a : a + 2048], k)
                    held = best(*(np.concatenate(z) for z in zip(held, (ids[r], rep[a + c], score), strict=True)), k)
            yield _told(*held)

        found = entries.select("rep", "vec").mapInArrow(scan, _FOUND)
        out = found if out is None else out.union(found)
    return out


def _fit(entries: DataFrame, searched: DataFrame, dim: int, n: int, largest: float, kind: type, k: int) -> Layout | None:
    """The layout that CALIBRATION queries, chosen by hash, ask for; their true neighbours are found by one pass over all entries."""
    sample = tables.written(searched.orderBy(F.xxhash64("rep"), "rep").limit(CALIBRATION), "calibration")
    true = _exact(entries, sample, dim, k + 1)
    if true is None:
        return Layout(n, dim, largest, kind, (2,), 2)
    first = W.partitionBy("query").orderBy(F.desc("score"), "rep")
    true = true.groupBy("query", "rep").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(first)).where((F.col("n") <= k + 1) & (F.col("query") != F.col("rep")))
    near = true.join(entries.select("rep", "vec"), "rep").select("query", "vec").toArrow()  # CALIBRATION x (k + 1) rows at most
    rows = sample.toArrow()
    place = {rep: i for i, rep in enumerate(rows.column("rep").to_pylist())}
    of = np.array([place[q] for q in near.column("query").to_pylist()], np.int64)
    x = matrix(near.column("vec").combine_chunks(), dim) if len(of) else np.zeros((0, dim))
    found = fitted(matrix(rows.column("vec").combine_chunks(), dim), x, of, n, largest)
    return Layout(n, dim, largest, kind, *found) if found else None


def search(vectors: DataFrame, query_ids: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20) -> DataFrame:
    """Each query's k nearest rows found, its own left out: (query_id, rank, vec_id, score), from rank 1; ties go to the smaller id.

    query_ids has a column query_id of ids of vectors. Every other row is a candidate; queries for which the tables find fewer than k rows are
    held against all rows, so each gets k, or all there are; so are all queries, if no tables are found that reach TARGET with MOST_PROBES. Rows with a null id, a null or zero vector, or null or non-finite components
    take no part, nor do vectors of another length than the most frequent one. Repeated rows count once; if an id has several vectors,
    its best counts. An empty table gives no rows. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    v = F.col("vec")
    kind = np.float32 if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & v.isNotNull())
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0].dim
    rows = rows.where(F.size("vec") == dim)
    ids = rows.distinct().withColumn("n", F.row_number().over(W.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = ids.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).orderBy(F.col("ids")[0], "vec")
    entries = tables.written(entries.withColumn("rep", F.monotonically_increasing_id()), "vectors")  # numbered in the order of their smallest ids
    n, largest = entries.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()
    asked = rows.join(query_ids.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi").distinct()
    asked = tables.written(asked.join(entries.select("rep", "vec"), "vec").select("id", "rep", "vec"), "queries")
    searched = asked.select("rep", "vec").distinct()
    def ranked(found: DataFrame) -> DataFrame:
        """(query_id, vec_id, score, rank) with ids in the place of entries."""
        nearest = W.partitionBy("query").orderBy(F.desc("score"), "rep")  # entries are in the order of their smallest ids, so no more than k + 1 can count
        found = found.groupBy("query", "rep").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1).drop("n")
        ids = found.join(entries.select("rep", "ids"), "rep").select("query", F.explode("ids").alias("vec_id"), "score")
        first = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        ids = ids.groupBy("query", "vec_id").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
        each = ids.join(asked.select(F.col("id").alias("query_id"), F.col("rep").alias("query")), "query").where("vec_id <> query_id")
        each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    layout = _fit(entries, searched, dim, n, largest, kind, k)
    if layout is None:  # no tables find enough: all queries are held against all rows, once
        return ranked(_exact(entries, searched, dim, k + 1)).select("query_id", "rank", "vec_id", "score")
    coded = tables.written(layout.coded(entries), "coded")
    hot = tables.written(layout.hot(coded), "hot-slots")
    n_hot = hot.count()
    hot = None if not n_hot else F.broadcast(hot) if n_hot <= BROADCAST_GROUPS else hot
    first = max(1, round(layout.probes * FIRST))
    unbound = searched.withColumn("bound", F.lit(float("-inf")))
    found = tables.written(layout.found(layout.points(coded), layout.queries(unbound, 0, first), hot, k + 1), "found")
    if layout.probes > first:
        nearest = W.partitionBy("query").orderBy(F.desc("score"), "rep")
        bounds = found.distinct().withColumn("n", F.row_number().over(nearest)).where(F.col("n") == k + 1).select(F.col("query").alias("rep"), F.col("score").alias("bound"))
        bound = searched.join(bounds, "rep", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        rest = layout.found(layout.points(coded), layout.queries(tables.written(bound, "bounds"), first, layout.probes), hot, k + 1)
        found = found.unionByName(tables.written(rest, "found"))

    result = tables.written(ranked(found), "nearest")
    most = rows.select("id").distinct().limit(k + 1).count() - 1
    counts = result.groupBy(F.col("query_id").alias("id")).count()
    short = asked.join(counts, "id", "left").where(F.coalesce("count", F.lit(0)) < min(k, most))
    short = tables.written(short.select("rep", "vec").distinct(), "short")
    rest = _exact(entries, short, dim, k + 1)
    if rest is not None:
        again = asked.join(short.select("rep"), "rep", "left_semi").select(F.col("id").alias("query_id")).distinct()
        full = ranked(rest).join(again, "query_id", "left_semi")
        result = result.join(again, "query_id", "left_anti").unionByName(full)
    return result.select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = tables.read(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id")))


QUERIES = {"op5_nearest": op5_nearest}
ORACLES: dict[str, str] = {}
