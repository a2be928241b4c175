"""Chunks, vectors, sources, citations and history for answering questions from documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import trim_white

# --- chunks


def fixed_windows(text: Column, size: int = 400, step: int = 280) -> Column:
    """Overlapping windows of characters that start every step; none for empty text."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def token_windows(tokens: Column, size: int = 874, overlap: int = 50) -> Column:
    """Windows of tokens; the last is the first that reaches the end."""
    n = F.size(tokens)
    last = F.greatest(F.lit(0), F.ceil((n - size) / (size - overlap)).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * (size - overlap) + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Recursive splitting: at the first separator that occurs, pieces too long with the ones after it; short pieces are put together again up to size, sharing at most overlap."""
    here = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, rest = separators[here], separators[here + 1 :]
    pieces = list(text) if mark == "" else [p for i, p in enumerate((mark + x if i else x for i, x in enumerate(text.split(mark)))) if p]
    out: list[str] = []
    held: list[str] = []
    total = 0

    def emit() -> None:
        if joined := "".join(held).strip():
            out.append(joined)

    for piece in pieces:
        if len(piece) >= size:
            emit()
            held, total = [], 0
            out += split_text(piece, size, overlap, rest) if rest else [piece]
            continue
        if total + len(piece) > size and held:
            emit()
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    emit()
    return out


# Where texts are split, and the length of chunks that are left out.
SEPARATORS, SHORTEST = ("\n\n", "\n", " ", ""), 20


def recursive_chunks(size: int = 400, overlap: int = 120, separators: tuple[str, ...] = SEPARATORS, shortest: int = SHORTEST):
    """A vectorised function text -> chunks of more than shortest characters."""

    @F.pandas_udf("array<string>")
    def chunks(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [c for c in split_text(t, size, overlap, separators) if len(c.strip()) > shortest] if t else [])

    return chunks


@F.udtf(returnType="chunk_index int, chunk_text string")
class SplitChunks:
    """recursive_chunks as a table function, with the longest chunk and the longest overlap as arguments: a row per chunk, numbered from 0."""

    def eval(self, text: str, size: int, overlap: int):
        found = split_text(text, size, overlap, SEPARATORS) if text else []
        for i, chunk in enumerate(c for c in found if len(c.strip()) > SHORTEST):
            yield i, chunk


def number_chunks(docs: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    """A row per chunk with a dense chunk_index from 0."""
    return docs.select(*keep, F.posexplode(chunks).alias("chunk_index", "chunk_text"))


# --- vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine distance, in double precision; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hashing_embedder(dim: int = 64, prefix: str = ""):
    """A deterministic stand-in for an embedding model: normalised sums of signed word hashes, loaded once per worker. Only texts without words have a zero vector."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            out = np.zeros((len(series), dim))
            for i, text in enumerate(series):
                words = (prefix + (text or "")).lower().split()
                for w in words:
                    h = zlib.crc32(w.encode())
                    out[i, h % dim] += 1 if h >> 31 else -1
                if words and not out[i].any():  # they cancel each other: all of them count as one
                    out[i, zlib.crc32(" ".join(words).encode()) % dim] = 1
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.Series(list((out / np.where(norm > 0, norm, 1)).astype(np.float32)))

    return embed


#: Numbers in the query vectors that are sent to all chunks at once, and scores that are held at a time.
BLOCK_NUMBERS, HELD_SCORES = 1_000_000, 1_000_000


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the vectors that have so many numbers, all finite, and a length, as unit vectors; which rows these are)."""
    lists = vectors.cast(pa.list_(pa.float64()))
    own = pc.fill_null(pc.equal(pc.list_value_length(lists), width), False).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(own)
    m = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(rows) else np.zeros((0, width))
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    good = np.isfinite(length) & (length > 0)
    return m[good] / length[good, None], rows[good]


def _best(scores: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best scores of each row that are not below its floor, ties to the first column; -inf is never among them."""
    if scores.shape[1] <= k:
        return np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
    above, tied = scores > least, (scores == least) & (least > -np.inf)
    free = k - above.sum(axis=1, keepdims=True)
    if (tied.sum(axis=1, keepdims=True) > free).any():
        tied &= np.cumsum(tied, axis=1) <= free
    return np.nonzero((above | tied) & (scores >= floor[:, None]))


def _first(rows: pa.Table, k: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(the k best rows of each query by score, ties to the smaller chunk; the queries that have as many, and the least score of each)."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("__q", "ascending"), ("score", "descending"), ("chunk_id", "ascending")], null_placement="at_start")).combine_chunks()
    q = rows.column("__q").to_numpy()
    starts = np.flatnonzero(np.diff(q, prepend=-1))
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    last = np.flatnonzero(place == k - 1)
    return rows.filter(pa.array(place < k)), q[last], rows.column("score").to_numpy()[last]


def _scored(chunks: DataFrame, block: pa.Table, width: int, k: int, scope: str | None, others: bool, digits: int | None) -> DataFrame:
    """Chunks with query_id and score, the best k of each task for each query of a block, as one matrix product a batch. What a task holds are so many rows for each query, twice."""
    matrix, rows = _matrix(block.column("vec").combine_chunks() if block.num_rows else pa.array([], block.schema.field("vec").type), width)
    ids = block.column("query_id").take(pa.array(rows)).combine_chunks()
    scopes = block.column(scope).take(pa.array(rows)).to_pylist() if scope else None
    sent = chunks.sparkSession.sparkContext.broadcast((matrix, ids, scopes))
    kept = [c for c in chunks.columns if c != "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, ids, scopes = sent.value
        groups: dict = {None: np.arange(len(asked))}
        if scopes is not None:
            groups = {}
            for i, x in enumerate(scopes):
                if x is not None:
                    groups.setdefault(x, []).append(i)
        step = max(1, HELD_SCORES // max(1, len(asked)))
        held: list[pa.Table] = []  # the best so far, then what may be better
        floor, n = np.full(len(asked), -np.inf), 0
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("chunk_id"), null_placement="at_start"))
            units, places = _matrix(batch.column("vec"), width)
            members: dict = {None: np.arange(len(places))}
            if scope:
                members = {}
                for i, x in enumerate(batch.column(scope).take(pa.array(places)).to_pylist()):
                    members.setdefault(x, []).append(i)
            for group in groups.keys() & members.keys():
                queries, own = np.asarray(groups[group]), np.asarray(members[group])
                for low in range(0, len(own), step):
                    some = own[low : low + step]
                    score = asked[queries] @ units[some].T
                    if digits is not None:
                        score = np.round(score, digits)
                    told = pa.array(places[some])
                    if others:
                        mine, theirs = ids.take(pa.array(queries)).to_numpy(zero_copy_only=False), batch.column("chunk_id").take(told).to_numpy(zero_copy_only=False)
                        score[mine[:, None] == theirs[None, :]] = -np.inf
                    q, c = _best(score, k, floor[queries])
                    taken = batch.select(kept).take(told.take(pa.array(c)))
                    held.append(pa.Table.from_arrays([*taken.columns, pa.array(queries[q]), pa.array(score[q, c])], names=[*kept, "__q", "score"]))
                    n += len(q)
                    if n > 2 * k * len(asked):
                        best, full, least = _first(pa.concat_tables(held), k)
                        held, n = [best], best.num_rows
                        floor[full] = least
        if n:
            best = _first(pa.concat_tables(held), k)[0]
            named = pa.Table.from_arrays([*best.select(kept).columns, ids.take(best.column("__q").combine_chunks()), best.column("score")], names=[*kept, "query_id", "score"])
            yield from named.combine_chunks().to_batches(max_chunksize=10_000)

    schema = StructType([*[f for f in chunks.schema if f.name != "vec"], StructField("query_id", from_arrow_type(ids.type)), StructField("score", DoubleType())])
    # One task a core: each sends k rows for every query, however many chunks it reads.
    return chunks.coalesce(max(1, chunks.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, schema)


def top_k(queries: DataFrame, chunks: DataFrame, *, k: int = 20, threshold: float | None = 0.45, fallback: bool = True, scope: str | None = None, others: bool = False, digits: int | None = None) -> DataFrame:
    """The k most similar chunks of each query (query_id, vec) among chunks (chunk_id, vec), by cosine, ties to the smaller id.

    Only scores of at least threshold count; with fallback, a query that has none gets its best k all the same. With scope (a project, say) a query sees only the chunks of its own; null is nobody's.
    With others, an entry does not answer itself; digits rounds scores before they are ranked. Vectors that are null or zero, or hold nulls or what is not finite, or are not as long as the longest query take
    no part. Queries are sent to the chunks in blocks of so many numbers as BLOCK_NUMBERS; chunks stay where they are, and only the best of every task are shuffled.
    """
    asked = queries.select("query_id", "vec", *([scope] if scope else []))
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    blocks = max(1, -(-n * max(width, 1) // BLOCK_NUMBERS))
    parts = [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else asked for i in range(blocks)]
    scored = reduce(DataFrame.unionByName, [_scored(chunks, part.toArrow(), max(width, 1), k, scope, others, digits) for part in parts])
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    if threshold is not None:
        kept = F.col("score") >= threshold
        if fallback:
            kept = kept | (F.max("score").over(W.partitionBy("query_id")) < threshold)
        ranked = ranked.withColumn("__kept", kept).where("__kept").drop("__kept")
    return ranked


# --- chunks by project

#: Folders that a store's projects are dealt to.
SHELVES = 64


def _shelf(project: Column) -> Column:
    return F.pmod(F.xxhash64(project), F.lit(SHELVES)).cast("int")


def store_chunks(chunks: DataFrame, path: str) -> None:
    """Adds chunks (project_id, chunk_id, vec, ...) to a store: folders by a hash of the project, in each of them sorted by project so that row groups hold few."""
    shelved = chunks.withColumn("shelf", _shelf(F.col("project_id")))
    shelved.repartition("shelf", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).sortWithinPartitions("shelf", "project_id").write.mode("append").partitionBy("shelf").parquet(path)


def stored_chunks(store: DataFrame, queries: DataFrame) -> DataFrame:
    """The chunks of a store on the shelves that the projects of queries are on: other folders are not read. At most SHELVES numbers go to the driver."""
    needed = [x.shelf for x in queries.where(F.col("project_id").isNotNull()).select(_shelf(F.col("project_id")).alias("shelf")).distinct().collect()]
    return store.where(F.col("shelf").isin(needed)).drop("shelf")


def search_projects(store: DataFrame, queries: DataFrame, **how) -> DataFrame:
    """top_k of queries (query_id, project_id, vec) among the chunks of their own projects."""
    return top_k(queries, stored_chunks(store, queries), scope="project_id", **how)


def retyped(chunks: DataFrame, size: int, vec: str = "embedding") -> DataFrame:
    """chunks with vectors of another size taken out, so that they are embedded anew: what is left when the vector column gets another type."""
    return chunks.withColumn(vec, F.when(F.size(vec) == size, F.col(vec)))


# --- sources, prompts, citations


def text_name(text: Column, longest_dropped: int = 40) -> Column:
    """What tells a stripped text from all others; null for one of at most so many characters, which is no source."""
    return F.when(F.length(trim_white(text)) > longest_dropped, F.unhex(F.sha2(trim_white(text), 256)))


def distinct_chunks(found: DataFrame, longest_dropped: int = 40) -> DataFrame:
    """Per query the first of equal stripped texts of more than so many characters, numbered source 1.. in rank order. Where found has the names of its texts (name, by text_name), no text moves."""
    if "name" in found.columns:
        rows = found.where(F.col("name").isNotNull())
    else:
        rows = found.withColumns({"text": trim_white(F.col("text")), "name": text_name(F.col("text"), longest_dropped)}).where(F.col("name").isNotNull())
    rows = rows.withColumn("__n", F.row_number().over(W.partitionBy("query_id", "name").orderBy("rank"))).where("__n = 1").drop("__n")
    rows = rows.withColumn("source", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    return rows if "name" in found.columns else rows.drop("name")


#: Ids (8 bytes each) that may be broadcast to pick texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def with_texts(sources: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """sources (doc_id, name, ...) with their stripped texts. ids has the ids (doc_id) that are asked for, once each: texts of no other documents move, and none is sorted."""
    if ids.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    texts = docs.select("doc_id", trim_white(F.col("text")).alias("text"), text_name(F.col("text")).alias("name"))
    return texts.join(sources.hint("shuffle_hash"), ["doc_id", "name"])


def sources_block(sources: DataFrame, with_file: bool = False) -> DataFrame:
    """(query_id, block): every source under its mark, in order; a source that is there twice counts once."""
    head = F.concat(F.lit("[S"), F.col("source"), F.lit("]"), *([F.lit(" ("), F.col("file_name"), F.lit(", "), F.col("chunk_index"), F.lit(")")] if with_file else []))
    rows = sources.select("query_id", F.struct("source", F.concat(head, F.lit("\n"), F.col("text"), F.lit("\n\n")).alias("part")).alias("row"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.array_distinct(F.collect_list("row"))), lambda r: r["part"]), "").alias("block"))


def history_block(messages: DataFrame, thread: str, order: str, role: str, content: str, *, newest: int = 10, shown: int = 5) -> DataFrame:
    """(thread, block): the last messages as ROLE: content, oldest first."""
    last = messages.withColumn("__n", F.row_number().over(W.partitionBy(thread).orderBy(F.desc(order)))).where(F.col("__n") <= min(newest, shown))
    rows = last.select(thread, F.struct(order, F.concat(F.upper(role), F.lit(": "), F.coalesce(content, F.lit(""))).alias("line")).alias("row"))
    return rows.groupBy(thread).agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["line"]), "\n").alias("block"))


def prompt(question: Column, sources: Column, history: Column, template: str = "Sources:\n%s\nHistory:\n%s\nQuestion: %s\nAnswer:", no_history: str = "(Chưa có)") -> Column:
    return F.format_string(template, F.coalesce(sources, F.lit("")), F.coalesce(F.nullif(history, F.lit("")), F.lit(no_history)), question)


def cited(answer: Column, sources: Column) -> Column:
    """The sources (structs with source and score) whose mark stands in the answer, scores to four digits."""
    marked = F.transform(sources, lambda s: s.withField("source_marker", F.concat(F.lit("S"), s["source"])).withField("relevance_score", F.round(s["score"], 4)))
    return F.filter(marked, lambda s: F.contains(answer, F.concat(F.lit("["), s["source_marker"], F.lit("]"))))


def marks(answer: Column) -> Column:
    """Numbers of the sources that an answer marks, in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"(?i)\[s(\d+)\]"), 1), lambda x: x.cast("int"))
