"""Token counts of fields and sections by offset-mapped attribution.

The fields of a document are joined and encoded once, whole, so counts add up to what a model will see; encoding sections one by one would not.
Every token's span follows from the byte length of its vocabulary entry. An interval join, within the document, of token spans with
section spans attributes tokens; a token that crosses a boundary goes where RULES says.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: first: the section of the token's first byte; last: of its last byte; most: that with most of its bytes, the earlier on a tie; shared: each in proportion to bytes.
RULES = ("first", "last", "most", "shared")
_encoders: dict[int, tuple] = {}


def encoder(vocabulary: bytes, pattern: str):
    """(encoding, byte length of each token), made once per Python worker."""
    key = hash((vocabulary, pattern))
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        lengths[list(ranks.values())] = [len(x) for x in ranks]
        _encoders[key] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[key]


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section, for token ends and section bounds in bytes from 0 to the same last one; sections without bytes get none."""
    n = len(bounds) - 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    if rule in ("first", "last"):
        at = starts if rule == "first" else ends - 1
        return np.bincount(np.searchsorted(bounds, at, "right") - 1, minlength=n).astype(float)
    low, high = np.searchsorted(bounds, starts, "right") - 1, np.searchsorted(bounds, ends - 1, "right") - 1
    out = np.bincount(low[low == high], minlength=n).astype(float)
    for s, e, a, b in zip(*(x[low != high].tolist() for x in (starts, ends, low, high)), strict=True):
        parts = np.minimum(bounds[a + 1 : b + 2], e) - np.maximum(bounds[a : b + 1], s)
        if rule == "shared":
            out[a : b + 1] += parts / (e - s)
        else:
            out[a + int(parts.argmax())] += 1
    return out


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), joint: str = "\n", by_line: bool = True, rule: str = "first", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """A row per section of each document: (doc_id, field, section, start_char, end_char, n_tokens, doc_tokens).

    Sections are the fields or, with by_line, their lines; a line break belongs to the line that it ends, the joint to the field before it. section counts from
    0 through the document; start_char and end_char are its bounds in characters of the joined text. n_tokens is whole but under `shared`.
    A null field counts as empty and is one section of no character but its joint; a document without any text has sections without tokens. Special
    tokens' strings are ordinary text. Null ids are kept. Repeated documents get their rows each time. An empty table gives no rows; extra columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # the vocabulary file, some MB
    kept = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)])

    def sections(values: list[str | None]) -> tuple[str, list[int], list[int]]:
        """(joined text, field of each section, characters in each)."""
        text, of, sizes = [], [], []
        for i, value in enumerate(values):
            value = (value or "") + (joint if i + 1 < len(values) else "")
            lines = [x + "\n" for x in value.split("\n")[:-1]] + [x for x in value.split("\n")[-1:] if x or "\n" not in value] if by_line else [value]
            of += [i] * len(lines)
            sizes += map(len, lines)
            text.append(value)
        return "".join(text), of, sizes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding, lengths = encoder(sent.value, pattern)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[1:]]
            for low in range(0, batch.num_rows, 500):
                doc, field, number, start, end, tokens, total = ([] for _ in range(7))
                for r in range(low, min(low + 500, batch.num_rows)):
                    text, of, sizes = sections([c[r] for c in columns])
                    ends = np.cumsum(lengths[coding.encode_ordinary(text)]) if text else np.zeros(0, np.int64)
                    chars = np.concatenate([[0], np.cumsum(sizes)])
                    codes = np.frombuffer(text.encode(), np.uint8)
                    places = np.append(np.flatnonzero((codes & 0xC0) != 0x80), len(codes))
                    doc += [r] * len(of)
                    field += of
                    number += range(len(of))
                    start.append(chars[:-1])
                    end.append(chars[1:])
                    tokens.append(attribute(ends, places[chars], rule))
                    total += [len(ends)] * len(of)
                if not doc:
                    continue
                n = pa.array(np.concatenate(tokens)) if rule == "shared" else pa.array(np.concatenate(tokens).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array([fields[f] for f in field], pa.string()), pa.array(number, pa.int32()), pa.array(np.concatenate(start), pa.int64()), pa.array(np.concatenate(end), pa.int64()), n, pa.array(total, pa.int64())], names=["doc_id", "field", "section", "start_char", "end_char", "n_tokens", "doc_tokens"])

    kind = "double" if rule == "shared" else "long"
    return kept.mapInArrow(count, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, field string, section int, start_char long, end_char long, n_tokens {kind}, doc_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents."""
    return count_tokens(tables.read(spark, sf_dir, "documents")).drop("field")


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
