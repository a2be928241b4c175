"""Secrets in texts: three rules, and a convolutional network over characters for what the rules leave.

Rules find the base spans. Candidates are all runs of characters that secrets are made of, long enough and with a digit, or very long. Those that a base
span covers are labelled findings; all distinct ones, and all of those that no rule covers, train the network, a
quarter held out. On that quarter its probabilities are calibrated by a temperature, and each kind's threshold is the highest, within bounds, that still finds
the wanted share of its held-out findings. Every candidate outside the base spans is then scored with the characters around it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .words import buffers, pieces

# Kinds in the order in which they are listed, and the rules; the first is held against lower-cased bytes, of which only A-Z change.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
LEAST_VALUE = 6
SECRET = np.zeros(256, bool)
SECRET[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", np.uint8)] = True

#: Bytes of a candidate with a digit at least, and of one without.
LEAST, LEAST_WITHOUT_DIGIT = 8, 20
#: Bytes of context on either side, and of a candidate seen at a time; longer ones are seen in several parts, the most secret of which counts.
CONTEXT, SEEN = 24, 64
WINDOW = CONTEXT + SEEN + CONTEXT
#: Distinct first parts of candidates that examples() gives at most of every kind and of none.
SAMPLE = 8_000
#: Distinct first parts that train in one group, and steps in which thresholds are found where there are more.
GROUP, STEPS = 16_000, 10_000
#: Filters, bytes that each spans, rounds of training, and share of held-out findings of a kind to find.
FILTERS, WIDTH, EPOCHS, RECALL = 32, 5, 6, 0.98
#: Bounds of a threshold: below the one a span is likelier none, at the other it is surely one, be the known findings surer still.
LEAST_THRESHOLD, MOST_THRESHOLD = 0.5, 0.9


class Model(NamedTuple):
    """filters by (byte of a filter's span, code, filter); codes are 0 for nothing, else an ASCII byte or 127, plus 128 within the candidate. recall is that of each kind on held-out findings; a kind without some has threshold 2."""

    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    temperature: float
    thresholds: np.ndarray
    recall: np.ndarray


def base_spans(joined: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of all matches of the rules, in order. Texts are told apart by a zero byte, which no rule spans."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(joined.lower()) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), kind, m.end()) for kind, rule in ((1, ACCESS), (2, HEX)) for m in rule.finditer(joined)]
    return sorted(found)


def candidates(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) in bytes of the runs of secrets' characters, without dots at their ends, that are long enough."""
    own = np.concatenate([[False], SECRET[data], [False]])
    edges = np.flatnonzero(own[1:] != own[:-1])
    starts, ends = edges[::2], edges[1::2]
    some = ends - starts >= LEAST
    starts, ends = starts[some], ends[some]
    solid = np.flatnonzero(data != ord("."))
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    some = low <= high
    starts, ends = solid[low[some]], solid[high[some]] + 1
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    some = ((digits[ends] > digits[starts]) & (ends - starts >= LEAST)) | (ends - starts >= LEAST_WITHOUT_DIGIT)
    return starts[some], ends[some]


def parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of every part of every candidate in a row of WINDOW, number of its candidate); texts lie between low and high."""
    n = -(-(ends - starts) // SEEN)
    of = np.repeat(np.arange(len(starts)), n)
    first = starts[of] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * SEEN
    out = np.zeros((len(of), WINDOW), np.uint8)
    for a in range(0, len(of), 8192):  # a very long text may be one candidate
        some = of[a : a + 8192]
        at = first[a : a + 8192, None] - CONTEXT + np.arange(WINDOW)
        past = np.minimum(first[a : a + 8192] + SEEN, ends[some])
        seen = (at >= low[some, None]) & (at < np.minimum(past + CONTEXT, high[some])[:, None])
        codes = np.where(seen, np.clip(data[np.where(seen, at, 0)], 1, 127), 0)
        out[a : a + 8192] = codes + 128 * (seen & (at >= starts[some, None]) & (at < ends[some, None]))
    return out, of


def activations(filters: np.ndarray, bias: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(row, place, filter) before the rectifier."""
    places = codes.shape[1] - len(filters) + 1
    out = np.broadcast_to(bias, (len(codes), places, len(bias))).copy()
    for o, table in enumerate(filters):
        out += table[codes[:, o : o + places]]
    return out


def logits(m: Model, codes: np.ndarray) -> np.ndarray:
    """One row for each row of codes: none of the kinds, then the kinds."""
    out = np.empty((len(codes), len(m.offset)), np.float32)
    for low in range(0, len(codes), 512):
        pooled = np.maximum(activations(m.filters, m.bias, codes[low : low + 512]).max(1), 0)
        out[low : low + 512] = pooled @ m.dense + m.offset
    return out


def probabilities(logit: np.ndarray, temperature: float) -> np.ndarray:
    x = logit / temperature
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def gradients(m: Model, codes: np.ndarray, kind: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the weighted cross entropy, by filters, bias, dense and offset."""
    act = activations(m.filters, m.bias, codes)
    place = act.argmax(1)
    rows = np.arange(len(codes))
    pooled = np.maximum(np.take_along_axis(act, place[:, None], 1)[:, 0], 0)
    p = probabilities(pooled @ m.dense + m.offset, 1.0)
    p[rows, kind] -= 1
    p *= (weight / weight.sum())[:, None]
    back = (p @ m.dense.T) * (pooled > 0)
    by_filter = np.zeros_like(m.filters)
    for o in range(len(m.filters)):
        np.add.at(by_filter[o], (codes[rows[:, None], place + o], np.arange(len(m.bias))[None]), back)
    return by_filter, back.sum(0), pooled.T @ p, p.sum(0)


def blank(codes: np.ndarray) -> np.ndarray:
    """The same without context, by which a value has to be known on its own."""
    return np.where(codes >= 128, codes, 0).astype(np.uint8)


def train(codes: np.ndarray, kind: np.ndarray, *, recall: float = RECALL, epochs: int = EPOCHS) -> Model:
    """kind is 0 for none, else 1 + place in KINDS. Rows are put in an order of their own first, so the model depends on nothing but their set.

    Rows of no kind may be secrets that no rule knows. Those that a first, short training takes for one are left out of the second, and of what calibrates it.
    """
    order = np.argsort([hashlib.md5(row.tobytes()).digest() for row in codes]) if len(codes) else np.zeros(0, int)
    codes, kind = codes[order], kind[order]
    held = np.arange(len(codes)) % 4 == 3
    early = fitted(codes[~held], kind[~held], 1)
    sure = (kind > 0) | (probabilities(logits(early, codes), 1.0)[:, 0] >= 0.5)
    codes, kind, held = codes[sure], kind[sure], held[sure]
    return calibrated(fitted(codes[~held], kind[~held], epochs), codes[held], kind[held], recall)


def fitted(codes: np.ndarray, kind: np.ndarray, epochs: int, start: Model | None = None, size: np.ndarray | None = None) -> Model:
    """The network after so many rounds, more for few rows, over the rows with and without their context; rare kinds weigh more.

    start has the weights to go on from, size the number of rows of each kind where these are but a part of all.
    """
    r = np.random.Generator(np.random.PCG64(7))
    n = 1 + len(KINDS)
    m = Model((r.normal(size=(WIDTH, 256, FILTERS)) * 0.1).astype(np.float32), np.zeros(FILTERS, np.float32), (r.normal(size=(FILTERS, n)) * 0.2).astype(np.float32), np.zeros(n, np.float32), 1.0, np.full(len(KINDS), 2.0), np.zeros(len(KINDS)))
    x, y = np.concatenate([codes, blank(codes)]), np.tile(kind, 2)
    size = np.bincount(y, minlength=n) if size is None else size
    weight = np.sqrt(size.max(initial=1) / np.maximum(size, 1))[y]
    weights = [np.array(w) for w in (start or m)[:4]]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs * max(1, 4_000 // max(1, len(x)))):
        for rows in np.array_split(r.permutation(len(x)), max(1, len(x) // 128)) if len(x) else []:
            step += 1
            for w, g, a, b in zip(weights, gradients(m._replace(filters=weights[0], bias=weights[1], dense=weights[2], offset=weights[3]), x[rows], y[rows], weight[rows]), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= 0.005 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)
    return m._replace(filters=weights[0], bias=weights[1], dense=weights[2], offset=weights[3])


def calibrated(m: Model, codes: np.ndarray, kind: np.ndarray, recall: float) -> Model:
    """The temperature of the least cross entropy over held-out rows, with one row of each kind taken for another, and each kind's threshold."""
    if not len(codes):
        return m
    logit, rows = logits(m, codes), np.arange(len(codes))
    wrong = 1 / (np.bincount(kind, minlength=len(m.offset)) + 2)[kind]

    def entropy(t: float) -> float:
        own = np.clip(probabilities(logit, t)[rows, kind], 1e-9, 1 - 1e-9)
        return -((1 - wrong) * np.log(own) + wrong * np.log(1 - own)).sum()

    temperature = min(np.geomspace(0.25, 8, 41), key=entropy)
    p = probabilities(logit, temperature)
    thresholds, found = m.thresholds.copy(), m.recall.copy()
    for k in range(len(KINDS)):
        own = np.sort(p[kind == k + 1, k + 1])
        if len(own):
            thresholds[k] = np.clip(own[int((1 - recall) * len(own))], LEAST_THRESHOLD, MOST_THRESHOLD)
            found[k] = (own >= thresholds[k]).mean()
    return m._replace(temperature=float(temperature), thresholds=thresholds, recall=found)


def rated(m: Model, codes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Kind of each of n candidates, 0 for none, from the rows of their parts: the kind that passes its threshold by most."""
    best = np.zeros((n, len(KINDS)))
    np.maximum.at(best, of, probabilities(logits(m, codes), m.temperature)[:, 1:])
    over = best - m.thresholds
    return np.where(over.max(1) >= 0, over.argmax(1) + 1, 0)


_SPANS = "array<struct<kind:int,start:long,end:long>>"


def _spans(kind: np.ndarray, start: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    values = pa.StructArray.from_arrays([pa.array(kind, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["kind", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: (doc_id, base, others, labelled, codes, part_of).

    base has the rules' spans (kind by place in KINDS; start and end in code points) by start and kind. others has the candidates that share nothing with them, in order and of kind -1;
    codes has the rows of their parts, on end, and part_of the number of the candidate of each. labelled has, for each candidate that a base span covers in part, its kind
    and its first part's row. A null text is empty. Null and repeated ids and repeated rows keep a row each; an empty table gives no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in pieces(batch.column(1)):
                yield _found(batch.column(0)[low:high], batch.column(1)[low:high])

    kept = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, base {_SPANS}, others {_SPANS}, labelled array<struct<kind:int,codes:binary>>, codes binary, part_of array<int>"
    return kept.mapInArrow(run, schema)


def _found(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    plain, bounds = buffers(texts)
    n = len(texts)
    low = bounds[:-1] + np.arange(n)  # a zero byte after each text
    high = low + np.diff(bounds)
    data = np.zeros(len(plain) + n, np.uint8)
    own = np.ones(len(data), bool)
    own[high] = False
    data[own] = plain
    spans = np.array(base_spans(data.tobytes()), np.int64).reshape(-1, 3)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    doc = np.searchsorted(high, spans[:, 0], "right")
    base = _spans(spans[:, 1], chars[spans[:, 0]] - chars[low[doc]], chars[spans[:, 2]] - chars[low[doc]], np.searchsorted(doc, np.arange(n + 1)))
    starts, ends = candidates(data)
    kind = np.full(len(starts), len(KINDS))  # the first listed of the kinds that cover a byte of it
    for k in range(len(KINDS) - 1, -1, -1):
        some = spans[spans[:, 1] == k]
        kind[np.searchsorted(some[:, 2], starts, "right") < np.searchsorted(some[:, 0], ends, "left")] = k
    doc = np.searchsorted(high, starts, "right")
    free = kind == len(KINDS)
    codes, of = parts(data, starts[free], ends[free], low[doc[free]], high[doc[free]])
    at = np.searchsorted(doc[free], np.arange(n + 1))
    others = _spans(np.full(free.sum(), -1), (chars[starts] - chars[low[doc]])[free], (chars[ends] - chars[low[doc]])[free], at)
    rows = np.searchsorted(of, at)
    first, _ = parts(data, starts[~free], np.minimum(ends[~free], starts[~free] + SEEN), low[doc[~free]], high[doc[~free]])
    labelled = pa.StructArray.from_arrays([pa.array(kind[~free], pa.int32()), pa.array([x.tobytes() for x in first], pa.binary())], ["kind", "codes"])
    number = of - at[np.searchsorted(at, of, "right") - 1] if len(of) else of
    columns = [
        ids, base, others, pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[~free], np.arange(n + 1)), pa.int32()), labelled),
        pa.array([codes[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:], strict=True)], pa.binary()), pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(number, pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "others", "labelled", "codes", "part_of"])


def distinct_parts(found: DataFrame) -> DataFrame:
    """(codes, kind) of all distinct first parts of candidates, as a written table; kind is len(KINDS) for none, and a row seen with several kinds counts as the first listed."""
    first = F.expr(f"filter(transform(sequence(1, greatest(size(part_of), 1)), i -> IF(size(part_of) > 0 AND (i = 1 OR part_of[i - 1] <> part_of[i - 2]), substring(codes, (i - 1) * {WINDOW} + 1, {WINDOW}), NULL)), x -> x IS NOT NULL)")
    rows = found.select(F.inline("labelled")).unionByName(found.select(F.lit(len(KINDS)).alias("kind"), F.explode(first).alias("codes")))
    return tables.written(rows.groupBy("codes").agg(F.min("kind").alias("kind")), "candidates")


def examples(found: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(codes, kind) of at most so many distinct first parts of each kind and of none, those of the smallest hashes, for who trains a network by hand; learned() takes all."""
    return _taken(distinct_parts(found), sample)


def _taken(distinct: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    taken = [r for k in range(len(KINDS) + 1) for r in distinct.where(F.col("kind") == k).orderBy(F.xxhash64("codes"), "codes").limit(sample).collect()]
    codes = np.frombuffer(b"".join(bytes(r.codes) for r in taken), np.uint8).reshape(-1, WINDOW)
    return codes, np.array([(r.kind + 1) % (len(KINDS) + 1) for r in taken], np.int64)


def _matrix(codes: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, WINDOW)


def _round(rows: DataFrame, start: Model, size: np.ndarray) -> Model:
    """The mean, by rows, of what the groups of rows (part, codes, kind) make of the network in a round of training each. Sums over groups are made in Spark, in the order of their numbers."""
    sent = rows.sparkSession.sparkContext.broadcast((start, size))

    def trained(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("codes")
        start, size = sent.value
        m = fitted(_matrix(table.column("codes").combine_chunks()), table.column("kind").to_numpy(), 1, start, size)
        return pa.table({"part": table.column("part")[:1], "n": pa.array([table.num_rows], pa.int64()), "weights": pa.array([(np.concatenate([w.ravel() for w in m[:4]]).astype(np.float64) * table.num_rows).tobytes()], pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = sum(np.frombuffer(w, np.float64) for w in table.column("weights").to_pylist())
        return pa.table({"part": table.column("part")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary())})

    schema = "part long, n long, weights binary"
    told = rows.groupBy("part").applyInArrow(trained, schema).groupBy(F.pmod("part", F.lit(16)).alias("sum")).applyInArrow(summed, schema).collect()
    told = sorted(told, key=lambda r: r.part)
    flat = (sum(np.frombuffer(bytes(r.weights), np.float64) for r in told) / sum(r.n for r in told)).astype(np.float32)
    ends = np.cumsum([w.size for w in start[:4]])
    return start._replace(**{name: part.reshape(w.shape) for name, part, w in zip(Model._fields, np.split(flat, ends[:-1]), start[:4], strict=False)})


def _sizes(rows: DataFrame) -> np.ndarray:
    out = np.zeros(1 + len(KINDS), np.int64)
    for r in rows.groupBy("kind").count().collect():
        out[r["kind"]] = r["count"]
    return out


def train_all(rows: DataFrame, n: int, *, recall: float = RECALL, epochs: int = EPOCHS) -> Model:
    """train() over all n rows (codes, kind) of a table, however many: groups of about GROUP rows train by themselves from the same weights, which are averaged after every round.

    Held-out rows are a quarter, by hash. What calibrates the network is summed over all of these: entropies in millionths, thresholds by counts of probabilities in steps of 1 / STEPS.
    """
    sc = rows.sparkSession.sparkContext
    groups = max(1, -(-n // GROUP))
    rows = rows.select("codes", "kind", F.pmod(F.xxhash64("codes"), F.lit(groups)).alias("part"), (F.pmod(F.xxhash64("codes", F.lit(1)), F.lit(4)) == 3).alias("held"))
    blank_model = fitted(np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), 0)
    own = rows.where(~F.col("held"))
    size = _sizes(own)
    early = sc.broadcast(_round(own, blank_model, size) if size.sum() else blank_model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities(logits(early.value, _matrix(batch.column("codes"))), 1.0)[:, 0] if batch.num_rows else np.zeros(0)
            yield batch.filter(pa.array((batch.column("kind").to_numpy() > 0) | (p >= 0.5)))

    sure = tables.written(rows.mapInArrow(judged, rows.schema), "examples")
    own, held = sure.where(~F.col("held")), sure.where("held")
    m, size = blank_model, _sizes(own)
    for _ in range(epochs if size.sum() else 0):
        m = _round(own, m, size)
    counts = _sizes(held)
    if not counts.sum():
        return m
    final, heats = sc.broadcast(m), np.geomspace(0.25, 8, 41)

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, logit = batch.column("kind").to_numpy(), logits(final.value, _matrix(batch.column("codes")))
            wrong = 1 / (counts + 2)[kind]
            for i, t in enumerate(heats):
                p = np.clip(probabilities(logit, t)[np.arange(len(kind)), kind], 1e-9, 1 - 1e-9)
                yield pa.RecordBatch.from_pydict({"heat": pa.array([i], pa.int64()), "cost": pa.array([int(np.round(-1e6 * ((1 - wrong) * np.log(p) + wrong * np.log(1 - p))).sum())], pa.int64())})

    costs = held.select("codes", "kind").mapInArrow(entropies, "heat long, cost long").groupBy("heat").agg(F.sum("cost").alias("cost")).collect()
    temperature = float(heats[min(costs, key=lambda r: (r.cost, r.heat)).heat])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            p = probabilities(logits(final.value, _matrix(batch.column("codes"))), temperature)[np.arange(len(kind)), kind]
            yield pa.RecordBatch.from_pydict({"kind": batch.column("kind").cast(pa.int64()), "step": pa.array(np.floor(p * STEPS), pa.int64())})

    thresholds, found = m.thresholds.copy(), m.recall.copy()
    told = held.where("kind > 0").select("codes", "kind").mapInArrow(steps, "kind long, step long").groupBy("kind", "step").count().collect()
    for k in range(len(KINDS)):
        by_step = np.zeros(STEPS + 2, np.int64)
        for r in told:
            if r["kind"] == k + 1:
                by_step[r["step"]] += r["count"]
        if n_own := by_step.sum():
            thresholds[k] = np.clip(np.searchsorted(np.cumsum(by_step), int((1 - recall) * n_own), "right") / STEPS, LEAST_THRESHOLD, MOST_THRESHOLD)
            found[k] = by_step[round(thresholds[k] * STEPS) :].sum() / n_own
    return m._replace(temperature=temperature, thresholds=thresholds, recall=found)


def learned(found: DataFrame) -> Model:
    """The network that all distinct first parts train: on the driver if they are at most GROUP, else in groups, all of them as well."""
    distinct = distinct_parts(found)
    n = distinct.count()
    return train(*_taken(distinct, n)) if n <= GROUP else train_all(distinct.select("codes", F.pmod(F.col("kind") + 1, F.lit(len(KINDS) + 1)).cast("long").alias("kind")), n)


def scan(found: DataFrame, model: Model) -> DataFrame:
    """(doc_id, base, spans, base_sha256): the rules' spans and, in spans, those that the network adds to them; both by start, kind and end. base_sha256 is that of base as `kind:start:end`, joined by commas."""
    sent = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                out = {"doc_id": part.column(0), "base": [], "spans": [], "base_sha256": []}
                for base, others, codes, of in zip(*(part.column(c).to_pylist() for c in ("base", "others", "codes", "part_of")), strict=True):
                    kinds = rated(sent.value, np.frombuffer(codes, np.uint8).reshape(-1, WINDOW), np.array(of, np.int64), len(others)) if others else []
                    added = [x | {"kind": int(k) - 1} for x, k in zip(others, kinds, strict=True) if k]
                    out["base"].append(base)
                    out["spans"].append(sorted([*base, *added], key=lambda x: (x["start"], x["kind"], x["end"])))
                    out["base_sha256"].append(hashlib.sha256(shown(base).encode()).hexdigest())
                kind = part.schema.field("base").type
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out["base"], kind), pa.array(out["spans"], kind), pa.array(out["base_sha256"], pa.string())], names=["doc_id", "base", "spans", "base_sha256"])

    return found.select("doc_id", "base", "others", "codes", "part_of").mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, base {_SPANS}, spans {_SPANS}, base_sha256 string")


def shown(spans: list[dict]) -> str:
    return ",".join(f"{KINDS[x['kind']]}:{x['start']}:{x['end']}" for x in spans)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the rules and of the network in all documents; the network learns from what the rules find in them."""
    found = tables.written(find(tables.read(spark, sf_dir, "documents")), "findings")
    scanned = scan(found, learned(found))
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return scanned.select("doc_id", *counts, "base_sha256", spans.alias("spans"))


QUERIES = {"op13_secret_scan": op13_secret_scan}
ORACLES: dict[str, str] = {}
