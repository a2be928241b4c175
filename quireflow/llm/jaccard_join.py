"""N-gram Jaccard self-join of documents through a token-group matrix.

A document's set is its distinct word shingles. All sets of a size class are cut by hash into the same number of blocks, more than two
linked sets can differ in; a token of a document is the hash of one whole block that is not empty, so two linked documents share a token, and two that
merely share frequent shingles hardly ever do.

1. Tokens. Documents that share a token with others stay in play, all others are done.
2. Families. Of the documents of one token, those may be linked whose sizes and bitmaps leave room for it: in a bitmap every shingle flips
   a bit, so two differ in no more bits than their sets in shingles. What hangs together by such pairs is a family of similar documents.
3. Groups. Families are dealt into groups of bounded size, each packed with all its shingles, and with the union of these.
4. Matrix. Two groups whose unions have too little in common for any link stay closed, and their members do not move. Of open ones, a document's
   overlap with the other's union bounds its overlap with any member; what this leaves is compared member by member, as products of
   0/1 matrices inside one task. They return links enough to connect components, not all pairs.

One document of each component of a group is linked with those of other groups first, in rounds. Groups that are by then one and the same component
are not compared, so a family of near copies costs work in proportion to its size. Within a batch, the documents of one token are sent on as one row, so a
token that a third of all documents has is a row per batch; where it is too many rows for a task, it is split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tables
from .words import mix, pieces, shingles, words

#: Ids (8 bytes each) that may be broadcast to pick texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Times that a set with too many empty blocks is cut anew before it lists its shingles one by one.
ROUNDS = 24
#: Documents and shingles of a group, columns of a dense slice, and documents that are held against a group at a time.
GROUP, GROUP_GRAMS, SLICE, ROWS = 256, 500_000, 8_192, 64
#: Groups on either side that meet in a task.
MEET = 8
#: Rows that a task holds while it lists tokens, and while it compares those of one token (more only where one token has more).
LISTED, ROWS_AT_ONCE = 2_500, 25_000
#: Shingles whose tokens are listed at once, or whose groups meet, and the most turns that this takes for more: only a part of all tokens, or of all groups that meet, is on disk then.
TURN_SHINGLES, TURNS = 5_000_000, 4
KEYS = ("doc_id", "family", "band", "part")


def classes(longest: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smallest size of each class, blocks that may be empty, number of blocks): sets of one class link into it and its neighbours only.

    There are one more blocks than linked sets can spoil and those that may be empty; of these there are as many as the smallest sets that
    list them have but for chance, or as many as can be spoilt if that is less.
    """
    low, first = 1, []
    while low <= longest + 1:
        first.append(low)
        low = max(low + 1, -(-low * 100 // percent))
    first.append(low)
    low, largest = np.array(first[:-1], np.int64), np.array(first[1:], np.int64) - 1
    spoilt = 2 * largest * (100 - percent) // (100 + percent)
    smallest = np.maximum(1, low * percent // 100)
    spare = np.ones(len(low), np.int64)
    while True:
        blocks = spoilt + 1 + spare
        holes = blocks * np.exp(-smallest / blocks)
        short = (holes + 2 * np.sqrt(holes) > spare) & (spare < spoilt)
        if not short.any():
            return low, spare, blocks
        spare = np.where(short, spare + 1 + spare // 16, spare)


def sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts on end, offsets); fewer than n words count as one shingle."""
    hashes, offsets, _, _ = words(texts)
    grams, bounds = shingles(hashes, offsets, n)
    out, counts = [], np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        own = grams[bounds[i] : bounds[i + 1]]
        few = offsets[i + 1] - offsets[i]
        if not len(own) and few:
            own = shingles(hashes[offsets[i] : offsets[i + 1]], np.array([0, few]), int(few))[0]
        out.append(np.unique(own))
        counts[i] = len(out[-1])
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run modulo 2**64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def tokens(grams: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, document) of all documents; those too small to differ from a linked set have none.

    Of the equal blocks of two linked sets there is one more than may be empty, so one is not, if one of the two has no more empty blocks than
    that. A set that has more is cut anew by another hash, in each round in which it fails, and lists its blocks of all these rounds; in the first round in which
    one of two linked sets succeeds both have listed theirs. Sets that fail in all ROUNDS list every shingle.
    """
    sizes = np.diff(offsets)
    low, spare, blocks = classes(int(sizes.max(initial=1)) * 100 // percent + 1, percent)  # the class above the largest set's too
    own = np.searchsorted(low, sizes, "right") - 1
    out, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for up in (0, 1):
        c = np.minimum(own + up, len(low) - 1)
        left = (sizes > 0) & (own + up < len(low)) & (100 * sizes >= percent * low[c]) & (blocks[c] > 1 + spare[c])
        for round_ in range(ROUNDS + 1):
            if not left.any():
                break
            used = np.repeat(left, sizes)
            doc, own_grams = np.repeat(np.arange(len(sizes)), np.where(left, sizes, 0)), grams[used]
            if round_ == ROUNDS:
                out.append(mix(own_grams + mix((c[doc] + 1).astype(np.uint64))))
                of.append(doc)
                break
            m = np.where(left, blocks[c], 0)
            first = np.concatenate([[0], np.cumsum(m)])
            spread = mix(own_grams ^ np.uint64(0x5DEECE66D + round_))
            at = first[doc] + ((spread >> np.uint64(20)) % m[doc].astype(np.uint64)).astype(np.int64)
            sums = np.zeros(first[-1], np.uint64)
            np.add.at(sums, at, mix(spread))
            filled = np.zeros(first[-1], bool)
            filled[at] = True
            holder = np.repeat(np.arange(len(sizes)), m)
            block = np.arange(first[-1]) - first[holder]
            out.append(mix(sums + mix((c[holder] << 40 | round_ << 32 | block).astype(np.uint64)))[filled])
            of.append(holder[filled])
            left &= np.bincount(holder[~filled], minlength=len(sizes)) > spare[c]
    return np.concatenate(out), np.concatenate(of)


def sketches(grams: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A bitmap per set in which every shingle flips one bit. Two bitmaps differ in no more bits than their sets do in shingles.

    A set of n shingles has 64 * 2**j bits, at least n; a bitmap is made half as wide by xor of its halves.
    """
    sizes = np.diff(offsets)
    words_ = (1 << np.ceil(np.log2(np.maximum(1, sizes / 64))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(words_)])
    of = np.repeat(np.arange(len(sizes)), sizes)
    bit = (mix(grams ^ np.uint64(0x6A09E667F3BCC909)) % (64 * words_[of]).astype(np.uint64)).astype(np.int64)
    out = np.zeros(first[-1], np.uint64)
    np.bitwise_xor.at(out, first[of] + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
    return [out[first[i] : first[i + 1]].tobytes() for i in range(len(sizes))]


def _described(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sketch): size, two hashes and a bitmap of each row's set."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in pieces(batch.column("text")):
                grams, offsets = sets(batch.column("text").slice(low, high - low), n)
                h1, h2 = (_sums(mix(grams ^ np.uint64(salt)), offsets).view(np.int64) for salt in (0x1F123BB5, 0x2545F491))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(np.diff(offsets)), pa.array(h1), pa.array(h2), pa.array(sketches(grams, offsets), pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "sketch"])

    return docs.mapInArrow(describe, "doc_id long, n_shingles long, h1 long, h2 long, sketch binary")


def _listed(docs: DataFrame, n: int, percent: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """(token, doc_id, more): per batch and token of those whose turn it is, its smallest document and the others, null if none. Equal sets of a batch count once, as the smallest id."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, LISTED) for b in batches for low in range(0, b.num_rows, LISTED)):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            parts, same = [], [np.zeros(0, np.uint64)]
            for low, high in pieces(batch.column("text")):
                grams, offsets = sets(batch.column("text").slice(low, high - low), n)
                t, d = tokens(grams, offsets, percent)
                same.append(mix(_sums(mix(grams), offsets) + np.diff(offsets).astype(np.uint64)))
                parts.append((t, low + d))
            same = np.concatenate(same)
            order = np.lexsort((ids, same))
            smallest = np.zeros(len(same), bool)
            smallest[order[np.diff(same[order], prepend=same[order][:1] ^ np.uint64(1)) != 0]] = True
            token, row = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            own = smallest[row] & ((token >> np.uint64(32)) % np.uint64(turns) == turn)
            token, doc = token[own], ids[row[own]]
            order = np.lexsort((doc, token))
            token, doc = token[order], doc[order]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(token)))
            rest = np.ones(len(token), bool)
            rest[starts] = False
            bounds = np.concatenate([[0], np.cumsum(sizes - 1)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(doc[rest], pa.int64()), mask=pa.array(sizes == 1))
            for a in range(0, len(starts), 200_000):
                at = starts[a : a + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(token[at].view(np.int64)), pa.array(doc[at], pa.int64()), lists.slice(a, 200_000)], names=["token", "doc_id", "more"])

    return docs.mapInArrow(listed, "token long, doc_id long, more array<long>")


def _turns(sized: DataFrame) -> int:
    """Turns that work on so many shingles takes."""
    return min(TURNS, max(1, -(-(sized.agg(F.sum("n_shingles")).first()[0] or 0) // TURN_SHINGLES)))


def close_pairs(run: np.ndarray, doc: np.ndarray, size: np.ndarray, sketch: list[bytes], percent: int, steps: int = 1, split: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, document, leader) within runs of one token: enough pairs to connect all that sizes and bitmaps leave possible, and the places of leaders.

    In a long run, and in one that is a part of a split token, leaders are taken in turn, each with all that are close to it and have none yet. If members of two leaders are close, the leaders are
    within three times the distance, so such leaders are joined; this may join more than is close, never less. steps says how many
    distances two may lie apart.
    """
    wide = np.array([len(x) // 8 for x in sketch], np.int64)
    tables_: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bitmaps(w: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of each row that has w words or more, and their bitmaps folded to w words."""
        if w not in tables_:
            rows = np.flatnonzero(wide >= w)
            out = np.zeros((len(rows), w), np.uint64)
            for k in np.unique(wide[rows]).tolist():
                own = np.flatnonzero(wide[rows] == k)
                x = np.frombuffer(b"".join(sketch[r] for r in rows[own]), np.uint64).reshape(len(own), k // w, w)
                out[own] = np.bitwise_xor.reduce(x, axis=1)
            place = np.full(len(wide), -1)
            place[rows] = np.arange(len(rows))
            tables_[w] = place, out
        return tables_[w]

    def sizes_fit(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Whether sets of these sizes may lie n distances apart; a little more than that, by rounding."""
        return np.minimum(a, b) >= (percent / 100) ** n * np.maximum(a, b) * (1 - 1e-9)

    def near(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
        fits = (doc[i] != doc[j]) & sizes_fit(size[i], size[j], n)
        low = np.minimum(wide[i], wide[j])
        for w in np.unique(low[fits]):
            place, bits = bitmaps(int(w))
            chosen = np.flatnonzero(fits & (low == w))
            for at in np.array_split(chosen, 1 + (len(chosen) * int(w) >> 18)):
                apart = np.bitwise_count(bits[place[i[at]]] ^ bits[place[j[at]]]).sum(axis=1, dtype=np.int64)
                fits[at] = apart * (100 + percent) <= n * (size[i[at]] + size[j[at]]) * (100 - percent)
        return fits

    upright: dict[int, np.ndarray] = {}

    def near_one(i: int, j: np.ndarray, n: int) -> np.ndarray:
        """near() of one row and many."""
        fits = (doc[j] != doc[i]) & sizes_fit(size[i], size[j], n)
        low = np.minimum(wide[i], wide[j])
        for w in np.unique(low[fits]).tolist():
            place, bits = bitmaps(w)
            if w not in upright:
                upright[w] = np.ascontiguousarray(bits.T)
            chosen = np.flatnonzero(fits & (low == w))
            at, apart = place[j[chosen]], np.zeros(len(chosen), np.int64)
            for k in range(w):
                apart += np.bitwise_count(upright[w][k][at] ^ bits[place[i], k])
            fits[chosen] = apart * (100 + percent) <= n * (size[i] + size[j[chosen]]) * (100 - percent)
        return fits

    starts = np.flatnonzero(np.diff(run, prepend=run[:1] ^ 1))
    counts = np.diff(np.append(starts, len(run)))
    left, right, leaders = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
        fits = near(i, j, n)
        left.append(i[fits])
        right.append(j[fits])
        return fits

    def joined(i: int, j: np.ndarray) -> None:
        left.append(np.full(len(j), i))
        right.append(j)

    long = counts > 64 if split is None else (counts > 64) | split[starts]
    small = np.repeat(~long, counts)
    end = np.repeat(starts + counts, counts)
    for step in range(1, int(counts[~long].max(initial=1))):
        i = np.flatnonzero(small & (np.arange(len(run)) + step < end))
        add(i, i + step, steps)
    leaders.append(np.flatnonzero(small))
    for s, n in zip(starts[long].tolist(), counts[long].tolist(), strict=True):
        free, chosen = np.arange(s, s + n), []
        while len(free):
            first, rest = int(free[0]), free[1:]
            chosen.append(first)
            close = near_one(first, rest, steps)
            joined(first, rest[close])
            free = rest[~close & (doc[rest] != doc[first])]
        chosen = np.array(chosen)
        leaders.append(chosen)
        part = np.arange(len(chosen))  # leaders that hang together need not be held against each other
        for x in range(len(chosen) - 1):
            others = x + 1 + np.flatnonzero(part[x + 1 :] != part[x])
            if len(others):
                others = others[near_one(int(chosen[x]), chosen[others], 3 * steps)]
                joined(int(chosen[x]), chosen[others])
                if len(others):
                    part[np.isin(part, part[others])] = part[x]
            elif (part == part[0]).all():
                break
    i, j = np.concatenate(left), np.concatenate(right)
    _, node = np.unique(doc, return_inverse=True)
    root, ids = np.arange(node.max(initial=-1) + 1), np.zeros(node.max(initial=-1) + 1, np.int64)
    ids[node] = doc
    a, b = node[i], node[j]
    while True:  # smallest label of what hangs together
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    told = np.flatnonzero(root != np.arange(len(root)))
    return ids[root[told]], ids[told], np.sort(np.concatenate(leaders))


def _families(shared: DataFrame, sized: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of what may be linked: documents of one token that size and bitmap leave possible.

    A token of more than ROWS_AT_ONCE documents is dealt into parts; the leaders of its parts are held against each other in a further round, dealt again while they are too many. Each
    round's leaders stand for all within so many distances, so those of two that are close lie within three times as many: the next round looks that far, until one part is left.
    """
    described = sized.select("doc_id", F.col("n_shingles").cast("int").alias("n"), "sketch").distinct()
    tasks = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = ROWS_AT_ONCE

    def dealt(rows: DataFrame) -> DataFrame:
        """(token, doc_id, part): the part of a token that a document is dealt to, null where there is but one."""
        hot = rows.groupBy("token").count().where(F.col("count") > most).select("token", F.ceil(F.col("count") / most).cast("int").alias("parts"))
        hot = tables.small_or_not(tables.written(hot, "hot-tokens"), BROADCAST_IDS)
        return rows.join(hot, "token", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))).drop("parts")

    split = dealt(shared)

    def edges(steps: int):
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def told(table: pa.Table) -> pa.RecordBatch:
                token, part, doc = (table.column(c).to_numpy() for c in ("token", "part", "doc_id"))
                a, b, leaders = close_pairs(token ^ part, doc, table.column("n").to_numpy().astype(np.int64), table.column("sketch").to_pylist(), percent, steps, part >= 0)
                leaders = leaders[part[leaders] >= 0]
                kinds = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(token[leaders])])
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, doc[leaders]])), pa.array(np.concatenate([b, doc[leaders]])), kinds], names=["a", "b", "token"])

            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= ROWS_AT_ONCE:
                    table = pa.Table.from_batches(held).combine_chunks()
                    run = table.column("token").to_numpy() ^ table.column("part").to_numpy()
                    cut = int(np.flatnonzero(np.append(True, run[1:] != run[:-1]))[-1])  # the last run may go on
                    if cut:
                        yield told(table.slice(0, cut))
                        table = table.slice(cut)
                    held, n = table.to_batches(), table.num_rows
            if n:
                yield told(pa.Table.from_batches(held).combine_chunks())

        return found

    def ran(rows: DataFrame, steps: int) -> DataFrame:
        rows = rows.join(described, "doc_id").select("token", F.coalesce("part", F.lit(-1)).cast("long").alias("part"), "doc_id", "n", "sketch")
        rows = rows.repartition(tasks, "token", "part").sortWithinPartitions("token", "part")
        return rows.mapInArrow(edges(steps), "a long, b long, token long")

    out, steps, rows = None, 1, split
    while True:
        found = tables.written(ran(rows, steps), "edges")
        near = found.where("token is null").select("a", "b")
        out = near if out is None else out.union(near)
        leaders = found.where("token is not null").select("token", F.col("a").alias("doc_id")).distinct()
        if leaders.isEmpty():
            return _fewer(out)
        rows, steps = dealt(leaders), 3 * steps


def _fewer(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same: each b with its smallest a, and that with its others, of which all of a family have much the same.

    A document is a b at most once for each of its tokens, which bounds what is gathered for it.
    """
    lists = tables.written(edges.where("a <> b").groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("hubs")), "hubs")
    among = lists.where(F.size("hubs") > 1).select(F.col("hubs")[0].alias("a"), F.explode(F.slice("hubs", 2, F.size("hubs"))).alias("b"))
    return lists.select(F.col("hubs")[0].alias("a"), "b").union(among.distinct())


def overlaps(rows: np.ndarray, grams: np.ndarray, n: int, others: np.ndarray, other_grams: np.ndarray, m: int) -> np.ndarray:
    """Size of the intersection of n sets with m sets, each given as (set, gram), by matrix products over slices of the common grams."""
    out = np.zeros((n, m), np.float32)
    common = np.intersect1d(grams, other_grams)
    at, other_at = np.searchsorted(common, grams), np.searchsorted(common, other_grams)
    for low in range(0, len(common), SLICE):
        parts = []
        for size, r, g, k in ((n, rows, grams, at), (m, others, other_grams, other_at)):
            here = (k >= low) & (k < min(low + SLICE, len(common)))
            here[here] = common[k[here]] == g[here]
            dense = np.zeros((size, min(SLICE, len(common) - low)), np.float32)
            dense[r[here], k[here] - low] = 1
            parts.append(dense)
        out += parts[0] @ parts[1].T
    return out


def open_groups(x: tuple, y: tuple, percent: int) -> list[tuple[int, int]]:
    """Links (document, document) between the components of two groups, enough of them to connect what is linked.

    A group is (ids, components, sizes, grams on end, union of the grams). A document of x is held against the members of y only if its overlap
    with the union of y leaves room for a link.
    """
    (ids, of, sizes, grams, _), (y_ids, y_of, y_sizes, y_grams, union) = x, y
    rows = np.repeat(np.arange(len(ids)), sizes)
    k = np.minimum(np.searchsorted(union, grams), len(union) - 1)
    most = np.bincount(rows, union[k] == grams, len(ids))
    least = np.maximum(y_sizes.min(), -(-sizes * percent // 100))
    wanted = (most * (100 + percent) >= percent * (sizes + least)) & ((y_of[:, None] != of[None, :]).any(axis=0))
    if not wanted.any():
        return []
    top: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := top.get(v, v)) != v:
            top[v] = v = top.get(up, up)
        return v

    out: list[tuple[int, int]] = []
    others = np.repeat(np.arange(len(y_ids)), y_sizes)
    chosen = np.flatnonzero(wanted)
    for low in range(0, len(chosen), ROWS):
        mine = chosen[low : low + ROWS]
        # Components that are joined by now need no second link.
        roots, y_roots = np.array([root(v) for v in of[mine].tolist()]), np.array([root(v) for v in y_of.tolist()])
        open_ = roots[:, None] != y_roots[None, :]
        mine, open_ = mine[open_.any(axis=1)], open_[open_.any(axis=1)]
        if not len(mine):
            continue
        number = np.full(len(ids), -1)
        number[mine] = np.arange(len(mine))
        use = number[rows] >= 0
        common = overlaps(number[rows[use]], grams[use], len(mine), others, y_grams, len(y_ids))
        both = sizes[mine][:, None] + y_sizes[None, :] - common
        r, c = np.nonzero((100 * common >= percent * both) & open_)
        for i, j in zip(r.tolist(), c.tolist(), strict=True):
            a, b = root(int(of[mine[i]])), root(int(y_of[j]))
            if a != b:
                top[a] = b
                out.append((int(ids[mine[i]]), int(y_ids[j])))
    return out


def connected(ids: np.ndarray, links: list[tuple[int, int]]) -> np.ndarray:
    """Some id of each document's component, the same for all of it."""
    at = {v: i for i, v in enumerate(ids.tolist())}
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in links:
        root[find(at[a])] = find(at[b])
    return ids[[find(at[v]) for v in ids.tolist()]]


_GROUP = {"ids": np.int64, "of": np.int64, "sizes": np.int64, "union": np.uint64}


def _places(grams: np.ndarray, union: np.ndarray) -> bytes:
    """Shingles as their places in the union, of two bytes each if that is enough: members of a group share most."""
    return np.searchsorted(union, grams).astype(np.uint16 if len(union) <= 1 << 16 else np.uint32).tobytes()


def _shingles(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sizes, shingles on end, their union) of the group in a row."""
    ids, sizes, union = (np.frombuffer(batch.column(c)[i].as_py(), _GROUP[c]) for c in ("ids", "sizes", "union"))
    places = batch.column("grams")[i].as_py()
    return ids, sizes, union[np.frombuffer(places, np.uint16 if len(places) == 2 * sizes.sum() else np.uint32)], union


_PACKED = "family long, band int, part int, least long, ids binary, of binary, sizes binary, grams binary, union binary, links array<struct<a:long,b:long>>"


def _packed(columns: DataFrame, percent: int) -> DataFrame:
    """A row per group (family, band, part) of documents (doc_id, grams), with the links that connect what is linked within it."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table.column("grams").combine_chunks()
        ids, sizes, grams = table.column("doc_id").to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy().view(np.uint64)
        union = np.unique(grams)
        alone = (ids, ids.copy(), sizes, grams, union)
        links = open_groups(alone, alone, percent)
        binaries = [ids.tobytes(), connected(ids, links).tobytes(), sizes.tobytes(), _places(grams, union), union.tobytes()]
        found = pa.array([[{"a": a, "b": b} for a, b in links]], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
        return pa.Table.from_arrays([*(table.column(c).slice(0, 1).combine_chunks() for c in ("family", "band", "part")), pa.array([int(sizes.min())]), *(pa.array([x], pa.binary()) for x in binaries), found], names=[f.split()[0] for f in _PACKED.split(", ")])

    return tables.written(columns.groupBy("family", "band", "part").applyInArrow(pack, _PACKED), "packed")


def _parts(members: DataFrame) -> DataFrame:
    """members (family, band, doc_id, n_shingles, ...) with the part of their family and band that they are dealt to."""
    parts = members.groupBy("family", "band").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n_shingles") / GROUP_GRAMS)).alias("parts"))
    parts = tables.small_or_not(tables.written(parts, "parts"), BROADCAST_IDS)
    return members.join(parts, ["family", "band"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int")).drop("parts")


def _heads(packed: DataFrame) -> DataFrame:
    """(family, band, doc_id, n_shingles, grams): one document of each component of every group of a family and band that has several groups."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, grams, _ = _shingles(batch, i)
                of = np.frombuffer(batch.column("of")[i].as_py(), np.int64)
                _, first = np.unique(of, return_index=True)
                ends = np.cumsum(sizes)
                lists = pa.array([grams[ends[k] - sizes[k] : ends[k]].view(np.int64) for k in first], pa.list_(pa.int64()))
                same = [pa.array([batch.column(c)[i].as_py()] * len(first), batch.schema.field(c).type) for c in ("family", "band")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(ids[first]), pa.array(sizes[first]), lists], names=["family", "band", "doc_id", "n_shingles", "grams"])

    several = packed.groupBy("family", "band").count().where("count > 1").select("family", "band")
    chosen = packed.join(tables.small_or_not(tables.written(several, "several"), BROADCAST_IDS), ["family", "band"], "left_semi")
    return chosen.select("family", "band", "ids", "of", "sizes", "grams", "union").mapInArrow(heads, "family long, band int, doc_id long, n_shingles long, grams array<long>")


def _across(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what is linked among members (doc_id, n_shingles, family).

    Members of a family and size band are dealt into groups of about GROUP documents and GROUP_GRAMS shingles, packed as one row each with all
    their shingles; groups of neighbouring bands of a family are held against each other.
    """
    wide = 105 / percent  # sizes of linked documents differ by less than a band
    members = tables.written(members.withColumn("band", F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(wide))).cast("int")), "members")
    placed = docs.join(tables.small_or_not(tables.written(_parts(members), "groups"), BROADCAST_IDS), "doc_id")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in pieces(batch.column("text")):
                rows = batch.slice(low, high - low)
                grams, offsets = sets(rows.column("text"), n)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(grams.view(np.int64)))
                own = np.diff(offsets) == rows.column("n_shingles").to_numpy()
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in KEYS), lists], names=[*KEYS, "grams"]).filter(pa.array(own))

    columns = placed.select("doc_id", "family", "band", "part", "n_shingles", "text").mapInArrow(gathered, "doc_id long, family long, band int, part int, grams array<long>")
    packed = _packed(columns, percent)
    links = packed.select(F.inline("links"))
    # Heads of groups among themselves, as long as this leaves fewer.
    heads, before = _heads(packed), None
    while True:
        heads = tables.written(heads, "heads")
        count = heads.count()
        if not count or (before is not None and 2 * count > before):
            break
        before = count
        upper = _packed(_parts(heads).select("doc_id", "family", "band", "part", "grams"), percent)
        links = links.union(upper.select(F.inline("links")))
        heads = _heads(upper)
    links = tables.written(links.distinct(), "links")
    joined = components(links)
    # Pairs of groups: by components and unions alone.
    key = ["family", "band", "part"]
    ids = packed.select(*key, "ids").mapInArrow(_unpacked, "family long, band int, part int, doc_id long")
    of = tables.written(ids.join(joined, F.col("doc_id") == F.col("node"), "left").select(*key, "doc_id", F.coalesce("component", "doc_id").alias("component")), "of")
    whole = of.groupBy(*key).agg(F.when(F.min("component") == F.max("component"), F.min("component")).alias("only"))
    kinds = tables.written(whole.groupBy("family", "band", "only").agg(F.count("*").alias("n")), "kinds")
    x = kinds.select(*[F.col(c).alias(f"x_{c}") for c in kinds.columns])
    neighbours = F.expr("x_family = family and (x_band = band - 1 or x_band = band) and (x_only is null or only is null or x_only <> only)")
    pairs = x.join(kinds, neighbours).where("x_band < band or x_only is null or only is null or x_only < only")
    mixed = tables.written(pairs.select("family").distinct(), "mixed")  # families that are not yet one component
    if mixed.isEmpty():
        return links
    named = packed.join(tables.small_or_not(mixed, BROADCAST_IDS), "family", "left_semi").join(whole, key).select(*key, "only", "least", F.col("union").alias("grams"))
    left = named.select(*[F.col(c).alias(f"x_{c}") for c in named.columns])
    near = F.expr("x_family = family and (x_band = band - 1 or x_band = band and x_part < part) and (x_only is null or only is null or x_only <> only)")

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("x_grams", "grams"))
                common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                keep.append(common * (100 + percent) >= percent * (batch.column("x_least")[i].as_py() + batch.column("least")[i].as_py()))
            yield batch.drop_columns(["x_grams", "grams", "x_least", "least"]).filter(pa.array(keep, pa.bool_()))

    wanted = left.join(named, near).select("x_family", "x_band", "x_part", *key, "x_least", "least", "x_grams", "grams")
    wanted = tables.written(wanted.mapInArrow(open_, "x_family long, x_band int, x_part int, family long, band int, part int"), "open")
    # Open groups, with what is known of their components.
    by_group = of.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("doc_id", "component"))).alias("known"))  # GROUP entries or so
    both = wanted.select(*key).union(wanted.select("x_family", "x_band", "x_part")).distinct()
    full = packed.drop("links", "least", "of").join(tables.small_or_not(tables.written(both, "both"), BROADCAST_IDS), key, "left_semi").join(by_group, key)
    # Groups meet in blocks of MEET by MEET, so a group moves once for each block that it is wanted in and not for each group.
    block = ["family", "x_band", "x_block", "band", "block"]
    tied = wanted.withColumns({"x_block": F.floor(F.col("x_part") / MEET), "block": F.floor(F.col("part") / MEET)})
    of_x = tied.groupBy(*block, "x_part").agg(F.collect_list("part").alias("wanted")).withColumnRenamed("x_part", "part")
    of_y = tied.select(*block, "part").distinct().withColumn("wanted", F.lit(None).cast("array<int>"))
    payload = [c for c in full.columns if c not in key]
    sides = [(tables.small_or_not(tables.written(of, "meeting"), BROADCAST_IDS), band) for of, band in ((of_x, "x_band"), (of_y, "band"))]

    def search(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]

        def group(i: int) -> tuple:
            ids, sizes, grams, union = _shingles(batch, i)
            known = dict(batch.column("known")[i].as_py())
            return ids, np.array([known[v] for v in ids.tolist()], np.int64), sizes, grams, union

        asked, parts = batch.column("wanted").to_pylist(), batch.column("part").to_pylist()
        others = {parts[i]: group(i) for i, ys in enumerate(asked) if ys is None}
        found = [link for i, ys in enumerate(asked) if ys is not None for x in [group(i)] for y in ys for link in open_groups(x, others[y], percent)]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    turns = _turns(members)
    for turn in range(turns):
        here = full.where(F.pmod(F.xxhash64("family"), F.lit(turns)) == turn)
        met = [side.join(here.withColumnRenamed("band", band), ["family", band, "part"]).select(*block, "part", "wanted", *payload) for side, band in sides]
        links = links.union(tables.written(met[0].unionByName(met[1]).groupBy(*block).applyInArrow(search, "a long, b long"), "met"))
    return links


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document of packed groups."""
    for batch in batches:
        sizes = [len(x.as_buffer()) // 8 for x in batch.column("ids")]
        at = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("family", "band", "part")), pa.array(ids)], names=["family", "band", "part", "doc_id"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the links (a, b): the smallest node that can be reached.

    Every node points at its smallest neighbour's smallest neighbour in turn, so the rounds grow with the logarithm of the longest path;
    each is a table in the shared folder, of which the last is kept.
    """
    return tables.finished(links.sparkSession, "components", lambda: _reached(links))


def _reached(links: DataFrame) -> DataFrame:
    edges = tables.written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    state = tables.written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "node"), "components")
    while True:
        around = edges.join(state.select(F.col("node").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("near"))
        step = state.join(around.withColumnRenamed("a", "node"), "node").select("node", F.least("c", "near").alias("to"), F.col("c").alias("was"))
        jump = step.join(state.select(F.col("node").alias("to"), F.col("c").alias("far")), "to", "left")
        new = tables.written(jump.select("node", F.least("to", F.coalesce("far", "to")).alias("c"), "was"), "components")
        if new.where("c <> was").isEmpty():
            return new.select("node", F.col("c").alias("component"))
        state = new.select("node", "c")


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: (doc_id, n_shingles, component_id), linked where the Jaccard similarity of shingle sets is percent/100 or more.

    Words are runs other than ASCII white space with A-Z as a-z; a text with fewer words than shingle_words is one shingle. Null, empty and
    blank texts have no shingle and are linked with nothing: component_id is their own id. A null id gives a null component_id and no
    links. Rows of one id count as one document: what one of them links to, all do; each is returned. Extra columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return tables.finished(docs.sparkSession, "joined", lambda: _joined(docs, shingle_words, percent))


def _joined(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    sized = tables.written(_described(docs, shingle_words), "sets")
    known = sized.where("doc_id is not null and n_shingles > 0")
    # Equal sets: the smallest id stands for all.
    same = known.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    same = tables.small_or_not(tables.written(same, "equal-sets"), BROADCAST_IDS)  # beyond that, Spark splits the rows of a hot set
    copies = tables.written(known.join(same, ["n_shingles", "h1", "h2"]).where("doc_id > first").select("doc_id", "first").distinct(), "copies")
    # Families, and their groups opened through the matrix.
    families = tables.finished(spark, "families", lambda: _by_token(docs, known, copies, shingle_words, percent))
    sizes = families.join(known.select("doc_id", "n_shingles").distinct(), "doc_id")
    links = tables.finished(spark, "links", lambda: _across(docs, sizes, shingle_words, percent))
    every = components(links.union(copies.select(F.col("first").alias("a"), F.col("doc_id").alias("b"))))
    return sized.join(every.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _by_token(docs: DataFrame, known: DataFrame, copies: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """(doc_id, family) of documents that share a token with another."""
    # Tokens that several documents have. The smallest of equal sets lists every token, so its copies are not needed, but for ids that have other sets as well.
    several = known.groupBy("doc_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high")
    spare = tables.written(copies.select("doc_id").join(several, "doc_id", "left_anti"), "spare")
    asked, few = docs.where("doc_id is not null and text is not null"), spare.count() <= BROADCAST_IDS
    if few:  # copies list nothing; more of them list theirs, as else all texts would move
        asked = asked.join(F.broadcast(spare), "doc_id", "left_anti")
    turns = _turns(known)
    by, shared = W.partitionBy("token"), None
    for turn in range(turns):
        lists = _listed(asked, shingle_words, percent, turn, turns)
        lists = lists.withColumns({"low": F.min("doc_id").over(by), "high": F.max("doc_id").over(by)}).where("low < high or more is not null")
        found = lists.select("token", F.explode(F.concat(F.array("doc_id"), F.coalesce("more", F.array().cast("array<long>")))).alias("doc_id"))
        found = tables.written(found if few else found.join(spare, "doc_id", "left_anti"), "tokens")
        shared = found if shared is None else shared.union(found)
    # Tokens of the very same documents say the same: copies share most of theirs. Each such set of documents is told by its size and two sums of hashes.
    told = lambda salt: F.sum(F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 31)))
    alike = shared.groupBy("token").agg(F.count("*").alias("n"), told(1).alias("s"), told(2).alias("t"))
    kept = tables.written(alike.groupBy("n", "s", "t").agg(F.min("token").alias("token")).select("token"), "kept-tokens")
    shared = tables.written(shared.join(tables.small_or_not(kept, BROADCAST_IDS), "token", "left_semi"), "tokens")
    return components(_families(shared, known, percent)).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(tables.read(spark, sf_dir, "documents"), shingle_words=3, percent=90)


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLES = {
    "op10_jaccard_join": r"""
WITH RECURSIVE tokenised AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM tokenised),
sized AS (SELECT doc_id, len(g)::BIGINT AS n FROM grams),
flat AS (SELECT doc_id, unnest(g) AS t FROM grams),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM flat x JOIN flat y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sized s ON s.doc_id = a JOIN sized u ON u.doc_id = b WHERE 100 * common >= 90 * (s.n + u.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sized UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT sized.doc_id, n AS n_shingles, component_id
FROM sized JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON sized.doc_id = a""",
}
