"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the components of its links.

Each text is the set of its distinct shingles of 3 words (lower-cased in A-Z; words [^\\x20\\x09-\\x0D]+), as 64-bit hashes
without algebraic structure (`common.word_hashes`). Two sets link when 100 * |intersection| >= percent * |union|. The plan:

1. One pass gives every row its set's size, a 128-bit fingerprint and a bitmap of parities, and a fixed-size sketch of how
   many rows hold each shingle. Rows with equal sets form one class; one row stands for it, so copies never meet.
2. Shingles are ordered from rare to frequent by the sketch. A set of n needs at least ceil(percent * n / 100) of its
   shingles in common with a partner, so two linking sets share at least l shingles among the first
   n - ceil(percent * n / 100) + l of either. Each set chooses its l from the estimated cost of its candidates; a pair
   is a candidate when it shares min(l, l') shingles within both sets' prefixes of that length.
3. Postings are dealt by shingle and streamed in order; a shingle of one class goes no further. In a run of three or
   more, each class is first paired with one centre only (a star), so that a group of near copies costs as many checks as
   it has members. Pairs whose classes those links already connect are never made.
4. Pairs of different components must pass a bound from bitmaps before they leave the task that meets them: two sets
   differ in at least as many shingles as their bitmaps do in bits. Only pairs that are nearly links go on, and have their
   whole sets compared. A run of more than LONG classes is dealt in cells, each of LONG classes against all that come
   after them and fit in size, so no task holds more than LONG classes of a shingle or pairs all of a long run.

Any order of shingles gives the same links; the sketch only makes it cheap. Defined cases: null and empty texts have
size 0, link with nothing and are their own component; rows are documents, so repeated rows are copies of each other;
a null doc_id takes part, and its component is the smallest non-null doc_id in reach, or null. An empty table gives none.
A text of any length is one set, in memory that follows it. Extra columns are ignored, and kept by `keep_one`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.aligned import by_block, is_scan, keyed, located
from quarry.llm.components import components

SHINGLE = 3
PERCENT = 90
#: Counters of the frequency sketch, in PARTS pieces; its size does not depend on the input.
BUCKETS, PARTS = 1 << 18, 16
#: Parities that every set has; and most of those that a large set has besides.
BITS, MOST_BITS = 256, 1 << 15
#: Longest extension of a prefix, and the cost of verifying a candidate against that of a posting.
MOST, VERIFY = 4, 20
#: Classes of one shingle that a task pairs with each other.
LONG = 1024


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; fewer than k words are one shingle."""
    data, offsets = common.buffer_of(column)
    starts, ends, first = common.words_of(data, offsets)
    words = common.word_hashes(common.lowered(data), starts, ends)
    grams = common.run_hashes(words, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(grams[a : b - k + 1]) if b - a >= k else common.run_hashes(words[a:b], b - a) if b > a else grams[:0]


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities, BITS of them or so many that a set has few to a bit: of the shingles that fall on a bit, whether they are odd in number."""
    bits = min(MOST_BITS, max(BITS, 1 << (len(tokens) * 3 // 5).bit_length()))
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, size: int = BITS // 8) -> bytes:
    """The bitmap that a set has with `size` bytes: a bit's parity is that of all bits that fall on it."""
    return bits if len(bits) == size else np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0).tobytes()


def _needed(n, percent: int):
    """Least number of shingles that a set of n shares with any partner."""
    return -(-percent * n // 100)


def _sized(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, row, doc_id, n, f1, f2, bits), then the task's share of the sketch as rows (part, counts)."""
    counts = np.zeros(BUCKETS, np.int64)
    schema = pa.schema([("block", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("bits", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
    for batch in batches:
        sizes, prints, bits = [], [], []
        for s in shingle_sets(batch.column("text"), k):
            sizes.append(len(s))
            prints.append(fingerprint(s))
            bits.append(bitmap(s))
            np.add.at(counts, (s >> np.uint64(46)).astype(np.int64), 1)
        cols = [batch.column(c) for c in ("block", "row", "doc_id")] + [pa.array(sizes, pa.int32()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array(bits, pa.binary())]
        none = pa.nulls(batch.num_rows)
        yield pa.RecordBatch.from_arrays([*cols, none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
    null = [pa.nulls(PARTS, f.type) for f in list(schema)[:7]]
    blobs = [x.astype(np.int64).tobytes() for x in np.split(counts, PARTS)]
    yield pa.RecordBatch.from_arrays([*null, pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary())], schema=schema)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in common.record_batches(batch):
            x = np.frombuffer(blob, np.int64)
            total[part] = total[part] + x if part in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])


def prefix(tokens: np.ndarray, frequency: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """A set's tokens from rare to frequent, as far as its prefix goes, and l, the matches that its candidates must have.

    frequency: the sketch less its noise. Of the postings in a prefix of extension l, sum F(l), at most F(l) / l rows
    share l tokens (Markov), each to be verified at the cost VERIFY; the l of least F(l) + VERIFY * F(l) / l is taken.
    """
    n = len(tokens)
    need = _needed(n, percent)
    f = frequency[(tokens >> np.uint64(46)).astype(np.int64)]
    first = np.lexsort((tokens, f))[: n - need + MOST]
    most = min(MOST, need)
    total = np.cumsum(f[first])
    cost = [total[n - need + i - 1] * (1 + VERIFY / i) for i in range(1, most + 1)]
    match = 1 + int(np.argmin(cost)) if cost else 1
    return tokens[first[: n - need + match]], match


def _kept_rows(batch: pa.RecordBatch, table: pa.Table | None) -> pa.RecordBatch:
    """The rows of a batch that its findings name."""
    rows = batch.column("row").to_numpy()
    return batch.filter(pa.array(np.isin(rows, table.column("row").to_numpy()) if table is not None else np.zeros(len(rows), bool)))


def _postings(batches: Iterator[pa.RecordBatch], k: int, percent: int, frequency, path: str) -> Iterator[pa.RecordBatch]:
    """(token, f1, f2, n, at) of the prefixes of the rows at path; at is 8 times a token's place, plus l."""
    freq = frequency.value
    for whole, table in located(batches, path):
        token, f1, f2, n, at = ([np.zeros(0, t)] for t in (np.uint64, np.int64, np.int64, np.int32, np.int32))
        for s in shingle_sets(_kept_rows(whole, table).column("text"), k):
            p, match = prefix(s, freq, percent)
            a, b = fingerprint(s)
            m = len(p)
            token.append(p)
            f1.append(np.full(m, a, np.int64))
            f2.append(np.full(m, b, np.int64))
            n.append(np.full(m, len(s), np.int32))
            at.append(np.arange(m, dtype=np.int32) * 8 + match)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (f1, f2, n, at))], names=["token", "f1", "f2", "n", "at"])


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "bits"} | (
        {"bits": np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)} if "bits" in batch.schema.names else {}
    )


def _joined(x: dict[str, np.ndarray] | None, y: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return y if x is None else {c: np.concatenate((x[c], y[c])) for c in y}


def _of(x: dict[str, np.ndarray], rows) -> dict[str, np.ndarray]:
    return {c: v[rows] for c, v in x.items()}


def _possible(n, at, m, bt, percent: int, match) -> np.ndarray:
    """Whether sets of n and m that share the tokens at positions at and bt as one of their first `match` may link."""
    overlap = -(-percent * (n + m) // (100 + percent))
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(n - at, m - bt) >= overlap - match + 1)


class _Long:
    """The run of one token that is too long for one cell, met piece by piece in order of n."""

    def __init__(self, token: int) -> None:
        self.token, self.most, self.centre = token, [], None


def _shared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From postings sorted by token and n: those of shared tokens (kind 0) with the cells where they meet others, and, for
    runs of three or more, pairs with the run's centre (kind 1). In its own cell a posting has the role 0, in the cells of
    those before it 1."""
    names = ["kind", "token", "cell", "role", "f1", "f2", "n", "at", "g1", "g2"]

    def own(x: dict[str, np.ndarray], cell: int, role: int) -> pa.RecordBatch:
        size = len(x["token"])
        number = lambda v: np.full(size, v, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (number(0), x["token"], number(cell), number(role), x["f1"], x["f2"], x["n"], x["at"], np.zeros(size, np.int64), np.zeros(size, np.int64))], names=names)

    def stars(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Rows of x with their centres y, where these may link."""
        ok = (x["f1"] != y["f1"]) & _possible(x["n"].astype(np.int64), x["at"] // 8, y["n"].astype(np.int64), y["at"] // 8, percent, MOST)
        if ok.any():
            a, b = _of(x, ok), _of(y, ok)
            size = len(a["f1"])
            none = np.zeros(size, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.ones(size, np.int32), np.zeros(size, np.int64), none, none, a["f1"], a["f2"], none, none, b["f1"], b["f2"])], names=names)

    def short(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Whole runs, LONG at most."""
        begins = np.concatenate(([True], x["token"][1:] != x["token"][:-1])) if len(x["token"]) else np.zeros(0, bool)
        run = np.cumsum(begins) - 1
        count = np.bincount(run)
        more = np.flatnonzero(count[run] > 1)
        if not len(more):
            return
        yield own(_of(x, more), 0, 0)
        order = np.lexsort((x["f2"], x["f1"], x["at"] // 8, run))  # the centre has the token first: few tokens of its own stand before it
        centre = order[np.flatnonzero(begins)]
        some = np.flatnonzero(count[run] > 2)
        yield from stars(_of(x, some), _of(x, centre[run[some]]))

    def long(state: _Long, x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(x["token"]), LONG):
            part = _of(x, slice(i, i + LONG))
            yield own(part, len(state.most), 0)
            for cell, most in enumerate(state.most):
                fits = np.flatnonzero(100 * most >= percent * part["n"].astype(np.int64))
                if len(fits):
                    yield own(_of(part, fits), cell, 1)
            state.centre = state.centre or _of(part, np.lexsort((part["f2"], part["f1"], part["at"] // 8))[:1])
            yield from stars(part, _of(state.centre, np.zeros(len(part["token"]), np.int64)))
            state.most.append(int(part["n"].max()))

    held: dict[str, np.ndarray] | None = None
    state: _Long | None = None

    def ended(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """All of x's runs are at their end."""
        nonlocal state
        if state is not None:
            mine = int(np.searchsorted(x["token"], state.token, "right"))
            yield from long(state, _of(x, slice(0, mine)))
            x, state = _of(x, slice(mine, None)), None
        _, begin, count = np.unique(x["token"], return_index=True, return_counts=True)
        done = 0
        for i, n in zip(begin[count > LONG].tolist(), count[count > LONG].tolist(), strict=True):
            yield from short(_of(x, slice(done, i)))
            yield from long(_Long(int(x["token"][i])), _of(x, slice(i, i + n)))
            done = i + n
        yield from short(_of(x, slice(done, None)))

    for batch in batches:
        x = _joined(held, _arrays(batch))
        if not len(x["token"]):
            continue
        cut = int(np.searchsorted(x["token"], x["token"][-1]))  # the last token may go on
        if cut:
            yield from ended(_of(x, slice(0, cut)))
        held = _of(x, slice(cut, None))
        if len(held["token"]) > LONG:
            state = state or _Long(int(held["token"][0]))
            whole = len(held["token"]) // LONG * LONG
            yield from long(state, _of(held, slice(0, whole)))
            held = _of(held, slice(whole, None))
    if held is not None and (len(held["token"]) or state is not None):
        yield from ended(held)


def _meets(x: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows p and q those of different components that may link, by their sizes, places and bitmaps."""
    n, m = x["n"][p].astype(np.int64), x["n"][q].astype(np.int64)
    ok = (x["comp"][p] != x["comp"][q]) & _possible(n, x["at"][p] // 8, m, x["at"][q] // 8, percent, np.minimum(x["at"][p] % 8, x["at"][q] % 8))
    p, q, n, m = p[ok], q[ok], n[ok], m[ok]
    shared = (n + m - np.bitwise_count(x["bits"][p] ^ x["bits"][q]).sum(axis=1, dtype=np.int64)) // 2
    ok = 100 * shared >= percent * (n + m - shared)
    return p[ok], q[ok]


def _crossed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From postings sorted by token, cell, role and n, with the component that the stars gave and bitmaps: pairs of
    different components (a, b, need) that may link, once for each token they share."""

    def pairs(x: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        p, q = _meets(x, p, q, percent)
        if len(p):
            low = (x["f1"][p] < x["f1"][q]) | ((x["f1"][p] == x["f1"][q]) & (x["f2"][p] < x["f2"][q]))
            p, q = np.where(low, p, q), np.where(low, q, p)
            need = np.minimum(x["at"][p] % 8, x["at"][q] % 8).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x["f1"][p], x["f2"][p], x["f1"][q], x["f2"][q], need)], names=["a1", "a2", "b1", "b2", "need"])

    def within(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Rows of role 0 of whole cells: each against those after it in its cell, as far as sizes fit."""
        run = np.cumsum(np.concatenate(([0], (x["token"][1:] != x["token"][:-1]) | (x["cell"][1:] != x["cell"][:-1])))) if len(x["token"]) else np.zeros(0, np.int64)
        p, step = np.arange(len(run)), 1
        while len(p := p[p + step < len(run)]):
            q = p + step
            fits = (run[p] == run[q]) & (100 * x["n"][p].astype(np.int64) >= percent * x["n"][q].astype(np.int64))
            p = p[fits]
            yield from pairs(x, p, p + step)
            step += 1

    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        x = _joined(held, _arrays(batch))
        size = len(x["token"])
        if not size:
            continue
        key = np.concatenate(([True], (x["token"][1:] != x["token"][:-1]) | (x["cell"][1:] != x["cell"][:-1])))
        begin = np.flatnonzero(key)
        cell = np.cumsum(key) - 1
        for c in np.unique(cell[x["role"] == 1]).tolist():  # rows of long runs against the cell's own, which stand before them
            rows = np.arange(begin[c], begin[c + 1] if c + 1 < len(begin) else size)
            mine, later = rows[x["role"][rows] == 0], rows[x["role"][rows] == 1]
            for p in mine.tolist():
                fits = later[100 * int(x["n"][p]) >= percent * x["n"][later].astype(np.int64)]
                yield from pairs(x, np.full(len(fits), p), fits)
        cut = begin[-1]  # the last cell may go on
        yield from within(_of(x, np.flatnonzero(x["role"][:cut] == 0)))
        held = _of(x, np.flatnonzero((x["role"] == 0) & (np.arange(size) >= cut)))
    if held is not None:
        yield from within(held)


def _sets(batches: Iterator[pa.RecordBatch], path: str, k: int) -> Iterator[pa.RecordBatch]:
    """(f1, f2, tokens) of the rows that stand for the classes at path."""
    for whole, table in located(batches, path):
        if table is not None:
            sets = [(*fingerprint(s), s.tobytes()) for s in shingle_sets(_kept_rows(whole, table).column("text"), k)]
            cols = list(zip(*sets, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["f1", "f2", "tokens"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * both >= percent * (len(p) + len(q) - both):
                keep.append(i)
        yield batch.select(["a1", "a2", "b1", "b2"]).take(pa.array(keep, pa.int64()))


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs that the bound from their bitmaps allows to link."""
    for batch in batches:
        keep = []
        for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "m")), strict=True):
            size = min(len(x), len(y))
            apart = (int.from_bytes(folded(x, size), "little") ^ int.from_bytes(folded(y, size), "little")).bit_count()
            shared = (n + m - apart) // 2
            keep.append(100 * shared >= percent * (n + m - shared))
        yield batch.select(["a1", "a2", "b1", "b2"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """The pairs (a1, a2, b1, b2) of classes that link: by bitmap first, then by whole set."""
    side = lambda t, p, **c: t.select(F.col("f1").alias(f"{p}1"), F.col("f2").alias(f"{p}2"), *(F.col(v).alias(q) for q, v in c.items()))
    both = pairs.join(side(classes, "a", x="bits", n="n"), ["a1", "a2"]).join(side(classes, "b", y="bits", m="n"), ["b1", "b2"])
    near = common.written(both.select("a1", "a2", "b1", "b2", "x", "y", "n", "m").mapInArrow(lambda it: _near(it, percent), PAIRS), f"near-{name}")
    ends = near.select(F.col("a1").alias("f1"), F.col("a2").alias("f2")).union(near.select("b1", "b2")).distinct()
    path = by_block(classes.join(ends, ["f1", "f2"], "left_semi").select("key.block", "key.row"), f"wanted-{name}")
    sets = common.written(docs.select("block", "row", "text").mapInArrow(lambda it: _sets(it, path, k), "f1 long, f2 long, tokens binary"), f"tokens-{name}")
    whole = near.join(side(sets, "a", x="tokens"), ["a1", "a2"]).join(side(sets, "b", y="tokens"), ["b1", "b2"])
    links = common.written(whole.select("a1", "a2", "b1", "b2", "x", "y").mapInArrow(lambda it: _linked(it, percent), PAIRS), f"links-{name}")
    common.let_go(docs.sparkSession)
    return links


PAIRS = "a1 long, a2 long, b1 long, b2 long"


def classes_and_edges(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, edges): rows (block, row, doc_id, n, f1, f2); classes (f1, f2, n, rep doc_id); edges (a, b) of classes
    (f1, f2) that verified links connect: every two classes that link are connected by edges."""
    spark = documents.sparkSession
    partitions = common.shuffle_partitions(spark)
    docs = keyed(documents, F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    first = common.written(docs.mapInArrow(lambda it: _sized(it, k), "block long, row long, doc_id long, n int, f1 long, f2 long, bits binary, part int, counts binary"), "sets")
    rows = first.where("part is null").drop("part", "counts", "bits")
    members = first.where("part is null and n > 0").groupBy("f1", "f2")
    classes = common.written(members.agg(F.min("doc_id").alias("rep"), F.min(F.struct("block", "row")).alias("key"), F.first("n").alias("n"), F.max("bits").alias("bits")), "classes")
    path = by_block(classes.select("key.block", "key.row"), "stand-ins")
    parts = first.where("part is not null").select("part", "counts").repartition(PARTS, "part").mapInArrow(_added, "part int, counts binary").collect()  # BUCKETS numbers in all
    counts = np.zeros(BUCKETS, np.int64)
    for r in parts:
        counts.reshape(PARTS, -1)[r["part"]] = np.frombuffer(r["counts"], np.int64)
    mean = counts.mean()
    frequency = spark.sparkContext.broadcast(np.maximum(0, counts - mean - 4 * np.sqrt(mean + 1)))  # BUCKETS numbers
    posted = docs.select("block", "row", "text").mapInArrow(lambda it: _postings(it, k, percent, frequency, path), "token long, f1 long, f2 long, n int, at int")
    posted = posted.repartition(partitions, "token").sortWithinPartitions("token", "n", "f1", "f2")
    shared = common.written(posted.mapInArrow(lambda it: _shared(it, percent), "kind int, token long, cell int, role int, f1 long, f2 long, n int, at int, g1 long, g2 long"), "shared")
    common.let_go(spark)
    own = shared.where("kind = 0").select("token", "cell", "role", "f1", "f2", "n", "at")
    star = shared.where("kind = 1").select(F.col("f1").alias("a1"), F.col("f2").alias("a2"), F.col("g1").alias("b1"), F.col("g2").alias("b2")).distinct()
    linked = components(_hung(_ends(_verified(star, docs, classes, k, percent, "star"))))
    comp = linked.select(F.col("node.f1"), F.col("node.f2"), F.xxhash64("component.f1", "component.f2").alias("comp"))
    fold = lambda it: (pa.RecordBatch.from_arrays([*(b.column(c) for c in ("f1", "f2", "comp")), pa.array([folded(x) for x in b.column("bits").to_pylist()], pa.binary())], names=["f1", "f2", "comp", "bits"]) for b in it)
    known = classes.select("f1", "f2", "bits").join(comp, ["f1", "f2"], "left").select("f1", "f2", F.coalesce("comp", F.xxhash64("f1", "f2")).alias("comp"), "bits")
    known = known.mapInArrow(fold, "f1 long, f2 long, comp long, bits binary")
    dealt = own.join(known, ["f1", "f2"]).select("token", "cell", "role", "f1", "f2", "n", "at", "comp", "bits")
    dealt = dealt.repartition(partitions, "token", "cell").sortWithinPartitions("token", "cell", "role", "n", "f1", "f2")
    crossed = dealt.mapInArrow(lambda it: _crossed(it, percent), "a1 long, a2 long, b1 long, b2 long, need int")
    crossed = crossed.groupBy("a1", "a2", "b1", "b2").agg(F.count("*").alias("shared"), F.max("need").alias("need")).where("shared >= need").drop("shared", "need")
    edges = linked.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return rows, classes.drop("bits"), edges.unionByName(_ends(_verified(crossed, docs, classes, k, percent, "crossed")))


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.struct(F.col("a1").alias("f1"), F.col("a2").alias("f2")).alias("a"), F.struct(F.col("b1").alias("f1"), F.col("b2").alias("f2")).alias("b"))


def _hung(stars: DataFrame) -> DataFrame:
    """Edges that connect what stars (a class, its centre) do: each class to its least centre, and its other centres to that.
    A class has no more centres than tokens in its prefix."""
    own = stars.groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("all"))
    others = own.select(F.explode(F.filter("all", lambda x: x != F.col("least"))).alias("a"), F.col("least").alias("b"))
    return own.select("a", F.col("least").alias("b")).unionByName(others.distinct())


def _groups(edges: DataFrame) -> DataFrame:
    """(f1, f2, component) of the classes that have links."""
    return components(edges).select(F.col("node.f1"), F.col("node.f2"), "component")


def jaccard_components(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles (size of its set), component_id (smallest doc_id that links reach, its own included)."""
    rows, classes, edges = classes_and_edges(documents, k, percent)
    member = classes.join(_groups(edges), ["f1", "f2"], "left").select("f1", "f2", "rep", F.coalesce("component", F.struct("f1", "f2")).alias("component"))
    least = member.groupBy("component").agg(F.min("rep").alias("least"))
    least = member.join(least, "component").select("f1", "f2", "least")
    out = rows.join(least, ["f1", "f2"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """documents with one row of each group of near copies: of the rows that links of k-word shingles reach, the one with
    the smallest doc_id (a null one last; of repeated ids, the first row of the table stays). Empty texts all stay."""
    documents = documents if is_scan(documents) else common.written(documents, "input")
    rows, _, edges = classes_and_edges(documents, k, percent)
    best = rows.where("n > 0").groupBy("f1", "f2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "block", "row")).alias("best"))
    best = best.join(_groups(edges), ["f1", "f2"], "left").groupBy(F.coalesce("component", F.struct("f1", "f2")).alias("c")).agg(F.min("best").alias("best"))
    path = by_block(best.select("best.block", "best.row").unionByName(rows.where("n = 0").select("block", "row")), "kept")
    names = documents.columns
    docs = keyed(documents, *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, table in located(batches, path):
            yield pa.RecordBatch.from_arrays(_kept_rows(whole, table).columns[2:], names=names)

    return docs.mapInArrow(only, documents.schema)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, w[p : p + least(len(w), 3) - 1] AS g
  FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS (SELECT x.r AS a, y.r AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.r < y.r GROUP BY x.r, y.r),
l AS (SELECT a, b FROM i JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * i.i >= 90 * (x.n + y.n - i.i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT DISTINCT a AS r, a AS q FROM e UNION SELECT c.r, e.b FROM c JOIN e ON e.a = c.q)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.m, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN (SELECT c.r, min(o.doc_id) AS m FROM c JOIN d o ON o.r = c.q GROUP BY c.r) m USING (r)
"""
