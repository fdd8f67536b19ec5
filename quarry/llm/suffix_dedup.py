"""Suffix-array dedup of bytes by a distributed merge sort that is aware of common prefixes.

A byte goes when a 100-byte string over it also starts earlier: in a document with a smaller doc_id, or in the same one
at an earlier byte; judged on the input. The suffix array is a sparse one. Of each 100-byte window the 32-byte gram with
the least hash is the anchor (`repeats`), and only suffixes that start at anchors whose gram recurs are sorted, as far as
a window over the anchor reaches: up to 100 bytes from the anchor on, and the up to 68 bytes before it. Then:

1. Each task collects its distinct pieces (a suffix with what stands before it). Of a piece that it meets again only the
   earliest occurrence can stay, so the windows of the others are ranges to remove already.
2. It sorts the rest, front-codes them (a suffix is its common prefix with the one before it and the bytes that follow)
   and sends each shard its run. Shards are ranges of content: their borders are quantiles of a bounded sample of grams.
   All suffixes of a gram go to one shard; but a gram with more than repeats.HOT anchors is sent window by window, each
   to the shard of its own 100 bytes, so no gram is a group that grows with the corpus.
3. A shard's runs are merged by a loser tree whose nodes keep the common prefix with the last winner, so bytes known to
   be equal are never compared again; more than FAN runs are merged in rounds.
4. Two windows with o bytes before their anchors are equal when the suffixes agree for 100 - o bytes and what stands
   before them for o bytes. Both are runs of neighbours: of the merged order, cut where its common prefixes are shorter
   than 100 - o, and of the order of what stands before. In each class of windows the earliest stays.

Defined cases: null and empty texts have no bytes; texts under 100 bytes lose none; rows with one doc_id are told apart
by their starts alone, so where repeated rows are equal neither removes from the other; a null doc_id counts as larger
than any and as one document. An empty table gives none. A text is cut whole, however long, in memory that follows it.
Extra columns are ignored, and kept out of the results.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common, repeats
from quarry.llm.aligned import by_block, keyed, located

WINDOW, GRAM = 100, 32
#: Runs that one loser tree merges.
FAN = 64
#: Recurring anchors to a shard, about; ranges of content, beyond which shards go by hash within a range; and samples to a range.
SHARD, RANGES, SAMPLES = 60_000, 4096, 8
#: Bytes of pieces that a task holds before it sends them.
HELD = 32 << 20


def _units(data: np.ndarray, offsets: np.ndarray):
    grams = common.gram_hashes(data, GRAM)
    return grams, offsets, None, None


SCHEME = repeats.Scheme(WINDOW, GRAM, _units, True, 256, sampled=True)


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known to be equal."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_coded(run: list[tuple]) -> bytes:
    """A sorted run (key, numbers...) as bytes: common prefixes, lengths of what follows and numbers by column, then what follows."""
    same, rest, before = [], [], b""
    for key, *_ in run:
        n = common_prefix(before, key)
        same.append(n)
        rest.append(key[n:])
        before = key
    columns = [same, [len(x) for x in rest], *zip(*(x[1:] for x in run), strict=True)] if run else [[], []]
    return b"".join([struct.pack("<II", len(run), len(columns)), *(np.array(c, np.int64).tobytes() for c in columns), *rest])


def decoded(blob: bytes) -> Iterator[tuple]:
    """(common prefix with the one before, key, numbers...) of a front-coded run."""
    n, columns = struct.unpack_from("<II", blob)
    same, rest, *numbers = np.frombuffer(blob, np.int64, n * columns, 8).reshape(columns, n).tolist()
    at, before = 8 + 8 * n * columns, b""
    for i, (p, r, *more) in enumerate(zip(same, rest, *numbers, strict=True)):
        before = before[:p] + blob[at : at + r]
        at += r
        yield (p, before, *more)


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merges sorted runs of (common prefix with the run's suffix before, key, ...) into one of the same form.

    A loser tree: each inner node keeps the run that lost there, with the length of its common prefix with the winner
    that passed. That winner is what was last given out along the path, so of two suffixes that differ in these lengths
    the longer is the smaller, and of equal ones only the bytes beyond are compared. An exhausted run is None.
    """
    k = len(runs)
    heads: list[tuple | None] = [next(r, None) for r in runs]
    lcp = [0] * k
    tree = [-1] * k  # tree[0]: the winner

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of runs a and b; sets the loser's common prefix with the winner."""
        x, y = heads[a], heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)  # the loser's prefix with the winner is its own, the shorter
        p, q = x[1], y[1]
        same = common_prefix(p, q, lcp[a])
        first = same == len(p) if same == len(p) or same == len(q) else p[same] < q[same]
        if same == len(p) == len(q):
            first = a < b
        if first:
            lcp[b] = same
            return a, b
        lcp[a] = same
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while (head := heads[winner]) is not None:
        yield (lcp[winner], *head[1:])
        following = heads[winner] = next(runs[winner], None)
        lcp[winner] = following[0] if following is not None else 0
        node = (winner + k) // 2
        while node:
            winner, tree[node] = play(winner, tree[node])
            node //= 2


def merge_all(blobs: list[bytes]) -> Iterator[tuple]:
    """One sorted sequence of the front-coded runs, FAN at a time."""
    runs = list(blobs)
    while len(runs) > FAN:
        runs = [front_coded([x[1:] for x in merged([decoded(b) for b in runs[i : i + FAN]])]) for i in range(0, len(runs), FAN)]
    return merged([decoded(b) for b in runs])


def _shard(key: bytes, borders: list[bytes], spread: int) -> int:
    """The range that the bytes fall in; where there are more shards than ranges, one of its `spread` shards by hash."""
    at = bisect.bisect_right(borders, key)
    return at if spread == 1 else at * spread + int.from_bytes(hashlib.blake2b(key, digest_size=4).digest(), "little") % spread


_ROWS = "shard int, blob binary, block long, row long, q1 long, q2 long"
_SCHEMA = pa.schema([("shard", pa.int32()), ("blob", pa.binary()), ("block", pa.int64()), ("row", pa.int64()), ("q1", pa.int64()), ("q2", pa.int64())])


def _sorted_runs(batches: Iterator[pa.RecordBatch], path: str, borders: list[bytes], spread: int) -> Iterator[pa.RecordBatch]:
    """Rows of runs (shard, blob) and of ranges to remove (block, row, q1, q2)."""
    held: dict[bytes, list] = {}  # piece: earliest (doc, anchor), bytes before the anchor, whether hot, (block, row) of its occurrences there
    size, ranges = 0, repeats.Ranges()
    squeeze = zstandard.ZstdCompressor(level=1).compress

    def removals() -> pa.RecordBatch:
        found = ranges.taken()
        n = len(found[0])
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *map(pa.array, found)], schema=_SCHEMA)

    def runs() -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for piece, ((doc, at), left, hot, places) in held.items():
            suffix = piece[left:]
            run = by.setdefault(_shard(suffix if hot else suffix[:GRAM], borders, spread), [])
            # Then what stands before, backwards: equal suffixes are told apart by it.
            run += [(suffix + piece[:left][::-1], left, doc, at, block, row) for block, row in places]
        for shard in sorted(by):
            blob = squeeze(front_coded(sorted(by[shard])))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([blob], pa.binary()), *(pa.nulls(1, pa.int64()) for _ in range(4))], schema=_SCHEMA)

    for batch, c, hot in repeats.pieces(batches, SCHEME, path):
        raw = c.data.tobytes()
        rows, docs = batch.column("row").to_pylist(), [repeats.LAST if d is None else d for d in batch.column("doc_id").to_pylist()]
        block, first = batch.column("block")[0].as_py(), c.first.tolist()
        for t, at, lo, hi, is_hot in zip(c.text.tolist(), c.at.tolist(), c.lo.tolist(), c.hi.tolist(), hot.tolist(), strict=True):
            row, doc, base = rows[t], docs[t], first[t]
            for a, b, x in [(q, q, q) for q in range(lo, hi + 1)] if is_hot else ((lo, hi, at),):
                piece, own = raw[a : b + WINDOW], (doc, x - base)
                old = held.get(piece)
                if old is None:
                    held[piece] = [own, x - a, is_hot, [(block, row)]]
                    size += len(piece) + 400
                elif own > old[0]:
                    ranges.add(block, row, a - base, b - base)
                elif own == old[0]:
                    old[3].append((block, row))
                    size += 100
                else:
                    width = len(piece) - WINDOW
                    for where in old[3]:
                        ranges.add(*where, old[0][1] - old[1], old[0][1] - old[1] + width)
                    old[0], old[3] = own, [(block, row)]
        if len(ranges.out) > 50_000:
            yield removals()
        if size > HELD:
            yield from runs()
            held, size = {}, 0
    yield removals()
    yield from runs()


def _classes(left: np.ndarray, length: np.ndarray, same: np.ndarray, backwards: list[bytes], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, o): the windows of a shard's sorted suffixes, o bytes before their anchors, that are not the earliest of their class.

    left: bytes before each anchor; length: of the suffix; same: common prefix with the suffix before; backwards: what
    stands before an anchor, from it on."""
    n = len(left)
    order = np.lexsort((at, doc))
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], (doc[order][1:] != doc[order][:-1]) | (at[order][1:] != at[order][:-1]))))
    width = int(left.max(initial=0))
    table = np.zeros((n, width + 1), np.uint8)
    flat = np.frombuffer(b"".join(backwards), np.uint8)
    table[np.repeat(np.arange(n), left), np.arange(len(flat)) - np.repeat(np.cumsum(left) - left, left)] = flat
    back = np.argsort(np.ascontiguousarray(table).view(f"S{width + 1}").ravel(), kind="stable")
    ordered = table[back]
    differ = ordered[1:] != ordered[:-1]
    agree = np.concatenate(([0], np.where(differ.any(axis=1), differ.argmax(axis=1), width)))  # shorter ones end in zeros and never count where o is longer
    entries, offsets = [], []
    for o in range(width + 1):
        own = np.flatnonzero((left >= o) & (WINDOW - length <= o))
        if len(own) < 2:
            continue
        before = np.empty(n, np.int64)
        before[back] = np.cumsum(agree < o)
        key = np.cumsum(same < WINDOW - o)[own] * (n + 1) + before[own]
        by = np.lexsort((rank[own], key))
        key, first = key[by], rank[own][by]
        begin = np.concatenate(([True], key[1:] != key[:-1]))
        late = first > first[np.flatnonzero(begin)][np.cumsum(begin) - 1]
        entries.append(own[by[late]])
        offsets.append(np.full(int(late.sum()), o))
    return (np.concatenate(entries), np.concatenate(offsets)) if entries else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _losing(blobs: list[bytes]) -> list[np.ndarray]:
    """(block, row, q1, q2) of the windows of one shard's suffixes that start earlier elsewhere."""
    kept: list[tuple] = []
    for entry in merge_all(blobs):
        # A suffix of a gram that no neighbour has shares no window.
        if kept and entry[0] < GRAM and kept[-1][0] < GRAM:
            kept[-1] = entry
        else:
            kept.append(entry)
    same, keys, left, doc, at, block, row = zip(*kept, strict=True)
    same, left, doc, at, block, row = (np.array(x, np.int64) for x in (same, left, doc, at, block, row))
    same[0] = 0
    length = np.fromiter(map(len, keys), np.int64, len(keys)) - left
    entry, o = _classes(left, length, same, [k[n:] for k, n in zip(keys, length.tolist(), strict=True)], doc, at)
    order = np.lexsort((-o, entry))
    entry, o = entry[order], o[order]  # by entry, in the order of the text
    new = np.concatenate(([True], (entry[1:] != entry[:-1]) | (o[1:] != o[:-1] - 1))) if len(entry) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    end = np.concatenate((begin[1:], [len(entry)])) - 1 if len(begin) else begin
    e = entry[begin]
    return [block[e], row[e], at[e] - o[begin], at[e] - o[end]]


def _merged_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, blob) come sorted by shard."""
    whole = zstandard.ZstdDecompressor().decompress
    shard, blobs = None, []
    out = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in _losing(blobs)], names=repeats.Ranges.NAMES)
    for batch in batches:
        for now, blob in common.record_batches(batch):
            if now != shard:
                if blobs:
                    yield out()
                shard, blobs = now, []
            blobs.append(whole(blob))
    if blobs:
        yield out()


def _borders(samples: DataFrame, shards: int) -> tuple[list[bytes], int]:
    """Borders of `shards` ranges of content, RANGES at most, and how many shards there are to a range."""
    ranges = max(1, min(shards, RANGES))
    least = samples.distinct().orderBy("h", "gram").limit(ranges * SAMPLES).collect()  # RANGES times SAMPLES grams at most
    grams = sorted(bytes(r["gram"]) for r in least)
    return sorted({grams[len(grams) * i // ranges] for i in range(1, ranges)}) if grams else [], -(-shards // ranges)


def removed(documents: DataFrame) -> tuple[DataFrame, str]:
    """(docs, path): keyed docs (block, row, doc_id, text) and, by block, the windows to remove as ranges (row, q1, q2) of their starts."""
    parts = common.shuffle_partitions(documents.sparkSession)
    docs = keyed(documents, F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    path, count, samples = repeats.recurring(docs, SCHEME)
    borders, spread = _borders(samples, max(parts, count // SHARD))
    found = common.written(docs.mapInArrow(lambda it: _sorted_runs(it, path, borders, spread), _ROWS), "runs")
    dealt = found.where("shard is not null").select("shard", "blob").repartition(parts, "shard").sortWithinPartitions("shard")
    losing = dealt.mapInArrow(_merged_shards, "block long, row long, q1 long, q2 long")
    return docs, by_block(found.where("shard is null").select("block", "row", "q1", "q2").unionByName(losing), "ranges")


def digests(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    docs, path = removed(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, table in located(batches, path):
            data, offsets = common.buffer_of(batch.column("text"))
            mask = repeats.marked(table, batch, offsets, WINDOW)
            out = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text, gone = data[a:b], mask[a:b]
                n = int(gone.sum())
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0]) if n else 0
                out.append((b - a, n, spans, hashlib.sha256(text[~gone] if n else text).hexdigest()))
            c = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c[i], pa.int64()) for i in range(3)), pa.array(c[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(documents: DataFrame) -> DataFrame:
    """(doc_id, kept): the bytes of each text that stay. Cutting bytes may split a character, so kept is binary."""
    docs, path = removed(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, table in located(batches, path):
            data, offsets = common.buffer_of(batch.column("text"))
            mask = repeats.marked(table, batch, offsets, WINDOW)
            kept = [data[a:b][~mask[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary())], names=["doc_id", "kept"])

    return docs.mapInArrow(run, "doc_id long, kept binary")


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
g AS (
  SELECT r, doc_id, p, md5(substr(t, 2 * p - 1, 200)) AS g
  FROM (SELECT r, doc_id, t, unnest(generate_series(1, length(t) // 2 - 99)) AS p FROM d WHERE length(t) >= 200)),
h AS (SELECT r, p FROM (SELECT r, p, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, p) AS k FROM g) WHERE k > 1),
i AS (SELECT r, p, p + 99 AS e, max(p + 99) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
j AS (SELECT r, p, e, sum(CASE WHEN before IS NULL OR p > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM i),
s AS (SELECT r, k, min(p) AS a, max(e) AS e FROM j GROUP BY r, k),
o AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
n AS (
  SELECT r, count(*) AS n_spans, sum(e - a + 1) AS n_removed, string_agg(substr(t, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) || substr(any_value(t), 2 * max(e) + 1) AS kept
  FROM o JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(t) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, t))) AS kept_sha256
FROM d LEFT JOIN n USING (r)
"""
