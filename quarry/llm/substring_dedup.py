"""Substring dedup by words: recurring passages are confirmed, compiled to sharded Aho-Corasick automata, and all
documents are streamed through them.

A window is 13 consecutive words [^\\x20\\x09-\\x0D]+ of one document; a word goes when a window over it also starts in a
document with a smaller doc_id, judged on the input. The plan:

1. `repeats` finds the pieces of text whose windows may recur, each around one anchor, a 5-word gram. Each task collects
   its distinct pieces, with the smallest and largest doc_id it met them in and the groups of GRAIN rows these are in, and
   sends them to the shard of the gram.
2. A shard confirms the windows that several documents hold, by 128-bit hashes of their words. A passage is a longest run
   of confirmed windows of a piece that were all first in the same document. A gram with more than repeats.HOT anchors is
   sent window by window, each to the shard of its own words, so no gram is a group that grows with the corpus.
3. Passages go back to the groups of rows that hold them in a document after their first. So automata are sharded by documents: those of a group have the
   passages that occur there and no others, at most AUTOMATON words each, and however large the corpus, each document
   meets the automata of its own group only.
4. The last scan streams every document, word by word, through its automata (pyahocorasick). A word is DIGITS characters,
   the digits of its number in the automaton's vocabulary, since a node looks its children up one by one; digits of
   different places differ, so nothing matches across words. Wherever a passage occurs in a document that is not its
   first, its words go.

Defined cases: null and empty texts have no words and lose none; documents under 13 words lose none; rows with one
doc_id never remove from each other; a null doc_id counts as larger than any, so such rows lose what others hold and
remove nothing. Repeated rows give rows of their own. An empty table gives none. A text is streamed whole, however long,
in memory that follows it. Extra columns are ignored; `deduplicated` returns doc_id and text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common, repeats
from quarry.llm.aligned import by_block, keyed, located

WINDOW, GRAM = 13, 5
#: Rows that share automata, and words of the passages in one of them.
GRAIN, AUTOMATON, DIGITS = 1024, 600_000, 2
#: Recurring anchors to a shard, about; bytes of pieces that a task holds before it sends them.
SHARD, HELD = 40_000, 32 << 20
#: Stands for a document where a window is in one alone.
ALONE = -(2**63)


def _units(data: np.ndarray, offsets: np.ndarray):
    starts, ends, first = common.words_of(data, offsets)
    return common.run_hashes(common.word_hashes(data, starts, ends), GRAM), first, starts, ends


SCHEME = repeats.Scheme(WINDOW, GRAM, _units, False, GRAIN)


def _blob(columns: list, texts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join([struct.pack("<II", len(texts), len(columns)), *(np.array(x, np.int64).tobytes() for x in columns), np.array([len(t) for t in texts], np.int64).tobytes(), *texts]))


def _parsed(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(columns, lengths, texts) of a `_blob`."""
    blob = zstandard.ZstdDecompressor().decompress(blob)
    n, k = struct.unpack_from("<II", blob)
    numbers = np.frombuffer(blob, np.int64, n * (k + 1), 8).reshape(k + 1, n)
    return numbers[:-1], numbers[-1], blob[8 + 8 * n * (k + 1) :]


def _collected(batches: Iterator[pa.RecordBatch], path: str, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, blob, places): a task's distinct pieces with their grams, first and last doc_id, and how many groups of
    rows they are in; and these groups, (block, row) one after another, with the last doc_id there."""
    held: dict[bytes, list] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for piece, (gram, group, first, last, places) in held.items():
            by.setdefault(group % shards, []).append((gram, first, last, len(places), piece, places))
        for shard, found in by.items():
            *numbers, words, places = zip(*found, strict=True)
            flat = np.array([x for p in places for x in p], np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([_blob(numbers, words)], pa.binary()), pa.array([zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat).tobytes())], pa.binary())], names=["shard", "blob", "places"])

    for batch, c, hot in repeats.pieces(batches, SCHEME, path):
        raw = c.data.tobytes()
        docs = [repeats.LAST if d is None else d for d in batch.column("doc_id").to_pylist()]
        block = batch.column("block")[0].as_py()
        groups = [(block, r) for r in (batch.column("row").to_numpy() // GRAIN * GRAIN).tolist()]
        # Words that more or other than one space parts are joined anew.
        wide = np.concatenate(([0], np.cumsum((c.begins[1:] != c.ends[:-1] + 1) | (c.data[np.minimum(c.ends[:-1], len(c.data) - 1)] != 32)))) if len(c.begins) else np.zeros(0, np.int64)
        last_word = c.hi + WINDOW - 1
        plain = wide[last_word] == wide[c.lo]
        lists = (c.text, c.lo, c.hi, c.begins[c.lo], c.ends[last_word], c.h.view(np.int64), plain, hot)
        for t, lo, hi, a, b, gram, is_plain, is_hot in zip(*(x.tolist() for x in lists), strict=True):
            doc, where = docs[t], groups[t]
            for words in [b" ".join(raw[c.begins[q] : c.ends[q + WINDOW - 1]].split()) for q in range(lo, hi + 1)] if is_hot else (raw[a:b] if is_plain else b" ".join(raw[a:b].split()),):
                old = held.get(words)
                if old is None:
                    held[words] = [gram, int.from_bytes(hashlib.blake2b(words, digest_size=4).digest(), "little") if is_hot else gram, doc, doc, [[*where, doc]]]
                    size += len(words) + 400
                    continue
                if doc < old[2]:
                    old[2] = doc
                elif doc > old[3]:
                    old[3] = doc
                place = old[4][-1]
                if place[1] != where[1] or place[0] != where[0]:
                    old[4].append([*where, doc])
                    size += 150
                elif doc > place[2]:
                    place[2] = doc
        if size > HELD:
            yield from sent()
            held, size = {}, 0
    yield from sent()


def _passages(blobs: list[bytes], places: list[bytes]) -> pa.RecordBatch:
    """(block, row, blob): for each group of rows the passages of one shard's pieces that are there, and the documents that
    they were first in."""
    parsed = [_parsed(b) for b in blobs]
    _, first, last, count = np.concatenate([p[0] for p in parsed], axis=1)
    data, offsets = np.frombuffer(b"".join(p[2] for p in parsed), np.uint8), np.concatenate(([0], np.cumsum(np.concatenate([p[1] for p in parsed]))))
    whole = zstandard.ZstdDecompressor().decompress
    block, group, latest = (x.tolist() for x in np.concatenate([np.frombuffer(whole(p), np.int64).reshape(3, -1) for p in places], axis=1))
    at_place = np.concatenate(([0], np.cumsum(count))).tolist()
    starts, ends, at = common.words_of(data, offsets)
    hashes = common.word_hashes(data, starts, ends)
    one, two = common.run_hashes(hashes, WINDOW), common.run_hashes(common.mix(common.word_hashes(data, starts, ends, 1)), WINDOW)
    piece = np.repeat(np.arange(len(first)), np.diff(at))[: len(one)]
    own = np.flatnonzero(np.arange(len(one)) + WINDOW <= at[piece + 1])  # windows within their piece
    piece, one, two = piece[own], one[own], two[own]
    order = np.lexsort((first[piece], two, one))
    begin = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))
    edge = np.flatnonzero(begin)
    least, most = first[piece[order]][edge], np.maximum.reduceat(last[piece[order]], edge)
    doc = np.empty(len(own), np.int64)
    doc[order] = np.where(most > least, least, ALONE)[np.cumsum(begin) - 1]
    some = np.flatnonzero(doc != ALONE)
    own, piece, doc = own[some], piece[some], doc[some]
    new = np.concatenate(([True], (piece[1:] != piece[:-1]) | (own[1:] != own[:-1] + 1) | (doc[1:] != doc[:-1]))) if len(own) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    end = np.concatenate((begin[1:], [len(own)])) - 1 if len(begin) else begin
    raw = data.tobytes()
    found: dict[tuple[int, int], dict[bytes, int]] = {}
    for a, b, d, p in zip(starts[own[begin]].tolist(), ends[own[end] + WINDOW - 1].tolist(), doc[begin].tolist(), piece[begin].tolist(), strict=True):
        words = raw[a:b]
        for i in range(at_place[p], at_place[p + 1]):
            if latest[i] > d:  # else no document there loses it
                found.setdefault((block[i], group[i]), {})[words] = d
    rows = [(b, r, _blob([list(x.values())], list(x))) for (b, r), x in found.items()]
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["block", "row", "blob"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, blob, places) come sorted by shard."""
    shard, held = None, []
    for batch in batches:
        for now, *found in common.record_batches(batch):
            if now != shard:
                if held:
                    yield _passages(*zip(*held, strict=True))
                shard, held = now, []
            held.append(found)
    if held:
        yield _passages(*zip(*held, strict=True))


def confirmed(documents: DataFrame) -> tuple[DataFrame, str]:
    """(docs, path): keyed docs (block, row, doc_id, text) and the passages (row, blob) of each GRAIN rows, by block."""
    parts = common.shuffle_partitions(documents.sparkSession)
    docs = keyed(documents, F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    path, count, _ = repeats.recurring(docs, SCHEME)
    shards = max(parts, count // SHARD)
    sent = common.written(docs.mapInArrow(lambda it: _collected(it, path, shards), "shard int, blob binary, places binary"), "pieces")
    found = sent.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_confirmed, "block long, row long, blob binary")
    return docs, by_block(found, "passages")


class Automaton:
    """Passages compiled to an automaton over the digits of their words' numbers."""

    def __init__(self, passages: dict[bytes, int]) -> None:
        self.number: dict[bytes, int] = {}
        number = self.number
        keys = [[number.setdefault(w, len(number) + 1) for w in words.split(b" ")] for words in passages]  # 0: a word of no passage
        self.base = int(np.ceil((len(number) + 1) ** (1 / DIGITS) + 1e-9))
        self.match = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        sizes = np.array([len(k) for k in keys], np.int64)
        text = self._text([n for k in keys for n in k])
        at = (np.cumsum(sizes) - sizes) * DIGITS
        for i, (a, n) in enumerate(zip(at.tolist(), (sizes * DIGITS).tolist(), strict=True)):
            self.match.add_word(text[a : a + n], i)
        self.match.make_automaton()
        self.sizes, self.first = sizes, np.array(list(passages.values()), np.int64)

    def _text(self, numbers: list[int]) -> str:
        """DIGITS characters a number, each place from an alphabet of its own."""
        n = np.array(numbers, np.int64)
        digits = np.empty((len(n), DIGITS), "<u4")
        for i in range(DIGITS):
            digits[:, i] = n % self.base + 32 + i * self.base
            n //= self.base
        return digits.tobytes().decode("utf-32-le")

    def located(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, first document) of every occurrence of a passage in the words; end is the last word."""
        get = self.number.get
        found = list(self.match.iter(self._text([get(w, 0) for w in words])))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        end, i = np.array(found, np.int64).T
        end //= DIGITS
        return end - self.sizes[i] + 1, end, self.first[i]


class Shards:
    """The automata of one group of rows after another; they are kept while the group stays the same."""

    def __init__(self) -> None:
        self.key, self.automata = None, []

    def of(self, key: tuple, table: pa.Table | None) -> Iterator[Automaton]:
        if key != self.key:
            passages = {}
            for (docs,), sizes, texts in [] if table is None else map(_parsed, table.column("blob").to_pylist()):
                at = np.concatenate(([0], np.cumsum(sizes))).tolist()
                passages |= {texts[a:b]: d for a, b, d in zip(at[:-1], at[1:], docs.tolist(), strict=True)}
            self.key, self.automata = key, []  # none but the first is kept: their size is bounded, their number is not
            part: dict[bytes, int] = {}
            size = 0
            self.rest: list[dict[bytes, int]] = []
            for words, doc in passages.items():
                part[words] = doc
                size += words.count(b" ") + 1
                if size >= AUTOMATON:
                    self.rest.append(part)
                    part, size = {}, 0
            if self.rest:
                self.rest.append(part)
            elif part:
                self.automata = [Automaton(part)]
        yield from self.automata
        for part in self.rest:
            if part:
                yield Automaton(part)


def _streamed(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[list, list[list[bytes]], list[np.ndarray]]]:
    """(batch, words of each text, which of them go) of keyed batches, in groups of GRAIN rows."""
    shards = Shards()
    for whole, found in located(batches, path, GRAIN):
        rows = whole.column("row").to_numpy() // GRAIN * GRAIN
        edge = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1], [True]))).tolist()
        own = None if found is None else found.column("row").to_numpy()
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            batch = whole.slice(i, j - i)
            key = batch.column("block")[0].as_py(), int(rows[i])
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]
            docs = [repeats.LAST if d is None else d for d in batch.column("doc_id").to_pylist()]
            edges = [None] * len(texts)
            table = None if own is None or key == shards.key else found.filter(pa.array(own == key[1]))
            for automaton in shards.of(key, table):
                for k, (words, doc) in enumerate(zip(texts, docs, strict=True)):
                    if len(words) >= WINDOW:
                        begin, end, first = automaton.located(words)
                        late = first < doc
                        if late.any():
                            if edges[k] is None:
                                edges[k] = np.zeros(len(words) + 1, np.int64)
                            np.add.at(edges[k], begin[late], 1)
                            np.add.at(edges[k], end[late] + 1, -1)
            yield batch, texts, [None if e is None else np.cumsum(e[:-1]) > 0 for e in edges]


def _kept(words: list[bytes], gone: np.ndarray | None) -> bytes:
    return b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def _last_scan(documents: DataFrame, columns: Callable, schema: str) -> DataFrame:
    docs, path = confirmed(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, gone in _streamed(batches, path):
            yield pa.RecordBatch.from_pydict(columns(batch, texts, gone))

    return docs.mapInArrow(run, schema)


def digests(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""

    def columns(batch: pa.RecordBatch, texts: list, gone: list) -> dict:
        return {
            "doc_id": batch.column("doc_id"), "n_words": pa.array(list(map(len, texts)), pa.int64()), "n_removed": pa.array([0 if g is None else int(g.sum()) for g in gone], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(_kept(w, g)).hexdigest() for w, g in zip(texts, gone, strict=True)], pa.string()),
        }

    return _last_scan(documents, columns, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(documents: DataFrame) -> DataFrame:
    """(doc_id, text): the texts without the words to remove, kept words joined by one space; untouched texts as they are."""

    def columns(batch: pa.RecordBatch, texts: list, gone: list) -> dict:
        kept = [t if g is None else _kept(w, g).decode("utf-8", "surrogatepass") for t, w, g in zip(batch.column("text").to_pylist(), texts, gone, strict=True)]
        return {"doc_id": batch.column("doc_id"), "text": pa.array(kept, pa.string())}

    return _last_scan(documents, columns, "doc_id long, text string")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT r, doc_id, p, array_to_string(w[p : p + 12], ' ') AS g
  FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM d WHERE len(w) >= 13)),
h AS (SELECT r, p FROM (SELECT r, p, doc_id, min(doc_id) OVER (PARTITION BY g) AS m FROM g) WHERE coalesce(doc_id > m, m IS NOT NULL)),
x AS (SELECT DISTINCT r, unnest(generate_series(p, p + 12)) AS p FROM h),
k AS (
  SELECT w.r, count(x.p) AS n_removed, coalesce(string_agg(w.w, ' ' ORDER BY w.p) FILTER (x.p IS NULL), '') AS kept
  FROM (SELECT r, unnest(w) AS w, unnest(generate_series(1, len(w))) AS p FROM d) w LEFT JOIN x ON x.r = w.r AND x.p = w.p GROUP BY w.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
