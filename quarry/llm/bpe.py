"""Byte-level BPE encoding and decoding of whole texts.

Encoding takes merges from a priority queue of ranks over a doubly linked list of symbols; a queue entry whose symbols
have changed since is stale and skipped. So a pre-token of n bytes takes O(n log n), however long it is. Decoding
concatenates the vocabulary's byte strings. The vocabulary has a fixed size and is broadcast; each Python worker keeps
the encodings of at most CACHE pre-tokens.

Defined cases: a null text counts as empty and has no tokens; repeated rows, null ids and extra columns pass through as
rows of their own. The strings of special tokens in a text get their special ids, as the tokenizers library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

CACHE = 200_000
PART = 8 << 20
#: Pre-token pattern of byte-level BPE files (fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary's strings, as character: byte.

    Printable Latin-1 characters stand for themselves, the other bytes in turn for the characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """What a tokenizer file holds, with byte strings for its symbols."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], byte_symbols()
        as_bytes = lambda s: bytes(byte[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {as_bytes(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.strings = {i: s for s, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.first = [ids[bytes([b])] for b in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (as_bytes(s) for s in (merge.split(" ") if isinstance(merge, str) else merge))
            self.ranks[ids[a], ids[b]] = rank, ids[a + b]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE) -> None:
        self.vocabulary, self.most = vocabulary, cache
        self.cache: dict[str, bytes] = {}
        self.pieces = regex.compile(PATTERN).findall
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks, n = self.vocabulary.ranks, len(piece)
        symbol: list[int | None] = [self.vocabulary.first[b] for b in piece]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if found := ranks.get((symbol[i], symbol[i + 1])):
                queue.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue  # stale: one of the two has been merged since
            symbol[i], symbol[j] = new, None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := ranks.get((new, symbol[k])):
                    heapq.heappush(queue, (found[0], i, new, symbol[k], found[1]))
            h = before[i]
            if h >= 0 and (found := ranks.get((symbol[h], new))):
                heapq.heappush(queue, (found[0], h, symbol[h], new, found[1]))
        return [s for s in symbol if s is not None]

    def _packed(self, piece: str) -> bytes:
        out = np.array(self.merge(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(self.cache) >= self.most:
            self.cache.clear()
        self.cache[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        get, packed = self.cache.get, self._packed
        for i, part in enumerate(self.split(text) if self.split else [text]):
            if i % 2:
                out.append(np.array([self.vocabulary.special[part]], "<u4").tobytes())
            else:
                out += [get(p) or packed(p) for p in self.pieces(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        strings = self.vocabulary.strings
        return b"".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_kept: list[Encoder] = []


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder for a worker's vocabulary, so that its cache lasts from task to task."""
    if not _kept or _kept[0].vocabulary is not vocabulary:
        _kept[:] = [Encoder(vocabulary)]
    return _kept[0]


def tokenized(documents: DataFrame, path: str, *columns: str) -> DataFrame:
    """The columns, then n_tokens and ids (array<int>) of each row's text."""
    spark = documents.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary(path))
    docs = documents.select(*(F.col(f"`{c}`") for c in columns), F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            texts, at = batch.column("__text").to_pylist(), 0
            while at < len(texts):  # ids take more room than texts: cut what is given back at PART characters
                end, size = at, 0
                while end < len(texts) and (end == at or size < PART):
                    size += len(texts[end] or "")
                    end += 1
                ids = [encoder.encode(t or "") for t in texts[at:end]]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, end - at) for i in range(len(columns))), pa.array(n), lists], names=[*columns, "n_tokens", "ids"])
                at = end

    schema = documents.select(*(F.col(f"`{c}`") for c in columns)).schema.add("n_tokens", LongType()).add("ids", ArrayType(IntegerType()))
    return docs.mapInArrow(run, schema)


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 of the text decoded from those ids."""
    vocabulary = documents.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encoder.encode(text or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decoded(tokens: DataFrame, path: str, *columns: str) -> DataFrame:
    """The columns and text: ids of tokenized() turned back. Null ids give a null text."""
    vocabulary = tokens.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            texts = [None if x is None else encoder.decode(np.array(x, "<u4").tobytes()) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), pa.array(texts, pa.string())], names=[*columns, "text"])

    own = [F.col(f"`{c}`") for c in columns]
    return tokens.select(*own, F.col("ids").alias("__ids")).mapInArrow(run, tokens.select(*own).schema.add("text", StringType()))
