"""Recurring windows of a corpus: which stretches of a text are worth comparing, and with what.

A window is `window` consecutive units (bytes or words) of one text. Of the k-unit grams in a window the one with the
least hash is its anchor; equal windows have equal anchors at equal places, so a window can recur only if its anchor's
gram does. That leaves about 2 rows for each (window - gram + 2) units to count. A piece is the run of windows that share
one anchor: the units from the first of them to the end of the last.

`recurring` counts the grams of all anchors and sends them back to the rows that hold them, by groups of `grain` rows;
`pieces` cuts the pieces at those anchors in a second scan. Texts are never shuffled, and nothing depends on how the
input is split. All that is done with a batch of texts is done by numpy over its one buffer of bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.aligned import by_block, located

#: An anchor's gram in more places than this is split by window.
HOT = 5000
#: A null doc_id comes after all others.
LAST = 2**63 - 1
#: Of so many grams one is a sample of their contents.
SAMPLED = 256

_POSITION = np.uint64((1 << 24) - 1)
CHUNK = 1 << 20


@dataclass(frozen=True)
class Scheme:
    """units(bytes, offsets) gives (gram hashes by unit, first unit of each text and the number of all, begins, ends): unit
    i is the bytes from begins[i] to ends[i], or byte i where these are None."""

    window: int
    gram: int
    units: Callable
    within: bool  # whether an earlier start in the same document counts
    grain: int
    sampled: bool = False  # whether contents of grams are sampled


@dataclass
class Cut:
    """A batch's pieces: text, anchor and the first and last window of each, in units of the batch; hashes of their grams."""

    data: np.ndarray
    first: np.ndarray
    begins: np.ndarray | None
    ends: np.ndarray | None
    text: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    h: np.ndarray


def anchors(grams: np.ndarray, windows: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first, last): each anchor and the valid windows of `windows` grams, by their starts, whose least gram it is.

    The leftmost of equal grams wins. Many units are cut into overlapping chunks; an anchor met in two of them is given
    twice, with the windows of each."""
    n = min(len(grams) - windows + 1, len(valid))
    out: list[np.ndarray] = []
    for lo in range(0, max(n, 0), CHUNK):
        hi = min(lo + CHUNK, n)
        part = grams[lo : hi + windows - 1]
        m = (part & ~_POSITION) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span * 2 <= windows:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        rest = windows - span
        least = (np.minimum(m[: hi - lo], m[rest : rest + hi - lo]) & _POSITION).astype(np.int64)
        ok = valid[lo:hi]
        edge = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (ok[1:] != ok[:-1]))))
        last = np.concatenate((edge[1:], [hi - lo])) - 1
        keep = ok[edge]
        edge, last = edge[keep], last[keep]
        out.append(np.stack((least[edge] + lo, edge + lo, last + lo)))
    all_ = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    return all_[0], all_[1], all_[2]


def cut(column: pa.Array, s: Scheme) -> Cut:
    data, offsets = common.buffer_of(column)
    grams, first, begins, ends = s.units(data, offsets)
    size = np.diff(first)
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    some = size >= s.window
    np.add.at(edge, first[:-1][some], 1)
    np.add.at(edge, first[1:][some] - s.window + 1, -1)
    at, lo, hi = anchors(grams, s.window - s.gram + 1, np.cumsum(edge[:-1]) > 0)
    return Cut(data, first, begins, ends, np.searchsorted(first, lo, "right") - 1, at, lo, hi, grams[at])


def _anchor_rows(batches: Iterator[pa.RecordBatch], s: Scheme) -> Iterator[pa.RecordBatch]:
    """Rows (block, row, h, n, gram): of `grain` rows of a block, from row on, how often a gram is an anchor in them (in how
    many texts, if starts in the same document do not count), and some grams' contents."""
    for batch, _ in located(batches, ""):
        c = cut(batch.column("text"), s)
        group = batch.column("row").to_numpy() // s.grain * s.grain
        h, row, text = c.h, group[c.text], c.text
        order = np.lexsort((text, h, row))
        h, row, text, at = h[order], row[order], text[order], c.at[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        count = np.ones(len(h), np.int64)
        if not s.within:
            count[1:] = new[1:] | (text[1:] != text[:-1])
        begin = np.flatnonzero(new)
        n = np.add.reduceat(count, begin) if len(begin) else np.zeros(0, np.int64)
        h, row, at = h[begin], row[begin], at[begin]
        grams: list[bytes | None] = [None] * len(h)
        if s.sampled:
            for i in np.flatnonzero(h % np.uint64(SAMPLED) == 0).tolist():
                grams[i] = c.data[at[i] : at[i] + s.gram].tobytes()
        block = np.full(len(h), batch.column("block")[0].as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(row), pa.array(h.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(grams, pa.binary())], names=["block", "row", "h", "n", "gram"])


def recurring(docs: DataFrame, s: Scheme) -> tuple[str, int, DataFrame]:
    """(path, count, samples): where the recurring anchors of keyed docs are written by block (row, h, hot), how many rows
    these are, and the samples of grams (h, gram)."""
    rows = common.written(docs.select("block", "row", "text").mapInArrow(lambda it: _anchor_rows(it, s), "block long, row long, h long, n int, gram binary"), "anchors")
    seen = rows.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h", (F.col("n") > HOT).alias("hot"))
    path = by_block(rows.select("block", "row", "h").join(seen, "h"), "recurring")
    count = docs.sparkSession.read.schema("row long, h long, hot boolean").parquet(path).count()
    return path, count, rows.where("gram is not null").select("h", "gram")


def pieces(batches: Iterator[pa.RecordBatch], s: Scheme, path: str) -> Iterator[tuple[pa.RecordBatch, Cut, np.ndarray]]:
    """(batch, its pieces at recurring anchors, whether each anchor is hot)."""
    for batch, table in located(batches, path, s.grain):
        if table is None:
            continue
        c = cut(batch.column("text"), s)
        known = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(known, kind="stable")
        known, hot = known[order], np.asarray(table.column("hot").to_numpy(zero_copy_only=False), bool)[order]
        i = np.searchsorted(known, c.h).clip(0, len(known) - 1)
        keep = np.flatnonzero(known[i] == c.h)
        yield batch, Cut(c.data, c.first, c.begins, c.ends, c.text[keep], c.at[keep], c.lo[keep], c.hi[keep], c.h[keep]), hot[i[keep]]


class Ranges:
    """Windows to remove as rows (block, row, q1, q2), of their starts within the text; neighbours are joined."""

    NAMES = ["block", "row", "q1", "q2"]

    def __init__(self) -> None:
        self.out: list[list[int]] = []

    def add(self, block: int, row: int, q1: int, q2: int) -> None:
        last = self.out[-1] if self.out else None
        if last is not None and last[1] == row and last[0] == block and last[3] + 1 == q1:
            last[3] = q2
        else:
            self.out.append([block, row, q1, q2])

    def taken(self) -> list[np.ndarray]:
        out = np.array(self.out, np.int64).reshape(-1, 4)
        self.out = []
        return [np.ascontiguousarray(out[:, i]) for i in range(4)]


def marked(table: pa.Table | None, batch: pa.RecordBatch, first: np.ndarray, window: int) -> np.ndarray:
    """Of all units of a batch's texts (first: of each text, and all), those inside a window that starts in a range of the table."""
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    if table is not None:
        rows = batch.column("row").to_numpy()
        order = np.argsort(rows, kind="stable")
        text = order[np.searchsorted(rows[order], table.column("row").to_numpy())]
        np.add.at(edge, first[text] + table.column("q1").to_numpy(), 1)
        np.add.at(edge, first[text] + table.column("q2").to_numpy() + window, -1)
    return np.cumsum(edge[:-1]) > 0
