"""Forward data flow over control-flow graphs: a fixpoint for each method, for any analysis.

Methods are small and independent, so each is one group: its blocks, edges and instructions meet in one task, and the
work list runs there. An analysis is a picklable object of the ForwardAnalysis form.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry import schemas
from quarry.operators.graphs import KEY


class ForwardAnalysis(Protocol):
    """States are any values with ==; they go into tables as JSON by `show`."""

    def bottom(self) -> Any: ...

    def entry_state(self, method: dict) -> Any:
        """State at entry of blocks without predecessors."""

    def join(self, a: Any, b: Any) -> Any: ...

    def transfer(self, method: dict, block: dict, instructions: list[dict], state: Any) -> tuple[Any, list]:
        """(state after the block, what it reports)."""

    def show(self, state: Any) -> Any: ...


def fixpoint(analysis: ForwardAnalysis, method: dict, blocks: list[dict], edges: Iterable[tuple[int, int]], code: dict[int, list[dict]]) -> tuple[list, list, list[tuple[int, list]]]:
    """(entry states, exit states, reports of each visit in order) of blocks numbered from 0.

    The work list starts with all blocks in order; a block whose state before or after it changed queues its successors.
    Blocks with predecessors start from the bottom, even where they are the entry too.
    """
    before: list[list[int]] = [[] for _ in blocks]
    after: list[list[int]] = [[] for _ in blocks]
    for a, b in edges:
        before[b].append(a)
        after[a].append(b)
    entry: list = [None] * len(blocks)
    out: list = [None] * len(blocks)
    seen: list[bool] = [False] * len(blocks)
    waiting, queued, visits = deque(range(len(blocks))), [True] * len(blocks), []
    while waiting:
        b = waiting.popleft()
        queued[b] = False
        state = analysis.bottom() if before[b] else analysis.entry_state(method)
        for p in before[b]:
            if seen[p]:
                state = analysis.join(state, out[p])
        end, reports = analysis.transfer(method, blocks[b], code.get(b, []), state)
        visits.append((b, reports))
        if not seen[b] or entry[b] != state or out[b] != end:
            entry[b], out[b], seen[b] = state, end, True
            for s in after[b]:
                if not queued[s]:
                    queued[s] = True
                    waiting.append(s)
    return entry, out, visits


def per_method(instructions: DataFrame, blocks: DataFrame, edges: DataFrame, columns: list[str], run, schema: str | StructType) -> DataFrame:
    """Applies run(method, blocks, edges, code) -> rows to each method; instructions carry their block and the columns."""
    ins = instructions.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pc", "block", *columns))).alias("code"))
    bs = blocks.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("block", "start", "end"))).alias("blocks"))
    es = edges.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("src", "seq", "dst"))).alias("edges"))
    whole = bs.join(ins, KEY, "left").join(es, KEY, "left")

    def apply(batches: Iterable[pd.DataFrame]):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(parsed)
        for batch in batches:
            rows: list[dict] = []
            for m in batch.to_pylist():
                method = {k: m[k] for k in KEY}
                code: dict[int, list[dict]] = {}
                for i in m["code"] or ():
                    code.setdefault(i["block"], []).append(i)
                rows += run(method, m["blocks"], [(e["src"], e["dst"]) for e in m["edges"] or ()], code)
            yield pa.RecordBatch.from_pylist(rows, arrow)

    parsed = schemas.struct(schema) if isinstance(schema, str) else schema
    return whole.mapInArrow(apply, parsed)


def run_forward(instructions: DataFrame, blocks: DataFrame, edges: DataFrame, analysis: ForwardAnalysis, columns: tuple[str, ...] = ("opcode", "name", "registers")) -> DataFrame:
    """(dex_id, method_idx, block, entry, exit): the states at fixpoint, as JSON. instructions carry the column block."""

    def run(method, own, links, code):
        entry, out, _ = fixpoint(analysis, method, own, links, code)
        show = lambda s: json.dumps(analysis.show(s), separators=(",", ":"))
        return [method | {"block": b, "entry": show(entry[b]), "exit": show(out[b])} for b in range(len(own))]

    return per_method(instructions, blocks, edges, list(columns), run, "dex_id BIGINT, method_idx BIGINT, block INT, entry STRING, exit STRING")


class OpcodeSets:
    """Which opcodes may have run: the simplest analysis, for use and test."""

    def bottom(self):
        return frozenset()

    entry_state = lambda self, method: frozenset()

    def join(self, a, b):
        return a | b

    def transfer(self, method, block, instructions, state):
        return state | {i["opcode"] for i in instructions}, []

    def show(self, state):
        return sorted(state)
