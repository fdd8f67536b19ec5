"""Program graphs as tables: references, calls, basic blocks and control flow, over all methods at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.format.opcodes import NOT_CODE

KEY = ["dex_id", "method_idx"]


def is_code() -> Column:
    return ~F.col("format").isin(*NOT_CODE)


def is_invoke(opcode: str | Column = "opcode") -> Column:
    op = F.col(opcode) if isinstance(opcode, str) else opcode
    return op.between(0x6E, 0x72) | op.between(0x74, 0x78) | op.isin(0xFA, 0xFB)


def branch_kind(opcode: str | Column = "opcode") -> Column:
    """if, goto, switch, end (return or throw) or plain."""
    op = F.col(opcode) if isinstance(opcode, str) else opcode
    return F.when(op.between(0x32, 0x3D), "if").when(op.between(0x28, 0x2A), "goto").when(op.between(0x2B, 0x2C), "switch").when(op.between(0x0E, 0x11) | op.isin(0x73, 0x27), "end").otherwise("plain")


def references(instructions: DataFrame) -> DataFrame:
    """(dex_id, method_idx, pc, opcode, kind, target_idx): first and second references of each instruction."""
    pair = lambda n: F.struct(F.col(f"ref{n}_kind").alias("kind"), F.col(f"ref{n}_idx").alias("target_idx"), F.lit(n or "1").alias("which"))
    out = instructions.where("ref_kind IS NOT NULL").select(*KEY, "pc", "opcode", F.explode(F.array(pair(""), pair("2"))).alias("r"))
    return out.select(*KEY, "pc", "opcode", "r.*").where("kind IS NOT NULL")


def call_edges(instructions: DataFrame, methods: DataFrame) -> DataFrame:
    """(dex_id, method_idx, pc, callee): one edge a call, parallel ones kept; callees outside the method table are left out."""
    calls = instructions.where(is_invoke() & (F.col("ref_kind") == "method")).select(*KEY, "pc", F.col("ref_idx").alias("callee"))
    return calls.join(methods.select("dex_id", F.col("method_idx").alias("callee")), ["dex_id", "callee"]).select(*KEY, "pc", "callee")


def call_graph(instructions: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): every method is a node; an edge for each call."""
    return methods.select(*KEY), call_edges(instructions, methods)


def xrefs(instructions: DataFrame, methods: DataFrame) -> DataFrame:
    """(dex_id, method_idx, pc, kind, target_idx): calls as kind 'call', other references by kind; methods count only as calls."""
    calls = call_edges(instructions, methods).select(*KEY, "pc", F.lit("call").alias("kind"), F.col("callee").alias("target_idx"))
    return calls.unionByName(references(instructions).where("kind <> 'method'").select(*KEY, "pc", "kind", "target_idx"))


def _targets(code: DataFrame) -> DataFrame:
    """(key, pc, kind, seq, target): where each branch goes, before bounds; seq orders an instruction's targets."""
    kind = branch_kind()
    offsets = F.when(kind.isin("if", "goto"), F.array("offset")).when(kind == "switch", F.transform("switch_targets", lambda x: x.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    at = code.select(*KEY, "pc", kind.alias("kind"), F.posexplode(offsets).alias("seq", "by"))
    return at.select(*KEY, "pc", "kind", "seq", (F.col("pc") + F.col("by")).alias("target"))


def blocks(instructions: DataFrame, code_items: DataFrame, catch_handlers: DataFrame) -> DataFrame:
    """(dex_id, method_idx, block, start, end): basic blocks, numbered by start.

    A block starts at the method's first instruction, at a branch's target and behind a conditional branch, and at every
    handler's address; it ends where the next one starts. What follows goto, return or throw starts none by itself.
    """
    code = instructions.where(is_code())
    size = code_items.select(*KEY, "insns_size")
    first = code.groupBy(*KEY).agg(F.min("pc").alias("start"))
    behind = code.where(branch_kind().isin("if", "switch")).select(*KEY, (F.col("pc") + F.col("units")).alias("start"))
    caught = catch_handlers.select(*KEY, F.col("addr").alias("start")).join(first.select(*KEY), KEY, "left_semi")
    to = _targets(code).select(*KEY, F.col("target").alias("start"))
    starts = first.unionByName(behind).unionByName(caught).unionByName(to).join(size, KEY).where((F.col("start") >= 0) & (F.col("start") < F.col("insns_size"))).distinct()
    w = Window.partitionBy(*KEY).orderBy("start")
    return starts.select(*KEY, (F.row_number().over(w) - 1).alias("block"), "start", F.lead("start").over(w).alias("next"), "insns_size").select(*KEY, "block", "start", F.coalesce("next", "insns_size").alias("end"))


def in_blocks(instructions: DataFrame, own: DataFrame) -> DataFrame:
    """instructions with the block each is in, by a running maximum of block starts instead of a range join."""
    marks = own.select(*KEY, F.col("start").alias("pc"), F.col("block").alias("mark"))
    w = Window.partitionBy(*KEY).orderBy("pc").rowsBetween(Window.unboundedPreceding, 0)
    both = instructions.join(marks, [*KEY, "pc"], "full")
    return both.withColumn("block", F.last("mark", ignorenulls=True).over(w)).where("ord IS NOT NULL AND block IS NOT NULL").drop("mark")


def last_instructions(instructions: DataFrame, own: DataFrame) -> DataFrame:
    """(dex_id, method_idx, block, pc, ...): the last real instruction of each block."""
    return in_blocks(instructions.where(is_code()), own).groupBy(*KEY, "block").agg(F.max_by(F.struct("pc", "opcode", "units", "offset", "switch_targets"), "pc").alias("i")).select(*KEY, "block", "i.*")


def cfg_edges(instructions: DataFrame, own: DataFrame, try_items: DataFrame, catch_handlers: DataFrame) -> DataFrame:
    """(dex_id, method_idx, src, dst, kind, seq): branch, fall and except edges between blocks; parallel edges are kept.

    seq orders a block's edges: targets as they stand, then the fall to the next block, then handlers.
    """
    last = last_instructions(instructions, own)
    start = own.select(*KEY, F.col("start").alias("target"), F.col("block").alias("dst"))
    branch = last.select(*KEY, "block", F.col("pc").alias("pc")).join(_targets(last), [*KEY, "pc"]).join(start, [*KEY, "target"]).select(*KEY, F.col("block").alias("src"), "dst", F.lit("branch").alias("kind"), "seq")
    goes_on = last.where(branch_kind().isin("if", "switch", "plain")).select(*KEY, "block")
    fall = goes_on.join(own.select(*KEY, "block", F.col("end").alias("target")), [*KEY, "block"]).join(start, [*KEY, "target"]).select(*KEY, F.col("block").alias("src"), "dst", F.lit("fall").alias("kind"), F.lit(1 << 20).alias("seq"))
    return branch.unionByName(fall).unionByName(exception_edges(own, try_items, catch_handlers))


def exception_edges(own: DataFrame, try_items: DataFrame, catch_handlers: DataFrame) -> DataFrame:
    """Edges from each block that a try range overlaps to the blocks of its handlers."""
    h = catch_handlers.select(*KEY, F.col("handler_rel_off").alias("handler_off"), F.col("pos").alias("at"), F.col("addr").alias("target"))
    start = own.select(*KEY, F.col("start").alias("target"), F.col("block").alias("dst"))
    ranges = try_items.select(*KEY, "try_pos", "handler_off", F.col("start_addr").alias("lo"), (F.col("start_addr") + F.col("insn_count")).alias("hi"))
    reach = ranges.join(h, [*KEY, "handler_off"]).join(start, [*KEY, "target"])
    over = own.select(*KEY, F.col("block").alias("src"), "start", "end").join(reach, KEY).where((F.col("start") < F.col("hi")) & (F.col("end") > F.col("lo")))
    return over.select(*KEY, "src", "dst", F.lit("except").alias("kind"), ((F.col("try_pos") + 2) * (1 << 20) + F.col("at")).cast("int").alias("seq"))


def cfg(tables, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(blocks, edges) of all methods of a DexTables. compat images have handler offsets that find no handler."""
    own = blocks(tables.instructions, tables.code_items, tables.catch_handlers)
    return own, cfg_edges(tables.instructions, own, tables.try_items, tables.catch_handlers)
