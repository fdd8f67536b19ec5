"""Taint from sources to sinks over registers, within a method, by the data-flow runner."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import dataflow
from quarry.operators.findings import finding, location

KEY = ["dex_id", "method_idx"]


def registers_of(i: dict) -> list[int]:
    """The registers an instruction names, in a list or as a range."""
    if i["registers"]:
        return i["registers"]
    return list(range(i["range_start"], i["range_start"] + i["range_count"])) if i.get("range_count") else []


class Taint:
    """States are sets of tainted registers. Reports are (pc, rule, description, [(argument, register)])."""

    def bottom(self):
        return frozenset()

    entry_state = lambda self, method: frozenset()

    def join(self, a, b):
        return a | b

    def show(self, state):
        return sorted(state)

    def transfer(self, method, block, instructions, state):
        tainted, pending, reports = set(state), None, []
        for i in instructions:
            name, regs = i["name"], registers_of(i)
            if name.startswith("move-object"):
                if len(regs) > 1:
                    (tainted.add if regs[1] in tainted else tainted.discard)(regs[0])
            elif name.startswith("move-result-object"):
                if regs:
                    (tainted.add if _passes(pending, tainted) else tainted.discard)(regs[0])
                pending = None
            elif name.startswith(("const/", "const-string")) and regs:
                tainted.discard(regs[0])
            role = i["role"] if i["ref_kind"] == "method" else None
            if role == "sink":
                # What waits for a result still waits: a sink doesn't use it up.
                args = [(n, r) for n, r in enumerate(regs) if r in tainted]
                if args and {a for a, _ in args} >= set(i["args"] or ()):
                    reports.append((i["pc"], i["rule"], i["description"], args))
            else:
                pending = ("source", None, None) if role == "source" else ("pass", i["args"], regs) if role == "pass" else None
        return frozenset(tainted), reports


def _passes(pending, tainted) -> bool:
    """Whether the call that waits for its result gives a tainted one."""
    if pending is None:
        return False
    kind, args, regs = pending
    return kind == "source" or any(r in tainted for r in ([regs[a] for a in args if a < len(regs)] if args else regs))


_REPORT = "dex_id BIGINT, method_idx BIGINT, visit INT, pc BIGINT, rule STRING, description STRING, args STRING"


def incidents(instructions: DataFrame, blocks: DataFrame, edges: DataFrame, methods: DataFrame, code_items: DataFrame, roles: DataFrame, compat: bool = False) -> DataFrame:
    """(dex_id, method_idx, visit, pc, rule, description, args): sinks that taint reaches; args as JSON.

    Reported for the states at the fixpoint, or with compat for every visit of a block. Files without a source or without
    a sink, and methods without registers, are left out. roles is a short list of rules.
    """
    known = methods.join(F.broadcast(roles), ["class", "name", "signature"])
    best = known.groupBy("dex_id", F.col("method_idx").alias("ref_idx")).agg(F.min_by(F.struct("role", "rule", "description", "args"), "ord").alias("r")).select("dex_id", "ref_idx", "r.*")
    files = known.groupBy("dex_id").agg(F.bool_or(F.col("role") == "source").alias("a"), F.bool_or(F.col("role") == "sink").alias("b")).where("a AND b").select("dex_id")
    able = code_items.where("registers_size > 0").select(*KEY)
    code = instructions.join(files, "dex_id", "left_semi").join(able, KEY, "left_semi")
    code = code.join(best.withColumn("ref_kind", F.lit("method")), ["dex_id", "ref_kind", "ref_idx"], "left")
    own = blocks.join(files, "dex_id", "left_semi").join(able, KEY, "left_semi")

    def run(method, own, links, code):
        analysis = Taint()
        entry, _, visits = dataflow.fixpoint(analysis, method, own, links, code)
        if not compat:
            visits = [(b, analysis.transfer(method, own[b], code.get(b, []), entry[b])[1]) for b in range(len(own))]
        return [method | {"visit": n, "pc": pc, "rule": rule, "description": what, "args": json.dumps([{"index": a, "register": r} for a, r in args])} for n, (_, reports) in enumerate(visits) for pc, rule, what, args in reports]

    return dataflow.per_method(code, own, edges, ["name", "registers", "range_start", "range_count", "ref_kind", "role", "rule", "description", "args"], run, _REPORT)


def taint_findings(found: DataFrame, methods: DataFrame) -> DataFrame:
    own = methods.select(*KEY, "class", "name", "signature")
    args = F.from_json("args", "array<struct<index:int,register:int>>")
    message = F.concat(F.lit("Tainted data reaches "), F.col("description"), F.lit(" via arguments ["), F.array_join(F.transform(args, lambda a: a["index"].cast("string")), ", "), F.lit("]"))
    details = F.to_json(F.struct(F.col("pc"), F.col("description").alias("sink"), args.alias("tainted_args")))
    return finding(found.join(own, KEY, "left"), 3, 1, (F.col("method_idx"), F.col("visit"), F.col("pc")), id=F.col("rule"), kind="SensitiveDataLeak", severity="High", location=location(pc=F.col("pc")), message=message, extra=details)
