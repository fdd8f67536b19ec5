"""Rules on the calls of one method: WebView settings, TLS errors, file modes, started processes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import rules
from quarry.operators.findings import extra, finding, location

KEY = ["dex_id", "method_idx"]


def calls_with_roles(instructions: DataFrame, methods: DataFrame, callees: DataFrame) -> DataFrame:
    """Instructions that refer to a method with a role: (dex_id, method_idx, pc, registers, role, callee_signature). The callees are a short list of rules."""
    m = methods.join(F.broadcast(callees), ["class", "name"]).where("any_signature IS NULL OR any_signature = signature").select("dex_id", F.col("method_idx").alias("ref_idx"), "role", F.col("signature").alias("callee_signature"))
    return instructions.where("ref_kind = 'method'").select(*KEY, "pc", "registers", "ref_idx").join(m, ["dex_id", "ref_idx"]).drop("ref_idx")


def literal_at(instructions: DataFrame, calls: DataFrame, argument: int) -> DataFrame:
    """calls with `literal`, the constant last put into the register of their argument, null if unknown.

    A fold over a method's instructions in order of place, blind to branches: const sets, a move copies or forgets, and
    a return forgets. Only methods with such calls are folded; each is one group.
    """
    asked = calls.where(F.size("registers") > argument).select(*KEY, "pc", F.get("registers", F.lit(argument)).alias("ask"))
    steps = instructions.where(F.col("name").startswith("const") | F.col("name").startswith("move") | F.col("name").startswith("return")).join(asked.select(*KEY).distinct(), KEY, "left_semi")
    rows = steps.select(*KEY, "pc", "name", "registers", "literal", F.lit(None).cast("int").alias("ask")).unionByName(asked.select(*KEY, "pc", F.lit("").alias("name"), F.array().cast("array<int>").alias("registers"), F.lit(None).cast("long").alias("literal"), "ask"))
    grouped = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pc", "name", "registers", "literal", "ask"))).alias("steps"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for m in batch.to_pylist():
                known: dict[int, int] = {}
                for s in m["steps"]:
                    r, name = s["registers"], s["name"]
                    if s["ask"] is not None:
                        out.append((m["dex_id"], m["method_idx"], s["pc"], known.get(s["ask"])))
                    elif name.startswith("const"):
                        if r and s["literal"] is not None:
                            known[r[0]] = s["literal"]
                    elif name.startswith("move"):
                        if len(r) > 1:
                            if r[1] in known:
                                known[r[0]] = known[r[1]]
                            else:
                                known.pop(r[0], None)
                    elif r:
                        known.pop(r[0], None)
            c = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=[*KEY, "pc", "literal"])

    return calls.join(grouped.mapInArrow(fold, "dex_id long, method_idx long, pc long, literal long"), [*KEY, "pc"], "left")


def structural_findings(instructions: DataFrame, methods: DataFrame) -> DataFrame:
    spark = instructions.sparkSession
    calls = calls_with_roles(instructions, methods, rules.structural_callees(spark))
    own = methods.select(*KEY, "class", "name", "signature")
    pc = F.col("pc")
    place = location(pc=pc)
    seq = lambda at: (F.col("method_idx"), F.lit(at), pc)
    files = literal_at(instructions, calls.where("role = 'file_output'"), 2).where(F.col("literal").isin(*rules.WORLD_MODES)).join(own, KEY, "left")
    out = finding(files, 2, 1, seq(0), id="M9_INSECURE_FILE_MODE", kind="InsecureFileMode", severity="Medium", location=place, message="openFileOutput with MODE_WORLD_* flag detected", extra=extra(mode_literal=F.col("literal")))
    for role, id_, kind, message in (("exec", "M1_RUNTIME_EXEC", "RuntimeExec", "Runtime.exec invocation detected"), ("process", "M1_PROCESS_BUILDER", "ProcessBuilderExec", "ProcessBuilder constructor detected")):
        each = calls.where(F.col("role") == role).join(own, KEY, "left")
        out = out.unionByName(finding(each, 2, 1, seq(0), id=id_, kind=kind, severity="High", location=place, message=message, extra=extra(signature=F.col("callee_signature"))))
    return out.unionByName(chain(calls, own))


def chain(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """At most one finding a method: JavaScript with an interface, else with file access, else an override that accepts TLS errors."""
    at = lambda role: F.min(F.when(F.col("role") == role, F.col("pc")))
    per = calls.groupBy(*KEY).agg(at("javascript").alias("js"), at("interface").alias("iface"), at("file_access").alias("file"), F.bool_or(F.col("role") == "proceed").alias("proceed"))
    name, signature = rules.SSL_OVERRIDE
    per = per.join(methods, KEY, "left")
    js = F.col("js").isNotNull()
    case = F.when(js & F.col("iface").isNotNull(), 0).when(js & F.col("file").isNotNull(), 1).when((F.col("name") == name) & (F.col("signature") == signature) & F.col("proceed"), 2)
    per = per.withColumn("case", case).where("case IS NOT NULL")
    pick = lambda *v: F.when(F.col("case") == 0, v[0]).when(F.col("case") == 1, v[1]).otherwise(v[2])
    pc = pick(F.col("iface"), F.col("file"), F.lit(None).cast("long"))
    details = pick(
        extra(javascript_enabled_pc=F.col("js"), javascript_interface_pc=F.col("iface")),
        extra(javascript_enabled_pc=F.col("js"), file_access_pc=F.col("file")), extra(method=F.col("name")),
    )
    message = pick(F.lit("WebView enables JavaScript and attaches addJavascriptInterface"), F.lit("WebSettings enables JavaScript and allows file access"), F.lit("Method overrides onReceivedSslError and calls handler.proceed()"))
    return finding(
        per, 2, 1, (F.col("method_idx"), 1), id=pick(F.lit("M7_WEBVIEW_JS_INTERFACE"), F.lit("M7_WEBVIEW_FILE_ACCESS"), F.lit("M5_SSL_BYPASS")),
        kind=pick(F.lit("WebViewJavascriptInterface"), F.lit("WebViewFileAccess"), F.lit("SslErrorBypass")), severity=pick(F.lit("Critical"), F.lit("High"), F.lit("High")),
        location=location(pc=pc), message=message, extra=details,
    )
