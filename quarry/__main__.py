"""python -m quarry PATH [--max-findings N]: a summary and the findings of images."""

from __future__ import annotations

import argparse
import time
from dataclasses import replace

from pyspark.sql import SparkSession

from quarry.operators import resolve
from quarry.operators.findings import ORDER
from quarry.plans.engine import AnalysisConfig, analyze
from quarry.tables import DexTables


def report(spark: SparkSession, path: str, most: int | None = None) -> str:
    config = AnalysisConfig() if most is None else replace(AnalysisConfig(), max_findings=most)
    t = DexTables.load(spark, path)
    out: list[str] = []
    for o in resolve.overview(t).orderBy("path", "entry_name").collect():  # a row a file that was asked for
        out.append(f"Dex summary for {o['path']}" + (f" ({o['entry_name']})" if o["entry_name"] else ""))
        if o["parse_error"]:
            out.append(f"failed to parse dex file: {o['parse_error']}")
            continue
        out += [f"{k.capitalize().replace('_', ' ') + ':':<16}{o[k]}" for k in ("version", "file_size", "string_count", "type_count", "proto_count", "field_count", "method_count", "class_count")]
    out.append("\nTop classes by method count:")
    top = resolve.top_classes(t).collect()
    out += [f"  {r['method_count']:<5} {r['descriptor']}" for r in top] or ["  (no classes decoded)"]
    started = time.time()
    found = analyze(t, config)
    rows = found.findings.orderBy(*ORDER).collect()  # max_findings rows an image at most
    for s in found.stats.collect():
        out.append(f"\nAnalysis stats: methods={s['method_count']} strings={s['string_count']} instructions={s['instruction_count']} findings={s['finding_count']}")
    out += [f"Analysis elapsed: {round((time.time() - started) * 1000)} ms", f"\nAnalysis findings ({len(rows)} total):"]
    for n, r in enumerate(rows, 1):
        at = r["location"]
        out += [f"{n:>3}. [{r['severity']}] {r['id']} :: {at['class_descriptor']}::{at['method_name']}", f"     {r['message']}"]
        if at["pc"] is not None:
            out.append(f"     @pc {at['pc']}")
    t.release()
    return "\n".join(out if rows else [*out, "  No findings reported."])


def main() -> None:
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("path")
    p.add_argument("--max-findings", type=int)
    args = p.parse_args()
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    print(report(spark, args.path, args.max_findings))


if __name__ == "__main__":
    main()
