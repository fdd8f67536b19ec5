"""The analysis of images: all rules, their findings in order, and statistics."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions.literals import MIN_ENTROPY
from quarry.operators import graphs, pattern, resolve, rules, structural, taint
from quarry.operators.findings import ORDER
from quarry.tables import DexTables


@dataclass(frozen=True)
class AnalysisConfig:
    enable_pattern: bool = True
    enable_structural: bool = True
    enable_taint: bool = True
    secret_min_entropy: float = MIN_ENTROPY
    #: For each image, the first findings in order of passes; None: all.
    max_findings: int | None = 500
    #: Reproduces quirks: taint findings of every visit of a block.
    compat: bool = False
    ruleset: str = "reference"


@dataclass
class Report:
    findings: DataFrame
    stats: DataFrame
    started: float = field(default_factory=time.time)


def all_findings(t: DexTables, config: AnalysisConfig) -> DataFrame:
    spark = t.images.sparkSession
    methods = resolve.method_desc(t)
    if t._persist:
        methods = methods.persist()
    parts: list[DataFrame] = []
    if config.enable_pattern:
        refs = graphs.xrefs(t.instructions, t.methods)
        parts += [pattern.hardcoded_secrets(t.strings, refs, methods, config.secret_min_entropy), pattern.insecure_http(t.strings, refs, methods), pattern.weak_crypto(t.strings, refs, methods, rules.crypto_sinks(spark))]
    if config.enable_structural:
        parts.append(structural.structural_findings(t.instructions, methods))
    if config.enable_taint:
        blocks, edges = graphs.cfg(t)
        inside = graphs.in_blocks(t.instructions, blocks)
        found = taint.incidents(inside, blocks, edges, methods, t.code_items, rules.taint_roles(spark, config.ruleset), config.compat)
        parts.append(taint.taint_findings(found, methods))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schemas.FINDING)


def limited(findings: DataFrame, most: int | None) -> DataFrame:
    """The first findings of each image, in the order of passes, rules and places."""
    if most is None:
        return findings
    from pyspark.sql import Window

    w = Window.partitionBy("dex_id").orderBy(*ORDER[1:])
    return findings.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def statistics(t: DexTables, findings: DataFrame) -> DataFrame:
    """(dex_id, method_count, string_count, instruction_count, finding_count) of each image that parses."""
    n = t.instructions.groupBy("dex_id").agg(F.count("*").alias("instruction_count"))
    f = findings.groupBy("dex_id").agg(F.count("*").alias("finding_count"))
    out = resolve.overview(t).where("parse_error IS NULL").select("dex_id", "method_count", "string_count").join(n, "dex_id", "left").join(f, "dex_id", "left")
    return out.na.fill(0, ["instruction_count", "finding_count"])


def analyze(t: DexTables, config: AnalysisConfig = AnalysisConfig()) -> Report:  # noqa: B008
    """Findings and statistics; both lazy."""
    started = time.time()
    findings = limited(all_findings(t, config), config.max_findings)
    return Report(findings, statistics(t, findings), started)


def summary(findings: DataFrame) -> DataFrame:
    """(severity, rank, id, findings): counts by severity, the worst first."""
    ranks = F.array_position(F.array(*map(F.lit, schemas.SEVERITIES)), F.col("severity"))
    return findings.groupBy("severity", "id").agg(F.count("*").alias("findings")).withColumn("rank", ranks).orderBy("rank", "id")


def filter_severity(findings: DataFrame, severities: list[str]) -> DataFrame:
    return findings.where(F.col("severity").isin(*severities))
