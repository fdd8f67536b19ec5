"""The finding rows that all rules give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import schemas
from quarry.operators.resolve import NO_SIGNATURE, UNKNOWN


def location(found: bool = True, pc: Column | None = None) -> Column:
    """The place of a finding, from the columns class, name, signature and method_idx of a joined method_desc."""
    text = lambda c, none: F.coalesce(F.col(c), F.lit(none)) if found else F.lit(none)
    return F.struct(
        text("class", UNKNOWN).alias("class_descriptor"), text("name", UNKNOWN).alias("method_name"), text("signature", NO_SIGNATURE if found else "").alias("signature"),
        (F.col("method_idx") if found else F.lit(None).cast("long")).alias("method_idx"), (pc if pc is not None else F.lit(None)).cast("long").alias("pc"),
    )


def extra(**values: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in sorted(values.items()))), {"ignoreNullFields": "false"})


def finding(df: DataFrame, rule_pass: int, rule: int, seq: tuple, **columns: Column | str) -> DataFrame:
    """Findings with all columns in order; seq are up to three numbers that order a rule's findings within a file."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    seqs = [(lit(seq[i]) if i < len(seq) else F.lit(0)).cast("long").alias(f"seq{i + 1}") for i in range(3)]
    own = {k: lit(v) for k, v in columns.items()}
    out = df.select("dex_id", F.lit(rule_pass).alias("pass"), F.lit(rule).alias("rule"), *seqs, *(own[c].alias(c) for c in ("id", "kind", "severity", "location", "message", "extra")))
    return out.select(*(F.col(f.name).cast(f.dataType) for f in schemas.FINDING))


ORDER = ["dex_id", "pass", "rule", "seq1", "seq2", "seq3", "id", "message"]
