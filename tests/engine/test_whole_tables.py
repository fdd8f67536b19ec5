"""Operators on whole tables, with the rows that the queries and their SQL leave out, against brute force."""

import math
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from quarry import functions as fn
from quarry.functions import literals
from quarry.plans import queries

SF = "/root/testdata/sf0.01"


def test_preview_of_all_turns(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("text", fn.preview_literal(F.col("text")).alias("preview")).collect()
    cut = 0
    for r in rows:
        t = re.sub(r"^\s+|\s+$", "", r["text"])
        if len(b := t.encode()) > 64:
            cut, t = cut + (not t.isascii()), b[:64].decode(errors="ignore") + "…"
        assert r["preview"] == t
    assert cut > 100


def test_entropy_of_all_tokens(spark):
    t = spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(F.split("text", " ")).alias("t")).where(F.octet_length("t") >= literals.MIN_LENGTH).distinct()
    rows = t.select("t", fn.shannon_entropy(F.col("t")).alias("entropy")).collect()
    for r in rows:
        b = r["t"].encode()
        assert abs(r["entropy"] + sum(n / len(b) * math.log2(n / len(b)) for n in Counter(b).values())) < 1e-9
    assert sum(not r["t"].isascii() for r in rows) > 10_000


def test_access_flags_of_keys_above_the_tables(spark, tmp_path):
    keys = [0, 1, 0x7FFF, 0x8000, 0x10000, 0x10000, 0x10001, 0x18000, 0x20000, 0x30401, 1_200_000, 2**32, 2**63 - 1, -1, -0x8000, -(2**63), None]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(queries.access_flags(spark, str(tmp_path)).collect()) == order(c.execute(queries.SQL["access_flags"]).fetchall())
    whole = spark.read.parquet(str(tmp_path / "part.parquet")).select("p_partkey", fn.access_flag_names(F.col("p_partkey")).alias("names")).collect()
    for r in whole:  # the operator has the flags above ENUM too
        assert r["names"] == [n for n, bit in literals.FLAGS.items() if (r["p_partkey"] or 0) & bit]
    assert sum("CONSTRUCTOR" in r["names"] for r in whole) > 5 and sum("DECLARED_SYNCHRONIZED" in r["names"] for r in whole) > 4
