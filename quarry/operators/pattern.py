"""Rules on string literals: hard-coded secrets, cleartext HTTP, weak cryptography."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import classify_secret, preview_literal, secret_severity, weak_algorithm
from quarry.operators.findings import extra, finding, location

KEY = ["dex_id", "method_idx"]
#: Stands for "no method" where findings are told apart.
NOWHERE = 2**32 - 1


def with_uses(strings: DataFrame, xref: DataFrame) -> DataFrame:
    """strings with the methods that use them, in order of use (ord); unused ones once, with a null method."""
    uses = xref.where("kind = 'string'").select("dex_id", F.col("target_idx").alias("string_idx"), "method_idx", "pc")
    return strings.join(uses, ["dex_id", "string_idx"], "left")


def first_by(df: DataFrame, *key: str) -> DataFrame:
    """The first row of each key within a file, by string, method and place."""
    w = Window.partitionBy("dex_id", *key).orderBy("string_idx", "method_idx", "pc")
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _placed(df: DataFrame, methods: DataFrame):
    own = methods.select(*KEY, "class", "name", "signature")
    both = df.join(own, KEY, "left")
    return both, F.when(F.col("method_idx").isNull(), location(False)).otherwise(location())


def hardcoded_secrets(strings: DataFrame, xref: DataFrame, methods: DataFrame, min_entropy: float = 3.5) -> DataFrame:
    value = F.col("value")
    labelled = strings.where(value.isNotNull()).withColumn("label", classify_secret(value, min_entropy)).where("label IS NOT NULL")
    labelled = labelled.withColumn("severity", secret_severity(F.col("label"), value))
    found = with_uses(labelled, xref).withColumn("at", F.coalesce("method_idx", F.lit(NOWHERE)))
    both, place = _placed(first_by(found, "at", "label"), methods)
    message = F.concat(F.lit("Literal `"), preview_literal(value), F.lit("` matched "), F.col("label"), F.lit(" pattern"))
    return finding(both, 1, 1, (F.col("string_idx"), F.col("at"), F.col("pc")), id="M1_HARDCODED_SECRET", kind="HardcodedSecret", severity=F.col("severity"), location=place, message=message, extra=extra(pattern=F.col("label"), literal=value))


def insecure_http(strings: DataFrame, xref: DataFrame, methods: DataFrame) -> DataFrame:
    value = F.col("value")
    found = with_uses(strings.where(value.contains("http://")), xref).withColumn("at", F.coalesce("method_idx", F.lit(NOWHERE)))
    both, place = _placed(first_by(found, "at", "string_idx"), methods)
    message = F.concat(F.lit("Insecure HTTP literal `"), preview_literal(value), F.lit("` detected"))
    return finding(both, 1, 2, (F.col("string_idx"), F.col("at")), id="M5_INSECURE_HTTP", kind="InsecureCommunication", severity="Medium", location=place, message=message, extra=extra(literal=value, kind=F.lit("http_literal")))


def weak_crypto(strings: DataFrame, xref: DataFrame, methods: DataFrame, sinks: DataFrame) -> DataFrame:
    """One finding for each caller, sink and algorithm; the algorithm is that of the caller's first weak string. A file
    without any, but with a string that names the Cipher class, has one finding of severity Info."""
    callees = methods.join(F.broadcast(sinks), ["class", "name", "signature"]).select("dex_id", F.col("method_idx").alias("target_idx"), "sink", "description")  # a short list of rules
    weak = strings.withColumn("algorithm", weak_algorithm(F.col("value"))).where("algorithm IS NOT NULL")
    of = with_uses(weak, xref).where("method_idx IS NOT NULL").groupBy(*KEY).agg(F.min_by("algorithm", "string_idx").alias("algorithm"))
    calls = xref.where("kind = 'call'").join(callees, ["dex_id", "target_idx"]).groupBy(*KEY, "sink", "description").agg(F.min("pc").alias("pc"))
    both = calls.join(of, KEY, "left").join(methods.select(*KEY, "class", "name", "signature"), KEY, "left")
    alg = F.col("algorithm")
    message = F.when(alg.isNotNull(), F.concat(F.col("description"), F.lit(" invoked with weak algorithm `"), alg, F.lit("`"))).otherwise(F.concat(F.col("description"), F.lit(" invoked (algorithm unknown – review manually)")))
    found = finding(both, 1, 3, (F.col("method_idx"), F.col("pc")), id=F.col("sink"), kind="WeakCrypto", severity=F.when(alg.isNotNull(), "High").otherwise("Low"), location=location(), message=message, extra=extra(sink=F.col("description"), algorithm=F.coalesce(alg, F.lit("unknown"))))
    named = strings.where(F.col("value").contains("javax/crypto/Cipher")).select("dex_id").distinct().join(calls.select("dex_id").distinct(), "dex_id", "left_anti")
    return found.unionByName(finding(named, 1, 3, (0,), id="M10_CIPHER", kind="WeakCrypto", severity="Info", location=location(False), message="Cipher APIs referenced but no invocations were resolved", extra=extra(reason=F.lit("cipher_descriptor"))))
