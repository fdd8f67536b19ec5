"""What a string literal gives away: secrets by pattern, keyword and entropy, weak algorithms, and its preview."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels and patterns of secrets, the first that matches counts (fixed values).
SECRET_PATTERNS = {
    "aws_access_key": "AKIA[0-9A-Z]{16}",
    "private_key": "BEGIN [A-Z ]+PRIVATE KEY",
    "slack_token": "xox[baprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"eyJ[a-zA-Z0-9_-]{20,}\.[a-zA-Z0-9_-]{20,}\.[a-zA-Z0-9_-]{10,}",
    "password_assignment": r"(?iU)password\s*[:=]",
}
#: Keywords that make a literal suspicious whatever its length (fixed values).
KEYWORDS = ["password=", "password:", "secret=", "secret:", "api_key", "token=", "token:", "authorization: basic"]
#: Needles of weak algorithms, the first that is found counts (fixed values).
WEAK_ALGORITHMS = {"md5": "MD5", "sha1": "SHA1", "sha-1": "SHA1", "des": "DES", "rc4": "RC4", "rc2": "RC2", "ecb": "ECB"}
MIN_LENGTH, MIN_ENTROPY, HIGH_ENTROPY, PREVIEW = 8, 3.5, 4.5, 64
#: Access flags by bit, as the format defines them and as compat mode decodes them (fixed values).
FLAGS = {"PUBLIC": 0x1, "PRIVATE": 0x2, "PROTECTED": 0x4, "STATIC": 0x8, "FINAL": 0x10, "SYNCHRONIZED": 0x20, "VOLATILE": 0x40, "TRANSIENT": 0x80, "NATIVE": 0x100, "INTERFACE": 0x200, "ABSTRACT": 0x400, "STRICT": 0x800, "SYNTHETIC": 0x1000, "ANNOTATION": 0x2000, "ENUM": 0x4000, "CONSTRUCTOR": 0x10000, "DECLARED_SYNCHRONIZED": 0x20000}
COMPAT_FLAGS = FLAGS | {"INTERFACE": 0x20000, "ANNOTATION": 0x20000, "ENUM": 0x40000, "DECLARED_SYNCHRONIZED": 0x2000}


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shannon_entropy(value: Column) -> Column:
    """Base-2 entropy of a string's UTF-8 bytes; 0 for an empty one, null for null. One sort and one fold over its bytes."""
    found = F.array_sort(F.regexp_extract_all(F.hex(F.encode(value, "UTF-8")), F.lit(".."), F.lit(0)))

    def entropy(s: Column) -> Column:
        total = F.size(s)
        ends = F.filter(F.sequence(F.lit(1), total), lambda i: (i == total) | (F.get(s, i - 1) != F.get(s, i)))  # of runs of one byte
        shares = _bound(ends, lambda e: F.transform(e, lambda end, i: (end - F.coalesce(F.get(e, i - 1), F.lit(0))) / total))
        return F.when(total > 0, F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)))

    return F.when(value.isNotNull(), F.coalesce(_bound(found, entropy), F.lit(0.0)))


def has_keyword(value: Column) -> Column:
    return value.rlike("|".join(KEYWORDS))


def classify_secret(value: Column, min_entropy: float = MIN_ENTROPY) -> Column:
    """Label of a literal: a pattern's, 'keyword', 'entropy', or null. Blank and short ones without a keyword have none.

    Cheap tests come first; entropy is computed only where nothing else has matched."""
    label = F.when(F.trim(value) == "", F.lit(None).cast("string")).when((F.octet_length(value) < MIN_LENGTH) & ~has_keyword(value), None)
    for name, pattern in SECRET_PATTERNS.items():
        label = label.when(value.rlike(pattern), name)
    return label.when(has_keyword(value), "keyword").when((F.octet_length(value) >= MIN_LENGTH) & (shannon_entropy(value) >= min_entropy), "entropy")


def secret_severity(label: Column, value: Column) -> Column:
    return F.when(label.isin(*SECRET_PATTERNS), "High").when(label == "keyword", "Medium").when(label == "entropy", F.when(shannon_entropy(value) > HIGH_ENTROPY, "High").otherwise("Medium"))


def ascii_lower(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def weak_algorithm(value: Column) -> Column:
    """The first weak algorithm whose needle the literal holds, or null."""
    low, out = ascii_lower(value), None
    for needle, name in WEAK_ALGORITHMS.items():
        test = low.contains(needle)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def preview_literal(value: Column) -> Column:
    """The trimmed literal, cut to the longest whole characters within PREVIEW bytes, and an ellipsis if cut."""
    t = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    sizes = F.transform(F.sequence(F.lit(1), F.lit(PREVIEW)), lambda n: F.when(F.octet_length(F.substring(t, F.lit(1), n)) <= PREVIEW, n).otherwise(0))
    return F.when(F.octet_length(t) <= PREVIEW, t).otherwise(F.concat(F.substring(t, F.lit(1), F.array_max(sizes)), F.lit("…")))


def access_flag_names(flags: Column, compat: bool = False) -> Column:
    """Names of the flags that are set, by bit. compat: by deviating bits, others dropped."""
    table = COMPAT_FLAGS if compat else FLAGS
    names = [F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in table.items()]
    return F.array_compact(F.array(*names))
