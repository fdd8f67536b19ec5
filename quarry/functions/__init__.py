"""Scalar functions over columns, built from Spark's own; Arrow functions only where bytes have to be read one by one."""

from quarry.functions.literals import (
    KEYWORDS, SECRET_PATTERNS, WEAK_ALGORITHMS, access_flag_names, ascii_lower, classify_secret, has_keyword, preview_literal,
    secret_severity, shannon_entropy, weak_algorithm,
)
from quarry.functions.binary import le_u16, le_u32, mutf8_decode, sleb128, uleb128, uleb128_encode

__all__ = ["KEYWORDS", "SECRET_PATTERNS", "WEAK_ALGORITHMS", "access_flag_names", "ascii_lower", "classify_secret", "has_keyword", "le_u16", "le_u32", "mutf8_decode", "preview_literal", "secret_severity", "shannon_entropy", "sleb128", "uleb128", "uleb128_encode", "weak_algorithm"]
