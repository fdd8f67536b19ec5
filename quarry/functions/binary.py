"""Numbers and strings in binary columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType

from quarry.format import leb128, mutf8


def _little_endian(data: Column, offset: int, size: int) -> Column:
    byte = lambda i: F.hex(F.substring(data, offset + i + 1, 1))
    return F.conv(F.concat(*(byte(i) for i in reversed(range(size)))), 16, 10).cast("long")


def le_u16(data: Column, offset: int) -> Column:
    return _little_endian(data, offset, 2)


def le_u32(data: Column, offset: int) -> Column:
    return _little_endian(data, offset, 4)


def _value(read, data: bytes | None) -> int | None:
    if data is None:
        return None
    try:
        return read(data, 0, "leb128")[0]
    except ValueError:
        return None


@F.pandas_udf(LongType())
def uleb128(data: pd.Series) -> pd.Series:
    """The unsigned number at the start of the bytes; null where there is none."""
    return pd.Series([_value(leb128.read_unsigned, x) for x in data], dtype="Int64")


@F.pandas_udf(LongType())
def sleb128(data: pd.Series) -> pd.Series:
    return pd.Series([_value(leb128.read_signed, x) for x in data], dtype="Int64")


@F.pandas_udf(BinaryType())
def uleb128_encode(value: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else leb128.unsigned(int(x)) for x in value])


@F.pandas_udf(StringType())
def mutf8_decode(data: pd.Series) -> pd.Series:
    """Modified UTF-8 bytes as text; null where they are malformed."""

    def one(x: bytes | None) -> str | None:
        try:
            return None if x is None else mutf8.decode(x)
        except ValueError:
            return None

    return pd.Series([one(x) for x in data])
