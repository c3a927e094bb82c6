"""Content hashes and stable ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Offset and prime of the 64-bit FNV-1a hash, and the constant that the lower half is seeded with.
FNV_OFFSET, FNV_PRIME, GOLDEN = 0xCBF29CE484222325, 0x100000001B3, 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
SEPARATOR = "␟"


def finding_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def turn_hash(session: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws(":", session, index.cast("string")).cast("binary"), 256)


def chunk_hash(session: Column, index: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", session, index.cast("string"), text).cast("binary"), 256)


def row_signature(*columns: Column) -> Column:
    """SHA-256 of the columns as JSON."""
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)


def fnv1a64(text: str, seed: int = FNV_OFFSET) -> int:
    """Over code points."""
    h = seed & MASK
    for c in text:
        h = ((h ^ ord(c)) * FNV_PRIME) & MASK
    return h


def wide_id(parts: list[str]) -> str:
    """128 bits of the joined parts as 32 hexadecimal digits."""
    joined = SEPARATOR.join(parts)
    high = fnv1a64(joined)
    return f"{high:016x}{fnv1a64(joined[::-1], high ^ GOLDEN):016x}"


@F.pandas_udf(StringType())
def wide_id_of(joined: pd.Series) -> pd.Series:
    """wide_id() of texts that are joined already."""
    distinct = {x: None if x is None else wide_id(x.split(SEPARATOR)) for x in joined.unique()}
    return joined.map(distinct)


def stable_id(*parts: Column) -> Column:
    """wide_id() of string columns."""
    return wide_id_of(F.concat_ws(SEPARATOR, *parts))
