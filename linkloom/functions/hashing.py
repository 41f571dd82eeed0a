"""Order-sensitive hashes of strings."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Fixed values of the manifest's hash.
OFFSET_BASIS = 1469598103934665603
PRIME = 1099511628211
MASK = (1 << 64) - 1


def list_hash(urls: list[str]) -> int:
    """Unsigned 64-bit FNV-1a-like hash of strings in order, a line feed after each."""
    h = OFFSET_BASIS
    for url in urls:
        for byte in url.encode() + b"\n":
            h = ((h ^ byte) * PRIME) & MASK
    return h


def string_hash(text: str, modulus: int | None = None) -> int:
    """The hash of a URL key: times 33 plus byte, from 5381, over the lower-case text."""
    h = 5381
    for byte in text.lower().encode():
        h = (h * 33 + byte) & MASK
    return h % modulus if modulus else h


def string_hash_of(text: Column) -> Column:
    """string_hash of a column, as decimal(20,0); bytes of the lower-case text, all in the JVM."""
    kind = "decimal(20,0)"
    size = F.octet_length(F.lower(text))
    byte = lambda i: F.conv(F.hex(F.substring(F.lower(text).cast("binary"), i, F.lit(1))), 16, 10).cast(kind)
    bytes_ = F.when(size > 0, F.transform(F.sequence(F.lit(1), size), byte)).otherwise(F.array().cast(f"array<{kind}>"))
    return F.aggregate(bytes_, F.lit(5381).cast(kind), lambda h, b: ((h * 33 + b) % F.lit(str(1 << 64)).cast("decimal(38,0)")).cast(kind))


@F.pandas_udf(DecimalType(20, 0))
def list_hash_of(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: Decimal(list_hash(list(u))))


def ordered_hash(df: DataFrame, value: str, order: str) -> DataFrame:
    """One row, hash decimal(20,0): the list hash of a column in an order. The list is one seed list, not a corpus."""
    listed: Column = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return df.agg(listed.alias("values")).select(list_hash_of("values").alias("hash"))
