"""Scalar string functions with the semantics of a C program's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.instr(F.lower(text), F.lower(part)) > 0


def equals_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def leading_int(text: Column) -> Column:
    """The integer a text begins with, 0 if there is none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def truncated(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def local_timestamp() -> Column:
    """Now, in the session's time zone, as manifests write it."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
