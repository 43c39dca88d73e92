"""Portable random numbers: the same in Spark and in SQL, under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(1 << 32)


def prn_bits(key: Column, salt: str | Column) -> Column:
    """32 random bits of (key, salt) as a long: the first eight hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":"), salt if isinstance(salt, Column) else F.lit(salt))), 1, 8), 16, 10).cast("long")


def prn(key: Column, salt: str | Column) -> Column:
    """A number in [0, 1)."""
    return prn_bits(key, salt) / F.lit(SCALE)


def prn_sql(key: str, salt: str) -> str:
    """The same bits as DuckDB SQL."""
    return f"('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 8))::BIGINT"


def bits60(key: Column, salt: str) -> Column:
    """60 random bits of (key, salt) as a long: the first fifteen hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{salt}"))), 1, 15), 16, 10).cast("long")


def below(key: Column, salt: str, total: Column) -> Column:
    """A random whole number from 0 to ``total`` - 1 (a long above 0): the 60 bits times the total, divided by 2**60, exactly."""
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products below 2**123 have at most 38 digits
    return F.call_function("div", wide(bits60(key, salt)) * wide(total), wide(F.lit(1 << 60)))


def below_sql(key: str, salt: str, total: str) -> str:
    """The same number as DuckDB SQL."""
    return f"((('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 15))::BIGINT::HUGEINT * ({total})) // {1 << 60})::BIGINT"
