"""Numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def percent_half_even(part: Column, whole: Column) -> Column:
    """Whole-number percentage, ties to the even number; 0 when there is nothing to count."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, 0)).otherwise(0).cast("int")


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def text_bucket(text: Column, buckets: int) -> Column:
    """First eight hex digits of the MD5 digest, modulo the number of buckets."""
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")
