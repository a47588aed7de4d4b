"""Hashes that other engines can reproduce: slices of the MD5 hex digest as integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_int(value: Column, start: int = 1, digits: int = 8) -> Column:
    """``digits`` hex digits of the MD5 of ``value`` from position ``start``, as a long. At most 15 digits fit."""
    if not 1 <= digits <= 15:
        raise ValueError("digits must be from 1 to 15")
    return F.conv(F.substring(F.md5(value), start, digits), 16, 10).cast("long")


def unit(value: Column, start: int = 1) -> Column:
    """A number in [0, 1) with 52 random bits."""
    return md5_int(value, start, 13).cast("double") / F.lit(float(1 << 52))
