"""Quantised values as column expressions.

Values are clamped to [-1, 1] for every width. q = v * (2^(b-1) - 1), rounded half away from zero in
doubles; not-a-number is the least value of the integer type. Width 99 keeps floats. The count
statistic N is neither clamped nor quantised, as a count isn't in [-1, 1].
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import check_bits

TYPES = {8: "tinyint", 16: "smallint", 32: "int", 99: "float"}


def clamp(value: Column) -> Column:
    """To [-1, 1]; not-a-number stays (least and greatest would turn it into 1)."""
    v = value.cast("float")
    return F.when(F.isnan(v), v).when(v > 1, F.lit(1.0).cast("float")).when(v < -1, F.lit(-1.0).cast("float")).otherwise(v)


def quantise(value: Column, bits: int) -> Column:
    check_bits(bits)
    v = clamp(value)
    if bits == 99:
        return v
    x = v.cast("double") * F.lit(float(2 ** (bits - 1) - 1))
    return F.when(F.isnan(v), F.lit(-(2 ** (bits - 1)))).otherwise(F.signum(x) * F.floor(F.abs(x) + 0.5)).cast(TYPES[bits])


def dequantise(code: Column, bits: int) -> Column:
    """float(q) / float(scale), rounded once to a float."""
    check_bits(bits)
    if bits == 99:
        return code.cast("float")
    value = (code.cast("float").cast("double") / F.lit(float(2 ** (bits - 1) - 1)).cast("float").cast("double")).cast("float")
    return F.when(code == -(2 ** (bits - 1)), F.lit(float("nan")).cast("float")).otherwise(value)


def encode(value: Column, stat: str, bits: int) -> Column:
    return value.cast("float") if stat == "N" else quantise(value, bits)


def decode(code: Column, stat: str, bits: int) -> Column:
    return code.cast("float") if stat == "N" else dequantise(code, bits)
