"""Statistics, bit widths, layouts and schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and order of the statistics, bit widths and layouts.
STATS = ("PHASED_R", "UNPHASED_R", "PHASED_R2", "UNPHASED_R2", "D", "DPRIME", "N")
BITS = (8, 16, 32, 99)
FORMATS = ("full", "upper")
VERSION = "2.1"
OLDEST_VERSION = "1.1"
#: Largest absolute error of a value in [-1, 1] by bit width.
MAX_ERROR = {8: 0.00394625, 16: 1.525879e-05, 32: 2.328389e-10, 99: 0.0}

VARIANTS = T.StructType(
    [
        T.StructField("idx", T.LongType()),
        T.StructField("chrom", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("alt", T.StringType()),
    ]
)


def check_stat(name: str) -> str:
    if name not in STATS:
        raise ValueError(f"unknown statistic {name!r}; known: {', '.join(STATS)}")
    return name


def check_available(stats: list[str], wanted: str) -> str:
    if check_stat(wanted) not in stats:
        raise ValueError(f"statistic {wanted} is not available; the matrix has {', '.join(stats)}")
    return wanted


def check_bits(bits: int) -> int:
    if bits not in BITS:
        raise ValueError(f"bits must be one of {BITS}, not {bits!r}")
    return bits


def check_format(layout: str) -> str:
    if layout not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {layout!r}")
    return layout


def in_order(names: list[str]) -> list[str]:
    """Statistics among names, in the fixed order."""
    return [s for s in STATS if s in names]


def diagonal_value(stat: str) -> float:
    """Value of a variant with itself where the input doesn't say: 1, but not a number for D."""
    return float("nan") if stat == "D" else 1.0
