"""Matrices from pair tables and from square matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import check_stat, diagonal_value, in_order
from ..sources.text import dense_index
from .matrix import LDMatrix, through_codec, union_all

#: Rows of a variant list (some 100 bytes each) up to which joins on it are broadcast.
BROADCAST_VARIANTS = 500_000


def sized(variants: DataFrame, n: int) -> DataFrame:
    """A broadcast of variants where their number allows it; else a plain side of a shuffled join."""
    return F.broadcast(variants) if n <= BROADCAST_VARIANTS else variants


def duplicate_ids(variants: DataFrame) -> DataFrame:
    """(id, n, lines): identifiers that occur more than once, with their first two 1-based places (one
    that a large part of the list has, such as a dot, never has its places gathered)."""
    counts = variants.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    first = variants.select("id", "idx", F.row_number().over(W.partitionBy("id").orderBy("idx")).alias("_k")).where("_k <= 2")
    places = first.groupBy("id").agg(F.sort_array(F.collect_list(F.col("idx") + 1)).alias("lines"))
    return counts.join(places, "id")


def require_unique_ids(variants: DataFrame) -> DataFrame:
    bad = duplicate_ids(variants).limit(1).collect()
    if bad:
        raise ValueError(f"duplicate variant {bad[0]['id']} in lines {', '.join(map(str, bad[0]['lines'][:2]))}")
    return variants


def unknown_ids(pairs: DataFrame, variants: DataFrame) -> DataFrame:
    """Identifiers of the pairs that the variant list lacks."""
    named = pairs.select(F.col("ID_A").alias("id")).union(pairs.select("ID_B")).distinct()
    return named.join(variants.select("id"), "id", "left_anti")


def min_filter(cells: DataFrame, min_abs: float, column: str) -> DataFrame:
    """Rows whose value isn't under min_abs in size; not-a-number stays, and so do the row's other
    statistics whatever their size."""
    if column not in cells.columns:
        raise ValueError(f"column {column} is not available for the minimum")
    return cells.where(~(F.abs(F.col(column)) < F.lit(min_abs)))


def index_pairs(pairs: DataFrame, variants: DataFrame, n: int, carry: list[str] | None = None) -> DataFrame:
    """(col, row, statistics): identifiers to places, A to the column and B to the row."""
    ids = variants.select("id", "idx")
    a, b = ids.toDF("ID_A", "col"), ids.toDF("ID_B", "row")
    stats = in_order(pairs.columns)
    return pairs.join(sized(a, n), "ID_A").join(sized(b, n), "ID_B").select("col", "row", *(carry or []), *(F.col(s).cast("float").alias(s) for s in stats))


def check_pair_order(pairs: DataFrame, line: str) -> None:
    """Strict mode: columns must not decrease along ``line`` and each row must lie after its column.
    Lines are compared in chunks, each with the largest column of the chunks before."""
    chunk = F.expr(f"`{line}` div 65536")
    tops = pairs.groupBy(chunk.alias("_chunk")).agg(F.max("col").alias("_top"))
    before = tops.select("_chunk", F.max("_top").over(W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    highest = F.greatest(F.coalesce(F.max("col").over(W.partitionBy("_chunk").orderBy(line).rowsBetween(W.unboundedPreceding, -1)), F.lit(-1)), F.coalesce("_before", F.lit(-1)))
    bad = pairs.withColumn("_chunk", chunk).join(F.broadcast(before), "_chunk").withColumn("_high", highest).where("col < _high OR col >= row").limit(1).collect()
    if bad:
        raise ValueError(f"pairs are not in order: column {bad[0]['col']}, row {bad[0]['row']}")


def symmetrise(cells: DataFrame) -> DataFrame:
    """Each pair as (col, row) and (row, col); one scan, no shuffle."""
    stats = in_order(cells.columns)
    both = F.explode(F.array(F.struct(F.col("col").alias("c"), F.col("row").alias("r")), F.struct(F.col("row").alias("c"), F.col("col").alias("r"))))
    return cells.select(both.alias("p"), *stats).select(F.col("p.c").alias("col"), F.col("p.r").alias("row"), *stats)


def diagonal(variants: DataFrame, stats: list[str]) -> DataFrame:
    return variants.select(F.col("idx").alias("col"), F.col("idx").alias("row"), *(F.lit(diagonal_value(s)).cast("float").alias(s) for s in stats))


def from_pairs(pairs: DataFrame, variants: DataFrame, bits: int = 8, min_abs: float = 0.01, min_col: str = "PHASED_R", columns: list[str] | None = None, layout: str = "full", strict: bool = False, check: bool = True) -> LDMatrix:
    """Matrix of a pair table: identifiers joined to places, rows under the minimum dropped, both
    triangles and the diagonal filled in, values quantised. ``columns`` picks statistics (all if not
    given). Pairs in any order are taken; strict asks for the order that ``check_pair_order`` tells, by
    the column ``line`` that ``read_pairs`` numbers on request."""
    if strict and "line" not in pairs.columns:
        raise ValueError("the order can only be checked on pairs that were read with line='line'")
    check_stat(min_col)
    n = variants.count()
    if check:
        require_unique_ids(variants)
        lost = unknown_ids(pairs, variants).limit(1).collect()
        if lost:
            raise ValueError(f"variant {lost[0]['id']} is not in the variant list")
    kept = min_filter(pairs, min_abs, min_col)
    stats = in_order(columns if columns is not None else pairs.columns)
    if strict:
        check_pair_order(index_pairs(kept, variants, n, ["line"]), "line")
    placed = index_pairs(kept, variants, n)
    placed = placed.select(F.least("col", "row").alias("col"), F.greatest("col", "row").alias("row"), *stats)
    cells = placed if layout == "upper" else symmetrise(placed)
    entries = cells.unionByName(diagonal(variants, stats))
    return LDMatrix(through_codec(entries, bits), variants, n, bits, layout)


#: Columns in which the reference column is sought before all others.
LEADING = 64


def reference_column(square: DataFrame, stat: str) -> int | None:
    """First column that isn't all not-a-number. It is mostly among the leading ones; all others are
    read only if these have no number."""
    numbers = square.where(~F.isnan(stat))
    for part in (numbers.where(F.col("col") < LEADING), numbers.where(F.col("col") >= LEADING)):
        first = part.agg(F.min("col")).first()[0]
        if first is not None:
            return first
    return None


def good_variants(square: DataFrame, stat: str) -> DataFrame:
    """(idx): places that are numbers in the reference column; an error if there is no such column."""
    first = reference_column(square, stat)
    if first is None:
        raise ValueError("all values are not numbers")
    return square.where((F.col("col") == first) & ~F.isnan(stat)).select(F.col("row").alias("idx"))


def restrict(entries: DataFrame, kept: DataFrame, n: int) -> DataFrame:
    """Entries whose column and row are kept, moved to the dense places of the kept variants.
    kept: (idx, new)."""
    a, b = kept.select(F.col("idx").alias("col"), F.col("new").alias("_c")), kept.select(F.col("idx").alias("row"), F.col("new").alias("_r"))
    joined = entries.join(sized(a, n), "col").join(sized(b, n), "row")
    return joined.select(F.col("_c").alias("col"), F.col("_r").alias("row"), *in_order(entries.columns))


def from_square(square: DataFrame, variants: DataFrame, bits: int = 8, min_abs: float = 0.01, stat: str = "PHASED_R", layout: str = "full") -> LDMatrix:
    """Matrix of all cells of a square matrix: variants that are not numbers in the reference column
    are removed from both axes, small cells dropped, places made dense."""
    check_stat(stat)
    n = variants.count()
    kept = dense_index(good_variants(square, stat), "idx", "new")
    cells = min_filter(square, min_abs, stat)
    if layout == "upper":
        cells = cells.where("row >= col")
    # A generated value is a column of its own; else the codec repeats its whole expression many times over.
    cells = cells.select("col", "row", F.explode(F.array(stat)).alias(stat))
    entries = restrict(cells, kept, n)
    left = variants.join(sized(kept, n), "idx").withColumn("idx", F.col("new")).drop("new")
    return LDMatrix(through_codec(entries, bits), left, kept.count(), bits, layout)


def block_diagonal(matrices: list[DataFrame], sizes: list[int]) -> DataFrame:
    """Entries of several matrices along one diagonal."""
    moved, base = [], 0
    for entries, size in zip(matrices, sizes):
        moved.append(entries.select((F.col("col") + base).alias("col"), (F.col("row") + base).alias("row"), *in_order(entries.columns)))
        base += size
    return union_all(moved)
