"""Roundtrip metrics and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roundtrip_metrics(pairs: DataFrame, original: str, decoded: str) -> DataFrame:
    """One row: non-zero counts of both, correlation over all and over non-zero originals, and the
    largest absolute difference; pairs with a value that is not a number are left out."""
    a, b = F.col(original).cast("double"), F.col(decoded).cast("double")
    kept = pairs.select(a.alias("a"), b.alias("b")).where(~F.isnan("a") & ~F.isnan("b"))
    return kept.agg(
        F.count(F.when(F.col("a") != 0, True)).alias("nonzero_original"),
        F.count(F.when(F.col("b") != 0, True)).alias("nonzero_decoded"),
        F.corr("a", "b").alias("corr_all"),
        F.corr(F.when(F.col("a") != 0, F.col("a")), F.when(F.col("a") != 0, F.col("b"))).alias("corr_nonzero"),
        F.max(F.abs(F.col("a") - F.col("b"))).alias("max_diff"),
    )


def nnz_per_column(entries: DataFrame) -> DataFrame:
    return entries.groupBy("col").agg(F.count("*").alias("n_entries"))


def chrom_bounds(variants: DataFrame) -> DataFrame:
    return variants.groupBy("chrom").agg(F.min("pos").alias("min_pos"), F.max("pos").alias("max_pos"), F.count("*").alias("n_variants"))
