"""Deterministic LD inputs from the embeddings table: a vector is a variant, a component a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunks

CHROMS = ("20", "21", "22", "Y")


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variants (idx, chrom, pos, id, ref, alt) with dosages g and haplotypes h."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = raw.count()
    chrom = F.element_at(F.array(*(F.lit(c) for c in CHROMS)), (F.floor(F.col("vec_id") * 4 / n) + 1).cast("int"))
    v = F.transform("embedding", lambda x: x.cast("double"))
    return raw.select(
        F.col("vec_id").alias("idx"),
        chrom.alias("chrom"),
        (10000 + 1000 * F.col("vec_id")).cast("int").alias("pos"),
        F.concat(F.lit("rs"), (F.col("vec_id") + 1000).cast("string")).alias("id"),
        F.lit("A").alias("ref"),
        F.lit("C").alias("alt"),
        F.transform(v, lambda x: F.when(x < -0.1, 0).when(x < 0.1, 1).otherwise(2).cast("tinyint")).alias("g"),
        F.transform(v, lambda x: (x > 0).cast("tinyint")).alias("h"),
    )


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotypes(spark, sf_dir).drop("g", "h")


def pairs(spark: SparkSession, sf_dir: str, window: int = 60_000, least: float = 0.1) -> DataFrame:
    """Pair table of variants at most window apart with |UNPHASED_R| >= least."""
    g = genotypes(spark, sf_dir)
    ld = chunks.window_ld(g, window, ["ref", "alt"])
    kept = ld.where(F.abs("UNPHASED_R") >= least)
    return kept.select(
        F.col("idx_a").alias("a"), F.col("idx_b").alias("b"), F.col("id_a").alias("ID_A"), F.col("ref_a").alias("REF_A"), F.col("alt_a").alias("ALT_A"), F.col("id_b").alias("ID_B"), F.col("ref_b").alias("REF_B"), F.col("alt_b").alias("ALT_B"),
        *(F.col(c).cast("float").alias(c) for c in ("PHASED_R", "UNPHASED_R", "D", "DPRIME")),
    )
