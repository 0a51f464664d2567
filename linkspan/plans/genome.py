"""From variants with genotypes to one indexed genome matrix, as one application.

Chunks exist in a scatter of processes to bound their memory; here the window join bounds it, so a
genome is one plan: no overlap is computed twice and nothing is concatenated. ``by_chunks`` runs the
chunked form on the same data, which the tests hold against it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import chrom_rank
from ..operators import chunks, index, ingest, metrics, transform
from ..operators.matrix import LDMatrix
from ..schema import check_bits, check_stat


#: Positions of one chromosome that are ranked together; a genome has some 30,000 such stretches.
PLACE_STRETCH = 100_000


def check_parameters(vcf: str | None = None, pfile: str | None = None, bits: int = 8, min_col: str = "PHASED_R", window_kb: int = 1000, r2: float = 0.01) -> None:
    if (vcf is None) == (pfile is None):
        raise ValueError("give exactly one of the VCF and the pfile template")
    check_bits(bits)
    check_stat(min_col)
    if window_kb <= 0 or not 0 <= r2 <= 1:
        raise ValueError("the window must be positive and r2 in [0, 1]")


def select_variants(variants: DataFrame, extract: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Variants to use: kept and excluded lists applied, all copies of repeated identifiers removed."""
    if extract is not None:
        variants = index.extract(variants, extract)
    if exclude is not None:
        variants = index.exclude(variants, exclude)
    return index.remove_all_copies(variants)


def place_variants(variants: DataFrame) -> DataFrame:
    """variants with places in the order of chromosome and position: ranks within stretches of
    PLACE_STRETCH positions plus the counts of the stretches before, so no task holds a chromosome."""
    from pyspark.sql import Window as W

    stretch = F.expr(f"pos div {PLACE_STRETCH}")
    cut = variants.withColumn("_s", stretch)
    ranked = cut.withColumn("_r", F.row_number().over(W.partitionBy("chrom", "_s").orderBy("pos", "id")) - 1)
    sizes = cut.groupBy("chrom", "_s").count()
    earlier = W.orderBy(chrom_rank(F.col("chrom")), "chrom", "_s").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("chrom", "_s", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    return ranked.join(F.broadcast(before), ["chrom", "_s"]).withColumn("idx", (F.col("_before") + F.col("_r")).cast("long")).drop("_r", "_s", "_before")


def pair_table(variants: DataFrame, window: int, r2: float, stat: str = "UNPHASED_R2") -> DataFrame:
    """LD of all pairs in the window from r2 on."""
    pairs = chunks.window_ld(variants, window, ["ref", "alt"])
    names = {f"{c}_{s}": f"{c.upper()}_{s.upper()}" for c in ("id", "ref", "alt") for s in "ab"}
    kept = pairs.where(~F.isnan(stat) & (F.col(stat) >= r2))
    return kept.select(*(F.col(k).alias(v) for k, v in names.items()), *(F.col(c).cast("float").alias(c) for c in ("PHASED_R", "UNPHASED_R", "PHASED_R2", "UNPHASED_R2", "D", "DPRIME")))


def build_genome(variants: DataFrame, window: int = 1_000_000, r2: float = 0.01, bits: int = 8, min_abs: float = 0.0, min_col: str = "PHASED_R", extract: DataFrame | None = None, exclude: DataFrame | None = None, stage: str | None = None) -> LDMatrix:
    """Matrix of all chromosomes of variants (chrom, pos, id, ref, alt, g, h). stage: a folder that
    keeps the variants in use and the pair table, each written once and read from there."""

    def kept(frame: DataFrame, name: str) -> DataFrame:
        if stage is None:
            return frame
        frame.write.parquet(f"{stage}/{name}")
        return frame.sparkSession.read.parquet(f"{stage}/{name}")

    used = kept(place_variants(select_variants(variants, extract, exclude)), "variants")
    return ingest.from_pairs(kept(pair_table(used, window, r2), "pairs"), used.drop("g", "h"), bits, min_abs, min_col)


def by_chunks(variants: DataFrame, window: int = 1_000_000, r2: float = 0.01, bits: int = 8, min_abs: float = 0.0, min_col: str = "PHASED_R") -> LDMatrix:
    """The same by chunks that overlap by a window, concatenated by chromosome and then disjointly."""
    used = place_variants(select_variants(variants))
    bounds = metrics.chrom_bounds(used)
    plan = chunks.nonempty_chunks(chunks.genomic_chunks(bounds, window), used).orderBy(chrom_rank(F.col("chrom")), "chunk_id").collect()  # a row for each chunk
    from ..sources.text import dense_index

    done: dict[str, list[LDMatrix]] = {}
    for c in plan:
        part = used.where((F.col("chrom") == c["chrom"]) & F.col("pos").between(c["start"], c["end"]))
        part = dense_index(part, "idx", "_new").withColumn("idx", F.col("_new")).drop("_new")
        done.setdefault(c["chrom"], []).append(ingest.from_pairs(pair_table(part, window, r2), part.drop("g", "h"), bits, min_abs, min_col, check=False))
    return transform.concat([transform.concat(m, overlapping=True) for m in done.values()])
