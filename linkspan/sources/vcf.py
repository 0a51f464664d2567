"""Variant call text files: variants with their samples' genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import numbered

# Columns before the samples', and the fields of a diploid call of two known alleles.
FIRST_SAMPLE = 9
CALL = r"^[01][|/][01](:|$)"


def read_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(idx, chrom, pos, id, ref, alt, g, h) in file order: dosages of the second allele by sample, and
    both haplotypes of each. Only phased calls (0|1) or such whose phase doesn't matter (0/0, 1/1) of
    one alternative allele have such a form; a line with any other call, a missing one included, is
    an error that names it. A line without an identifier (.) gets chrom:pos:ref:alt. Compressed files
    are read as well, each plain gzip file by one task."""
    lines = numbered(spark.read.text(path).where((F.col("value") != "") & ~F.col("value").startswith("#")))
    cut = lines.select("idx", F.split("value", "\t").alias("f"))
    calls = F.slice("f", F.lit(FIRST_SAMPLE + 1), F.greatest(F.lit(0), F.size("f") - FIRST_SAMPLE))
    names = {"chrom": F.col("f")[0], "pos": F.col("f")[1].cast("int"), "id": F.col("f")[2], "ref": F.col("f")[3], "alt": F.col("f")[4]}
    v = cut.select("idx", *(c.alias(n) for n, c in names.items()), F.try_element_at("f", F.lit(FIRST_SAMPLE)).alias("_form"), calls.alias("_calls"))
    usable = F.forall("_calls", lambda c: c.rlike(CALL) & (c.substr(2, 1).eqNullSafe("|") | (c.substr(1, 1) == c.substr(3, 1))))
    good = F.coalesce(F.col("_form").startswith("GT"), F.lit(False)) & ~F.contains("alt", F.lit(",")) & usable
    where = F.concat_ws(":", "chrom", F.col("pos").cast("string"), "ref", "alt")
    checked = F.when(good, F.col("_calls")).otherwise(F.raise_error(F.concat(F.lit("calls that can't be used at "), where)).cast("array<string>"))
    allele = lambda c, k: c.substr(k, 1).cast("tinyint")
    return v.select("idx", "chrom", "pos", F.when(F.col("id") == ".", where).otherwise(F.col("id")).alias("id"), "ref", "alt", checked.alias("_calls")).select(
        "idx", "chrom", "pos", "id", "ref", "alt",
        F.transform("_calls", lambda c: (allele(c, 1) + allele(c, 3)).cast("tinyint")).alias("g"),
        F.flatten(F.transform("_calls", lambda c: F.array(allele(c, 1), allele(c, 3)))).alias("h"),
    )
