"""The variant index: lookups by identifier, by place and by region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids as names


def build_index(variants: DataFrame) -> DataFrame:
    """variants with id_number and id_template (number and template of the identifier). An identifier without a
    digit, or two with the same number and template, is an error."""
    bad = variants.where(~names.has_number(F.col("id"))).limit(1).collect()
    if bad:
        raise ValueError(f"identifier {bad[0]['id']!r} has no digit")
    index = variants.withColumns({"id_number": names.id_number(F.col("id")), "id_template": names.id_template(F.col("id"))})
    twice = repeated_keys(index).limit(1).collect()
    if twice:
        raise ValueError(f"identifiers are not unique: {twice[0]['id_template']} with number {twice[0]['id_number']}")
    return index


def repeated_keys(index: DataFrame) -> DataFrame:
    return index.groupBy("id_number", "id_template").agg(F.count("*").alias("n")).where("n > 1")


def save_index(index: DataFrame, path: str) -> None:
    """Sorted by chromosome and position, so that a region reads few row groups."""
    index.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.mode("overwrite").parquet(path)


def request(spark: SparkSession, ids: list[str]) -> DataFrame:
    """(ord, id) of a list of identifiers; repeats stay."""
    return spark.createDataFrame(list(enumerate(ids)), "ord long, id string")


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (ord, id) joined to the index by number and template; every match of a repeat stays."""
    keys = wanted.withColumns({"id_number": names.id_number(F.col("id")), "id_template": names.id_template(F.col("id"))})
    return keys.join(index.select("idx", "chrom", "pos", "id_number", "id_template"), ["id_number", "id_template"]).select("ord", "id", "idx", "chrom", "pos")


def missing(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested identifiers that the index lacks."""
    keys = wanted.withColumns({"id_number": names.id_number(F.col("id")), "id_template": names.id_template(F.col("id"))})
    return keys.join(index, ["id_number", "id_template"], "left_anti").select("id").distinct()


def by_place(index: DataFrame, places: DataFrame) -> DataFrame:
    """(idx, chrom, pos, id, ref, alt) of places (idx)."""
    return index.join(places.select("idx"), "idx").select("idx", "chrom", "pos", "id", "ref", "alt")


def region(index: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Variants of a chromosome from start to end, both inclusive."""
    return index.where((F.col("chrom") == chrom) & F.col("pos").between(start, end))


def require_region(index: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    found = region(index, chrom, start, end)
    if found.isEmpty():
        raise ValueError(f"no variants in {chrom}:{start}-{end}")
    return found


def remove_all_copies(variants: DataFrame) -> DataFrame:
    """Variants whose identifier occurs once; all copies of the others go."""
    once = variants.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id")
    return variants.join(once, "id", "left_semi")


def extract(variants: DataFrame, ids: DataFrame) -> DataFrame:
    return variants.join(ids.select("id"), "id", "left_semi")


def exclude(variants: DataFrame, ids: DataFrame) -> DataFrame:
    return variants.join(ids.select("id"), "id", "left_anti")


def keep_both_ends(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs whose two identifiers are both kept."""
    kept = ids.select("id").distinct()
    return pairs.join(kept.toDF("ID_A"), "ID_A", "left_semi").join(kept.toDF("ID_B"), "ID_B", "left_semi")
