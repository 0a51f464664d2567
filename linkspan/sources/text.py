"""Text inputs: variant lists, pair tables, keep lists, ranges and path templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.ids import natural_key
from ..schema import STATS, in_order

#: The leading columns of a variant list, and of a pair table.
VARIANT_COLUMNS = ("CHROM", "POS", "ID", "REF", "ALT")
PAIR_COLUMNS = ("ID_A", "REF_A", "ALT_A", "ID_B", "REF_B", "ALT_B")


#: What tells the blocks of a file scan apart: task, file, start and length.
_BLOCK = ("_part", "_file", "_start", "_length")


def numbered(lines: DataFrame, name: str = "idx") -> DataFrame:
    """lines (a file scan, filtered or not, with its hidden ``_metadata``) with their 0-based place in
    file order: files in natural order of their paths, blocks by their start. A scan deals blocks to
    tasks by their size, so the order of tasks isn't that of the files; a line's place is its place
    in its block plus the lines of all blocks before (a table of blocks). The scan runs twice; a
    block that the second run cuts or deals otherwise than the first is an error."""
    own = {"_part": F.spark_partition_id(), "_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_length": F.col("_metadata.file_block_length"), "_place": F.monotonically_increasing_id()}
    marked = lines.select("*", *(c.alias(k) for k, c in own.items()))
    sizes = marked.groupBy(*_BLOCK).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    earlier = W.orderBy(natural_key(F.col("_file")), "_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(*_BLOCK, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = marked.join(F.broadcast(before), list(_BLOCK), "left")
    moved = F.raise_error(F.lit("the file scan was cut otherwise when its lines were numbered")).cast("long")
    return joined.withColumn(name, F.coalesce(F.col("_place") + F.col("_shift"), moved)).drop(*_BLOCK, "_place", "_shift")


def numbered_records(rows: DataFrame, name: str = "idx") -> DataFrame:
    """rows of one file of fixed-length records with their 0-based place: there, tasks are in file order."""
    marked = rows.withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", 33)
    sizes = marked.groupBy(part.alias("_part")).count()
    before = sizes.select("_part", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = marked.withColumn("_part", part).join(F.broadcast(before), "_part")
    within = F.col("_place") - F.shiftleft("_part", 33)
    return joined.withColumn(name, (F.col("_before") + within).cast("long")).drop("_place", "_part", "_before")


def dense_index(rows: DataFrame, order: str, name: str, bucket: int = 1 << 16) -> DataFrame:
    """rows with a dense 0-based index in the order of the distinct whole numbers in ``order``: ranks
    inside buckets plus the counts of the buckets before."""
    own = F.expr(f"`{order}` div {bucket}")
    counted = rows.withColumn("_bucket", own)
    sizes = counted.groupBy("_bucket").count()
    before = sizes.select("_bucket", F.coalesce(F.sum("count").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy(order)) - 1
    return counted.withColumn("_rank", rank).join(F.broadcast(before), "_bucket").withColumn(name, (F.col("_before") + F.col("_rank")).cast("long")).drop("_bucket", "_rank", "_before")


def header_fields(spark: SparkSession, path: str, no_header: bool = False) -> list[str]:
    """Fields of the first line that starts with # but not ##; with no_header, of the first line that isn't empty."""
    lines = spark.read.text(path)
    wanted = F.length(F.trim("value")) > 0 if no_header else F.col("value").startswith("#") & ~F.col("value").startswith("##")
    first = lines.where(wanted).limit(1).collect()
    if not first:
        raise ValueError(f"{path} has no header line")
    line = first[0][0]
    return (line if no_header else line[1:]).split("\t")


def count_fields(spark: SparkSession, path: str) -> int:
    """Tab-separated fields of the last line that starts with #."""
    lines = numbered(spark.read.text(path)).where(F.col("value").startswith("#"))
    last = lines.agg(F.max_by("value", "idx")).first()[0]
    if last is None:
        raise ValueError(f"{path} has no line that starts with #")
    return last.count("\t") + 1


def data_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither empty nor comments."""
    return spark.read.text(path).where((F.col("value") != "") & ~F.col("value").startswith("#"))


def count_rows(spark: SparkSession, path: str) -> int:
    return data_lines(spark, path).count()


def read_variants(spark: SparkSession, path: str, header: bool = True, whitespace: bool = False) -> DataFrame:
    """(idx, chrom, pos, id, ref, alt) in file order. With header, the first five header fields must be
    CHROM POS ID REF ALT; further columns are ignored. whitespace: any run of it separates fields."""
    if header and tuple(header_fields(spark, path)[:5]) != VARIANT_COLUMNS:
        raise ValueError(f"{path}: the header must begin with {' '.join(VARIANT_COLUMNS)}")
    cut = F.split(F.trim("value") if whitespace else F.col("value"), r"\s+" if whitespace else "\t")
    lines = numbered(data_lines(spark, path))
    short = F.raise_error(F.concat(F.lit(f"{path}: a variant line has fewer than 5 fields: "), "value"))
    fields = lines.select("idx", F.when(F.size(cut) >= 5, cut).otherwise(short.cast("array<string>")).alias("f"))
    return fields.select("idx", F.col("f")[0].alias("chrom"), F.col("f")[1].cast("int").alias("pos"), F.col("f")[2].alias("id"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(idx, id) of a list with one identifier a line."""
    return numbered(data_lines(spark, path)).select("idx", F.col("value").alias("id"))


def expect_count(variants: DataFrame, n: int) -> DataFrame:
    found = variants.count()
    if found != n:
        raise ValueError(f"the variant list has {found} rows, the matrix {n}")
    return variants


def stat_columns(names: list[str]) -> list[str]:
    """Statistics among a header's fields."""
    return in_order([n.lstrip("#") for n in names])


def read_pairs(spark: SparkSession, path: str | list[str], line: str | None = None) -> DataFrame:
    """Pair table: identifiers, alleles and every statistic of the header as float. Broken lines fail.
    line: name of a column for the place of each pair in the file."""
    first = path if isinstance(path, str) else path[0]
    names = header_fields(spark, first)
    known = set(STATS)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.csv(path, sep="\t", header=False, comment="#", schema=schema, mode="FAILFAST")
    keys = [F.col(n) for n in names if n in PAIR_COLUMNS]
    if line is not None:
        raw = numbered(raw, line)
        keys.append(F.col(line))
    return raw.select(*keys, *(_number(F.col(s)).alias(s) for s in stat_columns(names) if s in known))


def _number(text: Column) -> Column:
    """As a float; nan and inf are values, any other text that isn't a number is an error."""
    low = F.lower(text)
    value = F.when(low.isin("nan", "-nan"), F.lit(float("nan"))).when(low.isin("inf", "+inf", "infinity"), F.lit(float("inf"))).when(low.isin("-inf", "-infinity"), F.lit(float("-inf")))
    return F.coalesce(value.cast("float"), text.cast("float"))


def read_keep(spark: SparkSession, path: str) -> DataFrame:
    """(idx): one non-negative whole number a line; anything else is an error that names the line."""
    lines = numbered(spark.read.text(path), "line")
    bad = lines.where(~F.col("value").rlike(r"^\d+$") | F.col("value").try_cast("bigint").isNull()).orderBy("line").limit(1).collect()
    if bad:
        raise ValueError(f"{path}, line {bad[0]['line'] + 1}: expected one non-negative integer, found {bad[0]['value']!r}")
    return lines.select(F.col("value").cast("bigint").alias("idx"))


def parse_range(text: str) -> tuple[int, int]:
    """START-END, 0-based, both inclusive."""
    found = re.fullmatch(r"(\d+)-(\d+)", text.strip())
    if not found or int(found[1]) > int(found[2]):
        raise ValueError(f"a range must be START-END with START <= END, not {text!r}")
    return int(found[1]), int(found[2])


def expand_template(template: str, chroms: str | list[str]) -> list[str]:
    """Paths of a {CHR} template for a comma list of chromosomes."""
    names = [c.strip() for c in chroms.split(",")] if isinstance(chroms, str) else list(chroms)
    return [template.replace("{CHR}", c) for c in names if c]
