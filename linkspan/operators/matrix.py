"""The matrix: entries in long form, variants and metadata; opening and saving.

``entries`` has (col, row) and a float column for each statistic. A stored entry is a row, whatever
its value; a pair without a row reads as 0. The stored form is Parquet, range-partitioned and sorted
by (col, row) with quantised columns, so that column and row predicates prune row groups and a query
reads only the statistics it names. ``entries`` decodes lazily on top of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import decode, encode
from ..schema import OLDEST_VERSION, VERSION, check_bits, check_format, in_order


@dataclass
class LDMatrix:
    entries: DataFrame
    variants: DataFrame
    n: int
    bits: int = 8
    layout: str = "full"
    version: str = VERSION
    stored_nnz: int | None = field(default=None, compare=False)

    def __post_init__(self):
        check_bits(self.bits)
        check_format(self.layout)

    @property
    def stats(self) -> list[str]:
        return in_order(self.entries.columns)

    @property
    def nrow(self) -> int:
        return self.n

    @property
    def ncol(self) -> int:
        return self.n

    @property
    def dim(self) -> tuple[int, int]:
        return self.n, self.n

    @property
    def nnz(self) -> int:
        """Stored entries, with the diagonal and both triangles."""
        return self.entries.count() if self.stored_nnz is None else self.stored_nnz

    def meta(self) -> dict:
        return {"dim": {"rows": self.n, "cols": self.n}, "nnz": self.nnz, "bits": self.bits, "format": self.layout, "version": self.version, "stats": self.stats}

    def summary(self) -> str:
        return "\n".join((f"dimensions: {self.n} x {self.n}", f"stored entries: {self.nnz}", f"bits: {self.bits}", f"layout: {self.layout}", f"statistics: {', '.join(self.stats)}"))

    def __str__(self) -> str:
        return f"LD matrix of {self.n} variants ({self.layout}, {self.bits} bit; {', '.join(self.stats)})"

    def both_triangles(self) -> DataFrame:
        """Entries with the other triangle, where only one is stored."""
        if self.layout == "full":
            return self.entries
        mirror = self.entries.where("row <> col").select(F.col("row").alias("col"), F.col("col").alias("row"), *self.stats)
        return self.entries.unionByName(mirror)

    def with_entries(self, entries: DataFrame, **changes) -> LDMatrix:
        return replace(self, entries=entries, stored_nnz=None, **changes)


def quantised(entries: DataFrame, bits: int) -> DataFrame:
    """Codes as they are stored."""
    return entries.select("col", "row", *(encode(F.col(s), s, bits).alias(s) for s in in_order(entries.columns)))


def decoded(codes: DataFrame, bits: int) -> DataFrame:
    return codes.select("col", "row", *(decode(F.col(s), s, bits).alias(s) for s in in_order(codes.columns)))


def through_codec(entries: DataFrame, bits: int) -> DataFrame:
    """Values as they read back after storage."""
    return decoded(quantised(entries, bits), bits)


def save(matrix: LDMatrix, path: str, partitions: int | None = None) -> None:
    """Entries, variants and metadata under path: one range shuffle, sorted by (col, row)."""
    spark = matrix.entries.sparkSession
    codes = quantised(matrix.entries, matrix.bits)
    ranged = codes.repartitionByRange(partitions, "col") if partitions else codes.repartitionByRange("col")
    ranged.sortWithinPartitions("col", "row").write.option("compression", "zstd").parquet(f"{path}/entries")
    matrix.variants.select("idx", "chrom", "pos", "id", "ref", "alt").write.parquet(f"{path}/variants")
    nnz = spark.read.parquet(f"{path}/entries").count()
    text = json.dumps(matrix.meta() | {"nnz": nnz})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    """Metadata of a stored matrix (a folder that ``save`` wrote) or of a JSON file; a missing version
    is the oldest."""
    lines = spark.read.text(path if path.endswith(".json") else f"{path}/meta", wholetext=True).collect()
    meta = json.loads("".join(r[0] for r in lines))
    meta.setdefault("version", OLDEST_VERSION)
    check_bits(meta["bits"])
    check_format(meta["format"])
    return meta


def open_matrix(spark: SparkSession, path: str) -> LDMatrix:
    """Handle on a stored matrix; fails if a part or a statistic of the metadata is missing."""
    meta = read_meta(spark, path)
    codes = spark.read.parquet(f"{path}/entries")
    missing = [s for s in meta["stats"] if s not in codes.columns]
    if missing:
        raise ValueError(f"{path} lacks statistics {missing}")
    codes = codes.select("col", "row", *in_order(meta["stats"]))
    return LDMatrix(decoded(codes, meta["bits"]), spark.read.parquet(f"{path}/variants"), meta["dim"]["rows"], meta["bits"], meta["format"], meta["version"], meta["nnz"])


#: Cells of a dense matrix that a task makes.
TASK_CELLS = 1 << 23


def dense_cells(stored: DataFrame, n: int, stat: str) -> DataFrame:
    """(col, row, stat) of all n * n cells of a matrix, 0 where nothing is stored. Only stored cells are
    shuffled, by their column. A run (first, last, value) is a stored cell with the zeros before it in its
    column, or the zeros after the last one; its cells are made in the task that hands them on, so the
    n * n cells are on no disk."""
    spark = stored.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-n * n // TASK_CELLS))
    cells = stored.select(F.col("col").cast("long").alias("col"), F.struct(F.col("row").cast("long").alias("row"), stat).alias("cell"))
    every = cells.union(spark.range(n).select("id", F.lit(None)))
    columns = every.repartition(tasks, "col").groupBy("col").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("cells", lambda c: c["row"] + 1))
    end = lambda k: F.get("cells", k)
    runs = F.transform(starts, lambda first, k: F.struct(first.alias("first"), F.coalesce(end(k)["row"], F.lit(n).cast("long")).alias("last"), end(k)[stat].alias("value")))
    run = columns.select("col", F.inline(runs)).where(F.col("first") < n)
    # A cell that is stored twice has a run of its own for either copy.
    made = run.select("col", "last", "value", F.explode(F.sequence(F.least("first", "last"), F.least("last", F.lit(n - 1).cast("long")))).alias("row"))
    zero = F.lit(0.0).cast(stored.schema[stat].dataType)
    return made.select("col", "row", F.when(F.col("row") == F.col("last"), F.col("value")).otherwise(zero).alias(stat))


def column_pointers(entries: DataFrame, n: int) -> DataFrame:
    """(col, n_entries, pointer): exclusive running count over the columns 0..n-1, and n itself. Ranks
    run inside buckets of columns, with the buckets' totals added."""
    from pyspark.sql import Window as W

    per = entries.groupBy("col").agg(F.count("*").alias("k"))
    spark = entries.sparkSession
    all_cols = spark.range(n + 1).select(F.col("id").alias("col")).join(per, "col", "left").select("col", F.coalesce("k", F.lit(0)).alias("n_entries"), F.expr("col div 65536").alias("_b"))
    totals = all_cols.groupBy("_b").agg(F.sum("n_entries").alias("_t"))
    before = totals.select("_b", F.coalesce(F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    running = F.coalesce(F.sum("n_entries").over(W.partitionBy("_b").orderBy("col").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return all_cols.withColumn("_r", running).join(F.broadcast(before), "_b").select("col", "n_entries", (F.col("_r") + F.col("_before")).cast("long").alias("pointer"))


def delta_encode(entries: DataFrame) -> DataFrame:
    """(col, k, delta, overflow): k-th row of a column as its distance to the row before (the first:
    to the column); overflow marks distances that 16 bits can't hold next to the mark 32767."""
    from pyspark.sql import Window as W

    w = W.partitionBy("col").orderBy("row")
    delta = F.col("row") - F.coalesce(F.lag("row").over(w), F.col("col"))
    return entries.select("col", (F.row_number().over(w) - 1).cast("long").alias("k"), delta.cast("long").alias("delta")).withColumn("overflow", (F.col("delta") >= 32767) | (F.col("delta") < -32768))


def delta_decode(deltas: DataFrame) -> DataFrame:
    """(col, k, row) from the running sum of a column's distances."""
    from pyspark.sql import Window as W

    w = W.partitionBy("col").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    return deltas.select("col", "k", (F.col("col") + F.sum("delta").over(w)).cast("long").alias("row"))


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
