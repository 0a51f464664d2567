"""Shared helpers: table access, intermediate tables in the shared folder, Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path

#: White space of every text contract here: [\x20\x09-\x0D].
WS_CLASS = "[\\x20\\x09-\\x0D]"
WS_BYTES = b" \t\n\x0b\x0c\r"
#: Stand-in for a null id where an operator needs an order: below every real id.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write df once to the run's shared folder and read it back: cuts lineage, survives lost executors,
    and lets several consumers reuse one computation. checkpoint() would compute the plan twice. The
    folder goes when the application ends, as results read from it until then."""
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that very long texts don't meet in one batch. The settings
    stay with the session: plans are run after this returns, and read them then."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))):
        spark.conf.set(key, value)


def id_or_null_stand_in(col: Column) -> Column:
    return F.coalesce(col.cast("long"), F.lit(NULL_ID))


def crc_mod(col: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod modulus (null id: of the empty text)."""
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def words_of(text: bytes | None) -> list[bytes]:
    """Maximal runs outside [\\x20\\x09-\\x0D]; bytes.split() cuts at exactly these."""
    return text.split() if text else []
