"""Square matrices: N x N little-endian floats, column by column, without a header."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import numbered_records


def _cells(stat: str):
    def run(batches):
        for batch in batches:
            for col, raw in zip(batch.column("col").to_pylist(), batch.column("body").to_pylist()):
                values = np.frombuffer(raw, "<f4")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), col, np.int64)), pa.array(np.arange(len(values))), pa.array(values)], names=["col", "row", stat])

    return run


def read_square(spark: SparkSession, path: str, n: int, stat: str = "PHASED_R") -> DataFrame:
    """(col, row, stat) of all n * n cells. Fixed-length records, one a matrix column, are read in
    parallel; only the cut into cells runs in Python, on whole columns."""
    records = spark.createDataFrame(spark.sparkContext.binaryRecords(path, 4 * n).map(lambda r: (bytearray(r),)), "body binary")
    return numbered_records(records, "col").mapInArrow(_cells(stat), f"col long, row long, {stat} float")


def cells_of(square: DataFrame, stat: str) -> DataFrame:
    """Cells as stored: not-a-number stays a value."""
    return square.select("col", "row", F.col(stat).cast("float").alias(stat))
