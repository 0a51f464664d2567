"""Binary archives: a compressed-column matrix in several files under one prefix, read and written.

Columns are read in parallel: a task takes a stretch of columns, reads its byte ranges of each file
and decodes them in pieces, so its memory is bounded however many entries a column has. Files are
opened where the executors run: a local prefix must be a folder that all of them see, others are
URIs that Arrow can open (hdfs, s3, gs). Predicates don't reach these files; queries on a large
archive are better asked after one ``save`` of it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import TYPES, dequantise, quantise
from ..operators.matrix import LDMatrix, read_meta
from ..schema import OLDEST_VERSION, VERSION, check_available, in_order
from . import text

# The files of an archive, all little-endian. Column pointers (64 bits, one more than
# columns), rows, metadata, variants, distances that 16 bits can't hold (32 bits) and, by column, how
# many of them lie before (64 bits), values by statistic. Rows are 32-bit numbers in the oldest
# version; later each is a 16-bit distance to the row before, a column's first one the column less
# the row, and FAR stands for a distance in the other file.
POINTERS, ROWS, META, VARIANTS = ".p.bin", ".i.bin", ".meta.json", ".vars.txt"
FAR_VALUES, FAR_INDEX = ".io.bin", ".io.index"
VALUES = ".x.{}.bin"
FAR = 32767
WIDTHS = {8: "<i1", 16: "<i2", 32: "<i4", 99: "<f4"}

#: Columns of a stretch, and entries of a piece.
STRETCH, PIECE = 4096, 1 << 18


def _located(prefix: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(prefix) if "://" in prefix or prefix.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(prefix))


def is_archive(prefix: str) -> bool:
    system, base = _located(prefix)
    return system.get_file_info(base + META).type == fs.FileType.File


def _suffixes(version: str, stats: list[str]) -> list[str]:
    far = [] if version == OLDEST_VERSION else [FAR_VALUES, FAR_INDEX]
    return [POINTERS, ROWS, *far, *(VALUES.format(s) for s in stats)]


def _numbers(file: pa.NativeFile, first: int, count: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = file.read_at(int(count) * size, int(first) * size)
    if len(raw) < count * size:
        raise EOFError(f"an archive file ends before number {first + count}")
    return np.frombuffer(raw, kind)


def undo_distances(stored: np.ndarray, far: np.ndarray, col: np.ndarray, head: np.ndarray, carry: np.ndarray) -> np.ndarray:
    """Rows of entries from their distances. far: the distances that FAR stands for, in order; head
    marks a column's first entry; carry: the row before the first entry. Arithmetic is that of 32-bit
    numbers, as a first row may lie beyond its column."""
    step = stored.astype(np.int64).view(np.uint64)
    step[stored == FAR] = far
    step[head] = col[head].astype(np.uint64) - step[head]
    total = np.cumsum(step, dtype=np.uint64)
    before = np.concatenate([np.zeros(1, np.uint64) - carry, total[head] - step[head]])
    return (total - before[np.cumsum(head)]) & np.uint64(0xFFFFFFFF)


def _decoder(prefix: str, n: int, bits: int, version: str, stats: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def stretch(first: int, files: dict[str, pa.NativeFile]) -> Iterator[pa.RecordBatch]:
        last = min(first + STRETCH, n)
        pointers = _numbers(files[POINTERS], first, last - first + 1, "<u8").astype(np.int64)
        used = 0 if version == OLDEST_VERSION else int(_numbers(files[FAR_INDEX], first, 1, "<u8")[0])
        carry = np.zeros(1, np.uint64)
        for start in range(int(pointers[0]), int(pointers[-1]), PIECE):
            size = min(PIECE, int(pointers[-1]) - start)
            at = np.arange(start, start + size)
            k = np.searchsorted(pointers, at, "right") - 1
            if version == OLDEST_VERSION:
                row = _numbers(files[ROWS], start, size, "<u4")
            else:
                stored = _numbers(files[ROWS], start, size, "<i2")
                far = _numbers(files[FAR_VALUES], used, np.count_nonzero(stored == FAR), "<u4")
                used += len(far)
                row = undo_distances(stored, far, first + k, pointers[k] == at, carry)
                carry = row[-1:]
            values = [pa.array(_numbers(files[VALUES.format(s)], start, size, WIDTHS[bits])) for s in stats]
            yield pa.RecordBatch.from_arrays([pa.array(first + k), pa.array(row.astype(np.int64)), *values], names=["col", "row", *stats])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _located(prefix)
        with ExitStack() as stack:
            files = {x: stack.enter_context(system.open_input_file(base + x)) for x in _suffixes(version, stats)}
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield from stretch(k * STRETCH, files)

    return run


def read_archive_variants(spark: SparkSession, path: str) -> DataFrame:
    """The archive's variant list: with a header, of five columns apart by white space, or of identifiers."""
    first = spark.read.text(path).where("value <> '' AND value NOT LIKE '##%'").first()
    if first is not None and first[0].startswith("#"):
        return text.read_variants(spark, path)
    if first is not None and len(first[0].split()) >= len(text.VARIANT_COLUMNS):
        return text.read_variants(spark, path, header=False, whitespace=True)
    return text.read_ids(spark, path).selectExpr("idx", "cast(null as string) chrom", "cast(null as int) pos", "id", "cast(null as string) ref", "cast(null as string) alt")


def open_archive(spark: SparkSession, prefix: str, stats: list[str] | None = None) -> LDMatrix:
    """Matrix of an archive; stats: those to be read, else all. A missing or short file is an error."""
    system, base = _located(prefix)
    if not is_archive(prefix):
        raise FileNotFoundError(f"missing file: {prefix}{META}")
    meta = read_meta(spark, prefix + META)
    n, bits, version = meta["dim"]["cols"], meta["bits"], meta["version"]
    wanted = in_order([check_available(meta["stats"], s) for s in stats or meta["stats"]])
    sizes = {x: system.get_file_info(base + x) for x in _suffixes(version, in_order(meta["stats"]))}
    for suffix, info in sizes.items():
        if info.type != fs.FileType.File:
            raise FileNotFoundError(f"missing file: {prefix}{suffix}")
    with system.open_input_file(base + POINTERS) as file:
        nnz = int(_numbers(file, n, 1, "<u8")[0])
    least = {ROWS: 4 if version == OLDEST_VERSION else 2} | {VALUES.format(s): np.dtype(WIDTHS[bits]).itemsize for s in wanted}
    for suffix, width in least.items():
        if sizes[suffix].size < nnz * width:
            raise ValueError(f"{prefix}{suffix} is too short for {nnz} entries")
    stretches = -(-n // STRETCH)
    schema = ", ".join(["col long", "row long", *(f"{s} {TYPES[bits]}" for s in wanted)])
    codes = spark.range(0, stretches, 1, max(1, stretches)).mapInArrow(_decoder(prefix, n, bits, version, wanted), schema)
    # Here the count is a value like the others.
    entries = codes.select("col", "row", *(dequantise(F.col(s), bits).alias(s) for s in wanted))
    return LDMatrix(entries, read_archive_variants(spark, prefix + VARIANTS), n, bits, meta["format"], version, nnz)


def _encoder(stats: list[str], bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_col, last_row = -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            col, row = (batch.column(c).to_numpy() for c in ("col", "row"))
            head = np.diff(col, prepend=last_col) != 0
            distance = np.where(head, col - row, np.diff(row, prepend=last_row))
            last_col, last_row = col[-1], row[-1]
            far = (distance < 0) | (distance >= FAR)
            cols, place = np.unique(col, return_inverse=True)
            parts = {
                "cols": cols.astype("<i8"), "held": np.bincount(place).astype("<i8"), "n_far": np.bincount(place, weights=far).astype("<i8"),
                ROWS: np.where(far, FAR, distance).astype("<i2"), FAR_VALUES: (distance[far] & 0xFFFFFFFF).astype("<u4"),
            }
            parts |= {VALUES.format(s): batch.column(s).to_numpy(zero_copy_only=False).astype(WIDTHS[bits]) for s in stats}
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts.values()], names=list(parts))

    return run


def write_archive(matrix: LDMatrix, prefix: str) -> None:
    """The matrix as an archive under a prefix. Executors encode; the driver appends their bytes, one
    partition at a time and in order, and keeps two numbers for each column."""
    if "N" in matrix.stats:
        raise ValueError("an archive holds values in [-1, 1] only, so no count statistic")
    stats, blobs = matrix.stats, [ROWS, FAR_VALUES, *(VALUES.format(s) for s in matrix.stats)]
    codes = matrix.entries.select("col", "row", *(quantise(F.col(s), matrix.bits).alias(s) for s in stats))
    ordered = codes.repartitionByRange("col").sortWithinPartitions("col", "row")
    encoded = ordered.mapInArrow(_encoder(stats, matrix.bits), ", ".join(f"`{x}` binary" for x in ("cols", "held", "n_far", *blobs)))
    counts = {"held": np.zeros(matrix.n + 1, np.int64), "n_far": np.zeros(matrix.n + 1, np.int64)}
    system, base = _located(prefix)
    system.create_dir(os.path.dirname(base))
    with ExitStack() as stack:
        files = {x: stack.enter_context(system.open_output_stream(base + x)) for x in blobs}
        for part in encoded.toLocalIterator():
            cols = np.frombuffer(part["cols"], "<i8") + 1
            for name, total in counts.items():
                total[cols] += np.frombuffer(part[name], "<i8")
            for suffix, file in files.items():
                file.write(part[suffix])
    meta = matrix.meta() | {"nnz": int(counts["held"].sum()), "version": VERSION}
    whole = {POINTERS: np.cumsum(counts["held"]).astype("<u8").tobytes(), FAR_INDEX: np.cumsum(counts["n_far"]).astype("<u8").tobytes(), META: json.dumps(meta, indent=2).encode()}
    for suffix, content in whole.items():
        with system.open_output_stream(base + suffix) as file:
            file.write(content)
    with system.open_output_stream(base + VARIANTS) as file:
        file.write(("#" + "\t".join(text.VARIANT_COLUMNS) + "\n").encode())
        for v in matrix.variants.orderBy("idx").toLocalIterator():
            file.write(("\t".join("." if v[c.lower()] is None else str(v[c.lower()]) for c in text.VARIANT_COLUMNS) + "\n").encode())
