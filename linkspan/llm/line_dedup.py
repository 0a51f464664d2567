"""Corpus-wide line deduplication with two Bloom filters.

A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends with A-Z lower-cased. Keys of at
least ``min_chars`` code points that occur in at least ``min_docs`` documents lose all their lines
except in the document with the largest id that holds them.

1. Each task hashes its lines and emits, per filter segment, the bit positions seen once and those
   seen twice (in two documents). Segments are merged on the executors: a bit is set in the
   "twice" filter if one task had it twice or two tasks had it. Parts are merged in two steps, so that
   a merge holds about the root of the number of tasks.
2. The twice filter (size bound: ``MAX_FILTER_BITS`` bits = 128 MB; a fuller filter only lets more
   lines through) is broadcast. Only lines whose bits are all set, the suspected repeats, shuffle.
3. Suspects are confirmed exactly on a 128-bit digest: distinct (digest, document), then count and
   largest document with map-side combine, so a line that a third of the corpus holds is no hot
   task. Confirmed (document, digests) lists join back to the texts that lose lines, which are
   rebuilt; their ids, broadcast after a check of their number, tell them from all other texts, which
   pass through without a shuffle.

Defined cases: null or empty text is one empty line; rows that share an id are one document; a null
id is one document below all others; repeated rows stay; an empty table gives an empty table. Other
columns pass through unchanged whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS_BYTES, id_or_null_stand_in, materialise, small_batches

MIN_FILTER_BITS, MAX_FILTER_BITS, SEGMENT_BITS = 20, 30, 20
DOC, TEXT, DROPS = "_ls_doc", "_ls_text", "_ls_drops"
#: Ids (8 bytes each) of documents that lose lines that may be broadcast.
BROADCAST_IDS = 2_000_000
#: Bytes of text that one step of merging stands for at least: the square of its parts' number.
MERGE_BYTES = 64 << 20


def digest(raw: bytes, min_chars: int) -> bytes | None:
    """128-bit digest of a line's key, or None for a key that is too short."""
    key = raw.strip(WS_BYTES)
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def _positions(words: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions for each digest (rows of two 64-bit words)."""
    return (words >> np.uint64(64 - bits)).astype(np.uint32)


def _doc_digests(text: bytes, min_chars: int) -> set[bytes]:
    found = {digest(raw, min_chars) for raw in text.split(b"\n")}
    found.discard(None)
    return found


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column(TEXT).to_pylist()]


def _filter_parts(bits: int, min_chars: int):
    """Map task: bit positions seen once and twice, by segment of the filter."""

    def run(batches):
        once, twice = [], []

        def flush():
            if not once:
                return None
            seen, counts = np.unique(np.frombuffer(b"".join(once), dtype=[("a", "<u8"), ("b", "<u8")]), return_counts=True)
            both = np.stack([seen["a"], seen["b"]], axis=1)
            a, b = np.unique(_positions(both, bits)), np.unique(_positions(both[counts > 1], bits))
            once.clear()
            return a, np.union1d(b, np.concatenate(twice)) if twice else b

        # Digests of one document are distinct, so a count over 1 means two documents (or rows).
        held, parts = 0, []
        for batch in batches:
            for text in _texts(batch):
                found = _doc_digests(text, min_chars)
                once.extend(found)
                held += len(found)
            if held > 2_000_000:  # memory bound; what two flushes share is found when they are merged
                parts.append(flush())
                held = 0
        if once:
            parts.append(flush())
        for a, b in parts:
            seg_a, seg_b = a >> SEGMENT_BITS, b >> SEGMENT_BITS
            segments = np.unique(seg_a)
            lo_a, hi_a = np.searchsorted(seg_a, segments), np.searchsorted(seg_a, segments, "right")
            lo_b, hi_b = np.searchsorted(seg_b, segments), np.searchsorted(seg_b, segments, "right")
            mask = np.uint32((1 << SEGMENT_BITS) - 1)
            yield pa.RecordBatch.from_pydict({
                "segment": pa.array(segments.astype(np.int32)),
                "once": pa.array([(a[i:j] & mask).tobytes() for i, j in zip(lo_a, hi_a)], pa.binary()),
                "twice": pa.array([(b[i:j] & mask).tobytes() for i, j in zip(lo_b, hi_b)], pa.binary()),
            })

    return run


def _seen(table: pa.Table) -> np.ndarray:
    """Times (2: or more) that parts of one segment have each bit."""
    seen = np.zeros(1 << SEGMENT_BITS, np.uint8)
    for once, twice in zip(table.column("once"), table.column("twice")):
        part = np.zeros(1 << SEGMENT_BITS, np.uint8)
        part[np.frombuffer(once.as_buffer(), np.uint32)] = 1
        part[np.frombuffer(twice.as_buffer(), np.uint32)] = 2
        seen = np.minimum(seen + part, 2)
    return seen


def _merge_some(table: pa.Table) -> pa.Table:
    """Some parts of one segment as one."""
    seen = _seen(table)
    out = [pa.array([np.flatnonzero(seen >= n).astype(np.uint32).tobytes()], pa.binary()) for n in (1, 2)]
    return pa.table({"segment": table.column("segment").slice(0, 1).combine_chunks(), "once": out[0], "twice": out[1]})


def _merge_segment(table: pa.Table) -> pa.Table:
    """All parts of one segment: its bits of the twice filter."""
    return pa.table({"segment": table.column("segment").slice(0, 1).combine_chunks(), "bits": pa.array([np.packbits(_seen(table) >= 2, bitorder="little").tobytes()], pa.binary())})


def twice_filter(lines: DataFrame, bits: int, min_chars: int, size: int = 0) -> bytes:
    """The merged twice-seen filter. At most 2**MAX_FILTER_BITS bits reach the driver."""
    parts = lines.select(TEXT).mapInArrow(_filter_parts(bits, min_chars), "segment int, once binary, twice binary")
    groups = math.isqrt(size // MERGE_BYTES)
    if groups > 1:
        parts = parts.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(groups))).groupBy("segment", "group").applyInArrow(_merge_some, "segment int, once binary, twice binary")
    merged = parts.groupBy("segment").applyInArrow(_merge_segment, "segment int, bits binary")
    whole = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    step = (1 << SEGMENT_BITS) // 8
    for row in merged.toLocalIterator():
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        whole[row["segment"] * step : row["segment"] * step + step] = part
    return whole


def _suspects(shared, bits: int, min_chars: int):
    """Map task: (digest, document) of lines whose bits are all set in the twice filter."""

    def run(batches):
        whole = shared.value
        for batch in batches:
            docs = batch.column(DOC).to_pylist()
            keys, owner = [], []
            for doc, text in zip(docs, _texts(batch)):
                found = _doc_digests(text, min_chars)
                keys.extend(found)
                owner.extend([doc] * len(found))
            if not keys:
                continue
            pos = _positions(np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2), bits)
            hit = ((whole[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1).all(axis=1)
            at = np.flatnonzero(hit)
            yield pa.RecordBatch.from_pydict({"digest": pa.array([keys[i] for i in at], pa.binary()), DOC: pa.array([owner[i] for i in at], pa.int64())})

    return run


def _rebuild(min_chars: int, text_col: str, columns: list[str]):
    def run(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drops in zip(_texts(batch), batch.column(DROPS).to_pylist()):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if drops:
                    gone = set(drops)
                    lines = [raw for raw in lines if digest(raw, min_chars) not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append(b"\n".join(lines) if n_dropped[-1] else text)
            out = [pa.array(texts, pa.binary()).cast(pa.string()) if c == text_col else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with repeated lines removed from ``text_col`` (null becomes empty), plus n_lines and
    n_dropped (these two names replace columns of the same name)."""
    spark = docs.sparkSession
    small_batches(spark)
    lines = docs.select(id_or_null_stand_in(F.col(id_col)).alias(DOC), F.col(text_col).cast("binary").alias(TEXT))
    size = lines.agg(F.sum(F.octet_length(TEXT)).alias("n")).first()["n"] or 0
    # 8 bits for each line that could be there (a key has min_chars bytes and a line end at least).
    bits = min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, int(8 * size / (min_chars + 1)).bit_length()))
    shared = spark.sparkContext.broadcast(twice_filter(lines, bits, min_chars, size))
    suspects = materialise(lines.mapInArrow(_suspects(shared, bits, min_chars), f"digest binary, {DOC} long"))
    confirmed = suspects.distinct().groupBy("digest").agg(F.count("*").alias("n"), F.max(DOC).alias("_ls_keep")).where(F.col("n") >= min_docs)
    # Written, so that the join below starts from plain exchanges, whose hot partitions can be split.
    confirmed = materialise(confirmed.select("digest", "_ls_keep"))
    drops = materialise(suspects.join(confirmed, "digest").where(F.col(DOC) != F.col("_ls_keep")).groupBy(DOC).agg(F.collect_set("digest").alias(DROPS)))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    schema = T.StructType([T.StructField(c, T.StringType() if c == text_col else docs.schema[c].dataType) for c in columns] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    tagged = docs.select(*(F.col(c) for c in columns if c != text_col), id_or_null_stand_in(F.col(id_col)).alias(DOC), F.col(text_col).cast("binary").alias(TEXT))
    if drops.count() > BROADCAST_IDS:
        return tagged.join(drops, DOC, "left").mapInArrow(_rebuild(min_chars, text_col, columns), schema)
    losing = F.broadcast(drops.select(DOC))
    rebuilt = tagged.join(losing, DOC, "left_semi").join(drops.hint("merge"), DOC).mapInArrow(_rebuild(min_chars, text_col, columns), schema)
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = docs.select(*(text.alias(c) if c == text_col else F.col(c) for c in columns), id_or_null_stand_in(F.col(id_col)).alias(DOC)).join(losing, DOC, "left_anti")
    n_lines = (F.length(F.col(text_col)) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1).cast("long")
    return rebuilt.unionByName(same.select(*columns, n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")))
