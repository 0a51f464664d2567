"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Documents of a source are put in a fixed pseudo-random order and cut into blocks of ``block_docs``
documents. With whole-number weights c_s that add up to P (the given weights, exactly), block j of
source s is released at slot floor(j*P/c_s) and due by slot ceil((j+1)*P/c_s); one block runs in each
slot, of those released the one that is due first. This meets every deadline, so in any prefix of the
slots a source deviates from its target by less than one block.

Nothing is dropped. Where a source has no block left, a phase ends and the next one starts, with the
windows of the sources that are left; ``in_mix`` marks the first phase, in which all target weights
hold. So every slot up to the number of blocks is filled once.

Which block is due first depends on all slots before, so the schedule is one sequence, made on the
driver from the number of documents of each source: a heap operation a block. Its size is bounded: a
mix of more than MAX_BLOCKS blocks takes blocks of twice as many documents, and so on, and more than
MAX_SOURCES sources are an error that asks to pool rare ones. No document or id comes to the driver.

The order within a source needs no task that holds a whole source: documents are ranked inside hash
buckets (their number grows with the table) and bucket counts give the offsets. The schedule comes to
a bucket's documents as one array of some ``bucket_rows / block_docs`` slots, by the partitioning of
the ranks, so texts are shuffled once.

Blocks count documents, not tokens. Defined cases: a null source is a source of its own; rows that
agree in id and text share a rank order that doesn't matter; null ids count as one id; sources without
a given weight get ``default_weight``; a weight must be a positive number, and is exact as printed; an
empty table gives an empty table; columns named like the results are replaced.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RESULT = ("block", "offset", "release", "deadline", "slot", "in_mix")
#: Rows of the weights' table, and of the schedule (some 40 bytes each).
MAX_SOURCES, MAX_BLOCKS = 4096, 1 << 21
#: Blocks of a source that are sent as one row.
PART = 1024


def whole_weights(weights: Mapping[str, float | int | Fraction]) -> dict[str, int]:
    """The same proportions in whole numbers without a common factor."""
    exact = {}
    for s, w in weights.items():
        try:
            exact[s] = w if isinstance(w, Fraction) else Fraction(str(w))
        except ValueError:
            exact[s] = Fraction(0)
        if exact[s] <= 0:
            raise ValueError(f"the weight of {s!r} must be a positive number, not {w!r}")
    scale = math.lcm(*(x.denominator for x in exact.values()))
    out = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*out.values())
    return {s: c // common for s, c in out.items()}


def default_weights(counts: Mapping[str, int], temperature: float) -> dict[str, Fraction]:
    """Documents to the power temperature, in millionths of the largest (one at least)."""
    most = max(counts.values(), default=1) ** temperature
    return {s: Fraction(max(1, round(1_000_000 * n**temperature / most))) for s, n in counts.items()}


def pfair(weights: Mapping[str, int], blocks: Mapping[str, int]) -> Iterator[tuple[str, int, int, int, int, bool]]:
    """(source, block, release, deadline, slot, in the first phase) of all blocks, slot by slot. Ties in
    deadlines go by name."""
    left, done, start = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0
    first = True
    while left:
        shares = whole_weights({s: weights[s] for s in left})
        total = sum(shares.values())
        # Blocks to be released, one a source, and released ones by deadline.
        waiting = [(0, s, 0) for s in sorted(left)]
        ready: list[tuple[int, str, int, int]] = []
        slot = 0
        while True:
            while waiting and waiting[0][0] <= slot:
                release, s, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(j + 1) * total // shares[s]), s, j, release))
            deadline, s, j, release = ready[0]
            if j == left[s]:
                break  # a block that isn't there
            heapq.heappop(ready)
            yield s, done[s] + j, start + release, start + deadline, start + slot, first
            heapq.heappush(waiting, ((j + 1) * total // shares[s], s, j + 1))
            slot += 1
        # Each source's next block is in one of the heaps.
        for s, j in [(s, j) for _, s, j in waiting] + [(s, j) for _, s, j, _ in ready]:
            done[s] += j
            left[s] -= j
            if not left[s]:
                del left[s]
        start += slot
        first = False


def schedule(spark: SparkSession, weights: Mapping[str, int], blocks: Mapping[str, int]) -> DataFrame:
    """The schedule as a table (_ls_source, block, release, deadline, slot, in_mix)."""
    parts: dict[tuple[str, int], list[list]] = {}
    for s, j, *window in pfair(weights, blocks):
        part = parts.setdefault((s, j // PART), [[], [], [], []])
        for column, x in zip(part, window):
            column.append(x)
    rows = [(s, k * PART, *part) for (s, k), part in parts.items()]
    sent = spark.createDataFrame(rows, "_ls_source string, base long, release array<bigint>, deadline array<bigint>, slot array<bigint>, in_mix array<boolean>")
    zipped = F.posexplode(F.arrays_zip("release", "deadline", "slot", "in_mix")).alias("at", "w")
    return sent.select("_ls_source", "base", zipped).select("_ls_source", (F.col("base") + F.col("at")).alias("block"), "w.*")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str | None = "text",
    block_docs: int = 16,
    temperature: float = 0.5,
    default_weight: float = 1.0,
    bucket_rows: int = 20_000,
    seed: int = 11,
) -> DataFrame:
    """docs plus block, offset, release, deadline, slot, in_mix. weights: by source; without them a
    source weighs its number of documents to the power ``temperature``."""
    spark = docs.sparkSession
    docs = docs.drop(*RESULT)
    ordered = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed))
    sizes = docs.groupBy(_key(F.col(source_col)).alias("_ls_source")).count().limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"a mix has at most {MAX_SOURCES} sources: pool rare ones before")
    counts = {r["_ls_source"]: r["count"] for r in sizes}
    while sum(-(-n // block_docs) for n in counts.values()) > MAX_BLOCKS:
        block_docs *= 2
    bits = min(20, max(4, (sum(counts.values()) // bucket_rows).bit_length()))
    if weights is None:
        given: Mapping = default_weights(counts, temperature)
    else:
        named = {"s" + s if s is not None else "n": w for s, w in weights.items()}
        given = {s: named.get(s, default_weight) for s in counts}
    planned = schedule(spark, whole_weights(given) if given else {}, {s: -(-n // block_docs) for s, n in counts.items()})
    tagged = docs.withColumns({"_ls_source": _key(F.col(source_col)), "_ls_order": ordered}).withColumn("_ls_bucket", F.shiftrightunsigned("_ls_order", 64 - bits).cast("int"))
    per = docs.select(_key(F.col(source_col)).alias("_ls_source"), F.shiftrightunsigned(ordered, 64 - bits).cast("int").alias("_ls_bucket")).groupBy("_ls_source", "_ls_bucket").agg(F.count("*").alias("_ls_n"))
    earlier = W.partitionBy("_ls_source").orderBy("_ls_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select("_ls_source", "_ls_bucket", "_ls_n", F.coalesce(F.sum("_ls_n").over(earlier), F.lit(0)).alias("_ls_before"))
    # A bucket's blocks, and their slots as one array in the order of blocks.
    held = offsets.select("_ls_source", "_ls_bucket", "_ls_before", F.explode(F.expr(f"sequence(_ls_before div {block_docs}, (_ls_before + _ls_n - 1) div {block_docs})")).alias("block"))
    found = held.join(planned, ["_ls_source", "block"])
    entry = F.struct("block", "release", "deadline", "slot", "in_mix")
    plans = found.groupBy("_ls_source", "_ls_bucket").agg(F.min("_ls_before").alias("_ls_before"), F.sort_array(F.collect_list(entry)).alias("_ls_plan"))
    tie = [F.xxhash64(F.col(text_col))] if text_col else []
    rank = F.row_number().over(W.partitionBy("_ls_source", "_ls_bucket").orderBy("_ls_order", F.col(id_col), *tie))
    ranked = tagged.withColumn("_ls_rank", rank - 1).join(plans, ["_ls_source", "_ls_bucket"]).withColumn("_ls_rank", F.col("_ls_rank") + F.col("_ls_before"))
    at = F.expr(f"_ls_plan[cast(_ls_rank div {block_docs} - _ls_before div {block_docs} as int)]")
    placed = ranked.withColumns({"_ls_at": at, "_ls_offset": (F.col("_ls_rank") % block_docs).cast("long")})
    return placed.select(*(F.col(c) for c in docs.columns), F.col("_ls_at.block").alias("block"), F.col("_ls_offset").alias("offset"), *(F.col(f"_ls_at.{c}").alias(c) for c in RESULT[2:]))
