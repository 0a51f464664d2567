"""Matrix to matrix: filter, disjoint and overlapping concatenation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import in_order
from ..sources.text import dense_index
from .ingest import block_diagonal, restrict, sized
from .matrix import LDMatrix, through_codec, union_all


def filter_matrix(matrix: LDMatrix, keep: DataFrame | list[int] | None = None, between: tuple[int, int] | None = None, strict: bool = False) -> LDMatrix:
    """Submatrix of kept variants (0-based places: a list, a DataFrame (idx), or an inclusive range),
    with dense places and the same bits. strict repeats the narrower contract: one statistic, a
    sorted list, and no values that are not numbers in what is kept."""
    if (keep is None) == (between is None):
        raise ValueError("give either keep or between")
    spark = matrix.entries.sparkSession
    if isinstance(keep, list):
        if not keep:
            raise ValueError("the list of places is empty")
        if strict and keep != sorted(keep):
            raise ValueError("places are not sorted")
        if min(keep) < 0 or max(keep) >= matrix.n:
            raise IndexError(f"places out of bounds: the matrix has {matrix.n}")
        wanted = spark.createDataFrame([(i,) for i in sorted(set(keep))], "idx long")
    elif keep is not None:
        wanted = keep.select(F.col("idx").cast("long").alias("idx")).distinct()
        if not wanted.where((F.col("idx") < 0) | (F.col("idx") >= matrix.n)).isEmpty():
            raise IndexError(f"places out of bounds: the matrix has {matrix.n}")
    else:
        start, end = between
        if not 0 <= start <= end < matrix.n:
            raise IndexError(f"range {start}-{end} out of bounds: the matrix has {matrix.n}")
        wanted = None
    if strict and len(matrix.stats) != 1:
        raise ValueError("strict filtering takes one statistic")
    if wanted is None:
        # A range needs no join: predicates reach the scan and places move by a constant.
        part = matrix.entries.where(F.col("col").between(start, end) & F.col("row").between(start, end))
        entries = part.select((F.col("col") - start).alias("col"), (F.col("row") - start).alias("row"), *matrix.stats)
        variants = matrix.variants.where(F.col("idx").between(start, end)).withColumn("idx", F.col("idx") - start)
        n = end - start + 1
    else:
        kept = dense_index(wanted, "idx", "new")
        n = kept.count()
        entries = restrict(matrix.entries, kept, n)
        variants = matrix.variants.join(sized(kept, n), "idx").withColumn("idx", F.col("new")).drop("new")
    if strict and not entries.where(" OR ".join(f"isnan({s})" for s in matrix.stats)).isEmpty():
        raise ValueError("a kept cell is not a number")
    return matrix.with_entries(through_codec(entries, matrix.bits), variants=variants, n=n)


def _same_kind(matrices: list[LDMatrix]) -> None:
    if not matrices:
        raise ValueError("nothing to concatenate")
    kinds = {(m.bits, m.layout, tuple(m.stats)) for m in matrices}
    if len(kinds) > 1:
        raise ValueError(f"matrices differ in bits, layout or statistics: {sorted(kinds)}")


def concat(matrices: list[LDMatrix], overlapping: bool = False) -> LDMatrix:
    """Matrices of consecutive variants as one. Disjoint ones lie along the diagonal. Overlapping ones
    share the end of one and the start of the next: there, rows up to the column come from the
    former and rows past the column from the latter."""
    _same_kind(matrices)
    first = matrices[0]
    if not overlapping:
        entries = block_diagonal([m.entries for m in matrices], [m.n for m in matrices])
        variants, base = [], 0
        for m in matrices:
            variants.append(m.variants.withColumn("idx", F.col("idx") + base))
            base += m.n
        return first.with_entries(entries, variants=union_all(variants), n=base)
    tagged = union_all(m.variants.withColumn("chunk", F.lit(i).cast("long")) for i, m in enumerate(matrices))
    bounds = [r.asDict() for r in boundaries(tagged).orderBy("chunk").collect()]  # a row for each chunk
    check_boundaries(bounds)
    entries = concat_entries(union_all(m.entries.withColumn("chunk", F.lit(i).cast("long")) for i, m in enumerate(matrices)), first.entries.sparkSession.createDataFrame(bounds, BOUNDS))
    variants = concat_variants(tagged, first.entries.sparkSession.createDataFrame(bounds, BOUNDS))
    return first.with_entries(entries, variants=variants, n=bounds[-1]["place_start"] + bounds[-1]["n_variants"])


BOUNDS = "chunk long, n_variants long, shared_before long, shared_from long, place_start long, place_end long, matched boolean"


def boundaries(tagged: DataFrame) -> DataFrame:
    """Per chunk of variants (chunk, idx, id): n_variants; shared_before (variants shared with the
    chunk before), shared_from (first variant shared with the next), place_start and
    place_end (exclusive) of the chunk, matched (the shared variants agree one by one)."""
    sizes = tagged.groupBy("chunk").agg(F.count("*").alias("n_variants"))
    # The first variant of the next chunk is the pivot.
    pivots = tagged.where("idx = 0").select((F.col("chunk") - 1).alias("chunk"), F.col("id"))
    at = tagged.join(F.broadcast(pivots), ["chunk", "id"]).groupBy("chunk").agg(F.min("idx").alias("pivot"))
    ends = sizes.join(at, "chunk", "left").select("chunk", "n_variants", F.coalesce("pivot", "n_variants").alias("shared_from"))
    w = W.orderBy("chunk")  # a row for each chunk
    overlap = F.col("n_variants") - F.col("shared_from")
    own = ends.withColumn("shared_before", F.coalesce(F.lag(overlap).over(w), F.lit(0)))
    own = own.withColumn("place_start", F.coalesce(F.sum(F.col("n_variants") - overlap).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # All shared variants must agree: place in the chunk less the pivot is the place in the next.
    left = tagged.join(F.broadcast(ends.select("chunk", "shared_from")), "chunk").where("idx >= shared_from").select((F.col("chunk") + 1).alias("chunk"), (F.col("idx") - F.col("shared_from")).alias("idx"), F.col("id").alias("left_id"))
    agree = left.join(tagged, ["chunk", "idx"], "left").groupBy("chunk").agg(F.min(F.coalesce(F.col("left_id") == F.col("id"), F.lit(False))).alias("agrees")).select((F.col("chunk") - 1).alias("chunk"), "agrees")
    return own.join(agree, "chunk", "left").select(
        "chunk", "n_variants", "shared_before", "shared_from", "place_start", (F.col("place_start") + F.col("n_variants")).alias("place_end"), F.coalesce("agrees", F.lit(True)).alias("matched")
    )


def check_boundaries(bounds: list[dict]) -> None:
    for b in bounds:
        if not b["matched"]:
            raise ValueError(f"chunks {b['chunk']} and {b['chunk'] + 1} overlap but their variants differ")
        if b["shared_before"] > b["shared_from"]:
            raise ValueError(f"chunk {b['chunk']} overlaps chunks that are not its neighbours")


def concat_entries(tagged: DataFrame, bounds: DataFrame) -> DataFrame:
    """Entries (chunk, col, row, ...) at their global places, each pair from its owner: rows up to the
    column from the earlier chunk and rows past it from the later one where columns are shared."""
    b = F.broadcast(bounds.select("chunk", "shared_before", "shared_from", "place_start"))
    in_previous, in_next = F.col("col") < F.col("shared_before"), F.col("col") >= F.col("shared_from")
    owner = (~in_previous | (F.col("row") > F.col("col"))) & (~in_next | (F.col("row") <= F.col("col")))
    return tagged.join(b, "chunk").where(owner).select((F.col("col") + F.col("place_start")).alias("col"), (F.col("row") + F.col("place_start")).alias("row"), *in_order(tagged.columns))


def concat_variants(tagged: DataFrame, bounds: DataFrame) -> DataFrame:
    """Variants of all chunks, those shared with the chunk before left out, at their global places."""
    b = F.broadcast(bounds.select("chunk", "shared_before", "place_start"))
    columns = [c for c in tagged.columns if c not in ("chunk", "idx")]
    return tagged.join(b, "chunk").where("idx >= shared_before").select((F.col("idx") + F.col("place_start")).alias("idx"), *columns)
