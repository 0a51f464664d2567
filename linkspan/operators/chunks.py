"""Genomic chunks, and LD of variants in a window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def genomic_chunks(bounds: DataFrame, window: int, chunk: int | None = None, overlap: int | None = None) -> DataFrame:
    """(chrom, chunk_id from 1, start, end) from bounds (chrom, min_pos, max_pos). A chunk is two
    windows long and overlaps the next by one, if not given."""
    chunk, overlap = chunk or 2 * window, window if overlap is None else overlap
    step = chunk - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the chunk")
    starts = bounds.select("chrom", "max_pos", F.posexplode(F.sequence(F.col("min_pos").cast("long"), F.col("max_pos").cast("long"), F.lit(step).cast("long"))).alias("k", "start"))
    return starts.select("chrom", (F.col("k") + 1).cast("long").alias("chunk_id"), "start", F.least(F.col("start") + chunk - 1, F.col("max_pos").cast("long")).alias("end"))


def nonempty_chunks(chunks: DataFrame, variants: DataFrame) -> DataFrame:
    """Chunks (a chromosome's are equally long and equally far apart) with their number of variants;
    empty ones, and chromosomes of empty ones only, go. The chunks over a variant are computed from
    its position, as many as overlap there, and only counts meet the chunks."""
    grid = chunks.groupBy("chrom").agg(F.min("start").alias("_origin"), F.max("start").alias("_last"), F.max("chunk_id").alias("_k"), F.max(F.col("end") - F.col("start") + 1).alias("_span"))
    step = F.expr("CASE WHEN _k > 1 THEN (_last - _origin) div (_k - 1) ELSE 1 END")
    placed = variants.select("chrom", F.col("pos").cast("long").alias("pos")).join(F.broadcast(grid), "chrom").withColumn("_step", step)
    first, last = F.expr("greatest(0, (pos - _origin - _span + _step) div _step)"), F.expr("least(_k - 1, (pos - _origin) div _step)")
    within = placed.where("pos >= _origin").select("chrom", first.alias("_a"), last.alias("_b")).where("_a <= _b")
    counts = within.select("chrom", F.explode(F.sequence((F.col("_a") + 1).cast("long"), (F.col("_b") + 1).cast("long"))).alias("chunk_id")).groupBy("chrom", "chunk_id").agg(F.count("*").alias("n_variants"))
    return chunks.join(counts, ["chrom", "chunk_id"]).select("chrom", "chunk_id", "start", "end", "n_variants")


def window_pairs(variants: DataFrame, window: int, carry: list[str]) -> DataFrame:
    """Pairs of variants of a chromosome, A before B (by place), at most window apart. An equi-join on
    bins as wide as the window: of a pair, the variant that lies before meets the other in its own bin
    or in the next one, to which it is sent as well, so each pair meets once and a task holds two
    windows of variants."""
    wide = int(window) + 1
    v = variants.select("chrom", F.struct(F.col("pos").cast("long").alias("pos"), "idx").alias("at"), F.struct("idx", "pos", "id", *carry).alias("v"), F.expr(f"pos div {wide}").alias("bin"))
    left = v.select("chrom", F.col("at").alias("at_x"), F.col("v").alias("x"), F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("bin"))
    right = v.select("chrom", F.col("at").alias("at_y"), F.col("v").alias("y"), "bin")
    met = left.join(right, ["chrom", "bin"]).where((F.col("at_x") < F.col("at_y")) & (F.col("at_y.pos") - F.col("at_x.pos") <= window))
    ahead = F.col("x.idx") < F.col("y.idx")
    first, second = F.when(ahead, F.col("x")).otherwise(F.col("y")), F.when(ahead, F.col("y")).otherwise(F.col("x"))
    names = ["idx", "pos", "id", *carry]
    pairs = met.select("chrom", first.alias("a"), second.alias("b"))
    return pairs.select("chrom", *(F.col(f"a.{c}").alias(f"{c}_a") for c in names), *(F.col(f"b.{c}").alias(f"{c}_b") for c in names))


#: Variants of a tile, and its bytes of genotypes.
TILE, TILE_BYTES = 512, 1 << 21


def _tiles(variants: DataFrame, window: int, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tiles (chrom, bin, tile, members) of variants in bins as wide as the window, and the pairs of
    tiles to compare: each with itself, the later ones of its bin and all of the next bin. A bin has as
    many tiles as its variants need, so a dense one is no hot task; genotypes travel as bytes."""
    wide = int(window) + 1
    sample = variants.select(F.size("g") + F.size("h")).first()
    per_tile = max(1, min(TILE, TILE_BYTES // max(1, sample[0]))) if sample else TILE
    v = variants.select("chrom", F.expr(f"pos div {wide}").alias("bin"), "idx", F.col("pos").cast("long").alias("pos"), "id", *carry, *(F.col(c).cast("array<tinyint>").alias(c) for c in ("g", "h")))
    grid = v.groupBy("chrom", "bin").agg(F.ceil(F.count("*") / per_tile).alias("tiles"))
    members = F.collect_list(F.struct("idx", "pos", "id", *carry, "g", "h")).alias("members")
    tiles = v.join(grid, ["chrom", "bin"]).groupBy("chrom", "bin", F.expr("pmod(xxhash64(idx), tiles)").alias("tile")).agg(members)
    following = grid.select("chrom", (F.col("bin") - 1).alias("bin"), F.col("tiles").alias("more"))
    own = grid.join(following, ["chrom", "bin"], "left").select("chrom", "bin", "tiles", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.coalesce("more", F.lit(0)).alias("more"))
    here = F.transform(F.sequence("tile", F.col("tiles") - 1), lambda t: F.struct(F.col("bin").alias("bin_y"), t.alias("tile_y")))
    there = F.transform(F.sequence(F.lit(1).cast("long"), F.col("more").cast("long")), lambda t: F.struct((F.col("bin") + 1).alias("bin_y"), (t - 1).alias("tile_y")))
    return tiles, own.select("chrom", "bin", "tile", F.inline(F.when(F.col("more") > 0, F.concat(here, there)).otherwise(here)))


#: Sums of a pair: samples, haplotypes, then those of dosages and of haplotypes.
SUMS = ("n", "nh", "sx", "sy", "sxx", "syy", "sxy", "na", "nb", "nab")


def _pair_sums(window: int, names: list[str]):
    """Sums of all pairs in two tiles by matrix products, exact in doubles."""

    def matrix(members: pa.StructArray, name: str) -> np.ndarray:
        cells = members.field(name)
        flat = cells.flatten().to_numpy(zero_copy_only=False)
        if len(flat) % len(members) or (np.diff(cells.offsets.to_numpy()) * len(members) != len(flat)).any():
            raise ValueError("variants differ in their numbers of samples")
        return flat.reshape(len(members), -1).astype(np.float64)

    def compare(chrom: str, x: pa.StructArray, y: pa.StructArray, same: bool) -> Iterator[pa.RecordBatch]:
        pool = {c: pa.concat_arrays([x.field(c), y.field(c)]) for c in names}
        g, h = [[matrix(m, c) for m in (x, y)] for c in ("g", "h")]
        if g[0].shape[1] != g[1].shape[1] or h[0].shape[1] != h[1].shape[1]:
            raise ValueError("variants differ in their numbers of samples")
        s, q, m = (np.concatenate(z) for z in ([a.sum(1) for a in g], [(a * a).sum(1) for a in g], [a.sum(1) for a in h]))
        idx, pos = pool["idx"].to_numpy(), pool["pos"].to_numpy()
        for start in range(0, len(x), 64):
            rows = slice(start, min(start + 64, len(x)))
            near = np.abs(pos[rows, None] - pos[None, len(x) :]) <= window
            if same:
                near &= idx[rows, None] < idx[None, len(x) :]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            sxy, nab = (g[0][rows] @ g[1].T)[i, j], (h[0][rows] @ h[1].T)[i, j]
            i, j = i + start, j + len(x)
            a, b = np.where(idx[i] < idx[j], i, j), np.where(idx[i] < idx[j], j, i)
            size = np.ones(len(a))
            sums = (size * g[0].shape[1], size * h[0].shape[1], s[a], s[b], q[a], q[b], sxy, m[a], m[b], nab)
            ends = [pool[c].take(pa.array(k)) for k in (a, b) for c in names]
            yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(a)), *ends, *(pa.array(v.astype(np.int64)) for v in sums)], names=["chrom", *(f"{c}_{e}" for e in "ab" for c in names), *SUMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chrom, x, y, same = (batch.column(k) for k in ("chrom", "x", "y", "same"))
            for k in range(batch.num_rows):
                yield from compare(chrom[k].as_py(), x[k].values, y[k].values, same[k].as_py())

    return run


def window_ld(variants: DataFrame, window: int, carry: list[str]) -> DataFrame:
    """LD statistics of the pairs of variants (chrom, pos, idx, id, dosages g, haplotypes h) that
    window_pairs gives, with the columns of carry. All sums are whole numbers and each statistic is one
    division of them, so results don't depend on the order."""
    names = ["idx", "pos", "id", *carry]
    tiles, compared = _tiles(variants, window, carry)
    left = compared.join(tiles.select("chrom", "bin", "tile", F.col("members").alias("x")), ["chrom", "bin", "tile"])
    both = left.join(tiles.select("chrom", F.col("bin").alias("bin_y"), F.col("tile").alias("tile_y"), F.col("members").alias("y")), ["chrom", "bin_y", "tile_y"])
    types = {c: variants.schema[c].dataType.simpleString() for c in names} | {"pos": "bigint"}
    schema = ", ".join(["chrom string", *(f"{c}_{e} {types[c]}" for e in "ab" for c in names), *(f"{c} bigint" for c in SUMS)])
    sums = both.select("chrom", "x", "y", ((F.col("bin") == F.col("bin_y")) & (F.col("tile") == F.col("tile_y"))).alias("same")).mapInArrow(_pair_sums(int(window), names), schema)
    return ld_of_sums(sums)


def ld_of_sums(sums: DataFrame) -> DataFrame:
    """The statistics in place of SUMS."""
    sums = sums.withColumn("_dis", F.expr("nh * nab - na * nb"))
    over = lambda top, bottom: F.when(bottom == 0, F.lit(float("nan"))).otherwise(top / bottom)
    vx, vy = F.expr("n * sxx - sx * sx"), F.expr("n * syy - sy * sy")
    unphased = over(F.expr("n * sxy - sx * sy").cast("double"), F.sqrt((vx * vy).cast("double")))
    phased = over(F.col("_dis").cast("double"), F.sqrt(F.expr("na * (nh - na) * nb * (nh - nb)").cast("double")))
    most = F.when(F.col("_dis") >= 0, F.least(F.expr("na * (nh - nb)"), F.expr("(nh - na) * nb"))).otherwise(F.least(F.expr("na * nb"), F.expr("(nh - na) * (nh - nb)")))
    out = {
        "PHASED_R": phased, "UNPHASED_R": unphased, "PHASED_R2": phased * phased, "UNPHASED_R2": unphased * unphased,
        "D": F.col("_dis").cast("double") / F.expr("nh * nh").cast("double"), "DPRIME": over(F.col("_dis").cast("double"), most.cast("double")),
    }
    return sums.withColumns(out).drop(*SUMS, "_dis")
