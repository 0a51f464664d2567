"""Benchmark decontamination with spaced-seed hashes, in DataFrame functions only.

Texts are lower-cased and split into words of letters and digits. A seed looks at a span of words
through a fixed mask and hashes the words at its 1s only, so a word that was changed under a 0 does
no harm. Seeds of benchmark items are joined with seeds of documents; a hit fixes an alignment
(diagonal) of item and document, and the words around it are compared one by one: an alignment
counts if some window of ``window`` words (or the whole item, if shorter) has at least
``similarity`` of its words equal.

No item is too short: ``masks_for`` adds masks for each length of items until, whatever words the rule
allows to differ, some seed has none of them, so every alignment that counts has a hit. An item of so
few words that none may differ (four, at a similarity of 0.8) is found word for word.

Plan: documents are scanned once for seeds. The seeds' table of the benchmark is broadcast after its
size is checked; a larger one is turned into a bitmap of FILTER_BITS bits that is broadcast instead,
and only seeds whose bit is set are joined by shuffle. Documents with hits are then read again for the
comparison: their ids, broadcast after a check of their number, cut the scan, and each hit takes the
words under its item from its document, then meets the item's words; no row holds more than one hit.
Nothing is collected but the lengths of short items.

Defined cases: null and empty texts and items have no words and match nothing; rows that share an id
are one document; a null id is one document (null in the result); repeated items are found once, of
items that share an id each text counts and the best alignment of any is told; without items or
documents the result is empty.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, id_or_null_stand_in, materialise

#: Places looked at by each mask: weight 5 in spans of 8 and 9.
MASKS = ((0, 1, 3, 6, 7), (0, 2, 3, 4, 8))
WEIGHT = 5
#: Rows of at most 24 bytes (seeds of the benchmark, ids of documents with hits) up to which a side is broadcast.
BROADCAST_ROWS = 1_000_000
#: Bits of the filter for more seeds than that: 64 MB.
FILTER_BITS = 1 << 29


@lru_cache(maxsize=64)
def masks_for(n: int, differ: int) -> tuple[tuple[int, ...], ...]:
    """Masks for n words of which ``differ`` may differ: for any of them, a mask fits at some place
    without touching one. The fixed masks come first; others are added, the most useful first."""

    def places(mask: tuple[int, ...]) -> list[frozenset[int]]:
        return [frozenset(p + at for p in mask) for at in range(n - mask[-1])]

    open_cases = [frozenset(c) for c in combinations(range(n), differ)]
    out = []
    fixed = [m for m in MASKS if m[-1] < n]
    others = [m for m in combinations(range(n), min(WEIGHT, n - differ)) if m[0] == 0] if n > differ else []
    while open_cases:
        if fixed:
            best = fixed.pop(0)
        else:
            best = max(others, key=lambda m: (sum(any(x.isdisjoint(c) for x in places(m)) for c in open_cases), -m[-1]))
        left = [c for c in open_cases if not any(x.isdisjoint(c) for x in places(best))]
        if len(left) < len(open_cases):
            out.append(best)
        open_cases = left
    return tuple(out)


def allowed(n: int, similarity: float) -> int:
    """Words of n that may differ."""
    return n - ceil(n * similarity - 1e-9)


def words_of_text(text: Column) -> Column:
    """Hashes of the lower-cased words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(hashes: str, masks: list[tuple[int, ...]]) -> Column:
    """Array of (pos, seed) over all places and masks."""
    n = F.size(hashes)

    def of(mask: tuple[int, ...]) -> Column:
        def seed(i: Column) -> Column:
            return F.struct(i.alias("pos"), F.xxhash64(F.lit(str(mask)), *(F.get(hashes, i + p) for p in mask)).alias("seed"))

        return F.when(n > mask[-1], F.transform(F.sequence(F.lit(0), n - mask[-1] - 1), seed)).otherwise(F.array().cast("array<struct<pos:int,seed:bigint>>"))

    parts = [of(mask) for mask in masks]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _checked(side: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def _met(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """found joined with seeds; if they are too many to be broadcast, a bitmap of them is."""
    if seeds.count() <= BROADCAST_ROWS:
        return found.join(F.broadcast(seeds), "_ls_seed")
    bit = F.pmod("_ls_seed", F.lit(FILTER_BITS))
    bitmap = seeds.groupBy(F.bitmap_bucket_number(bit).alias("_ls_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_ls_bits"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_ls_bits", F.expr("cast(_ls_at div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    likely = found.withColumns({"_ls_part": F.bitmap_bucket_number(bit), "_ls_at": at}).join(F.broadcast(materialise(bitmap)), "_ls_part")
    likely = likely.withColumn("_ls_byte", byte).where(F.expr("shiftright(_ls_byte, cast(_ls_at % 8 as int)) % 2 = 1"))
    return likely.select(found.columns).join(seeds, "_ls_seed")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, similarity: float = 0.8
) -> DataFrame:
    """One row for each document and benchmark item it holds: the id, the item, doc_pos (word of the
    text at which the item would start; negative if its start is cut off), matched (equal words on
    that alignment) and item_words."""
    items = benchmark.select(F.col(item_col).alias("_ls_item"), words_of_text(F.col(item_text_col)).alias("_ls_iw")).where(F.size("_ls_iw") > 0).distinct()
    items = items.withColumn("_ls_mark", F.xxhash64("_ls_iw"))
    lengths = sorted(r[0] for r in items.select(F.least(F.size("_ls_iw"), F.lit(window))).distinct().collect())  # at most window many
    own = {n: list(masks_for(n, allowed(n, similarity))) for n in lengths or [window]}
    parts = [items.where(F.least(F.size("_ls_iw"), F.lit(window)) == n).select("_ls_item", "_ls_mark", F.size("_ls_iw").alias("_ls_n"), F.explode(_seeds("_ls_iw", masks)).alias("s")) for n, masks in own.items()]
    seeds = parts[0]
    for part in parts[1:]:
        seeds = seeds.union(part)
    seeds = seeds.select("_ls_item", "_ls_mark", "_ls_n", F.col("s.pos").alias("_ls_ipos"), F.col("s.seed").alias("_ls_seed")).distinct()
    texts = docs.select(id_or_null_stand_in(F.col(id_col)).alias("_ls_doc"), F.col(text_col).alias("_ls_text"))
    words = texts.select("_ls_doc", words_of_text(F.col("_ls_text")).alias("_ls_w"))
    every = list(dict.fromkeys(mask for masks in own.values() for mask in masks))
    found = words.select("_ls_doc", F.explode(_seeds("_ls_w", every)).alias("s")).select("_ls_doc", F.col("s.pos").alias("_ls_pos"), F.col("s.seed").alias("_ls_seed"))
    hits = materialise(_met(found, materialise(seeds)).select("_ls_doc", "_ls_item", "_ls_mark", "_ls_n", (F.col("_ls_pos") - F.col("_ls_ipos")).alias("_ls_diag")).distinct())
    return _verify(texts, hits, items, id_col, item_col, window, similarity)


def _verify(texts: DataFrame, hits: DataFrame, items: DataFrame, id_col: str, item_col: str, window: int, similarity: float) -> DataFrame:
    ids = materialise(hits.select("_ls_doc").distinct())
    met = texts.join(_checked(ids, ids.count()), "_ls_doc", "left_semi").select("_ls_doc", words_of_text(F.col("_ls_text")).alias("_ls_w"))
    # The document's words under the item, from where both begin. Hits are met by shuffle: a document may have many.
    under = F.slice("_ls_w", F.greatest("_ls_diag", F.lit(0)) + 1, F.greatest(F.col("_ls_n") + F.least("_ls_diag", F.lit(0)), F.lit(0)))
    cut = hits.hint("merge").join(met, "_ls_doc").select("_ls_doc", "_ls_item", "_ls_mark", F.col("_ls_diag").alias("diag"), under.alias("part"))
    number = items.count()
    wanted = _checked(items, 100 * number)  # of some 100 words
    pairs = cut.join(wanted, cut["_ls_item"].eqNullSafe(wanted["_ls_item"]) & (cut["_ls_mark"] == wanted["_ls_mark"]))
    pairs = pairs.select("_ls_doc", cut["_ls_item"].alias("item"), "diag", "part", F.col("_ls_iw").alias("iw"))
    skipped = F.greatest(-F.col("diag"), F.lit(0))
    same = F.transform(F.sequence(F.lit(0), F.size("iw") - 1), lambda j: F.coalesce((F.get("iw", j) == F.get("part", j - skipped)).cast("int"), F.lit(0)))
    pairs = pairs.select("_ls_doc", "item", "diag", F.size("iw").alias("n"), same.alias("same"))
    width = F.least(F.lit(window), F.col("n"))
    enough = F.exists(F.sequence(F.lit(0), F.col("n") - width), lambda s: F.aggregate(F.slice("same", s + 1, width), F.lit(0), lambda a, x: a + x) >= F.ceil(width * similarity - 1e-9))
    matched = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    best = pairs.where(enough).groupBy("_ls_doc", "item").agg(F.max(F.struct(matched.alias("matched"), (-F.col("diag")).alias("back"), F.col("n").alias("n"))).alias("b"))
    doc = F.when(F.col("_ls_doc") != NULL_ID, F.col("_ls_doc"))
    return best.select(doc.alias(id_col), F.col("item").alias(item_col), (-F.col("b.back")).cast("long").alias("doc_pos"), F.col("b.matched").cast("long").alias("matched"), F.col("b.n").cast("long").alias("item_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark item."""
    bad = find_contamination(docs, benchmark, id_col, text_col).select(id_or_null_stand_in(F.col(id_col)).alias("_ls_bad")).distinct()
    return docs.join(bad, id_or_null_stand_in(docs[id_col]) == bad["_ls_bad"], "left_anti")
