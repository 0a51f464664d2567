"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text: words are runs outside [\\x20\\x09-\\x0D]; a text fails with under
``min_words`` words or if over half of its words lie in three-word windows that occur twice or more.

The method's verdict: lines are normalised (lower case, digits as 0, white space runs as one space),
hashed, and the documents that hold a line are counted for each host (``source``). A line in more
than ``max_docs`` documents of a host is removed, however large the host is; a document that loses
more than ``max_loss`` of its words that way is depleted and rejected. The texts without these lines
come from ``remove_lines``.

Plan: the base rules are one pass without a shuffle. Line hashes shuffle as 16 bytes each, with
map-side combine, so a line of a third of the corpus is no hot task; only lines over the limit meet
the documents' lines again, and only numbers (no texts) are joined by document.

Defined cases: null text has no words and fails; a null source is a host of its own; rows that share
an id are one document where the documents of a line are counted (null ids are one), and rows of
their own in the result; repeated rows get the same verdict; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, id_or_null_stand_in

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WS_CLASS + "+"), lambda w: w != "")


def _repeated(hashes: str) -> Column:
    """Words of the array of word hashes that lie in a three-word window found twice or more.

    Windows are sorted with their places; neighbours with the same hash are repeats. Places of the
    repeats, in order, cover three words each, less what the next one covers again."""
    n = F.size(hashes)
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.struct(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("i")),
        ),
    )
    return F.sort_array(windows)


def base_rules(docs: DataFrame, text_col: str = "text", keep: list[Column] | None = None, min_words: int = 50) -> DataFrame:
    """keep plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    keep = keep or []
    names = [f"_ls_k{i}" for i in range(len(keep))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    first = docs.select(
        *(c.alias(n) for c, n in zip(keep, names)),
        F.transform(_words(text), lambda w: F.xxhash64(w)).alias("_ls_w"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("_ls_l"),
    )
    second = first.select(*names, "word_chars", "n_symbols", F.size("_ls_w").cast("long").alias("n_words"), (F.size("_ls_l") - F.size(F.array_distinct("_ls_l"))).cast("long").alias("n_dup_lines"), _repeated("_ls_w").alias("_ls_s"))
    n = F.size("_ls_s")
    # Places whose window equals a neighbour's in the sorted array.
    twice = F.filter(
        F.col("_ls_s"),
        lambda x, k: (F.get("_ls_s", k - 1)["h"] == x["h"]) & (k > 0) | F.coalesce(F.get("_ls_s", k + 1)["h"] == x["h"], F.lit(False)),
    )
    third = second.select(*names, "word_chars", "n_symbols", "n_words", "n_dup_lines", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_ls_p"))
    covered = F.aggregate(
        F.col("_ls_p"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    out = third.select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def normalise(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), WS_CLASS + "+", " "))


def _lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Each row's id, mark of its text, host and lines that hold a word."""
    host = F.coalesce(F.concat(F.lit("s"), F.col(host_col).cast("string")), F.lit("n"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_ls_id"), F.xxhash64(text).alias("_ls_mark"), host.alias("_ls_host"), F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]"))).alias("_ls_lines"))


def _frequent(lines: DataFrame, max_docs: int) -> DataFrame:
    """(_ls_host, _ls_h) of lines over the limit."""
    once = lines.select("_ls_host", id_or_null_stand_in(F.col("_ls_id")).alias("_ls_doc"), F.explode(F.array_distinct(F.transform("_ls_lines", lambda x: F.xxhash64(normalise(x))))).alias("_ls_h"))
    counts = once.groupBy("_ls_host", "_ls_h").agg(F.count_distinct("_ls_doc").alias("_ls_n"))
    return counts.where(F.col("_ls_n") > max_docs).select("_ls_host", "_ls_h")


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 20) -> DataFrame:
    """docs with the lines over the limit taken out of ``text_col`` (null: empty); rows and columns stay."""
    lines = _lines(docs, id_col, text_col, host_col)
    often = _frequent(lines, max_docs)
    held = lines.select("_ls_id", "_ls_mark", "_ls_host", F.explode(F.array_distinct(F.transform("_ls_lines", lambda x: F.xxhash64(normalise(x))))).alias("_ls_h"))
    gone = held.join(often, ["_ls_host", "_ls_h"]).groupBy("_ls_id", "_ls_mark", "_ls_host").agg(F.collect_set("_ls_h").alias("_ls_gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    host = F.coalesce(F.concat(F.lit("s"), F.col(host_col).cast("string")), F.lit("n"))
    own = (docs[id_col].eqNullSafe(gone["_ls_id"])) & (F.xxhash64(text) == gone["_ls_mark"]) & (host == gone["_ls_host"])
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("_ls_gone", F.xxhash64(normalise(x))) | ~F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    left = F.when(F.col("_ls_gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return docs.join(gone, own, "left").select(*(left.alias(c) if c == text_col else docs[c] for c in docs.columns))


def score_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, max_docs: int = 20, max_loss: float = 0.5
) -> DataFrame:
    """One row per row of docs: id, the base rules' columns, lost_words, kept."""
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    lines = _lines(docs, id_col, text_col, host_col)
    often = _frequent(lines, max_docs)
    placed = lines.select("_ls_id", "_ls_mark", "_ls_host", F.posexplode("_ls_lines").alias("_ls_at", "_ls_line")).select(
        "_ls_id", "_ls_mark", "_ls_host", "_ls_at", F.xxhash64(normalise(F.col("_ls_line"))).alias("_ls_h"), F.size(_words(F.col("_ls_line"))).alias("_ls_words")
    )
    # Rows that repeat id and text give the same lines; distinct counts them once.
    lost = placed.join(often, ["_ls_host", "_ls_h"]).select("_ls_id", "_ls_mark", "_ls_at", "_ls_words").distinct().groupBy("_ls_id", "_ls_mark").agg(F.sum("_ls_words").alias("_ls_lost"))
    base = base_rules(docs, text_col, [F.col(id_col), mark], min_words)
    both = base.join(lost, base["_ls_k0"].eqNullSafe(lost["_ls_id"]) & (base["_ls_k1"] == lost["_ls_mark"]), "left")
    gone = F.coalesce("_ls_lost", F.lit(0)).cast("long")
    return both.select(
        F.col("_ls_k0").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", gone.alias("lost_words"), (~F.col("base_failed") & (gone <= max_loss * F.col("n_words"))).alias("kept")
    )
