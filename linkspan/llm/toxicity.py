"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed character n-grams; a text's vector is the average of the embeddings
of its words' n-grams, and a softmax over two classes follows. Embeddings and softmax are trained
jointly, in numpy, so a misspelling that was never seen shares the n-gram vectors of the words it
resembles. Buckets that training texts don't show to be informative (likelihood-ratio test) are
pruned and take no part in the average; else a few words in a long text would vanish in it. Only the
text is an input.

The training sample is bounded by ``max_rows`` labelled rows for each class and ``max_chars``
characters in all, picked by a hash of the id, and is the only thing the driver gathers. Scoring is
one pass over whole texts without a shuffle: the softmax margin is linear in the words, so a task
computes it once for each distinct word and sums.

Defined cases: null or empty text gets the score of the zero vector; ids that the labels repeat with
different values are trained on as they stand; without labelled rows of both classes every score is
0; repeated rows score alike; other columns pass.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, small_batches

STRIP = b".,;:!?\"'()[]{}|*#$%&<>-_"


def subwords(word: bytes, buckets: int, shortest: int = 3, longest: int = 6) -> np.ndarray:
    """Hashed character n-grams of <word>; at least the word itself."""
    text = "<" + word.decode("utf-8", "replace") + ">"
    grams = [text[i : i + n] for n in range(shortest, longest + 1) for i in range(len(text) - n + 1)] or [text]
    if len(text) > longest:
        grams.append(text)
    return np.fromiter((zlib.crc32(g.encode()) % buckets for g in grams), np.int64, len(grams))


def clean_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words without punctuation at their ends."""
    if not text:
        return []
    return [w for w in (raw.strip(STRIP) for raw in text.decode("utf-8", "replace").lower().encode().split()) if w]


class Model:
    """margin: what a word adds to log(p1/p0); share: its part of the average. Buckets that the
    training texts show to be uninformative have neither."""

    def __init__(self, kept: np.ndarray, emb: np.ndarray, out: np.ndarray, bias: np.ndarray, buckets: int):
        self.margins = np.zeros(buckets, np.float32)
        self.margins[kept] = emb @ (out[:, 1] - out[:, 0])
        self.kept = np.zeros(buckets, bool)
        self.kept[kept] = True
        self.bias = float(bias[1] - bias[0])

    def word(self, word: bytes) -> tuple[float, float]:
        grams = subwords(word, len(self.margins))
        on = self.kept[grams]
        if not on.any():
            return 0.0, 0.0
        return float(on.mean()), float(self.margins[grams][on].sum() / len(grams))

    def margin(self, shares: float, total: float) -> float:
        return self.bias + total / (shares + PRIOR)


#: Pseudo-weight in the average, so that a single weak n-gram doesn't decide.
PRIOR = 0.5


def informative(seen: np.ndarray, n: tuple[int, int], least: float) -> np.ndarray:
    """Buckets more frequent in texts of class 1, by the likelihood-ratio statistic of text counts.
    seen: texts of class 0 and of class 1 that have a bucket."""
    n0, n1 = n
    b, a = seen.astype(np.float64)

    def part(observed, expected):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    both, total = a + b, n0 + n1
    g = 2 * (part(a, both * n1 / total) + part(b, both * n0 / total) + part(n1 - a, (total - both) * n1 / total) + part(n0 - b, (total - both) * n0 / total))
    return np.flatnonzero((g >= least) & (a / n1 > b / n0))


class Cached(dict):
    """word -> f(word), dropped as a whole when it holds too many."""

    def __init__(self, f, most: int = 100_000):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.f(word)
        return out


def train(texts: list[bytes], labels: list[int], buckets: int = 1 << 20, dim: int = 6, epochs: int = 12, rate: float = 0.1, least: float = 22.0, decay: float = 1e-4, seed: int = 7) -> Model | None:
    """Joint training of embeddings and softmax by mini-batches with adaptive steps."""
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        return None
    # Two passes over the texts; neither keeps more than a bounded cache of words.
    grams = Cached(lambda w: subwords(w, buckets).astype(np.int32))
    seen = np.zeros((2, buckets), np.int32)
    for text, label in zip(texts, y):
        bag = set(clean_words(text))
        if bag:
            seen[label][np.unique(np.concatenate([grams[w] for w in bag]))] += 1
    kept = informative(seen, (int((y == 0).sum()), int((y == 1).sum())), least)
    grams.clear()
    place = np.full(buckets, -1, np.int32)
    place[kept] = np.arange(len(kept))
    nothing = (np.zeros(0, np.int32), 1)

    def kept_grams(word: bytes) -> tuple[np.ndarray, int]:
        at = place[subwords(word, buckets)]
        on = at[at >= 0]
        return (on, len(at)) if len(on) else nothing

    known = Cached(kept_grams)
    rows = []
    for text in texts:
        ids, vals, shares = [nothing[0]], [np.zeros(0)], 0.0
        for w in clean_words(text):
            on, n = known[w]
            if len(on):
                shares += len(on) / n
                ids.append(on)
                vals.append(np.full(len(on), 1 / n))
        rows.append((np.concatenate(ids), np.concatenate(vals) / (shares + PRIOR)))
    known.clear()
    # A text without evidence is clean: an empty one for every 20 texts, as class 0.
    empty = len(rows) // 20 + 1
    rows += [(nothing[0], np.zeros(0))] * empty
    y = np.concatenate([y, np.zeros(empty, np.int64)])
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (len(kept), dim))
    out = rng.normal(0, 0.5, (dim, 2))
    bias, g_emb, g_out, g_bias = np.zeros(2), np.full((len(kept), dim), 1e-6), np.full((dim, 2), 1e-3), np.full(2, 1e-2)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    step = 32
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(order), step):
            part = order[s : s + step]
            lens = [len(rows[i][0]) for i in part]
            ids, vals = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            owner = np.repeat(np.arange(len(part)), lens)
            hidden = np.stack([np.bincount(owner, emb[ids, d] * vals, len(part)) for d in range(dim)], 1)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= weight[part][:, None] / len(part)
            d_hidden, d_out, d_bias = p @ out.T, hidden.T @ p + decay * out, p.sum(0)
            g_out += d_out**2
            g_bias += d_bias**2
            u, inv = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(inv, d_hidden[owner, d] * vals, len(u)) for d in range(dim)], 1) + decay * emb[u]
            g_emb[u] += grad**2
            emb[u] -= rate * grad / np.sqrt(g_emb[u])
            out -= rate * d_out / np.sqrt(g_out)
            bias -= rate * d_bias / np.sqrt(g_bias)
    return Model(kept, emb, out, bias, buckets)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 3000, max_chars: int = 16_000_000) -> Model | None:
    """Model of a bounded sample of labelled rows, picked by hash; whole texts, at most max_rows of
    each class and max_chars characters; a text that no longer fits is passed over."""
    rank = F.xxhash64(F.col("_ls_id"), F.lit(17))
    marked = labels.select(F.col(id_col).alias("_ls_id"), F.col(label_col).cast("int").alias("_ls_y")).where("_ls_y in (0, 1)").withColumn("_ls_rank", rank)
    # The sample is picked from the labels alone: at most 2 * max_rows ids are broadcast, no text moves but theirs.
    picked = [marked.where(F.col("_ls_y") == y).orderBy("_ls_rank", "_ls_id").limit(max_rows) for y in (1, 0)]
    sample = F.broadcast(picked[0].union(picked[1]))
    # A text that can't fit stays where it is.
    rows = docs.select(F.col(id_col).alias("_ls_id"), F.col(text_col).cast("binary").alias("_ls_text")).where(F.coalesce(F.octet_length("_ls_text"), F.lit(0)) <= max_chars // 2).join(sample, "_ls_id")
    texts, ys, size = [], [], [0, 0]
    for row in rows.orderBy("_ls_rank", "_ls_id", "_ls_y", "_ls_text").select("_ls_text", "_ls_y").toLocalIterator():
        text, y = bytes(row["_ls_text"] or b""), row["_ls_y"]
        if size[y] + len(text) <= max_chars // 2:
            size[y] += len(text)
            texts.append(text)
            ys.append(y)
    return train(texts, ys)


def _score(shared, columns: list[str], max_words: int = 300_000):
    def run(batches):
        model, cache = shared.value, {}
        for batch in batches:
            scores = []
            for text in batch.column("_ls_text").to_pylist():
                if model is None:
                    scores.append(0.0)
                    continue
                total = share = 0.0
                for w in clean_words(text):
                    found = cache.get(w)
                    if found is None:
                        if len(cache) > max_words:
                            cache.clear()
                        found = cache[w] = model.word(w)
                    share += found[0]
                    total += found[1]
                margin = model.margin(share, total)
                scores.append(float(1.0 / (1.0 + np.exp(-np.clip(margin, -60, 60)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(scores, pa.float64())], names=[*columns, "score"])

    return run


def score_toxicity(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """Columns ``keep`` (default: all) plus score and predicted (1 if score >= threshold)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField("score", T.DoubleType())])
    scored = docs.select(*columns, F.col(text_col).cast("binary").alias("_ls_text")).mapInArrow(_score(shared, columns), schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def training_rows(docs: DataFrame, id_col: str = "doc_id", folds: int = 3, held_out: int = 1) -> DataFrame:
    return docs.where(crc_mod(F.col(id_col), folds) != held_out)
