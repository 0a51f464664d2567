"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

log P(word | history) = log P(class | history) + log P(word | class, history).

The class softmax has hashed n-gram and skip features of the three classes before: each alone, each
pair (one of them skipping the middle) and all three. The frequent words, and the end, are classes of
their own; all other words are put in classes by a hash of their endings, so an unseen word has a
class too.

The softmax within a class has a bias for each word, (c + 0.5) / (C + 0.5 * (V + 1)) over the class's
C training tokens and V words, as the base score is smoothed, and hashed features of words: the word
with the two words before, with the word before, and with the word before that (a skip). A token is left
to the longest of these three contexts that is kept. A context is kept if, of all training tokens that
longer contexts leave to it, some word occurs at least REPEATS times; then every word of these tokens is
a feature. Nothing depends on blocks, and the table of features has no limit: it is learnt and read in
parts by a hash of the context, and no part is sent to all tasks or to the driver. As only words with a
feature differ from their biases, the sum over a class is 1 + sum(p * (exp(weight) - 1)) over these, and
is exact.

1. One pass cuts the corpus into blocks and writes each as a local dictionary and word numbers, so
   texts are split only once. Training counts of the dictionaries add up to the table of word counts,
   which is joined to the dictionaries (a row for each block and distinct word, never for each token).
2. Every training token's (class history, class) is counted; the gradients of the likelihood over these
   counts are those over all tokens. For the class softmax each update sends the weights to the tasks
   that hold the counts, adds up their gradients and takes a step scaled by the expected counts.
3. Each block is stored with its words' training counts, the tokens left and the gains so far, so that
   asking needs no shuffle of blocks. For each kind of context in turn, in ROUNDS over the parts, blocks
   send their distinct pairs of context and word, of training and held-out tokens, to the context's part,
   as packed arrays. A part adds up its pairs, finds the contexts to keep, trains their softmaxes (a
   context's words of a class are one of their own) and answers each block with the gain of each pair, or
   that the context is not kept. Tokens without a gain go on to the next kind. The answers of the first
   STORED kinds are added to the stored blocks, in SHARES one after the other, and their files go.
4. Blocks are scored in numpy from the class table, the word counts, the stored gains and the answers.

What the driver holds is bounded: class weights (``BUCKETS`` x ``CLASSES``) and a few totals; ``fit`` also
gathers the most frequent features, to look at.

Defined cases: null or empty text is the end token alone; null ids take the fold of the empty text;
repeated rows count and score as rows of their own; without training rows every word has count 0; an
empty table gives an empty table. Words are lower-cased (A-Z) runs outside [\\x20\\x09-\\x0D].
"""

from __future__ import annotations

import functools
import gc
import hashlib
import itertools
import time
from collections import defaultdict
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialise, small_batches

TOP, ENDINGS = 14, 16
END_CLASS, START_CLASS, CLASSES = TOP + ENDINGS, TOP + ENDINGS + 1, TOP + ENDINGS + 2
BUCKETS, TEMPLATES = 1 << 14, 8
END = b"\n"  # no word can be this
BLOCK_CHARS = 8_000_000
STOPS = b".,;:!?\"'()"
#: Features that ``fit`` shows on the driver (scores take all), and the times that a kept context must
#: have some word.
MAX_FEATURES, REPEATS = 1 << 20, 2
#: Tokens of the corpus for each part of the pairs, and the rounds in which the pairs of each kind of
#: context go to their parts: what one round shuffles is gone before the next.
PART_TOKENS, ROUNDS = 1_500_000, (4, 2, 1)
#: Kinds whose answers are added to the stored blocks, and the shares of blocks in which they are.
STORED, SHARES = 1, 2
#: Variance of a weight's prior within classes, and updates of the weights there.
SPREAD, WORD_UPDATES = 8.0, 40


def word_key(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in words]), "<i8")


def ending(word: bytes) -> int:
    return ENDINGS if word == END else crc32((word.rstrip(STOPS) or word)[-3:]) % ENDINGS


def _as_list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _encode(batches):
    """Rows of blocks: documents, lengths, training marks, dictionary, training counts, endings, numbers."""
    part, number = TaskContext.get().partitionId(), 0
    state: dict = {}

    def fresh():
        state.update(docs=[], lens=[], train=[], words=defaultdict(itertools.count().__next__), ids=[], chars=0)

    def block():
        nonlocal number
        words, ids = list(state["words"]), np.concatenate(state["ids"])
        lens, train = np.array(state["lens"]), np.array(state["train"], bool)
        counts = np.bincount(ids[np.repeat(train, lens)], minlength=len(words))
        row = {
            "block": pa.array([(part << 33) + number], pa.int64()),
            "docs": pa.array([state["docs"]], pa.list_(pa.int64())),
            "lens": pa.array([state["lens"]], pa.list_(pa.int32())),
            "train": pa.array([state["train"]], pa.list_(pa.bool_())),
            "words": _as_list(word_keys(words), pa.int64()),
            "counts": _as_list(counts, pa.int64()),
            "endings": pa.array([[ending(w) for w in words]], pa.list_(pa.int8())),
            "ids": pa.array([pa.compress(_planes(ids.astype(np.uint16 if len(words) <= 65536 else np.uint32)), "zstd", asbytes=True)], pa.binary()),
        }
        number += 1
        fresh()
        return pa.RecordBatch.from_pydict(row)

    fresh()
    for batch in batches:
        for doc, train, text in zip(batch.column("_ls_doc").to_pylist(), batch.column("_ls_train").to_pylist(), batch.column("_ls_text").to_pylist()):
            words = text.lower().split() if text else []
            words.append(END)
            state["ids"].append(np.fromiter(map(state["words"].__getitem__, words), np.int64, len(words)))
            state["docs"].append(doc)
            state["lens"].append(len(words))
            state["train"].append(train)
            state["chars"] += len(text or b"")
            if state["chars"] >= BLOCK_CHARS:
                yield block()
    if state["docs"]:
        yield block()


_BLOCK = "block long, docs array<bigint>, lens array<int>, train array<boolean>, words array<bigint>, counts array<bigint>, endings array<tinyint>, ids binary"


def classes_of(keys: np.ndarray, endings: np.ndarray, top: dict[int, int]) -> np.ndarray:
    """Class of each dictionary word."""
    out = endings.astype(np.int64) + TOP  # the end's ending number leads to END_CLASS
    if top:
        order = np.array(sorted(top), np.int64)
        at = np.minimum(np.searchsorted(order, keys), len(order) - 1)
        hit = order[at] == keys
        out[hit] = np.array([top[k] for k in order.tolist()])[at[hit]]
    return out


def _ids(raw: bytes, n_words: int, n_tokens: int) -> np.ndarray:
    kind = np.uint16 if n_words <= 65536 else np.uint32
    return _from_planes(pa.decompress(raw, n_tokens * np.dtype(kind).itemsize, "zstd", asbytes=True), kind).astype(np.int64)


def _list(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    """A list column's value as an array, without Python objects."""
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def histories(classes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """(c1 * C + c2) * C + c3 of the three classes before each token; START_CLASS before the text."""
    starts = np.cumsum(lens) - lens
    offset = np.arange(len(classes)) - np.repeat(starts, lens)
    out = np.zeros(len(classes), np.int64)
    for back in (1, 2, 3):
        before = np.full(len(classes), START_CLASS)
        before[back:] = classes[:-back] if back <= len(classes) else []
        before[offset < back] = START_CLASS
        out = out * CLASSES + before
    return out


def _count_histories(shared):
    def run(batches):
        cells = np.zeros(CLASSES**4, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                keys, lens, train = (_list(batch, c, i) for c in ("words", "lens", "train"))
                classes = classes_of(keys, _list(batch, "endings", i), shared.value)[_ids(batch.column("ids")[i].as_py(), len(keys), int(lens.sum()))]
                cell = histories(classes, lens) * CLASSES + classes
                cells += np.bincount(cell[np.repeat(train, lens)], minlength=len(cells))
        at = np.flatnonzero(cells)
        for s in range(0, len(at), 200_000):
            part = at[s : s + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(cells[part])], names=["cell", "n"])

    return run


def features(history: np.ndarray) -> np.ndarray:
    """Hashed features of each history: TEMPLATES columns."""
    c3, c2, c1 = history % CLASSES, history // CLASSES % CLASSES, history // CLASSES**2
    none = np.full(len(history), CLASSES)
    seen = [(none, none, none), (c1, none, none), (none, c2, none), (none, none, c3), (c1, c2, none), (c1, none, c3), (none, c2, c3), (c1, c2, c3)]
    out = np.empty((len(history), TEMPLATES), np.int64)
    for t, (a, b, c) in enumerate(seen):
        x = (((a * 64 + b) * 64 + c) * 8 + t).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out[:, t] = (x >> np.uint64(64 - 14)).astype(np.int64)
    return out


def log_softmax(weights: np.ndarray, feats: np.ndarray) -> np.ndarray:
    logits = np.zeros((len(feats), CLASSES))
    for t in range(TEMPLATES):
        logits += weights[feats[:, t]]
    logits[:, START_CLASS] = -1e9  # never predicted
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def _gradient(shared):
    """Observed and expected counts of each feature and class, and the log-likelihood, of a task's part."""

    def run(batches):
        parts = [(b.column("cell").to_numpy(), b.column("n").to_numpy()) for b in batches]  # CLASSES**4 cells in all
        if not parts:
            return
        cell, n = (np.concatenate(x) for x in zip(*parts))
        history, owner = np.unique(cell // CLASSES, return_inverse=True)
        counts = np.bincount(owner * CLASSES + cell % CLASSES, n, len(history) * CLASSES).reshape(-1, CLASSES)
        feats = features(history)
        logp = log_softmax(shared.value, feats)
        model = np.exp(logp) * counts.sum(1, keepdims=True)
        seen, expected = np.zeros(BUCKETS * CLASSES), np.zeros(BUCKETS * CLASSES)
        for t in range(TEMPLATES):
            at = (feats[:, t, None] * CLASSES + np.arange(CLASSES)).ravel()
            seen += np.bincount(at, counts.ravel(), len(seen))
            expected += np.bincount(at, model.ravel(), len(seen))
        total = float((counts * logp)[:, :START_CLASS].sum())
        yield pa.RecordBatch.from_pydict({"seen": pa.array([seen.astype(np.float32).tobytes()], pa.binary()), "expected": pa.array([expected.astype(np.float32).tobytes()], pa.binary()), "loglik": pa.array([total])})

    return run


def train_classes(cells: DataFrame, updates: int = 14, rate: float = 1.6, prior: float = 50.0) -> np.ndarray:
    """Weights after ``updates`` distributed gradient steps over all counted histories."""
    context = cells.sparkSession.sparkContext
    weights = np.zeros((BUCKETS, CLASSES), np.float32)
    for _ in range(updates):
        shared = context.broadcast(weights)
        seen, expected = np.zeros((BUCKETS, CLASSES)), np.zeros((BUCKETS, CLASSES))
        for row in cells.mapInArrow(_gradient(shared), "seen binary, expected binary, loglik double").toLocalIterator():
            seen += np.frombuffer(bytes(row["seen"]), np.float32).reshape(BUCKETS, CLASSES)
            expected += np.frombuffer(bytes(row["expected"]), np.float32).reshape(BUCKETS, CLASSES)
        # The gradient over its expected curvature; TEMPLATES features move together.
        step = (seen - expected - 0.02 * weights) / (expected + prior)
        weights = (weights + rate * np.clip(step, -2, 2) / TEMPLATES).astype(np.float32)
        shared.unpersist()
    return weights


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hash(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit number from several, element by element."""
    x = np.uint64(0x51)
    for part in parts:
        x = (x ^ part.astype(np.int64).view(np.uint64)) * _A
        x = (x ^ (x >> np.uint64(29))) * _B
        x = x ^ (x >> np.uint64(32))
    return x.view(np.int64)


def contexts(keys: np.ndarray, lens: np.ndarray, kind: int) -> np.ndarray:
    """Hashed context of each token: two words before, the word before, or the word before that."""
    starts = np.cumsum(lens) - lens
    offset = np.arange(len(keys)) - np.repeat(starts, lens)
    one, two = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    one[1:], two[2:] = keys[:-1], keys[:-2]
    one[offset < 1], two[offset < 2] = 1, 2  # before the text
    return _hash(np.full(1, kind, np.int64), *((one, two), (one,), (two,))[kind])


class Keys:
    """Distinct hashes, sorted, with the place of the first of each stretch of hashes: a look-up reads
    that place and some neighbours, where a binary search would jump twenty times."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes.view(np.uint64))
        self.shift = np.uint64(64 - max(8, len(self.sorted).bit_length() + 1))
        stretches = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.start = np.searchsorted(self.sorted, stretches).astype(np.int32)

    def __len__(self) -> int:
        return len(self.sorted)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 where they aren't."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self):
            return out
        wanted, last = hashes.view(np.uint64), len(self) - 1
        at, left = self.start[wanted >> self.shift].astype(np.int64), np.arange(len(hashes))
        while len(left):
            there = self.sorted[np.minimum(at, last)]
            same = (there == wanted) & (at <= last)
            out[left[same]] = at[same]
            on = (there < wanted) & (at < last)
            left, at, wanted = left[on], at[on] + 1, wanted[on]
        return out


def varied(classes: np.ndarray) -> np.ndarray:
    """Tokens of classes of several words; others have probability 1 within theirs."""
    return (classes >= TOP) & (classes < END_CLASS)


def starts(parts: int) -> np.ndarray:
    """The first context of each part."""
    return np.array([(p << 64) // parts for p in range(parts)], np.uint64)


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second: zeros of small numbers compress away."""
    raw, planes = x.view(np.uint8).reshape(len(x), x.itemsize), np.empty((x.itemsize, len(x)), np.uint8)
    for i in range(x.itemsize):  # some times as fast as a copy of the transpose
        planes[i] = raw[:, i]
    return planes.tobytes()


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    out = np.empty(planes.shape[::-1], np.uint8)
    for i, plane in enumerate(planes):
        out[:, i] = plane
    return out.view(kind).ravel()


def stable_order(hashes: np.ndarray) -> np.ndarray:
    """What a stable argsort gives. First bits and places are sorted as one number, which is several times
    as fast; where different hashes with the same first bits come out of order, all bits are sorted."""
    hashes, places = hashes.view(np.uint64), np.uint64((1 << len(hashes).bit_length()) - 1)
    order = (np.sort(hashes & ~places | np.arange(len(hashes), dtype=np.uint64)) & places).view(np.int64)
    got = hashes[order]
    return order if (got[1:] >= got[:-1]).all() else np.argsort(hashes, kind="stable")


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each different hash, in their order, and the number of each hash in this order."""
    by = stable_order(hashes)
    got, new, number = hashes[by], np.ones(len(by), bool), np.empty(len(by), np.int64)
    new[1:] = got[1:] != got[:-1]
    number[by] = np.cumsum(new) - 1
    return by[new], number


def asked(context: np.ndarray, keys: np.ndarray, left: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of context and word among the tokens left, sorted by context: a token of each pair,
    the pair's place for each token left, and where each part's pairs begin and end."""
    first, number = numbered(_hash(context[left], keys[left]))
    token = left[first]
    order = stable_order(context[token])
    place = np.empty(len(token), np.int64)
    place[order] = np.arange(len(token))
    token = token[order]
    return token, place[number], np.append(np.searchsorted(context[token].view(np.uint64), starts(parts)), len(token))


_STATE = "block long, docs array<bigint>, lens array<int>, train array<boolean>, words array<bigint>, endings array<tinyint>, ids binary, known binary, left binary, gains binary"


def _store(shared):
    """A block with its words' training counts, all tokens of classes of several words left, and no gains."""

    def run(block, counts):
        row = block.combine_chunks().to_batches()[0]
        words, known = _list(row, "words", 0), np.zeros(len(row.column("words")[0]), np.int64)
        for data in counts.column("data").to_pylist():
            found = np.frombuffer(data, np.int64)
            known[: len(found)] = found
        left = varied(classes_of(words, _list(row, "endings", 0), shared.value))[_ids(row.column("ids")[0].as_py(), len(words), int(_list(row, "lens", 0).sum()))]
        more = _planes(known), np.packbits(left).tobytes(), bytes(8 * len(row.column("lens")[0]))
        return pa.table([*(row.column(c) for c in _STATIC), *(pa.array([x], pa.binary()) for x in more)], names=[*_STATIC, "known", "left", "gains"])

    return run


_STATIC = ["block", "docs", "lens", "train", "words", "endings", "ids"]


class Block:
    """A stored block: its words' training counts and classes, its tokens' words, lengths and training
    marks, the tokens left and the gains of its documents."""

    def __init__(self, batch: pa.RecordBatch, i: int, top: dict[int, int]):
        self.number = batch.column("block")[i].as_py()
        words, self.lens, train = (_list(batch, c, i) for c in ("words", "lens", "train"))
        raw, known, left, gains = (batch.column(c)[i].as_py() for c in ("ids", "known", "left", "gains"))
        self.of_word, self.ids, self.known = classes_of(words, _list(batch, "endings", i), top), _ids(raw, len(words), int(self.lens.sum())), _from_planes(known, np.int64)
        self.keys, self.train = words[self.ids], np.repeat(train, self.lens)
        self.left = np.flatnonzero(np.unpackbits(np.frombuffer(left, np.uint8), count=len(self.ids)))
        self.gains = np.frombuffer(gains, np.float64)

    def add(self, answers: pa.Table, kinds, parts: int) -> Block:
        """Add the gains that these kinds of context give, in their order, and take their tokens out."""
        given: dict[int, dict] = {kind: {} for kind in kinds}
        for kind, part, data in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "data"))):
            given[kind][part] = np.frombuffer(data, np.float32)
        gain = np.zeros(len(self.ids))
        for kind in kinds:
            if len(self.left):
                got = np.concatenate([given[kind][p] for p in sorted(given[kind])])[asked(contexts(self.keys, self.lens, kind), self.keys, self.left, parts)[1]]
                hit = ~np.isnan(got)
                gain[self.left[hit]] = got[hit]
                self.left = self.left[~hit]
        self.gains = self.gains + np.add.reduceat(gain, np.cumsum(self.lens) - self.lens)
        return self

    def ask(self, parts: int, kind: int, low: int, high: int) -> pa.RecordBatch:
        """The distinct pairs of one kind of context and word, for parts from low to before high: the
        contexts' differences and numbers of pairs, the features, training tokens, words' counts and classes."""
        near, first, left = contexts(self.keys, self.lens, kind), starts(parts), self.left
        if high - low < parts:
            context = near[left].view(np.uint64)
            left = left[(context >= first[low]) & (context < first[high] if high < parts else True)]
        token, place, bounds = asked(near, self.keys, left, parts)
        times = np.bincount(place[self.train[left]], minlength=len(token)).astype(np.uint32)
        context, word = near[token], self.ids[token]
        feature, known, of_word = _hash(context, self.keys[token]), self.known[word].view(np.uint64), self.of_word[word].astype(np.uint8)
        rows = []
        for part in range(low, high):
            at = slice(bounds[part], bounds[part + 1])
            if at.start < at.stop:
                heads = np.flatnonzero(np.append(True, context[at][1:] != context[at][:-1]))
                columns = np.diff(context[at][heads], prepend=0), np.diff(heads, append=at.stop - at.start).astype(np.uint32), feature[at], times[at], known[at], of_word[at]
                rows.append((part, *map(_planes, columns)))
        part, *blobs = zip(*rows) if rows else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([self.number] * len(part), pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], names=["part", "block", "contexts", "pairs", "features", "times", "known", "classes"])


def _told(shared, parts: int, kinds):
    """The block of a group, with the answers of some kinds added."""

    def run(block: pa.Table, answers: pa.Table) -> tuple[pa.RecordBatch, Block]:
        row = block.combine_chunks().to_batches()[0]
        return row, Block(row, 0, shared.value).add(answers, kinds, parts)

    return run


def _update(shared, parts: int, kind: int):
    """Stored blocks with the answers of one more kind added."""
    told = _told(shared, parts, (kind,))

    def run(block, answers):
        row, got = told(block, answers)
        left = np.zeros(len(got.ids), bool)
        left[got.left] = True
        more = np.packbits(left).tobytes(), got.gains.tobytes()
        return pa.table([*(row.column(c) for c in (*_STATIC, "known")), *(pa.array([x], pa.binary()) for x in more)], names=[*_STATIC, "known", "left", "gains"])

    return run


_REQUEST = "part int, block long, contexts binary, pairs binary, features binary, times binary, known binary, classes binary"
_ANSWER = "block long, kind int, part int, data binary"


def _ask(shared, parts: int, kind: int, low: int, high: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield Block(batch, i, shared.value).ask(parts, kind, low, high)

    return run


def _ask_on(shared, parts: int, kind: int, low: int, high: int):
    """As _ask, with the answers since the stored kinds."""
    told = _told(shared, parts, range(STORED, kind))

    def run(block, answers):
        return pa.Table.from_batches([told(block, answers)[1].ask(parts, kind, low, high)])

    return run


def word_weights(cell: np.ndarray, p: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features, and log of the sum over its class for each, by gradient updates. cell:
    number of the feature's softmax; p: the word's bias as a probability; n: times of the feature;
    total: tokens of its softmax."""
    weight, cells = np.zeros(len(p)), int(cell.max()) + 1 if len(cell) else 0

    def sums(weight):
        return (1 + np.bincount(cell, p * np.expm1(weight), cells))[cell]

    for _ in range(WORD_UPDATES):
        q = p * np.exp(weight) / sums(weight)
        step = (n - total * q - weight / SPREAD) / (total * q * (1 - q) + 1 / SPREAD)
        weight = np.clip(weight + np.clip(step, -1, 1), -12, 16)
    return weight, np.log(sums(weight))


class Part:
    """All pairs of a part's contexts, their softmaxes trained. ends: where each request's pairs end."""

    def __init__(self, requests: pa.Table, class_sizes: np.ndarray):
        pairs = [[], [], [], [], []]
        for i in range(requests.num_rows):
            heads, fans, *rest = (_from_planes(requests.column(c)[i].as_py(), t) for c, t in (("contexts", np.int64), ("pairs", np.uint32), ("features", np.int64), ("times", np.uint32), ("known", np.int64), ("classes", np.uint8)))
            for column, x in zip(pairs, (np.repeat(np.cumsum(heads), fans), *rest)):
                column.append(x)
        self.ends = np.cumsum([len(x) for x in pairs[1]])
        context, feature, times, known, classes = (np.concatenate(x) for x in pairs)
        at, self.owner = numbered(feature)
        self.feature, self.context, of_class = feature[at], context[at], classes[at].astype(np.int64)
        self.n = np.bincount(self.owner, times, len(at))
        first, of_context = numbered(self.context)
        most = np.zeros(len(first))
        np.maximum.at(most, of_context, self.n)
        self.kept = (most >= REPEATS)[of_context]
        self.learnt = self.kept & (self.n > 0)
        self.cell = _hash(self.context, of_class)
        first, cell = numbered(self.cell)
        total, log_sums = np.bincount(cell, self.n, len(first)), np.zeros(len(first))
        self.weight, on = np.zeros(len(at)), cell[self.learnt]
        among = np.cumsum(np.bincount(on, minlength=len(first)) > 0) - 1
        p = (known[at] + 0.5) / class_sizes[of_class]
        self.weight[self.learnt], log_sums[on] = word_weights(among[on], p[self.learnt], self.n[self.learnt], total[on])
        self.log_sum = log_sums[cell]

    def gains(self) -> list[np.ndarray]:
        """Each request's gains; no number where the context is not kept."""
        gain = np.where(self.kept, self.weight - self.log_sum, np.nan).astype(np.float32)
        return np.split(gain[self.owner], self.ends[:-1])

    def features(self) -> pa.Table:
        got = {"feature": self.feature, "context": self.context, "cell": self.cell, "weight": self.weight.astype(np.float32), "log_sum": self.log_sum.astype(np.float32), "n": self.n.astype(np.int64)}
        return pa.table({k: x[self.learnt] for k, x in got.items()})


def _answer(class_sizes: np.ndarray, kind: int):
    def run(requests):
        gains = [x.tobytes() for x in Part(requests, class_sizes).gains()]
        return pa.table([requests.column("block"), pa.array([kind] * len(gains), pa.int32()), requests.column("part"), pa.array(gains, pa.binary())], names=["block", "kind", "part", "data"])

    return run


class WordModel:
    """Softmaxes within classes, to look at: contexts, features with weights, cells with their sums."""

    def __init__(self, rows: pa.Table):
        self.contexts = Keys(rows.column("context").to_numpy())
        self.features, self.weights = self._table(rows, "feature", "weight")
        self.cells, self.log_sums = self._table(rows, "cell", "log_sum")

    @staticmethod
    def _table(rows: pa.Table, key: str, value: str) -> tuple[Keys, np.ndarray]:
        hashes = rows.column(key).to_numpy()
        keys, values = Keys(hashes), np.zeros(len(hashes), np.float32)
        values[keys.find(hashes)] = rows.column(value).to_numpy()
        return keys, values[: len(keys)]


def most_frequent(found: DataFrame, most: int) -> DataFrame:
    """Some ``most`` rows of the greatest n; of the least n that still fits, those that a hash picks. No
    task sorts or holds them all."""
    level = F.least("n", F.lit(100_000))
    room, least, share = most, 0, 1.0
    for r in found.groupBy(level.alias("level")).count().orderBy(F.desc("level")).toLocalIterator():  # at most 100,000 rows
        least, share = r["level"], min(1.0, room / r["count"])
        room -= r["count"]
        if room <= 0:
            break
    picked = F.pmod(F.xxhash64("context", "word"), F.lit(1_000_000)) < int(share * 1_000_000)
    return found.where((level > least) | (level == least) & picked)


def _pack_known(batches):
    """Blocks' training counts by place in the dictionary."""
    for batch in batches:
        rows = []
        for found in batch.column("known"):
            pos, count = (found.values.field(c).to_numpy() for c in ("pos", "c"))
            counts = np.zeros(int(pos.max()) + 1, np.int64)
            counts[pos] = count
            rows.append(counts.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(rows, pa.binary())], names=["block", "data"])


def known_words(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """The training counts of the words of each block."""
    words = blocks.select("block", F.posexplode("words").alias("pos", "words")).join(counts.select("words", "c"), "words")
    return materialise(words.groupBy("block").agg(F.collect_list(F.struct("pos", "c")).alias("known")).mapInArrow(_pack_known, "block long, data binary"))


def _free_shuffles(spark) -> None:
    """Let go of the files of shuffles that no plan needs any more; else the next come on top of them.
    Spark's cleaner works on its own after a collection, and the last plan is let go a little later."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _discard(stored: DataFrame) -> None:
    """Delete the files of a table that was materialised here and that nothing reads any more."""
    jvm, conf = stored.sparkSession.sparkContext._jvm, stored.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in stored.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)


def _by_block(blocks: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def _share(rows: DataFrame, share: int) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64("block"), F.lit(SHARES)) == share)


def _union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def store_blocks(blocks: DataFrame, known: DataFrame, shared_top) -> list[DataFrame]:
    """The blocks with what is known of their words, by share."""
    out = []
    for share in range(SHARES):
        _free_shuffles(blocks.sparkSession)
        out.append(materialise(_by_block(_share(blocks.select(*_STATIC), share), _share(known, share), _store(shared_top), _STATE)))
    return out


def train_words(stored: list[DataFrame], shared_top, class_sizes: np.ndarray, parts: int, features: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The blocks with the gains of the first STORED kinds of context, and the answers of the other kinds,
    by part. The features themselves are put into the list, if there is one."""
    spark = stored[0].sparkSession
    told: list[DataFrame] = []
    for kind, rounds in enumerate(ROUNDS):
        answers = []
        for low, high in sorted({(r * parts // rounds, (r + 1) * parts // rounds) for r in range(rounds)}):
            if low < high:
                _free_shuffles(spark)
                if told:
                    requests = _by_block(_union(stored), _union(told), _ask_on(shared_top, parts, kind, low, high), _REQUEST)
                else:
                    requests = _union(stored).mapInArrow(_ask(shared_top, parts, kind, low, high), _REQUEST)
                if features is not None:
                    requests = materialise(requests)
                    features.append(requests.groupBy("part").applyInArrow(lambda table: Part(table, class_sizes).features(), "feature long, context long, cell long, weight float, log_sum float, n long"))
                answers.append(materialise(requests.groupBy("part").applyInArrow(_answer(class_sizes, kind), _ANSWER)))
                del requests
        if kind >= STORED:
            told += answers
            continue
        for share, before in enumerate(stored):
            _free_shuffles(spark)
            stored[share] = materialise(_by_block(before, _share(_union(answers), share), _update(shared_top, parts, kind), _STATE))
            _discard(before)
        for frame in answers:
            _discard(frame)
    _free_shuffles(spark)
    return _union(stored), _union(told)


def _score(shared, parts: int):
    def run(block, answers):
        top, table, log_class_size, base_total = shared.value
        row = block.combine_chunks().to_batches()[0]
        got = Block(row, 0, top).add(answers, range(STORED, len(ROUNDS)), parts)
        known, of_word, ids, lens = got.known, got.of_word, got.ids, got.lens
        classes = of_word[ids]
        base_word = np.log10(known + 0.5) - base_total
        # Words that are classes have probability 1 within them.
        in_class = np.where(varied(of_word), np.log10(known + 0.5) - log_class_size[of_word], 0.0)
        token = table[histories(classes, lens) * CLASSES + classes].astype(np.float64) + in_class[ids]
        starts = np.cumsum(lens) - lens
        return pa.table({
            "_ls_doc": row.column("docs")[0].values,
            "train": row.column("train")[0].values,
            "n_tokens": pa.array(lens.astype(np.int64)),
            "n_known": pa.array(np.add.reduceat((known > 0)[ids].astype(np.int64), starts), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base_word[ids], starts)),
            "score": pa.array(np.add.reduceat(token, starts) + got.gains / np.log(10)),
        })

    return run


@dataclass
class Model:
    """top: classes of the frequent words; table: log10 P(class | class history), flat; log_sizes: log10
    of the smoothed tokens of each class; words: of the softmaxes within classes, the MAX_FEATURES most
    frequent features (scores take all)."""

    top: dict[int, int]
    table: np.ndarray
    log_sizes: np.ndarray
    n_train: int
    n_types: int
    words: WordModel | None = None


def fit_classes(docs: DataFrame, id_col: str, text_col: str, folds: int, held_out: int) -> tuple[DataFrame, DataFrame, Model]:
    """Blocks, counts of training words, and the model of the training rows but for its features of words."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("_ls_doc"), (crc_mod(F.col(id_col), folds) != held_out).alias("_ls_train"), F.col(text_col).cast("binary").alias("_ls_text"))
    blocks = materialise(rows.mapInArrow(_encode, _BLOCK))
    entries = blocks.select(F.inline(F.arrays_zip("words", "counts", "endings"))).where("counts > 0")
    counts = materialise(entries.groupBy("words").agg(F.sum("counts").alias("c"), F.max("endings").alias("ending")))
    n_train, n_types = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    end_key = word_key(END)
    leaders = counts.where(F.col("words") != end_key).orderBy(F.desc("c"), "words").limit(TOP).collect()
    top = {r["words"]: i for i, r in enumerate(leaders)}
    sizes, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # ENDINGS + 1 rows
        sizes[TOP + r["ending"]], types[TOP + r["ending"]] = r["c"], r["v"]
    for r in leaders:
        sizes[TOP + r["ending"]] -= r["c"]
        types[TOP + r["ending"]] -= 1
    shared_top = spark.sparkContext.broadcast(top)
    cells = blocks.mapInArrow(_count_histories(shared_top), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    # At most CLASSES**4 rows, however large the corpus: few tasks add up each gradient.
    weights = train_classes(materialise(cells.repartition(6, F.expr(f"cell div {CLASSES}"))))
    table = np.concatenate([log_softmax(weights, features(np.arange(s, s + CLASSES**2)))for s in range(0, CLASSES**3, CLASSES**2)])
    table = (table / np.log(10)).astype(np.float32).ravel()
    return blocks, counts, Model(top, table, np.log10(sizes + 0.5 * (types + 1)), n_train, n_types)


def _words_of(blocks: DataFrame, counts: DataFrame, model: Model, features: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """What train_words returns, and the number of parts. Without a list of features the files of blocks
    go as soon as the blocks are stored with more."""
    tokens = blocks.agg(F.sum(F.expr("aggregate(lens, 0L, (a, x) -> a + x)"))).first()[0] or 0
    parts = tokens // PART_TOKENS + 1
    shared_top = blocks.sparkSession.sparkContext.broadcast(model.top)
    _free_shuffles(blocks.sparkSession)
    known = known_words(blocks, counts)
    stored = store_blocks(blocks, known, shared_top)
    _discard(known)
    if features is None:
        _discard(blocks)
    return *train_words(stored, shared_top, 10**model.log_sizes, parts, features), parts


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1) -> tuple[DataFrame, DataFrame, Model]:
    """Blocks, counts of training words, and the model of the training rows."""
    blocks, counts, model = fit_classes(docs, id_col, text_col, folds, held_out)
    features: list[DataFrame] = []
    _words_of(blocks, counts, model, features)
    every = materialise(_union(features).withColumn("word", F.col("feature")))
    model.words = WordModel(most_frequent(every, MAX_FEATURES).toArrow())
    return blocks, counts, model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1) -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    blocks, counts, model = fit_classes(docs, id_col, text_col, folds, held_out)
    stored, answers, parts = _words_of(blocks, counts, model)
    shared = docs.sparkSession.sparkContext.broadcast((model.top, model.table, model.log_sizes, float(np.log10(model.n_train + 0.5 * (model.n_types + 1)))))
    scored = _by_block(stored, answers, _score(shared, parts), "_ls_doc long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("_ls_doc").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_train).cast("long").alias("train_tokens"), "base_score", "score")
