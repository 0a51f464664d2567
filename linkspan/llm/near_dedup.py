"""Near-duplicate classes by Order MinHash with banded alignment.

Shingles are five lower-cased words (runs outside [\\x20\\x09-\\x0D]), labelled with their occurrence in
the text, so each labelled shingle is unique in it. A sketch takes the ``ELL`` shingles that are
least under one hash function and keeps their order in the text; its value is the hash of that
sequence. Two texts agree in a sketch if they share these shingles in the same order, which follows
edit similarity; ``SKETCHES`` of them are taken.

1. One pass over the texts gives digests and sketches. Exact copies fold into one node each (the
   least id), so copies never meet as pairs.
2. Texts that share a sketch are candidates. A bucket doesn't emit its pairs: in a round, each of its
   members is paired with the bucket's centre if that is of another class. Labels of classes come to
   the nodes, one row each, before the buckets are formed; the aggregate of a bucket returns its
   centre with the centre's label and whether it still holds several classes, and only buckets that
   do are joined back. So the pairs are at most linear in the members, those of members that a round
   has joined are never made, and a bucket of a third of the corpus is no single task. The rounds
   take the least and the greatest node and one picked by hash, which tests all pairs of up to four
   members. The texts of larger buckets that hold several classes even then are joined without a
   bucket (see ``_exact``), which finds all that is left between them.
3. Candidates are verified on whole texts by an alignment of their shingle sequences within a band
   around the diagonal (the band is as wide as a similarity of ``similarity`` allows). With m aligned
   shingles of a and b, similarity is m / (a + b - m), the Jaccard similarity for kept order.
4. Verified links are joined to classes by label propagation with written tables in between; nothing
   is collected.

Defined cases: texts of fewer than five words are one shingle of all their words; texts without
words are copies of others without words only if equal; a null text is an empty one; null ids are one
document, whose class has the null id; rows that share an id are one document, whose links are those of all
its texts; repeated rows are one node; very long texts are sketched piece by piece; an empty table
gives no rows. Other columns take no part.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, id_or_null_stand_in, materialise, small_batches

WORDS, ELL, SKETCHES = 5, 3, 18
#: Ids (8 bytes each) of candidates that may be broadcast to the scan of the texts.
BROADCAST_IDS = 2_000_000
#: Rounds of centres; after each, a bucket of up to one member more than rounds has no untested pair.
ROUNDS = 3
#: Shingles hashed at once: bounds the memory of a very long text.
PIECE = 1 << 16
#: A shingle of more texts of the mixed buckets is common.
COMMON = 16
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (a fixed public finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_FACTORS = _mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_MULTIPLIERS = (_mix(np.arange(101, 101 + SKETCHES, dtype=np.uint64)) | np.uint64(1))[:, None]


def word_hashes(text: bytes | None) -> np.ndarray:
    words = text.lower().split() if text else []
    return np.fromiter(map(crc32, words), np.uint32, len(words))


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """Hash of each shingle with its occurrence label, in text order."""
    if not len(words):
        return np.zeros(0, np.uint64)
    wide = words.astype(np.uint64)
    if len(wide) < WORDS:
        wide = np.concatenate([wide, np.full(WORDS - len(wide), np.uint64(len(words)))])
    n = len(wide) - WORDS + 1
    x = np.zeros(n, np.uint64)
    for i in range(WORDS):
        x += wide[i : i + n] * _FACTORS[i]
    x = _mix(x)
    order = np.argsort(x, kind="stable")
    same = np.concatenate([[False], x[order][1:] == x[order][:-1]])
    if same.any():
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(same, 0, at))
        label = np.empty(n, np.uint64)
        label[order] = (at - first).astype(np.uint64)
        x = _mix(x + label * _FACTORS[0])
    return x


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCHES signed 64-bit values: order-keeping minima."""
    least = np.zeros((SKETCHES, 0), np.int64)  # places, the minima of all pieces so far
    for start in range(0, len(shingles), PIECE):
        piece = np.broadcast_to(np.arange(start, min(start + PIECE, len(shingles))), (SKETCHES, min(PIECE, len(shingles) - start)))
        least = np.concatenate([least, piece], axis=1) if start else piece
        if least.shape[1] > ELL:
            hashed = _mix(shingles[least] * _MULTIPLIERS)
            least = np.take_along_axis(least, np.argpartition(hashed, ELL - 1, axis=1)[:, :ELL], axis=1)
    least = np.sort(least, axis=1)  # text order
    value = np.arange(SKETCHES, dtype=np.uint64)
    for i in range(least.shape[1]):
        value = _mix(value * _MIX[0] + shingles[least[:, i]])
    return value.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Most labelled shingles that can be aligned in order with |i - j| <= band."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        at = bisect_left(tails, x)
        if at == len(tails):
            tails.append(x)
        else:
            tails[at] = x
    return len(tails)


def similarity_of(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """m / (a + b - m) of the banded alignment; 0 where lengths alone rule ``least`` out."""
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    m = aligned(a, b, band=1 + int((1 - least) * max(len(a), len(b))))
    return m / (len(a) + len(b) - m)


def _sketches(batches):
    for batch in batches:
        docs, keys, values, n = [], [], [], []
        for doc, text in zip(batch.column("_ls_doc").to_pylist(), batch.column("_ls_text").to_pylist()):
            shingles = labelled_shingles(word_hashes(text))
            docs.append(doc)
            keys.append(hashlib.blake2b(text or b"", digest_size=16).digest())
            n.append(len(shingles))
            values.append(sketch(shingles).tolist() if len(shingles) else [])
        yield pa.RecordBatch.from_pydict({"_ls_doc": pa.array(docs, pa.int64()), "key": pa.array(keys, pa.binary()), "n": pa.array(n, pa.int32()), "values": pa.array(values, pa.list_(pa.int64()))})


def _hashed_words(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("_ls_doc"), pa.array([word_hashes(t).tobytes() for t in batch.column("_ls_text").to_pylist()], pa.binary())], names=["node", "words"])


def _verify(similarity: float):
    def run(batches):
        held, shingles = None, None
        for batch in batches:
            links = []
            for a, b, wa, wb in zip(*(batch.column(c).to_pylist() for c in ("centre", "member", "wa", "wb"))):
                if b != held:  # pairs of one member come together
                    held, shingles = b, labelled_shingles(np.frombuffer(wb, np.uint32))
                if similarity_of(labelled_shingles(np.frombuffer(wa, np.uint32)), shingles, similarity) >= similarity:
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    return run


def _placed_shingles(batches):
    for batch in batches:
        nodes, marks, sizes, found = [], [], [], []
        for node, words in zip(batch.column("node").to_pylist(), batch.column("words").to_pylist()):
            found.append(labelled_shingles(np.frombuffer(words, np.uint32)).view(np.int64))
            nodes.append(node)
            marks.append(int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True))
            sizes.append(len(found[-1]))
        at = [np.arange(n, dtype=np.int32) for n in sizes]
        owner = [np.repeat(np.array(x, t), sizes) for x, t in ((nodes, np.int64), (marks, np.int64), (sizes, np.int32))]
        columns = [*owner[:2], np.concatenate(at) if at else [], owner[2], np.concatenate(found) if found else []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["node", "mark", "at", "n", "shingle"])


def _parts(similarity: float):
    """For each node: the rare shingles of its prefix, and the size, key and prefix of its common part."""

    def run(batches):
        for batch in batches:
            out = {"node": batch.column("node").to_pylist(), "n": batch.column("n").to_pylist(), "n_shared": [], "rare": [], "n_common": [], "key": [], "common": []}
            for n, shared in zip(out["n"], batch.column("shared")):
                shared = shared.values
                size, shingle, at = (shared.field(c).to_numpy() for c in ("size", "shingle", "at"))
                least = math.ceil(similarity * n - 1e-9)  # shingles shared with any text that is alike
                order = np.lexsort((shingle, size))
                rare, common = order[size[order] <= COMMON], order[size[order] > COMMON]
                out["n_shared"].append(len(size))
                out["rare"].append(shingle[rare[: max(0, n - least + 1 - (n - len(size)))]].tolist())
                out["n_common"].append(len(common))
                enough = len(common) >= least
                out["key"].append(hashlib.blake2b(shingle[common[np.argsort(at[common])]].tobytes(), digest_size=16).digest() if enough else None)
                out["common"].append(shingle[common[: len(common) - least + 1]].tolist() if enough else [])
            yield pa.RecordBatch.from_pydict(
                {k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.list_(pa.int64())))}
            )

    return run


def connected(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, for nodes that have a link."""
    both = materialise(links.union(links.select("b", "a")).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("best"))
        step = labels.join(heard, labels["node"] == heard["a"]).select("node", "label", F.least("label", "best").alias("low"))
        # Pointer jumping: go on to the label of the label (a label is a node of its component).
        far = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        step = materialise(step.join(far, "low").select("node", F.least("low", "next").alias("new"), (F.least("low", "next") < F.col("label")).alias("moved")))
        labels = step.select("node", F.col("new").alias("label"))
        if step.where("moved").isEmpty():
            return labels


def _centre(turn: int) -> Column:
    """The centre of a bucket in a round, with its label: the least node, the greatest, one by hash."""
    own = F.struct("node", "label")
    if turn < 2:
        return (F.min, F.max)[turn](own)
    picked = [F.min_by(own, F.xxhash64("node", "band", "value", F.lit(i))) for i in range(2)]
    return F.when(~picked[0]["node"].isin(F.min("node"), F.max("node")), picked[0]).otherwise(picked[1])


def _round(open_nodes: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """open_nodes: (node, label, es), es the (band, value) of buckets that may hold several classes.
    Pairs (centre, member) of different classes, and (node, band, value, size) of the buckets that do."""
    members = open_nodes.select("node", "label", F.inline("es"))
    mixed = members.groupBy("band", "value").agg(F.count("*").alias("size"), F.min("label").alias("least"), F.max("label").alias("most"), _centre(turn).alias("centre")).where("least < most")
    # Written, so that the join starts from plain exchanges, whose hot partitions can be split.
    met = materialise(members.join(materialise(mixed.select("band", "value", "size", "centre")), ["band", "value"]))
    pairs = met.where("centre.label <> label").select(F.col("centre.node").alias("centre"), F.col("node").alias("member")).distinct()
    return pairs, met.select("node", "band", "value", "size")


class _Links:
    """Verified links so far and the classes (node, label) they make; no pair is verified twice."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, similarity: float):
        self.texts, self.nodes, self.similarity = texts, nodes, similarity
        self.done = self.links = self.labels = None

    def add(self, pairs: DataFrame) -> None:
        pairs = pairs.groupBy(F.least("centre", "member").alias("a"), F.greatest("centre", "member").alias("b")).agg(F.min("centre").alias("centre"))
        if self.done is not None:
            pairs = pairs.join(self.done, ["a", "b"], "left_anti")
        pairs = materialise(pairs)
        self.done = pairs if self.done is None else self.done.union(pairs)
        new = materialise(_verified(pairs, self.texts, self.nodes, self.similarity))
        if self.labels is not None and new.isEmpty():
            return
        self.links = new if self.links is None else self.links.union(new)
        self.labels = connected(self.links)

    def tag(self, nodes: DataFrame) -> DataFrame:
        """nodes (a row each) with the label of their class."""
        own = nodes if self.labels is None else nodes.join(self.labels, "node", "left")
        return own.withColumn("label", F.coalesce("label", "node") if self.labels is not None else F.col("node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """(id, class_id) for each row of docs: class_id is the least id of its near-duplicate class."""
    small_batches(docs.sparkSession)
    texts = docs.select(id_or_null_stand_in(F.col(id_col)).alias("_ls_doc"), F.col(text_col).cast("binary").alias("_ls_text"))
    sketched = materialise(texts.mapInArrow(_sketches, "_ls_doc long, key binary, n int, values array<bigint>"))
    nodes = sketched.groupBy("key").agg(F.min_by(F.struct("_ls_doc", "n", "values"), "_ls_doc").alias("s")).select("key", F.col("s._ls_doc").alias("node"), F.col("s.n").alias("n"), F.col("s.values").alias("values"))
    nodes = materialise(nodes)
    found = _Links(texts, nodes, similarity)
    entries = nodes.where("n > 0").select("node", F.transform("values", lambda v, i: F.struct(i.alias("band"), v.alias("value"))).alias("es"))
    for turn in range(ROUNDS):
        pairs, met = _round(found.tag(entries), turn)
        found.add(pairs)
        entries = materialise(met.where(F.col("size") > turn + 2).groupBy("node").agg(F.collect_list(F.struct("band", "value")).alias("es")))  # at most SKETCHES a node
    left = materialise(found.tag(_mixed(found.tag(entries))))
    if not left.isEmpty():
        found.add(_exact(texts, left, similarity))
    labels = found.labels
    classes = nodes.join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("class"))
    out = sketched.select("_ls_doc", "key").join(classes, "key")
    blank = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(blank("_ls_doc").alias(id_col), blank("class").alias("class_id"))


def _mixed(open_nodes: DataFrame) -> DataFrame:
    """(node) of buckets that hold several classes."""
    members = open_nodes.select("node", "label", F.inline("es"))
    mixed = members.groupBy("band", "value").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("band", "value")
    return members.join(materialise(mixed), ["band", "value"]).select("node").distinct()


def _exact(texts: DataFrame, left: DataFrame, similarity: float) -> DataFrame:
    """Pairs (centre, member) whose links join all classes that links between nodes of ``left`` join.

    Shingles are ordered by the texts that hold them, rare ones first. The first one that two alike
    texts share lies among the first n - ceil(similarity * n) + 1 of both. If it is rare (of at most
    COMMON texts), their pair is taken from that shingle's texts, in whatever else they agree. If it
    is common, all they share is common, so the common parts alone make them alike, and a shorter text
    with the same common part (the same shingles in the same order) does in place of either: each
    text is paired with the shortest text of its own common part and of each other that it meets."""
    wanted = left.select(F.col("node").alias("_ls_doc"))
    wanted = F.broadcast(wanted) if left.count() <= BROADCAST_IDS else wanted
    words = texts.join(wanted, "_ls_doc", "left_semi").mapInArrow(_hashed_words, "node long, words binary").distinct()
    shingles = materialise(words.mapInArrow(_placed_shingles, "node long, mark long, at int, n int, shingle long"))
    sizes = materialise(shingles.groupBy("shingle").agg(F.count("*").alias("size")).where("size > 1"))
    shared = shingles.join(sizes, "shingle").groupBy("node", "mark", "n").agg(F.collect_list(F.struct("size", "shingle", "at")).alias("shared"))
    parts = shared.mapInArrow(_parts(similarity), "node long, n int, n_shared int, rare array<bigint>, n_common int, key binary, common array<bigint>")
    parts = materialise(parts.join(left.select("node", "label"), "node"))

    def other(a: str, b: str) -> Column:
        """In other classes and of lengths that may be alike."""
        na, nb = F.col(a + ".n"), F.col(b + ".n")
        return (F.col(a + ".label") != F.col(b + ".label")) & (F.least(na, nb) >= similarity * F.greatest(na, nb) - 1e-9)

    def alike(a: str, b: str, left: str = "left") -> Column:
        """What both have left, from a place on, may be enough for the similarity: no place after the
        first that they share is of use."""
        return F.least(f"{a}.{left}", f"{b}.{left}") * (1 + similarity) >= similarity * (F.col(a + ".n") + F.col(b + ".n")) - 1e-6

    rare = parts.select("node", "n", "label", "n_shared", F.posexplode("rare").alias("at", "shingle")).withColumn("left", F.col("n_shared") - F.col("at"))
    a, b = rare.alias("a"), rare.alias("b")
    pairs = a.join(b, F.col("a.shingle") == F.col("b.shingle")).where((F.col("a.node") < F.col("b.node")) & other("a", "b") & alike("a", "b"))
    pairs = pairs.select(F.col("a.node").alias("centre"), F.col("b.node").alias("member"))
    # Of texts of one class with the same common part, the shortest is alike to all that any of them is alike to.
    entry = F.struct("node", "n", "label", "n_common", "common")
    high = parts.where("key is not null").groupBy("key", "label").agg(F.min_by(entry, F.struct("n", "node")).alias("s")).select("key", "s.*")
    high = materialise(high)
    least = materialise(high.groupBy("key").agg(F.min_by(entry, F.struct("n", "node")).alias("s")).select("key", "s.*"))
    high = materialise(high.join(least.select("key", F.col("node").alias("first")), "key").withColumn("first", F.col("first") == F.col("node")))
    a, b = least.alias("a"), high.alias("b")
    own = a.join(b, F.col("a.key") == F.col("b.key")).where(other("a", "b") & alike("a", "b", "n_common"))
    a, b = (x.select("key", "node", "n", "label", "n_common", *flag, F.posexplode("common").alias("at", "shingle")).withColumn("left", F.col("n_common") - F.col("at")).alias(name) for x, name, flag in ((least, "a", []), (high, "b", ["first"])))
    cross = a.join(b, F.col("a.shingle") == F.col("b.shingle")).where(F.when(F.col("b.first"), F.col("a.key") < F.col("b.key")).otherwise(F.col("a.key") != F.col("b.key")) & other("a", "b") & alike("a", "b"))
    for found in (own, cross):
        pairs = pairs.union(found.select(F.col("a.node").alias("centre"), F.col("b.node").alias("member")))
    return pairs


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose whole texts are similar enough; pairs come with their centre."""
    lengths = nodes.select("node", "n")
    a, b = lengths.toDF("a", "na"), lengths.toDF("b", "nb")
    close = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
    close = materialise(close.select("centre", (F.col("a") + F.col("b") - F.col("centre")).alias("member")).distinct())
    wanted = materialise(close.select(F.col("centre").alias("_ls_doc")).union(close.select("member")).distinct())
    # The ids of candidates are broadcast if they are few enough; else the texts are shuffled.
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    words = texts.join(wanted, "_ls_doc", "left_semi").mapInArrow(_hashed_words, "node long, words binary")
    words = materialise(words.distinct())
    # Members last, by shuffle: a member has few pairs, so the comparisons spread over all tasks; a centre may have very many.
    both = close.join(words.toDF("centre", "wa"), "centre").join(words.toDF("member", "wb").hint("merge"), "member")
    return both.mapInArrow(_verify(similarity), "a long, b long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """docs with one document of each near-duplicate class, the one with the least id."""
    classes = near_duplicates(docs, id_col, text_col, similarity)
    gone = classes.where(~F.col(id_col).eqNullSafe(F.col("class_id"))).select(F.col(id_col).alias("_ls_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_ls_gone"], "left_anti")
