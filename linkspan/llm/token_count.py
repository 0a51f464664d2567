"""Token counts under a unigram piece model, with forward scores shared along a trie of pre-tokens.

A text's pre-tokens are its words (runs outside [\\x20\\x09-\\x0D]) with the word mark in front. A
piece's log-probability falls with its rank in the vocabulary file (Zipf's law), as the files hold
ranks and no probabilities. A pre-token's count is that of its best-scoring segmentation (ties: fewer
tokens); a character outside the vocabulary costs one byte token for each UTF-8 byte. Every
[\\x09-\\x0D] character counts as one further token; spaces are part of the marks.

Each task inserts the distinct pre-tokens it meets in a trie. A node keeps the best forward score of
the path that leads to it, computed once for all pre-tokens that share the prefix, and the count at
terminals. The trie is dropped when it holds ``max_nodes`` nodes or pre-tokens of MAX_HELD bytes; of a
pre-token, only the first MAX_DEPTH characters enter it, and the scores of the rest are carried on with
as many scores as the longest piece needs. That bounds memory, whatever a text holds, and changes no
result. There is no shuffle.

Defined cases: null or empty text has no tokens; repeated rows are counted alike; other columns pass.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

MARK = "▁"
#: Depth of the trie in characters, and bytes of pre-tokens whose counts are kept.
MAX_DEPTH, MAX_HELD = 256, 32 << 20
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def load_pieces(path: str) -> dict[str, float]:
    """Piece -> log-probability by rank; read on the driver only (a vocabulary has a fixed size)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    # Single characters close the file of a merge vocabulary, so rank order is by score.
    total = math.log(sum(1 / (r + 10) for r in range(len(usable))))
    return {p: -math.log(r + 10) - total for r, p in enumerate(usable)}


class ForwardTrie:
    """Trie of pre-tokens with the best (score, tokens) of each prefix."""

    def __init__(self, pieces: dict[str, float], max_nodes: int = 400_000):
        self.pieces, self.max_nodes = pieces, max_nodes
        self.longest = max(map(len, pieces), default=1)
        self.byte_cost = min(pieces.values(), default=-10.0) - 10.0
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.score, self.tokens = [0.0], [0]
        self.terminal: dict[bytes, int] = {}
        self.held = 0

    def count(self, word: bytes) -> int:
        known = self.terminal.get(word)
        if known is not None:
            return known
        if len(self.children) > self.max_nodes or self.held > MAX_HELD:
            self.clear()
        text = MARK + word.decode("utf-8", "replace")
        children, score, tokens, pieces, longest = self.children, self.score, self.tokens, self.pieces, self.longest
        path, node = [0], 0
        for end, char in enumerate(text[:MAX_DEPTH] if len(text) > MAX_DEPTH else text, 1):
            child = children[node].get(char)
            if child is None:
                n_bytes = len(char.encode("utf-8", "replace"))
                best, fewest = score[node] + n_bytes * self.byte_cost, tokens[node] + n_bytes
                for start in range(max(0, end - longest), end):
                    gain = pieces.get(text[start:end])
                    if gain is not None:
                        before = path[start]
                        now = score[before] + gain
                        if now > best or now == best and tokens[before] + 1 < fewest:
                            best, fewest = now, tokens[before] + 1
                child = len(children)
                children[node][char] = child
                children.append({})
                score.append(best)
                tokens.append(fewest)
            node = child
            path.append(node)
        if len(text) > MAX_DEPTH:
            return self._rest(text, [(score[x], tokens[x]) for x in path[-longest:]])
        self.terminal[word] = tokens[node]
        self.held += len(word)
        return tokens[node]

    def _rest(self, text: str, last: list[tuple[float, int]]) -> int:
        """Tokens of the best segmentation from the scores of the places up to MAX_DEPTH."""
        pieces, longest = self.pieces, self.longest
        for end in range(MAX_DEPTH + 1, len(text) + 1):
            n_bytes = len(text[end - 1].encode("utf-8", "replace"))
            best, fewest = last[-1][0] + n_bytes * self.byte_cost, last[-1][1] + n_bytes
            base = end - len(last)
            for start in range(base, end):
                gain = pieces.get(text[start:end])
                if gain is not None:
                    now, n = last[start - base][0] + gain, last[start - base][1] + 1
                    if now > best or now == best and n < fewest:
                        best, fewest = now, n
            last.append((best, fewest))
            if len(last) > longest:
                del last[0]
        return last[-1][1]


def _count(shared, columns: list[str], text_col: str, max_nodes: int):
    def run(batches):
        trie = ForwardTrie(shared.value, max_nodes)
        count = trie.count
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column("_ls_text").to_pylist():
                words = text.split() if text else []
                n_words.append(len(words))
                extra = sum(map(text.count, (b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))) if text else 0
                n_tokens.append(extra + sum(map(count, words)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=[*columns, "n_pretokens", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER, max_nodes: int = 400_000, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of docs plus n_pretokens and n_tokens."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(tokenizer))
    columns = [c for c in (docs.columns if keep is None else keep) if c not in ("n_pretokens", "n_tokens")]
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(*columns, F.col(text_col).cast("binary").alias("_ls_text")).mapInArrow(_count(shared, columns, text_col, max_nodes), schema)
