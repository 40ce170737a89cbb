"""Token counts of a unigram tokenizer, by dynamic programming over a trie of pre-tokens.

A task keeps the distinct pre-tokens (white-space words) that it meets in a trie. The forward
score of a node, the best segmentation of the path to it, is computed once, however many
pre-tokens share the path; the node that ends a pre-token stores how many tokens its best
segmentation has, and a text's count is the sum over its pre-tokens.
"""

from __future__ import annotations

import importlib.util
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import byte_values, chunks

#: The folder with the vocabulary files of public tokenizers, and the file in it.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "piece_bpe_32k.model"
#: Marks a pre-token's start, as the vocabulary files write it.
MARK = "▁"
#: Trie nodes that a task keeps at most; then it starts afresh.
MAX_NODES = 1_500_000
#: Longer pre-tokens share no prefixes worth keeping: of them only the scores that a piece can reach are kept.
LONG_TOKEN = 1000


def load_pieces(path: str | None = None) -> list[str]:
    """The ordinary pieces of a SentencePiece file that the driver can read, in the order of their ranks.
    Without one, ``FileNotFoundError`` says which was looked for."""
    import sentencepiece

    if path is None:
        path = os.path.join(TOKENIZERS, VOCABULARY)
        if not os.path.exists(path) and (spec := importlib.util.find_spec("public_tokenizers")):
            path = os.path.join(os.path.dirname(spec.origin), VOCABULARY)
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary file at {path}; give another path, or the pieces themselves")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def unigram_scores(pieces: list[str]) -> dict[str, float]:
    """Log probabilities by rank: Zipf's law, as a vocabulary file keeps ranks but no frequencies."""
    total = math.log(sum(1 / (i + 2) for i in range(len(pieces))))
    scores: dict[str, float] = {}
    for i, piece in enumerate(pieces):
        if piece:
            scores.setdefault(piece, -math.log(i + 2) - total)
    return scores


class PreTokenTrie:
    """Forward scores of all inserted pre-tokens' prefixes. Node 0 is the empty path.

    A character that no piece covers costs ``unknown`` and counts as its UTF-8 bytes (byte
    fallback). Of equally good segmentations the one whose last piece is longest counts.
    """

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.max_nodes = max_nodes
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int] | None] = [None]
        self.best, self.tokens = [0.0], [0]

    def count(self, token: str) -> int:
        """Tokens of a pre-token's best segmentation."""
        if len(token) > min(LONG_TOKEN, self.max_nodes):
            return self._count_long(token)
        if len(self.best) + len(token) > self.max_nodes and len(self.best) > 1:
            self.clear()
        node, path = 0, [0]
        for i, c in enumerate(token):
            below = self.children[node]
            if below is None:
                below = self.children[node] = {}
            child = below.get(c)
            if child is None:
                child = below[c] = self._extend(path, token, i)
            node = child
            path.append(node)
        return self.tokens[node]

    def _count_long(self, token: str) -> int:
        """The same outside the trie, with the scores of the last prefixes only."""
        reach = self.longest
        best, tokens = [0.0] * (reach + 1), [0] * (reach + 1)  # of the prefix of n characters at n % (reach + 1)
        scores, size = self.scores, reach + 1
        for i in range(len(token)):
            top, count = -math.inf, 0
            for j in range(max(0, i + 1 - reach), i + 1):
                s = scores.get(token[j : i + 1])
                if s is None:
                    if j < i:
                        continue
                    s, n = self.unknown, len(token[i].encode("utf-8", "replace"))
                else:
                    n = 1
                before = j % size
                if best[before] + s > top:
                    top, count = best[before] + s, tokens[before] + n
            best[(i + 1) % size], tokens[(i + 1) % size] = top, count
        return tokens[len(token) % size]

    def _extend(self, path: list[int], token: str, i: int) -> int:
        """A node for token[: i + 1], below ``path``; its score comes from those of its prefixes."""
        best, tokens, scores = self.best, self.tokens, self.scores
        top, count = -math.inf, 0
        for j in range(max(0, i + 1 - self.longest), i + 1):
            s = scores.get(token[j : i + 1])
            if s is None:
                if j < i:
                    continue
                s, n = self.unknown, len(token[i].encode("utf-8", "replace"))
            else:
                n = 1
            before = path[j]
            if best[before] + s > top:
                top, count = best[before] + s, tokens[before] + n
        self.children.append(None)
        best.append(top)
        tokens.append(count)
        return len(best) - 1


class _Counts(dict):
    """Terminal counts of whole pre-tokens in front of the trie."""

    def __init__(self, trie: PreTokenTrie):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.trie.max_nodes // 4:
            self.clear()
        n = self.trie.count(MARK + word.decode("utf-8", "replace"))
        if len(word) <= LONG_TOKEN:
            self[word] = n
        return n


def token_counts(docs: DataFrame, keys: list[str], *, text: str = "text", pieces: list[str] | None = None, vocabulary: str | None = None,
                 max_nodes: int = MAX_NODES) -> DataFrame:
    """``keys``, then ``n_pretokens long, n_tokens long`` of every row's whole text.

    Pre-tokens are cut at ASCII white space and start with ``MARK``. Null and empty texts have no
    tokens. ``pieces`` are those of the file ``vocabulary`` unless given, by default that of
    ``TOKENIZERS``. Nothing is shuffled; a task's memory is bounded by ``max_nodes`` and one row's text,
    however many distinct pre-tokens there are and however long they are. Repeated rows each have their row; other columns are ignored.
    """
    scores = docs.sparkSession.sparkContext.broadcast(unigram_scores(load_pieces(vocabulary) if pieces is None else pieces))  # one vocabulary: a few MB
    source = docs.select(*(F.col(k) for k in keys), F.col(text).cast("string").alias("__text"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(PreTokenTrie(scores.value, max_nodes))
        for batch in batches:
            for chunk in chunks(batch, "__text"):
                words = [t.split() if t else [] for t in byte_values(chunk.column("__text"))]
                yield pa.RecordBatch.from_arrays(
                    [*(chunk.column(i) for i in range(len(keys))), pa.array(map(len, words), pa.int64()), pa.array((sum(map(counts.__getitem__, w)) for w in words), pa.int64())],
                    names=[*keys, "n_pretokens", "n_tokens"])

    return source.mapInArrow(run, types + "n_pretokens long, n_tokens long")
