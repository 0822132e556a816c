"""Token counts of a unigram vocabulary by dynamic programming over a trie of pre-tokens.

Each task inserts its distinct pre-tokens into a trie. A node holds the forward score of its prefix: the best sum of piece scores that
make it up, and the number of these pieces. Prefixes that pre-tokens share are scored once, and the node at which a pre-token ends
keeps its count, so a document's tokens are a sum of look-ups. No exchange; a lost task is run again.

The vocabulary file gives pieces in the order of their frequency; a piece's log probability is that of its rank under Zipf's law, in
whole millionths, so that sums are exact. What no piece covers is counted by its UTF-8 bytes. Of segmentations with equal scores
the one of fewer pieces counts.

Cases: a null or empty text has no tokens; a word longer than LONG characters is scored without entering the trie; repeated
rows give equal counts; an empty table gives no rows; other columns pass through if asked for, but one of an output's name gives way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from logstrata.llm.common import binary, carried, configure, neutral

SPACE = "▁"
#: Nodes, and pre-tokens with a count, after which a task begins a new trie, which changes no count.
NODES, KEPT = 500_000, 300_000
LONG = 256


def vocabulary(model_path: str) -> dict[str, int]:
    """Pieces with scores: millionths of -log(1 + rank)."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as f:
        proto.ParseFromString(f.read())
    pieces = [p.piece for p in proto.pieces if p.type == 1]
    return {p: -round(1e6 * math.log(1 + rank)) for rank, p in enumerate(pieces, 1)}


class Trie(dict):
    """Counts by pre-token; those missing are inserted when asked for."""

    def __init__(self, pieces: dict[str, int]):
        super().__init__()
        self.byte = min(pieces.values(), default=0) - 10_000_000  # a byte costs more than any piece
        self.found = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.some, self.longest = bool(pieces), max(map(len, pieces), default=1)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.edges: dict[tuple[int, str], int] = {}
        self.best: list[int] = [0]
        self.tokens: list[int] = [0]

    def insert(self, word: str) -> int:
        """Tokens of the best segmentation. Scores of the prefix that the trie has are taken from it, those beyond are worked out from
        the pieces that end there, which one walk of the vocabulary's automaton gives."""
        node, best, tokens, edges, known = 0, [0], [0], self.edges, 0
        keep = len(word) <= LONG
        if keep:
            for letter in word:
                to = edges.get((node, letter))
                if to is None:
                    break
                node, known = to, known + 1
                best.append(self.best[to])
                tokens.append(self.tokens[to])
        if known == len(word):
            return tokens[-1]
        best += [0] * (len(word) - known)
        tokens += [0] * (len(word) - known)
        matches = self.found.iter(word, max(0, known - self.longest + 1)) if self.some else ()
        end = known  # prefixes up to here are final
        for last, (length, own) in matches:
            if last < known:
                continue
            while end < last:  # later prefixes go on from these
                end += 1
                self._byte(word, end, best, tokens)
            i = last + 1
            if end < i:
                end = i
                self._byte(word, end, best, tokens)
            s, t = best[i - length] + own, tokens[i - length] + 1
            if s > best[i] or s == best[i] and t < tokens[i]:
                best[i], tokens[i] = s, t
        while end < len(word):
            end += 1
            self._byte(word, end, best, tokens)
        if keep:
            for i in range(known, len(word)):
                to = edges[node, word[i]] = len(self.best)
                self.best.append(best[i + 1])
                self.tokens.append(tokens[i + 1])
                node = to
        return tokens[-1]

    def _byte(self, word: str, i: int, best: list[int], tokens: list[int]) -> None:
        """The score of word[:i] with its last letter as bytes, from the final one of the prefix before."""
        width = len(word[i - 1].encode())
        best[i], tokens[i] = best[i - 1] + width * self.byte, tokens[i - 1] + width

    def __missing__(self, word: bytes) -> int:
        n = self.insert(SPACE + word.decode())
        if len(word) <= LONG:
            self[word] = n
        return n

    def total(self, words: list[bytes]) -> int:
        if len(self.best) > NODES or len(self) > KEPT:
            self.reset()
        return sum(map(self.__getitem__, words))


OUTPUTS = ("n_words", "n_tokens")


def token_counts(docs: DataFrame, pieces: dict[str, int], text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` with n_words (pre-tokens: what ASCII blanks part) and n_tokens."""
    configure(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary: megabytes
    sent, passed = neutral(docs, carried(carry, OUTPUTS), __text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            words, tokens = [], []
            for data in binary(batch.column("__text")):
                own = data.as_py().split()
                words.append(len(own))
                tokens.append(trie.total(own))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*batch.schema.names, *OUTPUTS])

    found = sent.mapInArrow(run, T.StructType([*sent.schema.fields, *(T.StructField(n, T.LongType()) for n in OUTPUTS)]))
    return found.select(*passed, *OUTPUTS)
