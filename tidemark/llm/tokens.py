"""Token counts by dynamic programming shared over a trie.

Distinct pre-tokens are inserted in a trie: when a node is made, the best unigram
score of the prefix that ends there, and its number of pieces, follow from those
of the nodes above, once for all pre-tokens below; terminals keep their counts,
and a text's count is the sum over the terminals of its pre-tokens.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body

#: Default vocabulary: a public one, ordered by rank.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A task's trie has at most about this many nodes, then it starts anew, inside a row as well; what a pre-token has
#: beyond its first DEEP characters gets no nodes, its scores follow one by one. Memory only, no count changes.
MAX_NODES = 1_500_000
DEEP = 256
_END = ""
_CODES = 0x110000


def load_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """piece -> log-probability. The file holds ranks in place of unigram
    scores, so probabilities follow Zipf's law over the ranks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    norm = math.log(sum(1 / r for r in range(1, len(plain) + 1)))
    return {p: -math.log(r) - norm for r, p in enumerate(plain, 1)}


class Trie:
    """Pre-tokens and the counts of their best segmentations into pieces. A
    character that no piece covers becomes its UTF-8 bytes, at ten below the
    worst score each. Equal scores go to fewer pieces."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.back: dict = {}  # the pieces, spelled backwards
        for piece, score in pieces.items():
            node = self.back
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[_END] = score
        self.byte = min(pieces.values(), default=0.0) - 10.0
        self.longest = max(map(len, pieces), default=1)
        self.clear()

    def clear(self) -> None:
        self.below: dict[int, int] = {}  # a node and a character, as one number, to the node below
        self.best, self.pieces = array("d", [0.0]), array("q", [0])
        self.terminals: dict[bytes, int] = {}

    def insert(self, word: str) -> list[int]:
        """The nodes from the root to where ``word`` ends; nodes that are missing
        are made, each from those on the way to it."""
        below, best, pieces, back = self.below, self.best, self.pieces, self.back
        path = [0]
        for i, c in enumerate(word):
            key = path[i] * _CODES + ord(c)
            node = below.get(key)
            if node is None:
                n_bytes = 1 if c < "\x80" else len(c.encode("utf-8", "replace"))
                top, n = best[path[i]] + self.byte * n_bytes, pieces[path[i]] + n_bytes
                piece, j = back.get(c), i
                while piece is not None:
                    score = piece.get(_END)
                    if score is not None:
                        s = best[path[j]] + score
                        if s > top or (s == top and pieces[path[j]] + 1 < n):
                            top, n = s, pieces[path[j]] + 1
                    if not j:
                        break
                    j -= 1
                    piece = piece.get(word[j])
                node = below[key] = len(best)
                best.append(top)
                pieces.append(n)
            path.append(node)
        return path

    def follow(self, word: str, path: list[int]) -> int:
        """The count of ``word``, of which the trie holds the beginning with the
        nodes ``path``. Only the scores of the last prefixes that a piece may
        begin at are kept."""
        back, size = self.back, self.longest + 1
        best, pieces = [0.0] * size, [0] * size
        for at in range(max(0, len(path) - size), len(path)):
            best[at % size], pieces[at % size] = self.best[path[at]], self.pieces[path[at]]
        for i in range(len(path) - 1, len(word)):
            c = word[i]
            n_bytes = 1 if c < "\x80" else len(c.encode("utf-8", "replace"))
            top, n = best[i % size] + self.byte * n_bytes, pieces[i % size] + n_bytes
            piece, j = back.get(c), i
            while piece is not None:
                score = piece.get(_END)
                if score is not None:
                    s = best[j % size] + score
                    if s > top or (s == top and pieces[j % size] + 1 < n):
                        top, n = s, pieces[j % size] + 1
                if not j:
                    break
                j -= 1
                piece = piece.get(word[j])
            best[(i + 1) % size], pieces[(i + 1) % size] = top, n
        return pieces[len(word) % size]

    def count(self, word: bytes) -> int:
        """The count at the terminal of a pre-token, with its leading mark."""
        n = self.terminals.get(word)
        if n is None:
            if len(self.best) > MAX_NODES:
                self.clear()
            marked = MARK + word.decode("utf-8", "replace")
            if len(marked) > DEEP:
                return self.follow(marked, self.insert(marked[:DEEP]))
            n = self.terminals[word] = self.pieces[self.insert(marked)[-1]]
        return n


def token_counts(docs: DataFrame, pieces: dict[str, float], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_pretokens, n_tokens) for every row. Pre-tokens are the words of a
    text (runs of anything but ASCII white space), each with a leading mark.

    Null and empty texts have none; a very long text is one row's work, the trie
    stays within MAX_NODES whatever it holds, with or without white space; null ids stay; repeated rows count
    alike; an empty table gives none; other columns are ignored. Each task builds
    the trie of the pre-tokens in its own rows, so nothing is shuffled and a hot
    word costs nothing more; ``pieces`` is the fixed vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(pieces)
        for b in batches:
            words, counts = [], []
            for raw in b.column(1):
                text_ = raw.as_py().split()
                words.append(len(text_))
                known = list(map(trie.terminals.get, text_))
                counts.append(sum(trie.count(w) if n is None else n for w, n in zip(text_, known)) if None in known else sum(known))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_pretokens", "n_tokens"])

    src = docs.select(F.col(id).alias("id"), body(text).alias("raw"))
    out = src.mapInArrow(run, f"id {docs.schema[id].dataType.simpleString()}, n_pretokens long, n_tokens long")
    return out.select(F.col("id").alias(id), "n_pretokens", "n_tokens")
