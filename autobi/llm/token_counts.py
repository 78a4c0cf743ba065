"""Counts of greedy word pieces by a linear automaton, without building the pieces.

The vocabulary is a trie with two roots: pieces that begin a word and pieces that continue one. Where no edge
fits, the failure link leads to the longest suffix that can still be matched, and a stored number says how many
pieces are complete by then. Every byte of a word is read once.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autobi.llm import common

KEPT, LONGEST = 400_000, 48
MARK = "▁"


class Automaton(dict):
    """Piece counts of words; as a dict it keeps those of short words (-1: cannot be cut into pieces)."""

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]):
        self.edges: dict[int, int] = {}  # node * 256 + byte: node
        self.nodes = 2  # 0 begins a word, 1 continues one
        whole = set()
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for byte in piece:
                    node = self.edges.setdefault(node << 8 | byte, self.nodes)
                    self.nodes += node == self.nodes
                if piece:
                    whole.add(node)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.edges.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        self.fail, self.pops = [-1] * self.nodes, [0] * self.nodes
        queue = deque((0, 1))
        while queue:
            parent = queue.popleft()
            for byte, node in below.get(parent, ()):
                if node in whole:
                    self.fail[node], self.pops[node] = 1, 1
                else:
                    at, pops = self.fail[parent], self.pops[parent]
                    while at >= 0 and (at << 8 | byte) not in self.edges:
                        pops += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.pops[node] = self.edges[at << 8 | byte], pops
                queue.append(node)

    def count(self, word: bytes) -> int:
        """Pieces of the word, or -1 if greedy cutting fails."""
        at, found, get, fail, pops = 0, 0, self.edges.get, self.fail, self.pops
        for byte in word:
            while (to := get(at << 8 | byte)) is None:
                if fail[at] < 0:
                    return -1
                found += pops[at]
                at = fail[at]
            at = to
        while at > 1:
            if fail[at] < 0:
                return -1
            found += pops[at]
            at = fail[at]
        return found

    def __missing__(self, word: bytes) -> int:
        found = self.count(word)
        if len(word) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[word] = found
        return found


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces that begin a word (those with a space mark before them) and pieces that continue one."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    names = [p.piece for p in model.pieces if p.type == 1]
    return [p[1:].encode() for p in names if p[0] == MARK and MARK not in p[1:] and len(p) > 1], [p.encode() for p in names if MARK not in p]


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(*vocabulary(path))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_tokens, n_unknown)`` of each text.

    Words are cut at ASCII white space and greedily, longest piece first; a word that cannot be cut so counts
    as one token and as unknown. Null and empty texts count zero. Repeated rows each give a row; other columns
    are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(model)
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in common.binary(batch.column(1)):
                counts = list(map(own.__getitem__, (text or b"").split()))
                bad = counts.count(-1)
                words.append(len(counts)), tokens.append(sum(counts) + 2 * bad), unknown.append(bad)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
