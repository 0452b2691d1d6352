"""Word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link and the number of pieces that
following it pops, both computed once, so a word's greedy longest-match piece count is
read off in one pass over its characters, without building a piece.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Mark of a word's start in the vocabulary.
START = "▁"
_BATCH = 512


class PieceAutomaton:
    """Greedy longest-match piece counts; a word that the pieces cannot spell counts as one unknown piece."""

    def __init__(self, pieces: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        ends: list[bool] = [False]
        for piece in pieces:
            node = 0
            for char in piece:
                child = self.next[node].get(char)
                if child is None:
                    child = self.next[node][char] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = child
            ends[node] = node > 0
        n = len(self.next)
        self.fail: list[int] = [-1] * n
        self.pops: list[int] = [0] * n
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for char, child in self.next[node].items():
                if ends[child]:
                    self.fail[child], self.pops[child] = 0, 1
                else:
                    back, popped = self.fail[node], self.pops[node]
                    while back >= 0 and char not in self.next[back]:
                        popped += self.pops[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[child], self.pops[child] = self.next[back][char], popped
                queue.append(child)

    def count(self, word: str) -> int:
        """Pieces of ``word``; 0 for one that cannot be spelt."""
        node, total = 0, 0
        for char in word:
            while (child := self.next[node].get(char)) is None:
                if (back := self.fail[node]) < 0:
                    return 0
                total += self.pops[node]
                node = back
            node = child
        while node:
            if (back := self.fail[node]) < 0:
                return 0
            total += self.pops[node]
            node = back
        return total


def load_pieces(model_file: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model; those with an inner start mark span words and are left out."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [p for p in map(model.id_to_piece, ids) if START not in p[1:]]


def count_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", max_words: int = 300_000) -> DataFrame:
    """Per document: n_words (between white space), n_pieces (an unknown word counts one) and n_unknown words.

    A null or empty text has none of them. Repeated rows give repeated rows, a null id
    stays null. ``max_words`` bounds the cache of word counts in a worker, not the result.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        automaton, known = PieceAutomaton(load_pieces(model_file)), {}
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                rows = batch.slice(at, _BATCH)
                cut = [(t or "").split() for t in rows.column(1).to_pylist()]
                if len(known) > max_words:
                    known = {}
                for word in set().union(*cut).difference(known):
                    known[word] = automaton.count(START + word)
                counts = [list(map(known.__getitem__, words)) for words in cut]
                unknown = [c.count(0) for c in counts]
                columns = [rows.column(0), *(pa.array(x, type=pa.int64()) for x in (list(map(len, counts)), [sum(c) + u for c, u in zip(counts, unknown)], unknown))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "n_pieces", "n_unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_pieces bigint, n_unknown bigint")
