"""License scans by template-markup matching.

A template is plain wording with ``<<opt>>...<</opt>>`` around words that may be left out
and ``<<var N>>`` where up to N words may stand. Each template becomes a token automaton;
a text is accepted at a place where all mandatory words match exactly and in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.license_texts import PHRASES, TEMPLATES

_MARKUP = re.compile(r"<<opt>>|<</opt>>|<<var \d+>>|[^\s<>]+")
#: Bytes of words are digits, a-z and all above 0x7F; A-Z fold to a-z, the rest separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_BATCH = 512


class TemplateAutomaton:
    """Token automaton of one template: states with word moves, free moves (optional) and any-word moves (replaceable)."""

    def __init__(self, markup: str):
        self.words: list[tuple[bytes, int] | None] = [None]
        self.free: list[set[int]] = [set()]
        self.any: list[int | None] = [None]
        at, opened = 0, []
        for part in _MARKUP.findall(markup):
            if part == "<<opt>>":
                opened.append(at)
            elif part == "<</opt>>":
                self.free[opened.pop()].add(at)
            elif part.startswith("<<var"):
                ends = [at]
                for _ in range(int(part[6:-2])):
                    new = self._state()
                    self.any[ends[-1]] = new
                    ends.append(new)
                at = self._state()
                for state in ends:
                    self.free[state].add(at)
            else:
                new = self._state()
                self.words[at] = (part.encode(), new)
                at = new
        if opened:
            raise ValueError(f"an optional region isn't closed: {markup}")
        self.accept = at
        self.start = self._closure({0})
        self.first = {self.words[s][0] for s in self.start if self.words[s]}
        if any(self.any[s] is not None for s in self.start) or at in self.start:
            raise ValueError(f"a template must begin with a fixed word: {markup}")

    def _state(self) -> int:
        self.words.append(None)
        self.free.append(set())
        self.any.append(None)
        return len(self.words) - 1

    def _closure(self, states: set[int]) -> set[int]:
        todo, found = list(states), set(states)
        while todo:
            for state in self.free[todo.pop()] - found:
                found.add(state)
                todo.append(state)
        return found

    def accepts(self, words: list[bytes], at: int) -> int | None:
        """The end of the shortest accepted wording that begins at word ``at``."""
        states = self.start
        for i in range(at, len(words)):
            moved = {self.words[s][1] for s in states if self.words[s] and self.words[s][0] == words[i]}
            moved |= {self.any[s] for s in states if self.any[s] is not None}
            if not moved:
                return None
            states = self._closure(moved)
            if self.accept in states:
                return i + 1
        return None


def _mandatory(markup: str) -> bytes:
    """The longest run of mandatory words: a text without it cannot match."""
    depth, runs = 0, [[]]
    for part in _MARKUP.findall(markup):
        depth += (part == "<<opt>>") - (part == "<</opt>>")
        if part.startswith("<<"):
            runs.append([])
        elif not depth:
            runs[-1].append(part)
    return b" " + " ".join(max(runs, key=len)).encode() + b" "


class LicenseScanner:
    """Finds phrases and accepted templates in one text."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.templates = [(label, TemplateAutomaton(m), _mandatory(m)) for label, m in templates.items()]

    def scan(self, text: str) -> tuple[int, list[int], set[str], dict[str, tuple[int, int]]]:
        """Word count, starts of phrases, their labels and each accepted template's first (start, end) in words."""
        words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
        line = b" " + b" ".join(words) + b" "
        starts, labels, found = [], set(), {}
        for phrase, label in self.phrases:
            at, done, before = line.find(phrase), 0, 0
            while at >= 0:  # words are counted on from the last place, so many places stay linear
                before, done = before + line.count(b" ", done, at), at
                starts.append(before)
                labels.add(label)
                at = line.find(phrase, at + 1)
        for label, automaton, needed in self.templates:
            if needed in line:
                for i, word in enumerate(words):
                    if word in automaton.first and (end := automaton.accepts(words, i)) is not None:
                        found[label] = (i, end)
                        break
        return len(words), starts, labels, found


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence findings per document.

    Columns: the id, n_words, n_base (places of phrases), first_word and last_word (null
    without a place), base_labels, labels (phrases' and templates'), score (1 where a
    template is accepted, 0.5 for a bare phrase, else 0) and matches (label, first and end
    word of each accepted template). A null text is an empty one.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scanner = LicenseScanner(phrases, templates)
        spans = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans]
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                rows = batch.slice(at, _BATCH)
                out = []
                for text in rows.column(1).to_pylist():
                    n, starts, base, found = scanner.scan(text or "")
                    out.append((
                        n, len(starts), min(starts, default=None), max(starts, default=None),
                        ",".join(sorted(base)), ",".join(sorted(base | found.keys())), 1.0 if found else 0.5 if base else 0.0,
                        [{"label": k, "first": a, "end": b} for k, (a, b) in sorted(found.items())],
                    ))
                columns = [pa.array(c, type=k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([rows.column(0), *columns], names=names)

    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<label:string,first:bigint,end:bigint>>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
