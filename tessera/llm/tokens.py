"""Exact, cached encoding with a word-level BPE vocabulary file.

Such a vocabulary lower-cases, drops white space and merges inside one word only, so the
ids of a text are the ids of its words in order. Each worker keeps the ids of words it has
seen and asks the tokenizer only for new ones, many at a time.
"""

from __future__ import annotations

import os
import re

#: Texts of these characters only are lower-cased and split here; others go to the tokenizer
#: in raw pieces between spaces. Excluded: separators that the tokenizer sees as symbols,
#: fractions and superscripts (numbers to the tokenizer, not decimal digits) and text beyond
#: Latin Extended-B, where combining marks begin soon after.
_UNUSUAL = re.compile("[\x1c-\x1f²³¹¼½¾]|[^\x00-ɏ]|<\\|")
_LETTERS = "a-zªµºß-öø-ɏ"
_PARTS = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")
#: Lower-case prose of words, single stops and commas needs no pattern to be cut.
_PROSE = re.compile(rf"[{_LETTERS} \n.,]*")
_SPLIT = re.compile("[ \n]+")


class WordEncoder:
    """Text to the ids' little-endian unsigned 32-bit bytes. ``max_words`` bounds the cache, not the result."""

    def __init__(self, vocabulary: str, max_words: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        tokens = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(tokens.values(), default=0) + 1, bool)
        self.ends[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        self.max_words = max_words
        self.words: dict[str, bytes] = {}

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, parts: list[str]) -> list[bytes]:
        """Parts that are one word each to the tokenizer: encoded as one text and cut after each word's last id."""
        import numpy as np

        (found,) = self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(parts):
            return self._one_by_one(parts)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def _learn(self, parts: list[str], raw: list[str]) -> None:
        for at in range(0, len(parts), 1000):
            own = parts[at : at + 1000]
            self.words.update(zip(own, self._together(own)))
        self.words.update(zip(raw, self._one_by_one(raw)))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain, raw, cut = set(), set(), []
        for text in texts:
            low = text.lower()
            if _PROSE.fullmatch(low) and ".." not in low and ",," not in low and ".," not in low and ",." not in low and "İ" not in text:
                words = low.replace(".", " . ").replace(",", " , ").split()
                plain.update(words)
            elif _UNUSUAL.search(text) or _UNUSUAL.search(low):  # some capitals' small letters lie beyond the range
                words = _SPLIT.split(text)
                raw.update(words)
            else:
                words = _PARTS.findall(low)
                plain.update(words)
            cut.append(words)
        if len(self.words) > self.max_words:
            self.words = {w: b for w, b in self.words.items() if len(b) <= 8}  # short words come again soonest
            if len(self.words) > self.max_words // 2:
                self.words = {}
        # difference(dict) looks each word up; a set minus a keys view would walk the whole cache
        self._learn(list(plain.difference(self.words)), list(raw.difference(plain).difference(self.words)))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in cut]


_ENCODERS: dict[str, WordEncoder] = {}


def shared_encoder(vocabulary: str) -> WordEncoder:
    """This worker's encoder: tasks that follow each other in a worker share its cache."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = WordEncoder(vocabulary)
    return _ENCODERS[vocabulary]
