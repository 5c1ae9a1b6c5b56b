"""Lines of a slice of texts, found without a loop over them."""

from __future__ import annotations

import numpy as np

from .common import _BASE, _GOLD, Words, mix


class Lines:
    """The \\n-split lines that hold a word: text index, number in the text, byte start and end, words and their hash."""

    def __init__(self, data: np.ndarray, off: np.ndarray, words: Words):
        cut = np.flatnonzero(data == 10)
        owner = np.searchsorted(off, cut, "right") - 1
        start = np.concatenate([off[:-1], cut + 1])
        text = np.concatenate([np.arange(len(off) - 1), owner])
        order = np.lexsort((start, text))
        start, text = start[order], text[order]
        number = np.arange(len(text)) - np.searchsorted(text, text)
        end = np.empty(len(text), np.int64)
        last = np.r_[text[1:] != text[:-1], True] if len(text) else np.zeros(0, bool)
        end[:-1] = start[1:] - 1
        end[last] = off[1:][text[last]]
        first = np.searchsorted(words.start, start)
        count = np.searchsorted(words.start, end) - first
        keep = count > 0
        self.text, self.number, self.start, self.end, self.first, self.count = (x[keep] for x in (text, number, start, end, first, count))

    def hashes(self, word_hashes: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each line's sequence of words."""
        if not len(self.text):
            return np.zeros(0, np.uint64)
        power = np.multiply.accumulate(np.full(int(self.count.max()), _BASE, np.uint64))
        pos = np.arange(len(word_hashes)) - np.repeat(self.first, self.count)
        return mix(np.add.reduceat(mix(word_hashes + _GOLD) * power[pos], self.first) + self.count.astype(np.uint64) * _GOLD)
