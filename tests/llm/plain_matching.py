"""Words, answers and longest common subsequences, written apart from the operator."""

from __future__ import annotations

import re
from bisect import bisect_left


def split_words(text):
    return [w for w in re.split(r"[\x09-\x0D\x20]+", (text or "").lower()) if w]


def answer_of(text):
    """The words of the last sentence; sentences end with . ! ? before white space, or with a line."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if split_words(p)]
    return split_words(parts[-1]) if parts else []


def common_length(a, b):
    """By the positions of b's words in a, from the last, and the least ends of chains."""
    where, ends = {}, []
    for i, w in enumerate(a):
        where.setdefault(w, []).insert(0, i)
    for w in b:
        for i in where.get(w, ()):
            at = bisect_left(ends, i)
            ends[at : at + 1] = [i]
    return len(ends)


class Words:
    """The same length by whole numbers, for many windows: a place of the list is free while its bit is set."""

    def __init__(self, words):
        self.n, self.bits = len(words), {}
        for i, w in enumerate(words):
            self.bits[w] = self.bits.get(w, 0) + 2**i

    def share_in(self, window):
        free = 2**self.n - 1
        for w in window:
            if w in self.bits:
                here = self.bits[w]
                free = ((free + (free & here)) | (free & ~here)) % 2**self.n
        return (self.n - free.bit_count()) / self.n


class Plain:
    def __init__(self, item_id, text):
        self.id, self.words = item_id, split_words(text)
        self.known, self.answer = Words(self.words), Words(answer_of(text))

    def found_in(self, window):
        found = self.known.share_in(window)
        return found >= 0.7 or found >= 0.5 and self.answer.share_in(window) >= 0.8
