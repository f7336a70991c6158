"""Byte n-gram features of words, vectorised over whole batches of texts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_LETTERS = bytearray(range(256))
for _c in range(128):
    _LETTERS[_c] = _c + 32 if 65 <= _c <= 90 else _c if 97 <= _c <= 122 or 48 <= _c <= 57 else 32
_LETTERS = bytes(_LETTERS)


def words_only(text: str) -> bytes:
    """The text's distinct words, one space around each: A-Z lower-cased, other ASCII signs as spaces."""
    return b" " + b" ".join(dict.fromkeys(text.encode().translate(_LETTERS).split())) + b" "


def _mix32(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


class Subwords:
    """All n-grams (``low`` to ``high`` bytes, word borders as spaces) of a list of cleaned texts.

    Lengths and virtual words are those with the fewest errors on a fold of their own within the rows that may be
    learnt from (crc32 of the id mod 4 is 1, fitted on 0 and 3); labels of the held-out fold had no part in it.

    A text's mean has ``virtual`` words of value 0 added, so that a few words decide nothing.
    ``each()`` yields, n by n, the word that each n-gram is in and its bucket; ``doc_of_word`` and
    ``words_in_doc`` place words in texts.
    """

    def __init__(self, texts: Sequence[bytes], buckets: int, low: int = 2, high: int = 4, virtual: int = 200):
        self.buckets, self.low, self.high = buckets, low, high
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.space = self.buf == 32
        count = np.cumsum(self.space)
        self.word = (count - 1).astype(np.int64)
        self.words = int(count[-1]) if len(count) else 0
        ends = np.cumsum(np.fromiter((len(t) for t in texts), np.int64, len(texts)))
        # a text of k words holds k + 1 spaces: the last one opens a word without n-grams
        per = np.diff(np.concatenate(([0], count[ends - 1] if len(ends) else [])))
        self.doc_of_word = np.repeat(np.arange(len(texts)), per.astype(np.int64))
        self.words_in_doc = np.maximum(per - 1, 0) + virtual

    def each(self):
        b, n = self.buf.astype(np.uint32), len(self.buf)
        h = b + np.uint32(1)
        clear = ~(self.space[:-1] & self.space[1:])  # a letter in it, no space strictly inside
        for size in range(2, self.high + 1):
            if n < size:
                return
            if size > 2:
                clear = clear[: n - size + 1] & ~self.space[1 : n - size + 2] & ~self.space[size - 2 : n - 1]
            h = h[: n - size + 1] * np.uint32(0x01000193) + b[size - 1 :] + np.uint32(1)
            if size >= self.low:
                at = np.flatnonzero(clear[: n - size + 1])
                yield self.word[at], (_mix32(h[at]) % np.uint32(self.buckets)).astype(np.int64)

    def text_means(self, table: np.ndarray) -> np.ndarray:
        """Mean over a text's words of the mean over the word's n-grams of ``table`` values."""
        total, n = np.zeros(self.words), np.zeros(self.words)
        for word, bucket in self.each():
            total += np.bincount(word, table[bucket], self.words)
            n += np.bincount(word, minlength=self.words)
        mean = np.divide(total, n, out=np.zeros_like(total), where=n > 0)
        docs = len(self.words_in_doc)
        return np.bincount(self.doc_of_word, mean, docs) / self.words_in_doc

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text: its buckets and their weights in text_means."""
        found = [*self.each()]
        word = np.concatenate([w for w, _ in found]) if found else np.empty(0, np.int64)
        bucket = np.concatenate([b for _, b in found]) if found else np.empty(0, np.int64)
        n = np.bincount(word, minlength=self.words)
        weight = 1.0 / (n[word] * self.words_in_doc[self.doc_of_word[word]])
        doc = self.doc_of_word[word]
        out = []
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(len(self.words_in_doc) + 1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            u, at = np.unique(bucket[order[a:b]], return_inverse=True)
            out.append((u.astype(np.int32), np.bincount(at, weight[order[a:b]], len(u)).astype(np.float32)))
        return out
