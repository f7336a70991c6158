"""Byte-level BPE token ids through a table of distinct words."""

from __future__ import annotations

import json
import os
from functools import cached_property
from itertools import chain

import numpy as np

from .common import WordTable, pieces

#: Bytes that each of the table's two generations may hold.
TABLE_BYTES = 48 << 20
_LEARN_WORDS = 200_000
_encoders: dict[str, "Encoder"] = {}


#: Classes of bytes; pre-tokens are runs of one class, the first with its space.
_LETTER, _DIGIT, _SIGN, _SPACE, _FEED, _END, _ODD = range(1, 8)
_CLASS = np.full(256, _ODD, np.int8)
for _c in range(33, 127):
    _CLASS[_c] = _LETTER if chr(_c).isalpha() else _DIGIT if chr(_c).isdigit() else _SIGN
for _c, _k in ((" ", _SPACE), ("\n", _FEED), ("\0", _END), ("'", _ODD)):
    _CLASS[ord(_c)] = _k
#: The lead byte of accented Latin letters, and what follows it in the two signs that are none.
_ACCENT, _NO_LETTERS = 0xC3, (0x97, 0xB7)


class Merges:
    """The library's merges, applied to many words in step; exact, and a test holds it to the library.

    Each turn merges, in every pre-token that still has a mergeable pair, its first pair of lowest rank, as
    the model does where every merge makes a token of its own.
    """

    #: Longest pre-token in bytes; the library encodes words with longer ones.
    LONGEST = 32

    def __init__(self, model: dict, letters: dict[int, str]):
        """model: as in the tokenizer's file."""
        vocab, pairs = model["vocab"], [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        made = [vocab.get(a + b, -1) for a, b in pairs]
        special = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        plain = model["type"] == "BPE" and not any(model.get(k) for k in special) and len(set(made)) == len(made) and -1 not in made and all(x in vocab for x in letters.values())
        self.usable = plain and max(vocab.values()) < 1 << 16
        if not self.usable:
            return
        self.byte = np.array([vocab[letters[b]] for b in range(256)], np.uint32)
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        order = np.argsort(key)
        self.none = np.int32(len(pairs))
        # sorted by pair, for lookup; no pair is the last entry
        self.key, self.rank = np.append(key[order], np.uint32((1 << 32) - 1)), np.append(order, self.none).astype(np.int32)
        self.made = np.array([*made, 0], np.uint32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << np.uint32(16) | right
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.rank[at], self.none)

    def _merge(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sym: (places, pre-tokens) of byte symbols, each column filled from its head; merged in place."""
        places, n = sym.shape
        done, sizes, who = np.zeros_like(sym), np.zeros_like(size), np.arange(n)
        # the place in the low bits: one minimum finds the lowest rank's first place
        top = (self.none << 6).astype(np.int32)
        key = np.full((places, n), top, np.int32)
        for i in range(places - 1):
            on = np.flatnonzero(size > i + 1)
            key[i, on] = self._ranks(sym[i, on], sym[i + 1, on]) << 6 | i
        while True:
            least = key.min(axis=0)
            if (over := least >= top).any():
                done[:, who[over]], sizes[who[over]] = sym[:, over], size[over]
                go = np.flatnonzero(~over)
                if not len(go):
                    return done, sizes
                sym, key, size, who, least = sym[:, go], key[:, go], size[go], who[go], least[go]
            at, col = least & 63, np.arange(len(who))
            sym[at, col] = self.made[least >> 6]
            size = size - 1
            for i in range(1, int(size.max()) + 1):
                shift = at < i
                below = i + 1 < places
                sym[i] = np.where(shift, sym[i + 1] if below else 0, sym[i])
                if below:
                    # one place further up, and always what was no pair
                    key[i] = np.where(shift, np.where(key[i + 1] >= top, top, key[i + 1] - 1), key[i])
            key[np.maximum(size - 1, 0), col] = top
            for side in (0, 1):  # the merged symbol with what follows it, and what precedes it
                i = at - side
                on = np.flatnonzero((i >= 0) & (i + 1 < size))
                i = i[on]
                r = self._ranks(sym[i, on], sym[i + 1, on])
                key[i, on] = np.where(r == self.none, top, r << 6 | i)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in order, for each word where its own end, and which words are left to the library."""
        buf = np.frombuffer(("\0".join(words) + "\0").encode(), np.uint8)
        kind = _CLASS[buf]
        lead = np.flatnonzero(buf[:-1] == _ACCENT)
        lead = lead[~np.isin(buf[lead + 1], _NO_LETTERS)]
        kind[lead] = kind[lead + 1] = _LETTER
        ends = np.flatnonzero(kind == _END)
        heads = np.concatenate(([0], ends[:-1] + 1))
        begin = np.ones(len(buf), bool)
        begin[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE) | (kind[:-1] == _END)
        at = np.flatnonzero(begin & (kind != _END))
        word = np.searchsorted(ends, at)
        size = np.minimum(np.append(at[1:], len(buf)), ends[word]) - at
        left = np.zeros(len(words), bool)
        left[word[size > self.LONGEST]] = True
        left[np.searchsorted(ends, np.flatnonzero(kind == _ODD))] = True
        fine = ~left[word]
        at, word, size = at[fine], word[fine], size[fine]
        count = np.zeros(len(at), np.int64)
        found = []
        low = 0
        for most in (4, 6, 8, 10, 12, 16, 24, self.LONGEST):
            own = np.flatnonzero((size > low) & (size <= most))
            low = most
            if len(own):
                place = at[own] + np.arange(most)[:, None]
                sym = self.byte[buf[np.minimum(place, len(buf) - 1)]]
                sym, n = self._merge(sym, size[own])
                count[own] = n
                found.append((own, sym, n))
        start = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.uint32)
        for own, sym, n in found:
            i, col = np.nonzero(np.arange(len(sym))[:, None] < n)
            out[start[own][col] + i] = sym[i, col]
        per = np.zeros(len(words), np.int64)
        np.add.at(per, word, count)
        return out, np.cumsum(per), left


class Encoder:
    """Ids as the tokenizers library gives them by default, each distinct word encoded once.

    Pre-tokens begin at a space or line feed that follows a sign other than white space, so a text may be
    cut there and its ids joined by position. The library itself encodes, whole, texts where such a sign
    follows white space or ends the text, and texts that spell an added token (whose id then stands for it).
    """

    def __init__(self, path: str):
        self.path = path
        self.words = WordTable(TABLE_BYTES)

    @cached_property
    def library(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def kind(self) -> np.dtype:
        """The narrowest unsigned type for all ids."""
        return np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")

    @cached_property
    def added(self) -> list[str]:
        return [t.content for t in self.library.get_added_tokens_decoder().values()]

    @cached_property
    def letters(self) -> dict[int, str]:
        """Bytes (as Latin-1 signs) to the signs that the model writes them with."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return dict(zip(plain, map(chr, plain))) | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}

    def _cut(self, text: str) -> list[str] | None:
        """The text's words, each with the space or line feed before it; None: the library takes it whole."""
        if not self.splits or "\0" in text or any(t in text for t in self.added):
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    @cached_property
    def spec(self) -> dict:
        return json.loads(self.library.to_str())

    @cached_property
    def splits(self) -> bool:
        """Whether texts may be cut as the class says: byte-level pre-tokens by the usual pattern, no normaliser."""
        pre = self.spec["pre_tokenizer"] or {}
        return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and self.spec["normalizer"] is None

    @cached_property
    def merges(self) -> Merges:
        return Merges(self.spec["model"], self.letters)

    def _learn(self, fresh: list[str]) -> None:
        put, words, rest = self.words.put, [], []
        for w in fresh:
            if w and (w == " " or w == "\n" or w[-1].isspace()):
                self.words.of[w] = None  # where it ends depends on what follows
            else:
                words.append(w)
        if self.merges.usable and words:
            ids, ends, left = self.merges.ids(words)
            flat, at = ids.astype(self.kind).tobytes(), 0
            for w, end, other in zip(words, (ends * self.kind.itemsize).tolist(), left.tolist()):
                if other:
                    rest.append(w)
                else:
                    put(w, flat[at:end])
                at = end
        else:
            rest = words
        for w, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False)):
            put(w, np.array(e.ids, self.kind).tobytes())

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text: its ids, little-endian, each of ``kind``."""
        cut = [self._cut(t) for t in texts]
        out = []
        for a, b in pieces(cut, lambda x: len(x or ()), _LEARN_WORDS):
            self._learn(self.words.fresh(set(chain.from_iterable(x for x in cut[a:b] if x))))
            get = self.words.of.__getitem__
            for text, words in zip(texts[a:b], cut[a:b]):
                try:
                    out.append(b"".join([*map(get, words)]) if words else self._whole(text))
                except TypeError:  # a None among them
                    out.append(self._whole(text))
        return out


def encoder(path: str) -> Encoder:
    """One table per Python worker, kept between batches and tasks."""
    return _encoders.setdefault(path, Encoder(path))
