"""Byte-level BPE by a depth-first walk over a trie of distinct words: prefixes that words share are encoded once."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .byte_bpe import Encoder
from .common import WordTable, map_arrow, pieces, texts_of

#: Bytes that each of the table's two generations may hold.
TABLE_BYTES = 48 << 20
_LEARN_WORDS = 100_000
_PAIRS = 500_000
_codecs: dict[str, "TrieCodec"] = {}

#: How the usual byte-level pre-tokeniser splits texts. A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PATTERN = regex.compile(PATTERN)
#: From this sign on, the library and the pattern above may follow different editions of Unicode.
_DISPUTED = "՘"


class LastTokens:
    """The last token of every prefix, from the last tokens of shorter ones.

    An encoding of a prefix ends with exactly one token t for which the encoding of what precedes t stays as
    it is when t follows: no merge across the boundary would have come first. So the encoding of a word is
    read off backwards from the last tokens of its prefixes, and a prefix's last token depends on the path
    to its node in the trie alone.
    """

    def __init__(self, model: dict, letters: dict[int, str]):
        """model: as in the tokenizer's file; letters: bytes to the signs that it writes them with."""
        vocab, of = model["vocab"], {s: b for b, s in letters.items()}
        raw = lambda s: bytes(of[c] for c in s)
        size = max(vocab.values()) + 1
        self.rank: dict[int, int] = {}
        self.made, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.bytes: list[bytes] = [b""] * size
        for s, b in of.items():
            self.bytes[vocab[s]] = bytes([b])
        sound = {vocab[s] for s in of}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[x << 32 | y] = rank
            self.made[z], self.left[z], self.right[z], self.bytes[z] = rank, x, y, raw(a + b)
            if x in sound and y in sound and self._apart(x, y, rank):
                sound.add(z)  # its own bytes are encoded as this token
        self._link(sound)
        self.known: dict[int, bool] = {}

    def _link(self, tokens: set[int]) -> None:
        """An automaton over the tokens' bytes: its state after a path tells which tokens end there, longest first."""
        self.next: list[dict[int, int]] = [{}]
        self.back, self.ending = [0], [()]
        for t in tokens:
            at = 0
            for b in self.bytes[t]:
                if (to := self.next[at].get(b)) is None:
                    to = self.next[at][b] = len(self.next)
                    self.next.append({})
                    self.back.append(0)
                    self.ending.append(())
                at = to
            self.ending[at] = ((len(self.bytes[t]), t),)
        level = list(self.next[0].values())
        while level:
            below = []
            for at in level:
                self.ending[at] += self.ending[self.back[at]]
                for b, to in self.next[at].items():
                    less = self.back[at]
                    while less and b not in self.next[less]:
                        less = self.back[less]
                    self.back[to] = self.next[less].get(b, 0)
                    below.append(to)
            level = below

    def _apart(self, x: int, y: int, until: float = float("inf")) -> bool:
        """Whether no merge across the boundary between x and y comes before ``until``.

        Goes back in time: of the two symbols at the boundary the one made last is undone, until both are bytes.
        A pair merges if its rank is below that of the merge that takes its left symbol away and not above that
        of the one that takes its right symbol away, since of equal ranks the leftmost comes first.
        """
        made, rank = self.made, self.rank.get
        gone_x = gone_y = until
        while True:
            r = rank(x << 32 | y)
            if r is not None and r < gone_x and r <= gone_y:
                return False
            if made[x] > made[y]:
                gone_x, x = made[x], self.right[x]
            elif made[y] >= 0:
                gone_y, y = made[y], self.left[y]
            else:
                return True

    def follows(self, x: int, y: int) -> bool:
        key = x << 32 | y
        if (out := self.known.get(key)) is None:
            if len(self.known) >= _PAIRS:
                self.known.clear()
            out = self.known[key] = self._apart(x, y)
        return out

    def walk(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, ids) in the trie's depth-first order, which is that of the sorted words.

        ``last`` holds what is known on the path from the root to the node at hand: at depth i the last token of the
        path's first i bytes. From one word to the next it is cut back to the node where the two part.
        """
        nexts, back, ending, known, follows = self.next, self.back, self.ending, self.known.get, self.follows
        sizes = [len(b) for b in self.bytes]
        last, state, before = [-1], [0], b""
        for w in sorted(words):
            depth, most = 0, min(len(w), len(before))
            while depth < most and w[depth] == before[depth]:
                depth += 1
            del last[depth + 1 :], state[depth + 1 :]
            at = state[depth]
            for end, byte in enumerate(w[depth:], depth + 1):
                while (to := nexts[at].get(byte)) is None:
                    at = back[at]
                at = to
                for size, t in ending[at]:
                    if size == end:
                        break
                    x = last[end - size]
                    fits = known(x << 32 | t)
                    if fits or fits is None and follows(x, t):
                        break
                last.append(t)
                state.append(at)
            ids, end = [], len(w)
            while end:
                ids.append(last[end])
                end -= sizes[last[end]]
            ids.reverse()
            yield w, ids
            before = w


class TrieCodec:
    """Ids as the tokenizers library gives them, and what they decode to.

    Texts are cut before a space or line feed that follows another sign; each distinct chunk is split into
    pre-tokens once, and the distinct pre-tokens that are new to the table go through one trie. Texts that spell an added token
    are encoded by the library whole, as are all texts under models that are no plain byte-level BPE.
    """

    def __init__(self, path: str):
        self.base = Encoder(path)
        self.words, self.parts = WordTable(TABLE_BYTES), WordTable(TABLE_BYTES)  # of chunks and of pre-tokens
        self.odd: dict[str, str] = {}  # what a chunk decodes to, unless that is the chunk

    @cached_property
    def plain(self) -> bool:
        return self.base.splits and self.base.merges.usable and (self.base.spec["decoder"] or {}).get("type") == "ByteLevel"

    @cached_property
    def states(self) -> LastTokens:
        return LastTokens(self.base.spec["model"], self.base.letters)

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii() or max(text) < _DISPUTED:
            return _PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.base.library.pre_tokenizer.pre_tokenize_str(text)]

    def _chunks(self, text: str) -> list[str] | None:
        """Parts whose ids may be joined; one part where white space comes in runs; None: the library takes the text."""
        if not self.plain or any(t in text for t in self.base.added):
            return None
        if "\0" in text:
            return [text]
        out = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        if out[0] == "":
            del out[0]
        return [text] if any(w[-1].isspace() for w in out) else out

    def _learn(self, fresh: list[str]) -> None:
        cut = [self.pre_tokens(w) for w in fresh]
        new = self.parts.fresh(set(chain.from_iterable(cut)))
        for w, ids in self.states.walk([p.encode() for p in new]):
            self.parts.put(w.decode(), array("I", ids).tobytes())
        get = self.parts.of.__getitem__
        for chunk, parts in zip(fresh, cut):
            own = b"".join([*map(get, parts)])
            self.words.put(chunk, own)
            if (back := self.decode(array("I", own))) != chunk:
                self.odd[chunk] = back

    def decode(self, ids: Iterable[int]) -> str:
        """What the library's decode(ids, skip_special_tokens=False) gives for ids of a plain model without added tokens."""
        raw = self.states.bytes
        return b"".join([raw[i] for i in ids]).decode(errors="replace")

    def _whole(self, text: str) -> tuple[bytes, str]:
        ids = self.base.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, "<u4").tobytes(), self.base.library.decode(ids, skip_special_tokens=False)

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Per text: its ids as little-endian unsigned 32-bit integers, and those ids decoded."""
        cut = [self._chunks(t) for t in texts]
        out = []
        for a, b in pieces(cut, lambda x: len(x or ()), _LEARN_WORDS):
            fresh = self.words.fresh(set(chain.from_iterable(x for x in cut[a:b] if x)))
            if len(self.odd) > _LEARN_WORDS:
                self.odd = {w: x for w, x in self.odd.items() if w in self.words.of or w in self.words.old}
            self._learn(fresh)
            get = self.words.of.__getitem__
            for text, chunks in zip(texts[a:b], cut[a:b]):
                if chunks is None:
                    out.append(self._whole(text))
                else:
                    odd = self.odd and not self.odd.keys().isdisjoint(chunks)
                    out.append((b"".join([*map(get, chunks)]), "".join([self.odd.get(w, w) for w in chunks]) if odd else text))
        return out


def codec(path: str) -> TrieCodec:
    """One table per Python worker, kept between batches and tasks."""
    return _codecs.setdefault(path, TrieCodec(path))


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        pairs = own.encode(texts_of(batch))
        n = [len(x) // 4 for x, _ in pairs]
        ids = [hashlib.sha256(x).hexdigest() for x, _ in pairs]
        back = [hashlib.sha256(y.encode()).hexdigest() for _, y in pairs]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        pairs = own.encode(texts_of(batch))
        flat = np.frombuffer(b"".join([x for x, _ in pairs]), "<u4").astype(np.int32)
        ends = np.cumsum([0, *[len(x) // 4 for x, _ in pairs]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat), pa.array([y for _, y in pairs])], ["doc_id", "ids", "decoded"])


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: what the library's encode and decode give for each whole text.

    Null counts as empty; an empty text has no ids and decodes to the empty text. Repeated rows repeat, other
    columns are not read, an empty table gives no rows.
    """
    return map_arrow(docs.select("doc_id", "text"), partial(_tokens, path=path), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_decode, without materialising ids as columns."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), partial(_digests, path=path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
