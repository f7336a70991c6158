"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cached_property, partial
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordTable, map_arrow, pieces, texts_of

MARK = "▁"
#: Bytes that each of the table's two generations may hold.
TABLE_BYTES = 32 << 20
_LEARN_WORDS = 100_000
_RUNS = re.compile(" *[^ ]+| +")
_codecs: dict[str, "Codec"] = {}


class Codec:
    """Encodes and decodes as the library does, segmenting each distinct word once.

    Holds for models whose pieces never run on past a non-marker into a marker, that hold no line feed
    inside longer pieces, mark words in front, keep white space and do no other normalisation: then the
    best segmentation of a text is that of its words, joined by position. Other models, and texts that
    spell the marker itself, go to the library whole.

    A text is cut before each run of spaces; where every space stands alone, also before line feeds.
    """

    def __init__(self, model_path: str):
        self.path = model_path
        self.words = WordTable(TABLE_BYTES)  # a word's ids in decimal, joined by commas
        self.odd: dict[str, str] = {}  # what a word decodes to, unless that is the word

    @cached_property
    def library(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    @cached_property
    def splits(self) -> bool:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(self.library.serialized_model_proto())
        n = m.normalizer_spec
        plain = n.name == "identity" and not n.precompiled_charsmap and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not m.trainer_spec.treat_whitespace_as_suffix and m.trainer_spec.byte_fallback
        return plain and not any(re.search(f"[^{MARK}]{MARK}|\n", p.piece) for p in m.pieces if p.type in (1, 4))

    @cached_property
    def surfaces(self) -> dict[int, str]:
        """What ordinary pieces decode to. Byte, unknown and control pieces are left to the library."""
        sp = self.library
        odd = (sp.is_byte, sp.is_unknown, sp.is_control, sp.is_unused)
        return {i: sp.id_to_piece(i).replace(MARK, " ") for i in range(sp.get_piece_size()) if not any(f(i) for f in odd)}

    def _decode(self, ids: list[int]) -> str:
        """The library's decode(ids) with the marker that it takes off the first piece still on."""
        try:
            return "".join([self.surfaces[i] for i in ids])
        except KeyError:
            back = self.library.decode(ids)
            return " " + back if self.surfaces.get(ids[0], "")[:1] == " " else back

    @cached_property
    def mark_id(self) -> int:
        return self.library.piece_to_id(MARK)

    def _learn(self, words: list[str]) -> None:
        """words: as in _words().

        The library puts its marker before each input, which stands for the first space of a word that has
        one; before a line feed it is a piece of its own and is taken off again.
        """
        ask = [w[1:] if w[0] == " " else w for w in words]
        ids = self.library.encode(ask, num_threads=1)
        for w, i in zip(words, ids):
            i = [self.mark_id] if w == " " else i if w[0] == " " else i[1:]
            self.words.put(w, ",".join(map(str, i)))
            if (back := self._decode(i)) != w:
                self.odd[w] = back

    def _words(self, text: str) -> list[str]:
        if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
            return _RUNS.findall(" " + text)
        return (" " + text.replace(" ", "\0 ").replace("\n", "\0\n")).split("\0") if "\0" not in text else _RUNS.findall(" " + text)

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """Per text: its ids in decimal, joined by commas, and those ids decoded."""
        out: list = [None] * len(texts)
        cut = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = ("", "")
            elif self.splits and MARK not in t:
                cut.append((i, self._words(t)))
            else:
                ids = self.library.encode(t)
                out[i] = (",".join(map(str, ids)), self.library.decode(ids))
        for a, b in pieces(cut, lambda x: len(x[1]), _LEARN_WORDS):
            fresh = self.words.fresh(set(chain.from_iterable(words for _, words in cut[a:b])))
            if len(self.odd) > _LEARN_WORDS:
                self.odd = {w: x for w, x in self.odd.items() if w in self.words.of or w in self.words.old}
            self._learn(fresh)
            get = self.words.of.__getitem__
            for i, words in cut[a:b]:
                back = texts[i]
                if self.odd and not self.odd.keys().isdisjoint(words):
                    # the first word's marker is the library's own and goes, as in decode()
                    back = "".join([self.odd.get(w, w) for w in words])[1:]
                out[i] = (",".join([*map(get, words)]), back)
        return out


def codec(model_path: str) -> Codec:
    """One table per Python worker, kept between batches and tasks."""
    return _codecs.setdefault(model_path, Codec(model_path))


def _encode(batches: Iterator[pa.RecordBatch], model_path: str) -> Iterator[pa.RecordBatch]:
    own = codec(model_path)
    for batch in batches:
        pairs = own.encode(texts_of(batch))
        n = [x.count(",") + 1 if x else 0 for x, _ in pairs]
        ids = [hashlib.sha256(x.encode()).hexdigest() for x, _ in pairs]
        back = [hashlib.sha256(y.encode()).hexdigest() for _, y in pairs]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _tokens(batches: Iterator[pa.RecordBatch], model_path: str) -> Iterator[pa.RecordBatch]:
    own = codec(model_path)
    for batch in batches:
        pairs = own.encode(texts_of(batch))
        ids = pa.array([[int(i) for i in x.split(",")] if x else [] for x, _ in pairs], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([y for _, y in pairs])], ["doc_id", "ids", "decoded"])


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: what the library's encode and decode give for each whole text.

    Null counts as empty; an empty text has no ids and decodes to the empty text. Repeated rows repeat.
    """
    return map_arrow(docs.select("doc_id", "text"), partial(_tokens, model_path=model_path), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_decode, without materialising ids as columns."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), partial(_encode, model_path=model_path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
