"""License scans: template markup compiled into token automata, beside plain phrases."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, texts_of

#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices in template markup: <<beginOptional>> ... <<endOptional>> may be absent (and may nest);
#: <<var;name="..";original="..";match="..">> stands for the words that match allows.
TEMPLATES = {
    "gpl-notice": '<<beginOptional>>this work is<<endOptional>> licensed under the <<beginOptional>>gnu<<endOptional>> general public license<<beginOptional>> version <<var;name="version";original="3";match="[0-9]+">><<beginOptional>> or later<<endOptional>><<endOptional>>',
    "cc-notice": 'licensed under <<beginOptional>>a <<endOptional>><<var;name="name";original="cc";match="(cc|creative commons)">> by<<beginOptional>> <<var;name="terms";original="nc";match="(nc|sa|nd|nc sa|nc nd)">><<endOptional>> <<var;name="version";original="4.0";match="[0-9]+ [0-9]+">>',
    "mit-notice": '<<var;name="verb";original="released";match="(released|licensed|distributed)">> under the <<beginOptional>>terms of the <<endOptional>>mit license',
    "apache-notice": '<<var;name="verb";original="licensed";match="(released|licensed|distributed)">> under the <<beginOptional>>terms of the <<endOptional>>apache license<<beginOptional>> version <<var;name="version";original="2.0";match="[0-9]+( [0-9]+)?">><<endOptional>>',
    "reserved-notice": '<<beginOptional>>copyright <<beginOptional>>c <<endOptional>><<var;name="year";original="2020";match="[0-9]{4}">> <<var;name="holder";original="the authors";match=".{1,120}">> <<endOptional>>all rights reserved',
    "mit": """<<beginOptional;name="title">>MIT License<<endOptional>> <<beginOptional;name="copyright">>Copyright <<beginOptional>>(c) <<endOptional>><<var;name="holder";original="<year> <holders>";match=".{0,500}">><<endOptional>>
Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="what";original="this software and associated documentation files (the Software)";match=".{1,200}">>, to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL <<var;name="who";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".{1,200}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """<<beginOptional;name="title">>ISC License<<endOptional>> <<beginOptional;name="copyright">>Copyright <<beginOptional>>(c) <<endOptional>><<var;name="holder";original="<year> <holders>";match=".{0,500}">><<endOptional>>
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="who";original="THE AUTHOR";match=".{1,100}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL <<var;name="whom";original="THE AUTHOR";match=".{1,100}">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}

_SIGNS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_MARKUP = re.compile(r'<<(beginOptional(?:;[^>]*)?|endOptional|var;(?:[^"]|"[^"]*")*?)>>', re.S)
_ATTRIBUTE = re.compile(r'(\w+)="([^"]*)"')
_ANY = re.compile(r"\.(\+|\*|\{(\d*),?(\d*)\})")

_PIECE = re.compile(r"\[[^\]]*\]|\{[^}]*\}|\\.|.", re.S)
_BARE = set("-,/:;\"'_&@#%")


def words_of(text: str) -> list[str]:
    """A-Z lower-cased; words are runs of letters, digits and signs beyond ASCII."""
    return [w.decode() for w in text.encode().translate(_SIGNS).split()]


@dataclass
class Region:
    """What may stand for a replaceable part: any words of ``low`` to ``high`` signs in all (None: any number), or
    words that ``pattern`` matches, joined by single spaces, in any case."""

    low: int = 0
    high: int | None = None
    pattern: regex.Pattern | None = None

    @classmethod
    def of(cls, match: str) -> "Region":
        if found := _ANY.fullmatch(match):
            many, low, high = found.groups()
            if many in "+*":
                return cls(int(many == "+"))
            return cls(int(low or 0), int(high) if high else None if "," in many else int(low or 0))
        # signs outside classes and counts: words are what is left between them
        plain = _PIECE.sub(lambda m: " ?" if m[0] in _BARE or m[0][0] == "\\" and not m[0][1:].isalnum() else m[0], match)
        return cls(pattern=regex.compile(plain, regex.I))

    def empty(self) -> bool:
        return self.pattern.fullmatch("") is not None if self.pattern else self.low == 0

    def ends(self, words: list[str], start: int) -> Iterator[int]:
        """Where runs of words from ``start`` on that the region matches end; the empty run is not among them."""
        run = ""
        for at in range(start, len(words)):
            run = f"{run} {words[at]}" if run else words[at]
            if self.pattern:
                if self.pattern.fullmatch(run):
                    yield at + 1
                elif not self.pattern.fullmatch(run, partial=True) and not self.pattern.fullmatch(run + " ", partial=True):
                    return
            elif self.high is not None and len(run) > self.high:
                return
            elif len(run) >= self.low:
                yield at + 1
                if self.high is None:
                    return  # the state behind the region goes on by itself


@dataclass
class Automaton:
    """A token automaton: arcs[state] lists (word, next), jumps[state] the states reached by reading nothing,
    regions[state] (region, next); loops are the states that any word leads back to."""

    arcs: list[list[tuple[str, int]]] = field(default_factory=lambda: [[]])
    jumps: list[list[int]] = field(default_factory=lambda: [[]])
    regions: list[list[tuple[Region, int]]] = field(default_factory=lambda: [[]])
    loops: set[int] = field(default_factory=set)
    end: int = 0

    def state(self) -> int:
        for x in (self.arcs, self.jumps, self.regions):
            x.append([])
        return len(self.arcs) - 1

    def match(self, words: list[str], start: int) -> int | None:
        """Where the longest accepted run of words from ``start`` ends; None if there is none."""
        due: dict[int, set[int]] = {start: {0}}
        best = None
        at = start
        while due:
            states = due.pop(at, set())
            todo = list(states)
            while todo:
                s = todo.pop()
                for t in self.jumps[s]:
                    if t not in states:
                        states.add(t)
                        todo.append(t)
            if self.end in states:
                best = at
            if at < len(words):
                for s in states:
                    for w, t in self.arcs[s]:
                        if words[at] == w:
                            due.setdefault(at + 1, set()).add(t)
                    if s in self.loops:
                        due.setdefault(at + 1, set()).add(s)
                    for region, t in self.regions[s]:
                        for end in region.ends(words, at):
                            due.setdefault(end, set()).add(t)
            at += 1
        return best

    def opening(self) -> tuple[set[str], bool]:
        """Words that a match may begin with, and whether any other may."""
        states, todo = {0}, [0]
        while todo:
            for t in self.jumps[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return {w for s in states for w, _ in self.arcs[s]}, any(self.regions[s] or s in self.loops for s in states)


def compile_template(template: str) -> Automaton:
    """Mandatory words become arcs, optional parts ways around them, replaceable parts regions as long as their pattern allows."""
    out, open_, at = Automaton(), [], 0
    for i, piece in enumerate(_MARKUP.split(template)):
        if i % 2 == 0:
            if "<<" in piece and ">>" in piece:
                raise ValueError(f"unknown markup in {piece!r}")
            for w in words_of(piece):
                to = out.state()
                out.arcs[at].append((w, to))
                at = to
        elif piece.startswith("beginOptional"):
            open_.append(at)
        elif piece == "endOptional":
            if not open_:
                raise ValueError("endOptional without beginOptional")
            to = out.state()
            out.jumps[at].append(to)
            out.jumps[open_.pop()].append(to)
            at = to
        else:
            match = dict(_ATTRIBUTE.findall(piece)).get("match")
            if match is None:
                raise ValueError(f"no match in {piece!r}")
            region, to = Region.of(match), out.state()
            out.regions[at].append((region, to))
            if region.empty():
                out.jumps[at].append(to)
            if region.pattern is None and region.high is None:
                # its first words are the region's; whatever follows leads back here
                out.loops.add(to)
                after = out.state()
                out.jumps[to].append(after)
                if region.empty():
                    out.jumps[at][-1] = after
                to = after
            at = to
    if open_:
        raise ValueError("beginOptional without endOptional")
    if len(out.arcs) == 1:
        raise ValueError("a template without words or regions accepts nothing")
    out.end = at
    return out


def required_words(template: str) -> set[str]:
    """Words that every accepted text holds: the mandatory ones outside optional parts."""
    depth, out = 0, set()
    for i, piece in enumerate(_MARKUP.split(template)):
        if i % 2 == 0:
            out |= set(words_of(piece)) if depth == 0 else set()
        else:
            depth += piece.startswith("beginOptional") - (piece == "endOptional")
    return out


def matches_template(text: str, template: str) -> bool:
    """Whether the text as a whole is the template's: mandatory wording exact, optional and replaceable parts as marked."""
    words = words_of(text)
    return compile_template(template).match(words, 0) == len(words)


class Scanner:
    """Phrases and templates over whole texts."""

    def __init__(self, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES):
        self.phrases = {tuple(p.split()): label for p, label in phrases.items()}
        made = [(label, compile_template(t), required_words(t)) for label, t in templates.items()]
        # an automaton, the words that a text must hold, and the words that a match may begin with (None: any)
        self.templates = [(label, a, {w.encode() for w in must}, None if a.opening()[1] else a.opening()[0]) for label, a, must in made]

    def scan(self, text: str) -> dict:
        """n_words, places [(start, label)] of phrases, spans [(start, end, label)] of templates."""
        words = text.encode().translate(_SIGNS).split()
        held = set(words)
        places, spans = [], []
        phrases = [p for p in self.phrases if held.issuperset(w.encode() for w in p)]
        templates = [t for t in self.templates if held.issuperset(t[2])]
        n = len(words)
        if phrases or templates:
            words = [w.decode() for w in words]
            for p in phrases:
                at = -1
                while True:
                    try:
                        at = words.index(p[0], at + 1)
                    except ValueError:
                        break
                    if tuple(words[at : at + len(p)]) == p:
                        places.append((at, self.phrases[p]))
            for label, auto, _, first in templates:
                at = 0
                while at < n:
                    end = auto.match(words, at) if first is None or words[at] in first else None
                    if end is None or end == at:  # an empty match is none
                        at += 1
                    else:
                        spans.append((at, end, label))
                        at = end
        return {"n_words": n, "places": sorted(places), "spans": sorted(spans)}


def _scan(batches: Iterator[pa.RecordBatch], phrases: Mapping[str, str], templates: Mapping[str, str]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(phrases, templates)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
    for batch in batches:
        found = [scanner.scan(t) for t in texts_of(batch)]
        size = {label: len(p) for p, label in scanner.phrases.items()}
        places = [[{"start": a, "end": a + size[x], "label": x} for a, x in f["places"]] for f in found]
        spans = [[{"start": a, "end": b, "label": x} for a, b, x in f["spans"]] for f in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f["n_words"] for f in found], pa.int64()), pa.array(places, span), pa.array(spans, span)], ["doc_id", "n_words", "places", "spans"])


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, places and spans (start, end, label; words from 0) of phrases and of templates.

    Phrases: all places where their words stand consecutively. Templates: longest matches, left to right,
    without overlaps per template; mandatory wording must match exactly, empty matches do not count. What a region
    matches is as long as its own pattern allows. Extra columns are not read; an empty table gives no rows. Null and empty texts have no
    words; repeated rows repeat. Reads whole texts in one pass without an exchange.
    """
    span = "array<struct<start: long, end: long, label: string>>"
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), partial(_scan, phrases=dict(phrases), templates=dict(templates)), f"doc_id {kind}, n_words long, places {span}, spans {span}")
