"""Conversation structure repair: Earley parsing of roles under a weighted grammar whose errors are productions of their own."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, own_prefix

#: Costs of edits, named by their letters in an audit, and of leaving a text cut short.
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
#: (head, left, role): a head is what ``left`` derives, then a turn of that role. Every head but the first may end a conversation if named so.
GRAMMAR = (("system", "nothing", "s"), ("asked", "nothing", "u"), ("asked", "system", "u"), ("asked", "answered", "u"), ("answered", "asked", "a"))
START, ENDS = "nothing", ("nothing", "answered")
_NAMES = {"u": "user", "a": "assistant"}

_BLANK, _DUPLICATE, _TRUNCATED = 1, 2, 3
_SPACE = r"\x20\x09-\x0D"
#: Rows after which the chart is tidied, and bytes of turns that are held in memory.
_TIDY, _SPOOL = 64, 4 << 20

Item = tuple[int, str]


class Chart:
    """An Earley chart over one conversation's turns, column by column.

    The grammar is left-linear: an item (head -> left . role, origin, cost, audit) has the conversation's
    start as its origin, so that a column holds one item for each ``left``, keyed by it: the cheapest, and of
    equally cheap ones the one whose audit comes first. Productions for errors go with each of GRAMMAR's: a turn of
    any role in place of the one awaited (rerole), none at all (insert), and, after every left, a turn that
    counts for nothing (delete). Two audits of equal cost over the same turns never begin with each other, as they
    would differ by keeps of no turn; so the first audit stays first whatever follows, and items may be merged.
    """

    def __init__(self) -> None:
        self.items: dict[str, Item] = {START: (0, "")}
        self.done: list[str] = []
        self.rows = 0
        self._insert()

    @staticmethod
    def _offer(column: dict[str, Item], head: str, item: Item) -> bool:
        if head not in column or item < column[head]:
            column[head] = item
            return True
        return False

    def _insert(self) -> None:
        """Completes what inserted turns complete, until no item gets better."""
        more = True
        while more:
            more = False
            for head, left, role in GRAMMAR:
                if role in _NAMES and left in self.items:
                    cost, audit = self.items[left]
                    more |= self._offer(self.items, head, (cost + COSTS["I"], audit + "I"))

    def scan(self, role: str, gone: bool, short: bool) -> None:
        """The next turn: its role's initial, whether it must be deleted, whether its text is cut short."""
        column: dict[str, Item] = {}
        extra = TRUNCATED if short else 0
        for left, (cost, audit) in self.items.items():
            self._offer(column, left, (cost + COSTS["D"], audit + "D"))
        if not gone:
            for head, left, awaited in GRAMMAR:
                if left in self.items:
                    cost, audit = self.items[left]
                    if role == awaited:
                        self._offer(column, head, (cost + COSTS["K"] + extra, audit + "K"))
                    if awaited in _NAMES:
                        self._offer(column, head, (cost + COSTS["R"] + extra, audit + "R"))
        self.items = column
        self._insert()
        self.rows += 1
        if self.rows % _TIDY == 0:
            self._tidy()

    def _tidy(self) -> None:
        """Takes out items that cannot win any more and the audits' common beginning: memory stays that of what is undecided.

        Whatever may follow a left can follow ``answered`` at 3 more (a system turn kept there is deleted here) and so, by one
        inserted turn, ``asked`` at 5 more. An end with nothing at all is no dearer after ``answered`` either.
        """
        least = min(self.items[h][0] + extra for h, extra in (("answered", COSTS["D"]), ("asked", COSTS["I"] + COSTS["D"])) if h in self.items)
        self.items = {h: i for h, i in self.items.items() if i[0] <= least}
        common = os.path.commonprefix([a for _, a in self.items.values()])
        if common:
            self.done.append(common)
            self.items = {h: (c, a[len(common) :]) for h, (c, a) in self.items.items()}

    def best(self) -> Item:
        """Cost and audit of the completed chart."""
        cost, audit = min(self.items[h] for h in ENDS if h in self.items)
        return cost, "".join(self.done) + audit


@lru_cache(maxsize=50_000)
def _known(shape: str) -> Item:
    return parse(shape)


def parse(shape: str) -> Item:
    """Cost and audit of a conversation, three signs a turn: role's initial, 1 if it must go, 1 if it is cut short."""
    chart = Chart()
    for i in range(0, len(shape), 3):
        chart.scan(shape[i], shape[i + 1] == "1", shape[i + 2] == "1")
    return chart.best()


def apply(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) turns that an audit leaves of a conversation."""
    awaited = None
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit != "K":
            role = _NAMES[awaited or "u"]
        yield role, text
        awaited = "a" if role[:1] == "u" else "u"


class _Turns:
    """A conversation's turns in order; beyond some bytes they wait in a file of the task's own."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str]] = []
        self.held, self.file = 0, None

    def add(self, role: str, text: str) -> None:
        self.rows.append((role, text))
        self.held += len(role) + len(text) + 100
        if self.held > _SPOOL:
            self.file = self.file or tempfile.TemporaryFile()
            for pair in self.rows:
                for x in pair:
                    raw = x.encode()
                    self.file.write(len(raw).to_bytes(8, "little") + raw)
            self.rows, self.held = [], 0

    def __iter__(self) -> Iterator[tuple[str, str]]:
        if self.file:
            self.file.seek(0)
            part = lambda head: self.file.read(int.from_bytes(head, "little")).decode()
            while head := self.file.read(8):
                yield part(head), part(self.file.read(8))
        yield from self.rows

    def close(self) -> None:
        if self.file:
            self.file.close()


class _Conversation:
    """What is known of one conversation while its turns pass."""

    def __init__(self, key: object):
        self.key, self.turns, self.shape, self.before = key, _Turns(), [], None
        self.faults = [0, 0, 0, 0]
        self.illegal = self.distinct = 0
        self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, fault: int, copies: int, new: bool) -> None:
        """``copies`` equal turns; ``new``: the first of them has not been seen before."""
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        initial = role[:1] or "-"
        for i in range(copies):
            own = fault if fault == _BLANK or (new and i == 0) else _DUPLICATE
            self.faults[own] += 1
            self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
            self.before = initial
            self.shape.append(f"{initial}{int(own in (_BLANK, _DUPLICATE))}{int(own == _TRUNCATED)}")
            self.turns.add(role, text)

    def repair(self) -> Item:
        shape = "".join(self.shape)
        return _known(shape) if len(shape) <= 96 else parse(shape)

    def row(self) -> dict:
        cost, audit = self.repair()
        sha, first = hashlib.sha256(), True
        for role, text in apply(audit, iter(self.turns)):
            sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        self.turns.close()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"conv_id": self.key, "gaps": gaps, "blank": self.faults[_BLANK], "duplicate": self.faults[_DUPLICATE], "truncated": self.faults[_TRUNCATED], "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": sha.hexdigest()}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Conversation]:
    """Conversations one by one from rows that are sorted by them."""
    held = None
    for batch in batches:
        for key, turn, role, text, fault, copies, new in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or held.key != key:
                if held is not None:
                    yield held
                held = _Conversation(key)
            if copies:
                held.add(turn, role, text, fault, copies, new)
    if held is not None:
        yield held


def _rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out = []
    for conversation in _runs(batches):
        out.append(conversation.row())
        if len(out) >= 2_000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema)


def _edited(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for conversation in _runs(batches):
        for i, (role, text) in enumerate(apply(conversation.repair()[1], iter(conversation.turns))):
            out.append({"conv_id": conversation.key, "position": i, "role": role, "text": text})
            size += len(text) + 50
            if size > _SPOOL:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        conversation.turns.close()
    yield pa.RecordBatch.from_pylist(out, schema)


def _counted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault, copies, new), each conversation whole and in order within a partition.

    Rows that are equal become one with their number before they are dealt out. ``new``: no earlier turn of the conversation
    has this role and text. Rows with a false ``here`` only say that a conversation exists.
    """
    here = F.col("here") if "here" in turns.columns else F.lit(True)
    one = lambda c: F.when(here, F.coalesce(F.col(c), F.lit(" ")))
    rows = turns.select("conv_id", F.when(here, F.col("turn").cast("long")).alias("turn"), one("role").alias("role"), one("text").alias("text"), here.alias("here"))
    rows = rows.groupBy("conv_id", "turn", "role", "text", "here").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.repartition("conv_id")
    text = F.col("text")
    fault = F.when(~text.rlike(f"[^{_SPACE}]"), _BLANK).when(~text.rlike(f"[.!?][{_SPACE}]*\\z"), _TRUNCATED).otherwise(0)
    again = F.row_number().over(Window.partitionBy("conv_id", "here", "role", "text").orderBy(F.asc_nulls_first("turn")))
    copies = F.when(F.col("here"), F.col("n")).otherwise(0)
    rows = rows.select("conv_id", "turn", "role", "text", F.coalesce(fault, F.lit(0)).alias("fault"), copies.alias("copies"), (again == 1).alias("new"))
    return rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, here): rows harmed by crc32 of ``conv_id:turn`` modulo 20, nulls counting as one space.

    0 drops the row (``here`` is false), 1 empties its text, 2 takes its full stops and marks away, 3 repeats it, 4 makes it the user's.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = own_prefix(conversations.columns)
    kind, text = F.col(f"{own}kind"), word("text")
    rows = conversations.withColumn(f"{own}kind", F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20)
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(word("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("here"),
        F.when(kind == 3, 2).otherwise(1).alias(f"{own}n"),
    )
    return rows.withColumn(f"{own}i", F.explode(F.sequence(F.lit(1), F.col(f"{own}n")))).drop(f"{own}n", f"{own}i")


def repaired(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``turns``: conv_id, turn, role, text and, if wanted, ``here`` (false: the row names its conversation only). A
    conversation's turns stand in order of ``turn``, nulls first, then by role and text. Null roles and texts count as one
    space; rows with a null conv_id are one conversation; other columns are not read. The repair is the cheapest
    that makes the roles ``(s?(ua)+)?`` by their initials; of equally cheap ones the audit that comes first.
    Conversations without turns have zeros, an empty audit and the digest of nothing. An empty table gives no rows.

    A conversation passes through one task, turn by turn, since the digest of its text is that of one
    sequence. The task holds three signs a turn; texts beyond 4 MB wait in a file of its own, and the chart keeps only
    what is undecided. Equal rows have become one row with a number before.
    """
    kind = turns.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *[T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return map_arrow(_counted(turns), partial(_rows, schema=_arrow(schema)), schema)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the turns of the repaired conversations; ordering, nulls and ties as in repaired()."""
    kind = turns.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return map_arrow(_counted(turns), partial(_edited, schema=_arrow(schema)), schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
