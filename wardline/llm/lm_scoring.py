"""LM scoring by a weighted backoff automaton over smoothed n-grams.

No executor and no driver ever holds the whole model. Documents form blocks of some megabytes. Each block
counts its own n-grams; the counts meet, by ranges of the n-grams' hashes, where totals over the corpus are
added up; totals go back to just those blocks that asked. A block then has exactly the part of the
automaton that its texts can reach, and traverses it.

A block sends a row to each of ``FAN`` ranges at most. Where that makes ranges too large, groups of blocks
meet first, their added counts are dealt to finer ranges, and so on, level by level; totals come back the
same way. Rows and bytes exchanged on each level grow with the input, and no range does.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_fold, input_bytes, map_arrow, materialise, mix64, pieces, texts_of, word_hashes

ORDER = 3
#: Weight of the lower order in Dirichlet smoothing.
MU = 40.0
_BLOCK, _RANGE_BYTES = 4 << 20, 6 << 20
#: Ranges that one block or group of blocks sends rows to, at most; ranges per level.
FAN = 256
#: Tasks of an exchange, at most: each works through its ranges or blocks one after the other.
_TASKS = 20_000
_END = np.uint64(0x5851F42D4C957F2D)
_LEVEL = np.uint64(7)
_TURN = np.uint64(0xDA942042E4DD58B5)
_ROWS = "block string, part long, payload binary, v long, n long"
_FIELDS = pa.schema([("block", pa.string()), ("part", pa.int64()), ("payload", pa.binary()), ("v", pa.int64()), ("n", pa.int64())])


def _row(block: list[str], part: list[int], payload: list[bytes], v: list[int] | None = None, n: list[int] | None = None) -> pa.RecordBatch:
    zero = [0] * len(block)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((block, part, payload, v or zero, n or zero), _FIELDS)], schema=_FIELDS)


def _pack(x: np.ndarray) -> bytes:
    """Byte planes of the array, compressed: high bytes of small numbers cost nothing."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def _unpack(x: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(x), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


class Block:
    """A block's tokens and n-grams. Keys: 61 bits of hash and, in the low three, the order."""

    def __init__(self, texts: list[bytes], order: int):
        words, at = word_hashes([t.lower() for t in texts])
        self.n_tokens = np.diff(at) + 1
        tokens = np.insert(words, at[1:], _END)
        self.ends = np.cumsum(self.n_tokens)
        self.starts = self.ends - self.n_tokens
        place = np.arange(len(tokens)) - np.repeat(self.starts, self.n_tokens)
        grams, keys, self.at = tokens, [], []
        for k in range(1, order + 1):
            if k > 1:
                longer = mix64(np.concatenate(([np.uint64(0)], grams[:-1])) * _TURN + tokens)
                grams = longer
            where = np.flatnonzero(place >= k - 1)
            self.at.append(where)
            keys.append((mix64(grams[where] + np.uint64(k)) & ~_LEVEL) | np.uint64(k))
        self.keys, self.back = np.unique(np.concatenate(keys), return_inverse=True)

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """How often each key occurs in the chosen documents."""
        mask = np.repeat(chosen, self.n_tokens)
        return np.bincount(self.back, np.concatenate([mask[a] for a in self.at]), len(self.keys)).astype(np.uint32)

    def by_place(self, totals: np.ndarray) -> list[np.ndarray]:
        """Per order: the total of the n-gram that ends at each token; 0 where a text is too short yet."""
        out, at = [], 0
        for where in self.at:
            c = np.zeros(int(self.ends[-1]) if len(self.ends) else 0)
            c[where] = totals[self.back[at : at + len(where)]]
            at += len(where)
            out.append(c)
        return out


def _cuts(keys: np.ndarray, prefix: int, level: int, fan: int) -> np.ndarray:
    """Where each of the ``fan`` equal parts of range ``prefix`` of ``fan ** level`` begins in the sorted keys."""
    marks = np.array([((prefix * fan + j) << 64) // fan ** (level + 1) for j in range(1, fan)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, marks), [len(keys)]))


def _dealt(name: str, keys: np.ndarray, counts: np.ndarray, prefix: int, level: int, fan: int) -> pa.RecordBatch:
    """Sorted keys and their counts as one row for each part of the range that holds any."""
    cut = _cuts(keys, prefix, level, fan)
    full = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
    packed = [_pack(np.diff(keys[cut[i] : cut[i + 1]], prepend=np.uint64(0))) for i in full]
    seen = [_pack(counts[cut[i] : cut[i + 1]].astype(np.uint64)) for i in full]
    return _row([name] * len(full), [prefix * fan + i for i in full], [len(a).to_bytes(4, "little") + a + b for a, b in zip(packed, seen)])


def _gathered(rows: pa.Table) -> tuple[list[str], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """A range's rows: their names and keys, all distinct keys, where each row's keys are among them, their summed counts."""
    keys, counts = [], []
    for payload in rows.column("payload").to_pylist():
        n = int.from_bytes(payload[:4], "little")
        keys.append(np.cumsum(_unpack(payload[4 : 4 + n], np.uint64), dtype=np.uint64))
        counts.append(_unpack(payload[4 + n :], np.uint64))
    unique, back = np.unique(np.concatenate(keys), return_inverse=True)
    return rows.column("block").to_pylist(), keys, unique, back, np.bincount(back, np.concatenate(counts), len(unique)).astype(np.uint64)


def _answers(names: list[str], part: list[int], keys: list[np.ndarray], back: np.ndarray, totals: np.ndarray, v: int = 0, n: int = 0) -> pa.Table:
    """Each row's totals in its own order."""
    ends, rest = np.cumsum([len(k) for k in keys]), [0] * (len(names) - 1)
    packed = [_pack(totals[back[e - len(k) : e]]) for e, k in zip(ends, keys)]
    return pa.Table.from_batches([_row(names, part, packed, [v, *rest], [n, *rest])])


def _block_texts(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Consecutive documents in blocks of some megabytes. A name tells where a block is from and what it holds."""
    place, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def close() -> tuple[str, pa.RecordBatch]:
        nonlocal number, held, size
        rows, crc = pa.concat_batches(held), 0
        for i, t in zip(rows.column(0).to_pylist(), rows.column(1)):
            crc = zlib.crc32(t.as_buffer(), zlib.crc32(str(i).encode(), crc))
        name = f"{place}-{number}-{crc:08x}"
        number, held, size = number + 1, [], 0
        return name, rows

    for batch in batches:
        texts = [t.encode() for t in texts_of(batch)]
        rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), batch.column(2)], ["doc_id", "text", "learn"])
        for a, b in pieces(texts, len, _BLOCK):
            more = sum(map(len, texts[a:b]))
            if held and size + more > _BLOCK:
                yield close()
            held.append(rows[a:b])
            size += more
    if held:
        yield close()


def _count(batches: Iterator[pa.RecordBatch], order: int, fan: int) -> Iterator[pa.RecordBatch]:
    """Each block's n-grams and training counts, by range."""
    for name, rows in _blocks(batches):
        block = Block(rows.column(1).to_pylist(), order)
        yield _dealt(name, block.keys, block.counts(rows.column(2).to_numpy(zero_copy_only=False)), 0, 0, fan)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same blocks' documents, compressed, as part -1."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for name, rows in _blocks(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
            out.write_batch(rows)
        yield _row([name], [-1], [sink.getvalue().to_pybytes()])


def _combine(level: int, fan: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def combine(key: tuple, rows: pa.Table) -> pa.Table:
        """One range of one group of members: their added counts, dealt to the range's parts."""
        part, group = (k.as_py() for k in key)
        _, _, unique, _, counts = _gathered(rows)
        return pa.Table.from_batches([_dealt(str(group), unique, counts, part, level, fan)])

    return combine


def _hand_down(rows: pa.Table, totals: pa.Table) -> pa.Table:
    """The totals of a range's parts, which its group asked for, to the group's members."""
    names, keys, unique, back, _ = _gathered(rows)
    order = np.argsort(totals.column("part").to_numpy(), kind="stable").tolist()
    payload = totals.column("payload").to_pylist()
    return _answers(names, rows.column("part").to_pylist(), keys, back, np.concatenate([_unpack(payload[i], np.uint64) for i in order]))


def _total(rows: pa.Table) -> pa.Table:
    """One finest range of n-grams: add up all counts and answer each row in its own order."""
    names, keys, unique, back, totals = _gathered(rows)
    single = (unique & _LEVEL) == 1
    v, n = int((totals[single] > 0).sum()), int(totals[single].sum())
    return _answers(names, rows.column("part").to_pylist(), keys, back, totals, v, n)


def _exchange(counted: DataFrame, parts: int, fan_most: int, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """Totals of all keys for each block (block, part, payload), training tokens, and kinds of them."""
    depth = 1
    while fan_most**depth < parts:
        depth += 1
    fan, tasks = math.ceil(parts ** (1 / depth) - 1e-9), min(parts, _TASKS)
    rows, saved = counted(fan), []
    for level in range(1, depth):
        group = F.pmod(F.xxhash64("block"), F.lit(fan ** (depth - level)))
        rows = scratch.write(rows.withColumn("g", group), f"level-{level}")
        saved.append(rows)
        dealt = rows.repartition(tasks, "part", "g").groupBy("part", "g")
        rows = dealt.applyInArrow(_combine(level, fan), _ROWS)
    totals = scratch.write(rows.repartition(tasks, "part").groupBy("part").applyInArrow(_total, _ROWS), "totals")
    sums = totals.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    for rows in reversed(saved):
        asked = totals.select((F.col("part") / fan).cast("long").alias("range"), F.col("block").cast("long").alias("g"), "part", "payload")
        totals = scratch.write(rows.groupBy("part", "g").cogroup(asked.groupBy("range", "g")).applyInArrow(_hand_down, _ROWS), "totals")
    return totals, int(sums.n or 0), int(sums.v or 0)


class Automaton:
    """The part of the backoff automaton that one block can reach, laid out along its tokens.

    States are contexts of up to order - 1 tokens that training texts hold; state 0 is the empty one. For
    the token at place i, ``arc[k][i]`` is the weight of the arc with this token out of the state of k
    tokens before it (nan: there is none), ``fail[k][i]`` the weight of that state's failure arc to the
    state of k - 1 tokens. Weights are log10 of Dirichlet-smoothed probabilities, so arcs and failures of
    a state sum to one.
    """

    def __init__(self, block: Block, totals: np.ndarray, n: int, v: int, mu: float):
        count = block.by_place(totals)
        self.unigram = np.log10((count[0] + 1) / (n + v + 1))
        lower = 10.0**self.unigram
        self.arc, self.fail = [self.unigram], [np.zeros(len(lower))]
        for k in range(1, len(count)):
            context = np.concatenate(([0.0], count[k - 1][:-1]))
            context[block.starts] = 0
            p = np.where(context > 0, (count[k] + mu * lower) / (context + mu), lower)
            with np.errstate(divide="ignore"):
                self.arc.append(np.where(count[k] > 0, np.log10(p), np.nan))
            self.fail.append(np.log10(mu / (context + mu)))
            lower = p
        self.known = count[0] > 0

    def traverse(self, block: Block) -> np.ndarray:
        """One left-to-right pass over all texts in step, each carrying its state and its sum."""
        docs = np.argsort(-block.n_tokens, kind="stable")
        state = np.zeros(len(docs), np.int64)
        total = np.zeros(len(docs), np.longdouble)
        live = len(docs)
        most = len(self.arc) - 1
        lengths, starts = block.n_tokens[docs], block.starts[docs]
        for step in range(int(lengths[0]) if live else 0):
            while lengths[live - 1] <= step:
                live -= 1
            at, s = starts[:live] + step, state[:live]
            weight = np.zeros(live)
            for k in range(most, 0, -1):
                here = s == k
                if not here.any():
                    continue
                gain = self.arc[k][at]
                none = here & np.isnan(gain)
                weight = np.where(none, weight + self.fail[k][at], weight)
                s = np.where(none, k - 1, s)
                # arcs of order k + 1 lead to the longest context they end with
                took = here & ~none
                weight = np.where(took, weight + np.where(took, gain, 0), weight)
                s = np.where(took, -min(k + 1, most) - 1, s)
            base = s == 0
            weight = np.where(base, weight + self.arc[0][at], weight)
            s = np.where(base, np.where(self.known[at], -min(1, most) - 1, -1), s)
            state[:live] = -s - 1
            total[:live] += weight
        out = np.empty(len(docs))
        out[docs] = total.astype(np.float64)
        return out


def _score(rows: pa.Table, order: int, n: int, v: int, mu: float) -> pa.Table:
    parts = [*zip(rows.column("part").to_pylist(), rows.column("payload").to_pylist())]
    parts.sort()
    docs = _block_texts(parts.pop(0)[1]) if parts[0][0] < 0 else None
    block = Block(docs.column(1).to_pylist(), order) if docs else None
    totals = np.concatenate([np.empty(0), *(_unpack(x, np.uint64) for _, x in parts)])
    if block is None or len(totals) != len(block.keys):
        raise RuntimeError("the files read changed between the two readings")
    auto = Automaton(block, totals, n, v, mu)
    cut = block.starts
    base = np.add.reduceat(auto.unigram.astype(np.longdouble), cut).astype(np.float64)
    known = np.add.reduceat(auto.known.astype(np.int64), cut)
    score = auto.traverse(block)
    learn = docs.column(2).to_numpy(zero_copy_only=False)
    return pa.Table.from_arrays(
        [docs.column(0), pa.array(~learn), pa.array(block.n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(known), n)), pa.array(base), pa.array(score)],
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def _is_scan(df: DataFrame) -> bool:
    """Whether the rows come straight from files, and so in the same order each time."""
    nodes = re.findall(r"^[\s:+\-]*(?:!|')?(\w+)", df._jdf.queryExecution().optimizedPlan().toString(), re.M)
    return set(nodes) <= {"Project", "Filter", "Relation"}


def lm_scores(docs: DataFrame, order: int = ORDER, mu: float = MU, folds: int = 7, held_out: int = 2, range_bytes: int = _RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row and whole text.

    ``docs`` is read twice; what is no plain scan of files is written out first, so that both readings agree.

    Learns from rows whose crc32(doc_id as text) mod ``folds`` is not ``held_out`` (null ids: the empty
    text). Tokens: words between ASCII white space, A-Z lower-cased, then one end per text. base_score is
    the add-one unigram log10 probability, score that of the smoothed n-gram model of ``order``; with
    nothing to learn from, all counts are 0. Null and empty texts are their end alone. Repeated rows each
    count, and score alike. An empty table gives no rows; extra columns are not read. A text is worked on
    whole, in memory some forty times its size.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not _is_scan(docs):
        docs = materialise(docs, "lm-documents")
    size = input_bytes(docs)
    parts = max(8 if size < 64 << 20 else 64, size // range_bytes)
    rows = docs.withColumn("learn", crc_fold(F.col("doc_id"), folds) != held_out)
    totals, n, v = _exchange(lambda f: map_arrow(rows, partial(_count, order=order, fan=f), _ROWS), parts, fan, scratch)
    scratch.done(totals)
    both = map_arrow(rows, _texts, _ROWS).unionByName(totals).repartition(max(1, min(size // _BLOCK, _TASKS)), "block")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.groupBy("block").applyInArrow(lambda rows: _score(rows, order, n, v, mu), out)
