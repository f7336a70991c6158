"""Shared folders, Arrow batch plumbing and vectorised word hashing."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as every operator of this subpackage understands it: [\x20\x09-\x0D].
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a temporary folder takes its place on a local master; a cluster raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="wardline-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{_below.get()}{name}-{uuid.uuid4().hex}"


#: Folder below the shared one that shared_dir() uses within passing(), for each thread its own.
_below: contextvars.ContextVar[str] = contextvars.ContextVar("below", default="")


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What operators write to the shared folder in this block goes at its end: results must be written by then."""
    path = shared_dir(spark, "passing")
    before = _below.set(f"{_below.get()}{path.rsplit('/', 1)[1]}/")
    try:
        yield
    finally:
        _below.reset(before)
        remove(spark, path)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _hadoop(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that an operator wrote for itself and that no result reads any more."""
    for path in paths:
        files, where = _hadoop(spark, path)
        files.delete(where, True)


class Scratch:
    """Tables that one run of an operator writes out; done() removes all but those that its result reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(path := shared_dir(self.spark, name))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def done(self, *keep: DataFrame) -> None:
        held = [f for df in keep for f in df.inputFiles()]
        remove(self.spark, *[p for p in self.paths if not any(p.rsplit("/", 1)[1] in f for f in held)])
        self.paths = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, executors may be lost after it."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a scan (file sizes); needs no job and works for every store.

    Where there is no estimate: 16 MB for each shuffle partition that the session asks for.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) << 24


def own_prefix(columns: Iterable[str]) -> str:
    """A prefix that no column's name begins with, for helper columns beside them."""
    names, out = [c.lower() for c in columns], "__"
    while any(c.startswith(out) for c in names):
        out += "_"
    return out


def repeated(df: DataFrame, times: Column, name: str) -> DataFrame:
    """Each row ``times`` times, numbered from 1 in ``name``; no array of more than 65,536 numbers is ever made."""
    own, step = own_prefix([*df.columns, name]), 1 << 16
    df = df.withColumn(f"{own}n", times.cast("long")).where(f"{own}n > 0")
    df = df.withColumn(f"{own}block", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col(f"{own}n") - 1, 16))))
    first = F.col(f"{own}block") * step + 1
    last = F.least(F.col(f"{own}n"), first + (step - 1))
    return df.withColumn(name, F.explode(F.sequence(first, last))).drop(f"{own}n", f"{own}block")


def crc_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


_SLICE = 2 << 20
_STRETCH = 1 << 20


def slices(batches: Iterable[pa.RecordBatch], most: int = _SLICE) -> Iterator[pa.RecordBatch]:
    """The batches' rows in views of about ``most`` bytes: what Python makes of a batch stays small."""
    for batch in batches:
        if batch.num_rows == 0:
            yield batch
            continue
        sizes = np.full(batch.num_rows, batch.nbytes / batch.num_rows)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        number = np.cumsum(sizes) // most
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1, [batch.num_rows]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a < b:
                yield batch.slice(a, b - a)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over small slices of the batches; the worker gives back what memory it can at the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(slices(batches))
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Freed memory goes back to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def pieces(items: list, size: Callable[[object], int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about ``most`` units; an item larger than that stands alone, whole."""
    start = total = 0
    for i, x in enumerate(items):
        n = size(x)
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(items):
        yield start, len(items)


def mix64(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _P), ("down", _P_INV)):
                a = np.full(max(n, 1 << 20), base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words in a buffer."""
    edge = np.empty(len(buf) + 2, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = _SPACE[buf]
    return np.flatnonzero(edge[:-1] & ~edge[1:]), np.flatnonzero(~edge[:-1] & edge[1:])


def word_hashes(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and offsets[i]: where text i's words begin.

    A word's hash is a polynomial in an odd base modulo 2^64, taken from one prefix sum over a buffer of
    texts, then finalised; it depends on the word's bytes alone. Very long texts are worked through in
    stretches that end with a word, so that memory besides the hashes themselves stays bounded.
    """
    texts = list(texts)
    hashes, counts = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    for a, b in pieces(texts, len, _STRETCH):
        buf = np.frombuffer(b"\n".join(texts[a:b]), np.uint8)
        starts = []
        for low, high in _stretches(buf):
            first, found = _hash_stretch(buf[low:high])
            starts.append(first + low)
            hashes.append(found)
        starts = np.concatenate(starts) if starts else np.empty(0, np.int64)
        bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts[a:b]), np.int64, b - a))
        counts.append(np.diff(np.searchsorted(starts, bounds), prepend=0))
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def _stretches(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about _STRETCH bytes; each but the last ends before white space, a longer word stands whole."""
    at = 0
    while at < len(buf):
        end = at + _STRETCH
        while end < len(buf):
            space = np.flatnonzero(_SPACE[buf[end : end + _STRETCH]])
            if len(space):
                end += int(space[0])
                break
            end += _STRETCH
        end = min(end, len(buf))
        yield at, end
        at = end


def _hash_stretch(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = word_spans(buf)
    up, down = _POWERS.get(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return starts, mix64((sums[ends] - sums[starts]) * down[starts])


class WordTable:
    """What has been worked out for distinct words, bytes or text, in memory bounded by bytes.

    Two generations: once the young one holds ``most`` bytes it becomes the old one, and an empty one takes
    its place. Words met again move from the old into the young, so what drops out has not come up for a whole
    generation. It may be worked out again; results never differ.
    """

    #: Bytes of an entry besides its letters: two objects' heads and their share of the dictionary.
    ENTRY = 200

    def __init__(self, most: int):
        self.most, self.of, self.old, self.held = most, {}, {}, 0

    def fresh(self, words: set[str]) -> list[str]:
        """Those of ``words`` that have yet to be put() into the table; all others can be read from ``of`` from now on."""
        if self.held > self.most:
            self.old, self.of, self.held = self.of, {}, 0
        out, old, of = [], self.old.get, self.of
        for w in words.difference(of):
            if (known := old(w)) is None:
                out.append(w)
            else:
                of[w] = known
                self.held += self.ENTRY + len(w) + len(known)
        return out

    def put(self, word: str, value: bytes | str) -> None:
        self.of[word] = value
        self.held += self.ENTRY + len(word) + len(value)
