"""Token ids in Arrow files of equal-length sequences with masks."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .common import input_bytes, map_arrow, materialise, pieces, shared_dir, texts_of

SEQUENCE = 1024
_PER_BATCH = 256
_SHARD_BYTES = 16 << 20


def _schema(length: int, kind: np.dtype) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(kind), False), length), False), pa.field("real", pa.int32(), False)])


#: Schemes that Hadoop and Arrow call by different names.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss"}


def arrow_uri(uri: str) -> str:
    """A Hadoop URI as Arrow's file systems know it; paths without a scheme are local, as in ``file:/a``."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return "file://" + uri
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return f"{_SCHEMES.get(scheme, scheme)}:{rest}"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(arrow_uri(uri))


class ShardWriter:
    """One shard: a stream of ids cut into sequences of ``length``; the last is padded.

    ``real`` says how many ids of a sequence are no padding, which comes last: all that a mask holds.

    Each record batch holds ``_PER_BATCH`` sequences as fixed-size lists without offsets or nulls, so the
    place of any id follows from its number alone.
    """

    def __init__(self, folder: str, shard: int, length: int, kind: np.dtype):
        self.fs, self.folder = filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name = shard_name(shard)
        self.draft = f"{self.folder}/_{self.name}-{uuid.uuid4().hex}"
        self.schema, self.length, self.kind = _schema(length, kind), length, kind
        self.sink = self.fs.open_output_stream(self.draft)
        self.out = ipc.new_file(self.sink, self.schema)
        self.held: list[bytes] = []
        self.size = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= 4 * self.length * _PER_BATCH * self.kind.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.kind)
        step = self.length * _PER_BATCH
        whole = len(ids) if last else len(ids) // step * step
        for at in range(0, whole, step):
            part = ids[at : min(at + step, whole)]
            room = -len(part) % self.length
            values = np.concatenate((part, np.zeros(room, self.kind)))
            real = np.full(len(values) // self.length, self.length, np.int32)
            real[-1] -= room
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values), type=self.schema.field("ids").type)
            self.out.write_batch(pa.record_batch([lists, pa.array(real)], schema=self.schema))
        self.held, self.size = ([], 0) if last else ([ids[whole:].tobytes()], (len(ids) - whole) * self.kind.itemsize)

    def close(self) -> None:
        """The shard gets its name once it is whole; a task that runs again puts the same bytes there."""
        self._flush(True)
        self.out.close()
        self.sink.close()
        self.fs.move(self.draft, f"{self.folder}/{self.name}")


def shard_name(shard: int) -> str:
    return f"shard-{shard:07d}.arrow"


class ShardReader:
    """Random access to a shard; arrays are views of the file's own memory where it can be mapped."""

    def __init__(self, folder: str, shard: int):
        files, path = filesystem(folder)
        path = f"{path}/{shard_name(shard)}"
        self.source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self.file = ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        # the mask of a sequence with n real ids is a view of this from place length - n on
        self._masks = np.repeat([True, False], self.length)
        self._held: tuple = (-1, None)

    def __enter__(self) -> "ShardReader":
        return self

    def __exit__(self, *_: object) -> None:
        self.source.close()

    def batch(self, i: int) -> pa.RecordBatch:
        if self._held[0] != i:
            self._held = i, self.file.get_batch(i)
        return self._held[1]

    def _flat(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        b = self.batch(i)
        return b.column(0).values.to_numpy(zero_copy_only=True), b.column(1).to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i, both views."""
        (ids, real), row = self._flat(i // _PER_BATCH), i % _PER_BATCH
        first = self.length - int(real[row])
        return ids[row * self.length : (row + 1) * self.length], self._masks[first : first + self.length]

    def real(self, start: int, n: int) -> int:
        """How many of the n places from ``start`` on the masks mark as ids."""
        out = 0
        for i in range(start // self.length, -(-(start + n) // self.length)) if n else ():
            mask = self.sequence(i)[1]
            low = i * self.length
            out += int(mask[max(0, start - low) : start + n - low].sum())
        return out

    def ids(self, start: int, n: int) -> np.ndarray:
        """The n ids from the shard's id number ``start`` on: a view, unless they lie in several batches."""
        step = self.length * _PER_BATCH
        parts = []
        while n > 0:
            flat, _ = self._flat(start // step)
            parts.append(flat[start % step : start % step + n])
            if not len(parts[-1]):
                raise ValueError(f"the shard ends before id {start}")
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end: int, length: int) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    shard, writer, at = TaskContext.get().partitionId(), None, 0
    stop = np.array([end], own.kind).tobytes()
    for batch in batches:
        texts = texts_of(batch)
        for a, b in pieces(texts, len, 2 << 20):
            writer = writer or ShardWriter(folder, shard, length, own.kind)
            n = []
            for ids in own.encode(texts[a:b]):
                writer.add(ids + stop)
                n.append(len(ids) // own.kind.itemsize + 1)
            offsets = at + np.concatenate(([0], np.cumsum(n)))
            at = int(offsets[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.full(b - a, shard)), pa.array(offsets[:-1]), pa.array(n, pa.int64())], ["doc_id", "shard", "offset", "n_tokens"])
    if writer:
        writer.close()


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end: int = 2, length: int = SEQUENCE) -> DataFrame:
    """Encode whole texts, append ``end`` to each, and write them in ascending doc_id order as shards.

    Returns the index: doc_id, shard, offset (ids before it in its shard), n_tokens (with the end id); the
    index is written once all shards are. Null texts count as empty, null ids come first, rows that repeat
    an id follow each other by text. A shard holds one range of doc_ids: about 16 MB of input files, 256 MB of very large inputs.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = input_bytes(docs)
    # shards grow once there are thousands: a range exchange samples a few ids per shard on the driver
    n = max(1, min(-(-size // _SHARD_BYTES), 4096 + size // (16 * _SHARD_BYTES)))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    fn = partial(_write, folder=folder, path=tokenizer_path, end=end, length=length)
    return materialise(map_arrow(rows, fn, "doc_id long, shard long, offset long, n_tokens long"), "token-index")


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    reader, held = None, None
    for batch in batches:
        crc, real = [], []
        for shard, offset, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            if shard != held:
                if reader:
                    reader.source.close()
                reader, held = ShardReader(folder, shard), shard
            real.append(reader.real(offset, n))
            crc.append(zlib.crc32(reader.ids(offset, n).astype("<u4").tobytes()))
        columns = [*batch.columns[:3], pa.array(real, pa.int64()), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "offset", "n_tokens", "ids_crc32"])
    if reader:
        reader.source.close()


def read_back(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """What the shards hold: doc_id, start (ids of all documents before it), n_tokens (places that masks mark), ids_crc32.

    ``index``: as write_shards() returns it, and no other; an empty one gives no rows. Documents that repeat an id
    have a row each; a shard that ends too early raises.
    """
    rows = index.repartition("shard").sortWithinPartitions("shard", "offset")
    read = map_arrow(rows, partial(_read, folder=folder), "doc_id long, shard long, offset long, n_tokens long, ids_crc32 long")
    # one row per shard
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("shard", before.alias("before"))
    return read.join(starts, "shard").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "shard", "offset")


def tokenize(docs: DataFrame, tokenizer_path: str, end: int = 2) -> DataFrame:
    """Write all documents as shards below the shared folder and describe each from what the files hold.

    Null and empty texts are their end id alone; null ids come first; repeated rows each count; an empty table gives no rows.
    """
    folder = shared_dir(docs.sparkSession, "tokens")
    return read_back(docs.sparkSession, write_shards(docs, tokenizer_path, folder, end), folder)
