"""Resampling towards a target's distribution by hashed n-gram weights; n-grams' CRCs are combined, never their letters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, own_prefix, pieces, repeated

_STRETCH = 1 << 20
#: Words up to this many bytes are hashed in step, longer ones by zlib.
_SHORT = 48
#: Lengths up to which shifts are looked up in one step; longer ones go by powers of two.
_DIRECT = 64
_BINS = 1 << 8

#: Bytes of words: digits, letters and all of a sign beyond ASCII. A-Z are lower-cased first.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True

_POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    """CRC register after each byte, from register 0."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), t >> np.uint32(1))
    return t


_TABLE = _byte_table()


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """GF(2) product of 32 x 32 matrices; column i is a 32-bit number, the image of bit i."""
    bits = (b[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(np.where(bits == 1, a[None, :], np.uint32(0)), axis=1)


def _as_bytes(m: np.ndarray) -> np.ndarray:
    """The matrix as four tables of 256: a number's image is the xor of its bytes' entries."""
    value = np.arange(256, dtype=np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for i in range(8):
            out[k] ^= np.where(value >> np.uint32(i) & np.uint32(1), m[8 * k + i], np.uint32(0))
    return out


@cache
def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of the matrices that append zero bytes to a CRC: 0 to 63 of them, and 64, 128, 256 and so on."""
    bit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    one = _TABLE[bit & np.uint32(255)] ^ (bit >> np.uint32(8))  # a zero byte, on each bit of the register
    m, direct = bit, []
    for _ in range(_DIRECT):
        direct.append(_as_bytes(m))
        m = _product(one, m)
    doubled = []
    for _ in range(32 - _DIRECT.bit_length() + 1):
        doubled.append(_as_bytes(m))
        m = _product(m, m)
    return np.array(direct), doubled


def _apply(tables: np.ndarray, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    out = np.zeros(len(x), np.uint32)
    for k in range(4):
        byte = (x >> np.uint32(8 * k)) & np.uint32(255)
        out ^= tables[k][byte] if at is None else tables[at, k, byte]
    return out


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs moved left by so many bytes each: crc(a + b) is shifted(crc(a), len(b)) ^ crc(b)."""
    direct, doubled = _shifts()
    out = _apply(direct, crc, length % _DIRECT)
    high = length // _DIRECT
    for k, tables in enumerate(doubled):
        if not high.any():
            break
        on = np.flatnonzero(high & 1)
        out[on] = _apply(tables, out[on])
        high = high >> 1
    return out


def word_crcs(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of words in a buffer, byte by byte for all words at once."""
    order = np.argsort(np.minimum(lengths, _SHORT + 1).astype(np.uint8), kind="stable")[::-1]
    at, size = starts[order], lengths[order]
    reg = np.full(len(at), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-size, -_SHORT, "left"))
    counts = np.bincount(np.minimum(size, _SHORT), minlength=_SHORT + 1)
    reach = len(at) - np.cumsum(counts)  # reach[i]: words of more than i bytes
    for i in range(_SHORT):
        n = int(reach[i])
        if n <= long:
            break
        r = reg[long:n]
        reg[long:n] = _TABLE[(r ^ buf[at[long:n] + i]) & np.uint32(255)] ^ (r >> np.uint32(8))
    reg = ~reg
    for k in range(long):
        reg[k] = crc32(buf[at[k] : at[k] + size[k]])
    out = np.empty(len(at), np.uint32)
    out[order] = reg
    return out


def _stretches(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about _STRETCH bytes that end between words; a longer word stands whole."""
    at = 0
    while at < len(buf):
        end = at + _STRETCH
        while end < len(buf):
            gap = np.flatnonzero(~_IN_WORD[buf[end : end + _STRETCH]])
            if len(gap):
                end += int(gap[0])
                break
            end += _STRETCH
        yield at, min(end, len(buf))
        at = min(end, len(buf))


def features(texts: list[bytes], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text's number, CRC of a run of 1 to n words joined by one space, text's number once per word), stretch by stretch.

    Runs end with their text; the last words of a stretch are carried into the next.
    """
    space = np.uint32(crc32(b" "))
    for a, b in pieces(texts, len, _STRETCH):
        buf = _LOWER[np.frombuffer(b"\n".join(texts[a:b]), np.uint8)]
        bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts[a:b]), np.int64, b - a))
        held = (np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64))
        for low, high in _stretches(buf):
            part = buf[low:high]
            edge = np.zeros(len(part) + 2, np.int8)
            edge[1:-1] = _IN_WORD[part]
            turn = np.diff(edge)
            starts = np.flatnonzero(turn == 1)
            lengths = np.flatnonzero(turn == -1) - starts
            own = np.searchsorted(bounds, starts + low, "right") + a
            if not len(starts):
                continue
            fresh = len(starts)
            crc = np.concatenate((held[0], word_crcs(part, starts, lengths)))
            size = np.concatenate((held[1], lengths))
            text = np.concatenate((held[2], own))
            found, whose = [crc[len(crc) - fresh :]], [own]
            spaced = shifted(np.full(len(crc), space, np.uint32), size) ^ crc  # of the word with a space before it
            run = crc
            for k in range(1, n):
                # run[i]: of the k words from i on
                if len(crc) <= k:
                    break
                run = shifted(run[:-1], size[k:] + 1) ^ spaced[k:]
                new = (np.arange(k, len(crc)) >= len(crc) - fresh) & (text[k:] == text[:-k])
                found.append(run[new])
                whose.append(text[k:][new])
            keep = max(0, len(crc) - (n - 1))
            held = (crc[keep:], size[keep:], text[keep:])
            yield np.concatenate(whose), np.concatenate(found), own


def _bytes_of(batch: pa.RecordBatch) -> list[bytes]:
    return pc.fill_null(batch.column(batch.schema.get_field_index("text")), "").cast(pa.binary()).to_pylist()


def _count(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for _, crc, _ in features(_bytes_of(batch), n):
            total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])


def bucket_counts(docs: DataFrame, n: int = 2, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket: one partial table per task, summed up."""
    part = map_arrow(docs.select("text"), partial(_count, n=n, buckets=buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, total in part.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # a row per bucket at most
        out[bucket] = total
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Per bucket floor(scale * ln of the target's smoothed share over the source's)."""
    b, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(source.tolist(), target.tolist())], np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], n: int, gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    buckets = np.uint32(len(gain))
    for batch in batches:
        rows = batch.num_rows
        total, count, words = (np.zeros(rows, np.int64) for _ in range(3))
        for text, crc, own in features(_bytes_of(batch), n):
            first, rows_here = int(text.min()), int(text.max()) - int(text.min()) + 1
            here = slice(first, first + rows_here)
            # whole numbers well below 2^53: sums in doubles are exact
            total[here] += np.bincount(text - first, gain[crc % buckets], minlength=rows_here).astype(np.int64)
            count[here] += np.bincount(text - first, minlength=rows_here)
            words[here] += np.bincount(own - first, minlength=rows_here)
        weight = np.floor_divide(total, np.maximum(count, 1))
        rest = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(words), pa.array(count), pa.array(weight)], [*batch.schema.names[:-1], "n_words", "n_features", "weight"])


def weighed(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000) -> DataFrame:
    """n_words, n_features and weight, the mean gain of each document's features, floored (none: 0), in place of the last column, ``text``."""
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema[:-1])
    return map_arrow(docs, partial(_weigh, n=n, gain=gain), f"{kept}n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = 7, scale: int = 1000) -> Column:
    """Noise from the id alone, so that reruns and other partitionings draw the same documents; a null id is the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _ranked(docs: DataFrame, target: DataFrame, percent: int, n: int, buckets: int, min_words: int, seed: int) -> DataFrame:
    """resample() over (doc_id, further keys, text), with the further keys.

    Ranks need no sort of all rows: scores are whole numbers of a bounded range (about 2^18 of them: 1000 times a
    logarithm of counts below 2^63, plus noise between -3,200 and 22,900), so how many documents stand above each
    score comes from a histogram, and only documents of one score are ordered among themselves. Rows that are
    equal are one row with a count before they are dealt by score.
    """
    scratch, keys = Scratch(docs.sparkSession), docs.columns[:-1]
    scored = weighed(docs, target, n, buckets).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = scratch.write(scored.withColumn("fit", F.col("n_words") >= min_words).drop("n_words"), "scored")
    groups = scored.groupBy(*keys, "n_features", "weight", "score", "fit").agg(F.count(F.lit(1)).alias("copies"))
    # how many stand above each score: bins of scores first, then within a bin
    one = scored.where("fit").groupBy("score").agg(F.count(F.lit(1)).alias("here")).withColumn("bin", F.floor(F.col("score") / _BINS))
    one = scratch.write(one, "histogram")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(upto(w)), F.lit(0))
    bins = one.groupBy("bin").agg(F.sum("here").alias("all"))  # some 1,000 rows
    bins = bins.select("bin", total("all", Window.orderBy(F.desc("bin"))).alias("over"))
    above = one.join(bins, "bin").select("score", (F.col("over") + total("here", Window.partitionBy("bin").orderBy(F.desc("score")))).alias("above"))
    drawn = (one.agg(F.sum("here").alias("n")).first().n or 0) * percent // 100
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight", *keys[1:], "fit")
    fit = F.when(F.col("fit"), F.col("copies")).otherwise(F.lit(0))
    ranked = groups.withColumn("before", total(fit, order)).join(above, "score", "left")
    rank = F.col("above") + F.col("before") + F.col("copy")
    ranked = repeated(ranked, F.col("copies"), "copy")
    return ranked.select(*keys, "n_features", "weight", "score", F.when(F.col("fit") & (rank <= drawn), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, n: int = 2, buckets: int = 10_000, min_words: int = 20, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank; ``rank`` (1, 2, 3...) where it is drawn, else null.

    Gumbel noise on importance weights: the floor(percent * N / 100) highest scores of the N documents with
    ``min_words`` words or more are a sample without replacement in proportion to exp(weight / 1000). Ties go to the
    smaller doc_id (null ids last), then to fewer features and the smaller weight. Null texts have no words; rows
    that repeat each other stand side by side in rank. An empty table gives no rows; an empty target counts no
    feature, so that rare buckets weigh most. Columns beside doc_id and text are not read.
    """
    return _ranked(docs.select("doc_id", "text"), target, percent, n, buckets, min_words, seed)


def drawn_documents(docs: DataFrame, target: DataFrame, percent: int = 25, n: int = 2, buckets: int = 10_000, min_words: int = 20, seed: int = 7) -> DataFrame:
    """The documents that resample() draws, with all their columns, each as many times as rows with its id and text are drawn.

    Which of several rows with one id and text stay follows their other columns (as JSON).
    """
    columns, own = docs.columns, own_prefix(docs.columns)
    key = F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256)).alias(f"{own}key")
    ranked = _ranked(docs.select("doc_id", key, "text"), target, percent, n, buckets, min_words, seed)
    picked = ranked.where("rank is not null").groupBy(f"{own}key").agg(F.count(F.lit(1)).alias(f"{own}n"))
    rest = [F.col(f"`{c}`") for c in columns if c not in ("doc_id", "text")]
    at = F.row_number().over(Window.partitionBy(f"{own}key").orderBy(F.to_json(F.struct(F.col("text"), *rest))))
    rows = docs.select("*", key).join(picked, f"{own}key").withColumn(f"{own}at", at)
    return rows.where(f"{own}at <= {own}n").select(*[F.col(f"`{c}`") for c in columns])
