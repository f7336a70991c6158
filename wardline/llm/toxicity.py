"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_fold, map_arrow, own_prefix, pieces, texts_of
from .subwords import Subwords, words_only

#: Labelled rows that a model is fitted on, at most: clean ones, toxic ones; and bytes that their texts hold together.
SAMPLE, SAMPLE_BYTES = (2_000, 1_000), 64 << 20
THRESHOLD = 0.3
_BUCKETS, _DIM, _EPOCHS, _RATE, _BATCH, _GAIN = 1 << 16, 4, 10, 0.15, 50, 30.0


@dataclass
class SubwordModel:
    """Embeddings of hashed n-grams, and the softmax's weights and biases for two classes."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def table(self) -> np.ndarray:
        """What each bucket adds to the difference of the two classes' logits: scoring needs no more."""
        return (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64) * _GAIN

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def fit(texts: Sequence[str], toxic: Sequence[int], base_rate: float, seed: int = 7) -> SubwordModel:
    """Joint training of embeddings and softmax by minibatch Adagrad; ``base_rate`` sets the prior.

    The sample is drawn by class, so the bias is moved by the log odds between it and ``base_rate``.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(toxic, np.int64)
    rows = [f for a, b in pieces(list(texts), len, 1 << 20) for f in Subwords([words_only(t) for t in texts[a:b]], _BUCKETS).features()]
    emb = rng.normal(0, 0.05, (_BUCKETS, _DIM)).astype(np.float32)
    w = rng.normal(0, 0.3, (_DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    ge, gw, gb = np.full(_BUCKETS, 1e-8, np.float32), np.full_like(w, 1e-8), np.full(2, 1e-8, np.float32)
    for _ in range(_EPOCHS if len(y) else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(order), _BATCH):
            own = order[at : at + _BATCH]
            idx = np.concatenate([rows[i][0] for i in own])
            val = np.concatenate([rows[i][1] for i in own]) * np.float32(_GAIN)
            ends = np.cumsum([0] + [len(rows[i][0]) for i in own])
            flat = val[:, None] * emb[idx]
            mean = np.stack([flat[a:b].sum(0) for a, b in zip(ends[:-1], ends[1:])])
            z = mean @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p /= len(own)
            d_mean = p @ w.T
            d_w, d_b = mean.T @ p, p.sum(0)
            used, back = np.unique(idx, return_inverse=True)
            row = np.repeat(np.arange(len(own)), np.diff(ends))
            d_e = np.stack([np.bincount(back, val * d_mean[row, k], len(used)) for k in range(_DIM)], 1).astype(np.float32)
            ge[used] += (d_e**2).mean(1)
            emb[used] -= _RATE * d_e / np.sqrt(ge[used])[:, None]
            gw += d_w**2
            w -= _RATE * d_w / np.sqrt(gw)
            gb += d_b**2
            bias -= _RATE * d_b / np.sqrt(gb)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    prior = float(np.clip(base_rate, 1e-3, 1 - 1e-3))
    bias = bias + np.array([0, np.log(prior / (1 - prior)) - np.log(share / (1 - share))], np.float32)
    return SubwordModel(emb, w, bias)


def fit_on(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> SubwordModel:
    """Fit on labelled documents outside the held-out fold: crc32(doc_id as text) mod 4 is not 2.

    At most ``sample`` rows of either label, the first in a hashed order of their ids, as far as these hold ``sample_bytes``
    together. With no labelled rows every score is the prior. Labels that are null or name no document are left out; of several labels
    of one document the highest counts.
    """
    open_ = labels.where(crc_fold(F.col("doc_id"), 4) != 2).where("toxic in (0, 1) and doc_id is not null")
    open_ = open_.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r.n for r in open_.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picks = [open_.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[k]) for k in (0, 1)]
    picked = F.broadcast(picks[0].union(picks[1]))  # as many rows as ``sample`` at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id")
    # one text of each id, the first: at most ``sample`` rows reach the driver, however often an id repeats
    one = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = sorted(one.withColumn("upto", upto).where(F.col("upto") <= sample_bytes).select("doc_id", "text", "toxic").collect())
    return fit([r.text for r in rows], [r.toxic for r in rows], totals.get(1, 0) / max(1, sum(totals.values())))


def _score(batches: Iterator[pa.RecordBatch], table: np.ndarray, offset: float, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [words_only(t) for t in texts_of(batch)]
        out = np.zeros(len(texts))
        for a, b in pieces(texts, len, 1 << 20):
            out[a:b] = Subwords(texts[a:b], len(table)).text_means(table)
        score = 1 / (1 + np.exp(-np.clip(out + offset, -500, 500)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, name])


def with_score(docs: DataFrame, model: SubwordModel, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the text's score, 0 to 1. Reads nothing but ``text``; adds no exchange."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    out = map_arrow(docs, partial(_score, table=model.table(), offset=model.offset(), name=name), schema)
    return out


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= 0.3).

    Every row and whole text is scored; null and empty texts get the prior's score. Repeated rows get equal
    scores. Only ``text`` enters a score.
    """
    model = fit_on(docs, labels)
    out = with_score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, with all their columns; repeated rows stay or go together, null texts count as empty."""
    model, name = fit_on(docs, labels), own_prefix(docs.columns) + "toxicity"
    return with_score(docs, model, name).where(F.col(name) < THRESHOLD).drop(name)
