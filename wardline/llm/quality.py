"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise, pieces, texts_of

#: Weakly labelled rows that the scorer is fitted on, at most, and bytes that their texts hold together.
SAMPLE, SAMPLE_BYTES = 6_000, 64 << 20
_BUCKETS = 1 << 14
_STRETCH = 200
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_STOPS = bytes(ord(c) for c in ".!?")
#: Frequent words of the languages in hand.
_COMMON = frozenset(b"the of and to in a is that for it as was with be by on not he his but der die und das den von zu mit ist ein eine nicht le la les et des une est dans pour que qui el los las de en un por con para se del".split())
LABELLERS = ("signs", "word_length", "variety", "capitals", "digits", "sentences", "common_words", "length")


def _vote(value: float, bad: bool, good: bool) -> int:
    return 0 if bad else 1 if good else -1


def votes(text: str) -> list[int]:
    """One vote per labeller: 1 good, 0 poor, -1 none. They overlap on purpose; none is trusted alone."""
    raw = text.encode()
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return [-1] * (len(LABELLERS) - 1) + [0]
    letters = max(1, size - n)
    count = lambda of: size - len(raw.translate(None, of)) if raw else 0
    signs, upper, digits = (count(x) / letters for x in (_SIGNS, _UPPER, _DIGITS))
    lower = raw.lower().split()
    # share of distinct words in stretches of a fixed length: long texts are no less varied for being long
    kinds = sum(len(set(lower[i : i + _STRETCH])) for i in range(0, n, _STRETCH)) / n
    ends = count(_STOPS) / n
    mean = letters / n
    common = sum(map(_COMMON.__contains__, lower)) / n
    return [
        _vote(signs, signs > 0.12, signs < 0.06),
        _vote(mean, mean < 2.5 or mean > 9.5, 3.5 < mean < 8),
        _vote(kinds, kinds < 0.25, kinds > 0.35),
        _vote(upper, upper > 0.3, upper < 0.1),
        _vote(digits, digits > 0.15, digits < 0.03),
        _vote(ends, ends > 0.5 or (ends < 0.01 and n > 60), 0.03 < ends < 0.3),
        _vote(common, common < 0.08, common > 0.2),
        _vote(n, n < 15, n > 60),
    ]


@dataclass
class LabelModel:
    """prior[class]; table[labeller, class, vote + 1]: how a labeller votes on a class."""

    prior: np.ndarray
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) for rows of votes."""
        log = np.log(self.prior)[None, :] + sum(np.log(self.table[j][:, patterns[:, j] + 1]).T for j in range(patterns.shape[1]))
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(axis=1)

    def accuracy(self) -> np.ndarray:
        """Per labeller: the estimated share of its votes that are right."""
        said = self.table[:, :, 1:] * self.prior[None, :, None]
        return (said[:, 0, 0] + said[:, 1, 1]) / said.sum(axis=(1, 2))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
    """Labeller behaviour and class prior from counted vote patterns alone, starting from the majority.

    A smoothing count in favour of labellers being right more often than not keeps the classes from swapping.
    """
    agree = ((patterns == 1).sum(1) + 0.5) / ((patterns >= 0).sum(1) + 1)
    good = np.where(agree > 0.7, 0.9, np.where(agree < 0.5, 0.1, 0.5)).astype(float)
    smooth = np.ones((patterns.shape[1], 2, 3))
    smooth[:, 0, 1] = smooth[:, 1, 2] = 4
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts], axis=1)
        table = smooth.copy()
        for j in range(patterns.shape[1]):
            for v in (-1, 0, 1):
                table[j, :, v + 1] += weight[patterns[:, j] == v].sum(axis=0)
        model = LabelModel((weight.sum(0) + 1) / (weight.sum() + 2), table / table.sum(axis=2, keepdims=True))
        good = model.posterior(patterns)
    return model


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 1- to 3-grams of the whole text and their weights, of unit length per order."""
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    idx, val = [np.zeros(1, np.int64)], [np.array([min(1.0, len(raw) / 400)])]
    h = np.zeros(len(raw), np.uint32)
    for n in (1, 2, 3):
        if len(raw) < n:
            break
        h = h[: len(raw) - n + 1] * np.uint32(257) + raw[n - 1 :] + np.uint32(1)
        mixed = h * np.uint32(0x9E3779B1)
        c = np.bincount((mixed ^ (mixed >> np.uint32(15))) % np.uint32(_BUCKETS - 1), minlength=_BUCKETS - 1)
        at = np.flatnonzero(c)
        idx.append(at + 1)
        val.append(c[at] / np.linalg.norm(c[at]))
    return np.concatenate(idx), np.concatenate(val)


def fit_scorer(texts: Sequence[str], good: Sequence[float], epochs: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adagrad; returns weights and bias."""
    rng = np.random.default_rng(seed)
    rows, y = [features(t) for t in texts], np.asarray(good, float)
    w, g, bias, gb = np.zeros(_BUCKETS), np.full(_BUCKETS, 1e-6), 0.0, 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 32):
            own = order[at : at + 32]
            z = np.array([rows[i][1] @ w[rows[i][0]] for i in own]) + bias
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[own]) / len(own)
            idx = np.concatenate([rows[i][0] for i in own])
            d = np.bincount(idx, np.concatenate([e * rows[i][1] for e, i in zip(err, own)]), _BUCKETS)
            g += d * d
            w -= 0.3 * d / np.sqrt(g)
            gb += err.sum() ** 2
            bias -= 0.3 * err.sum() / np.sqrt(gb)
    return w, float(bias)


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [votes(t) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["".join("?01"[v + 1] for v in row) for row in found], pa.string())], ["doc_id", "votes"])


def _score(batches: Iterator[pa.RecordBatch], model: LabelModel, w: np.ndarray | None, bias: float) -> Iterator[pa.RecordBatch]:
    """Without ``w`` the score is the posterior."""
    known: dict[str, float] = {}
    for batch in batches:
        for a, b in pieces(texts := texts_of(batch), len, 8 << 20):
            rows = [votes(t) for t in texts[a:b]]
            names = ["".join("?01"[v + 1] for v in r) for r in rows]
            for name, r in zip(names, rows):
                if name not in known:
                    known[name] = float(model.posterior(np.array([r]))[0])
            posterior = np.array([known[x] for x in names])
            score = posterior
            if w is not None:
                z = np.array([v @ w[i] for i, v in map(features, texts[a:b])]) + bias
                score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(names), pa.array(posterior), pa.array(score)], ["doc_id", "votes", "posterior", "score"])


def quality(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, votes, posterior, score, predicted for every row and whole text; no given labels are used.

    votes: one sign per labeller (1, 0 or ? for none). Counts of all vote patterns in the corpus (3 to the
    number of labellers at most) tell, by expectation-maximisation, how often each labeller is right;
    posterior is P(good) given the votes. The linear scorer learns the posteriors of at most ``sample``
    rows, one of each id (of its texts the first), the first in a hashed order of ids, as far as these hold ``sample_bytes``
    together; score is its P(good), predicted whether that is 0.5 or more. Where there is nothing to fit, since every id is null
    or the first text is larger than that, the score is the posterior.
    Null and empty texts get the length labeller's vote alone. With no rows at all nothing is returned; repeated rows repeat, extra columns are not read.
    """
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    labelled = materialise(map_arrow(rows, _label, f"doc_id {kind}, votes string"), "votes")
    counted = labelled.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()  # at most 3^8 patterns
    if not counted:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, votes string, posterior double, score double, predicted int")
    patterns = np.array([["?01".index(c) - 1 for c in r.votes] for r in counted])
    model = expectation_maximisation(patterns, np.array([r.n for r in counted], float))
    chosen = F.broadcast(labelled.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    one = rows.join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    # ``sample`` rows, and so many of them as ``sample_bytes`` hold, reach the driver
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    texts = sorted(tuple(r) for r in one.withColumn("upto", upto).where(F.col("upto") <= sample_bytes).select("doc_id", "text").collect())
    texts = [t for _, t in texts]
    w, bias = fit_scorer(texts, model.posterior(np.array([votes(t) for t in texts]))) if texts else (None, 0.0)
    schema = f"doc_id {kind}, votes string, posterior double, score double"
    out = map_arrow(rows, partial(_score, model=model, w=w, bias=bias), schema)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
