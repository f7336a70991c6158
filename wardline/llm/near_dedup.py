"""BagMinHash near-dedup: weighted Jaccard over multisets of five-word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, mix64, own_prefix, pieces, texts_of, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: 32 bands of 4: a pair at similarity 0.8 shares no band with probability 5e-8.
BANDS, ROWS = 32, 4
_CHUNK = 1 << 20
_PLACE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_U64 = np.uint64


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of k words; of a shorter text, one of all its words; of no words, none."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, k, _U64)
    for j in range(k):
        out = out + words[j : n - k + 1 + j] * _PLACE[j % len(_PLACE)] + _U64(j // len(_PLACE))
        if k > len(_PLACE):
            out = mix64(out)
    return mix64(out)


def text_digest(words: np.ndarray) -> tuple[int, int]:
    """128 bits of the word sequence."""
    at = np.arange(1, len(words) + 1, dtype=_U64)
    a = mix64(words + at * _PLACE[0]).sum(dtype=_U64) + _U64(len(words))
    b = mix64(words ^ (at * _PLACE[1])).sum(dtype=_U64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def bag_signatures(doc: np.ndarray, item: np.ndarray, count: np.ndarray, docs: int, size: int) -> np.ndarray:
    """BagMinHash signatures, (docs, size): P(equal components of two bags) is their weighted Jaccard.

    ``doc``, ``item``, ``count``: each bag's distinct items with multiplicities. Weights are integers, so
    unit levels discretise them without loss. Levels (0,1], (1,2], (2,4], (4,8] ... of an item each carry
    a Poisson process of the range's length as rate, seeded by item and range alone. A point's unit level
    within its range comes from successive halvings (its bits); levels above the weight do not count.
    Points come in ascending order and end for an item once they exceed the bag's largest component.
    """
    h = np.full(docs * size, np.inf)
    top = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)  # index of the highest range
    owner = np.repeat(np.arange(len(item)), top + 1)
    rung = np.arange(len(owner)) - np.repeat(np.cumsum(top + 1) - top - 1, top + 1)
    width = np.where(rung == 0, 1, 1 << np.maximum(rung - 1, 0)).astype(np.int64)
    low = np.where(rung == 0, 0, width)
    seed, d, weight = mix64(item[owner] + rung.astype(_U64) * _PLACE[2]), doc[owner], count[owner]
    x, step = np.zeros(len(owner)), 0
    while len(owner):
        r = mix64(seed + _U64((2 * step + 1) * int(_PLACE[3]) & (1 << 64) - 1))
        s = mix64(r ^ _PLACE[4])
        x = x - np.log((((r >> _U64(11)).astype(np.float64)) + 0.5) * 2.0**-53) / width
        # the low bits choose component and level; the high ones of r gave the waiting time
        level = low + 1 + ((s >> _U64(32)) & (width - 1).astype(_U64)).astype(np.int64)
        slot = d * size + (s & _U64(0xFFFFFFFF)).astype(np.int64) % size
        hit = (level <= weight) & (x < h[slot])
        np.minimum.at(h, slot[hit], x[hit])
        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))  # doc stays sorted
        limit = h.reshape(docs, size)[d[first]].max(axis=1)
        on = x <= np.repeat(limit, np.diff(np.append(first, len(d))))
        owner, seed, d, weight, x, width, low = owner[on], seed[on], d[on], weight[on], x[on], width[on], low[on]
        step += 1
    return h.reshape(docs, size)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.view(_U64).reshape(len(sig), bands, rows)
    out = np.zeros((len(sig), bands), _U64) + np.arange(1, bands + 1, dtype=_U64) * _PLACE[0]
    for j in range(rows):
        out = mix64(out ^ mix64(bits[:, :, j] + _PLACE[1]))
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, t1, t2, texts = batch.column(0), batch.column(2), batch.column(3), [t.encode() for t in texts_of(batch)]
        for a, b in pieces(texts, len, _CHUNK):
            words, at = word_hashes(texts[a:b])
            bags, digests = [], []
            for i in range(b - a):
                own = words[at[i] : at[i + 1]]
                digests.append(text_digest(own))
                bags.append(np.unique(shingles(own), return_counts=True))
            n = [len(u) for u, _ in bags]
            sig = bag_signatures(np.repeat(np.arange(b - a), n), np.concatenate([u for u, _ in bags]), np.concatenate([c for _, c in bags]).astype(np.int64), b - a, bands * rows)
            keys = band_keys(sig, bands, rows)
            lists = [k if m else None for k, m in zip(keys, n)]  # without words: no keys, no links
            d1, d2 = (pa.array([x[j] for x in digests], pa.int64()) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([ids[a:b], t1[a:b], t2[a:b], d1, d2, pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "t1", "t2", "d1", "d2", "keys"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's shingle multiset as one sorted set: an item's repetition number is part of its hash."""
    for batch in batches:
        ids, texts = batch.column(0), [t.encode() for t in texts_of(batch)]
        for a, b in pieces(texts, len, _CHUNK):
            words, at = word_hashes(texts[a:b])
            out = []
            for i in range(b - a):
                u, c = np.unique(shingles(words[at[i] : at[i + 1]]), return_counts=True)
                nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                out.append(np.sort(mix64(np.repeat(u, c) + nth.astype(_U64) * _PLACE[0])).tobytes())
            yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(out, pa.binary())], ["id", "bag"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), _U64), np.frombuffer(y.as_buffer(), _U64)
            at = np.searchsorted(x, y)
            both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
            score.append(both / (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], ["a", "b", "score"])


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, label): the smallest id of each id's connected component, for ids that edges (a, b) name.

    Large-star and small-star turns until all that is left are stars; every turn is written to the shared folder.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    materialise = scratch.write
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = materialise(edges.select(low.alias("a"), high.alias("b")).where("a < b").distinct(), "links")
    while True:
        ends = links.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
        odd = ends.groupBy("id").agg(F.max("up").alias("up"), F.sum("down").alias("down")).where("down > 1 or (up = 1 and down = 1)")
        if odd.isEmpty():
            break
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        # large star: each id's larger neighbours hang on its smallest neighbour
        large = materialise(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct(), "large")
        # small star: each id and its smaller neighbours hang on the smallest of them
        least = materialise(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        joined = large.join(least, "b")
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).union(joined.select(F.col("m").alias("a"), "b"))
        links = materialise(small.where("a < b").distinct(), "links")
    return links.select(F.col("b").alias("id"), F.col("a").alias("label")).union(links.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct())


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per item of each bag."""
    for batch in batches:
        items = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        n = [len(x) for x in items]
        for a, b in pieces(n, int, 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items[a:b])), batch.column(0)[a:b].take(pa.array(np.repeat(np.arange(b - a), n[a:b])))], ["element", "id"])


def _possible(rows: DataFrame, bags: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): every pair of rows (id, l, minor), a minor, of different l whose bags can reach ``similarity``.

    Exact: bags of na and nb items at that similarity share o = s / (1 + s) (na + nb) items at least. With all
    bags in one order, rarest items first, let their first common item be a's k-th and b's j-th (from 0): they
    share na - k and nb - j items at most, so b has (na - k) (1 + s) / s - na items at most, and likewise a.
    """
    materialise = scratch.write
    known = bags.join(rows, "id")
    size = materialise(known.select("id", "l", "minor", (F.length("bag") / 8).cast("long").alias("n")), "bag-facts")
    items = materialise(map_arrow(known.select("id", "bag"), _elements, "element long, id long"), "elements")
    count = items.groupBy("element").agg(F.count(F.lit(1)).alias("f"))
    k = F.row_number().over(Window.partitionBy("id").orderBy("f", "element")) - 1
    ranked = items.join(count, "element").join(size, "id").withColumn("k", k)
    ranked = ranked.where((F.col("f") > 1) & (F.col("k") <= (1 - similarity) * F.col("n") + 1e-6))
    most = (F.col("n") - F.col("k")) * ((1 + similarity) / similarity) - F.col("n") + 1e-6
    rare = materialise(ranked.select("element", "id", "l", "minor", "n", most.alias("most")), "rare")
    own = rare.where("minor").select("element", F.col("id").alias("a"), F.col("l").alias("la"), F.col("n").alias("na"), F.col("most").alias("most_a"))
    may = (F.col("la") != F.col("l")) & (F.col("n") <= F.col("most_a")) & (F.col("na") <= F.col("most"))
    return own.join(rare, "element").where(may).select("a", F.col("id").alias("b"))


class _Verifier:
    """Exact multiset overlap of candidate pairs; remembers the links found."""

    def __init__(self, bags: DataFrame, similarity: float, scratch: Scratch):
        self.bags, self.similarity, self.scratch, self.links, self.tried = bags, similarity, scratch, None, None

    def try_pairs(self, pairs: DataFrame) -> None:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = self.scratch.write(pairs, "pairs")
        one = self.bags.select(F.col("id").alias("a"), F.col("bag").alias("x"))
        two = self.bags.select(F.col("id").alias("b"), F.col("bag").alias("y"))
        rows = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
        links = self.scratch.write(map_arrow(rows, _overlap, "a long, b long, score double").where(F.col("score") >= self.similarity), "similar")
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        self.links = links if self.links is None else self.links.union(links)

    def labels(self) -> DataFrame:
        return self.scratch.write(components(self.links.select("a", "b"), self.scratch), "labels")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    one, two = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    both = pairs.join(one, "a", "left").join(two, "b", "left")
    return both.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _text_marks() -> list[Column]:
    """128 bits of the text as it is written, which the rows of one word sequence may differ in."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest doc_id of its class), n_links, kept.

    Classes are the connected components of links: same word sequence, or multiset Jaccard of five-word
    shingles of at least ``similarity`` (texts of fewer words have one shingle: all their words). n_links:
    verified links of the row's text to other texts, at least those that hold its class together. Texts
    without words are copies of each other and link to nothing else; null counts as empty. Rows are told
    apart by their texts, also where they share a doc_id or have none; a null doc_id comes first. Of each
    class one text of one doc_id is kept; rows that repeat both are one document. doc_ids count as whole numbers: text that is
    none raises, as casts do. Extra columns are not read; an empty table gives no rows.

    Same texts collapse before anything else. A band bucket's texts are first tried against its head, the one
    that shares most buckets with others (of a base and its variants, the base): a star, linear in the
    bucket. Texts of buckets that still hold different components are then tried against those texts that
    share one of their rarest shingles, which no pair similar enough can avoid. No link between components
    is lost, and a group of mutual copies never yields all its pairs.
    """
    return _classes(docs, similarity, bands, rows).select("doc_id", "class_id", "n_links", "kept")


def _classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """near_dedup with the marks of each row's text, t1 and t2."""
    none = -(2**63)
    scratch = Scratch(docs.sparkSession)
    materialise = scratch.write
    t1, t2 = _text_marks()
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("doc_id"), "text", t1.alias("t1"), t2.alias("t2"))
    signed = materialise(map_arrow(docs, partial(_sign, bands=bands, rows=rows), "doc_id long, t1 long, t2 long, d1 long, d2 long, keys array<long>"), "signed")
    # ids of distinct word sequences, in the order of their smallest doc_ids
    reps = signed.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("m")).select(F.col("m.doc_id").alias("doc"), "d1", "d2", "m.t1", "m.t2")
    reps = reps.repartitionByRange("doc", "d1", "d2").sortWithinPartitions("doc", "d1", "d2")
    reps = materialise(reps.withColumn("id", F.monotonically_increasing_id()), "reps")
    keys = signed.where(F.col("keys").isNotNull()).groupBy("d1", "d2").agg(F.first("keys").alias("keys"))
    own = keys.join(reps, ["d1", "d2"]).select("id", F.explode("keys").alias("key"))
    bucket = materialise(own, "buckets")
    sizes = materialise(bucket.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    bucket = materialise(bucket.join(sizes, "key"), "shared")
    weight = materialise(bucket.groupBy("id").agg(F.sum(F.col("n") - 1).alias("w")), "weights")
    heads = bucket.join(weight, "id").groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("a"))).alias("h"))
    heads = materialise(heads.select("key", (-F.col("h.a")).alias("a"), "h.w"), "heads")
    star = materialise(bucket.join(heads, "key").where("id <> a").groupBy("a", F.col("id").alias("b")).agg(F.max("w").alias("w")), "star")

    wanted = reps.join(weight, "id").select("id", F.col("doc").alias("doc_id"), "t1", "t2")
    texts = docs.join(wanted, ["doc_id", "t1", "t2"]).groupBy("id").agg(F.min("text").alias("text"))
    check = _Verifier(materialise(map_arrow(texts, _bags, "id long, bag binary"), "bags"), similarity, scratch)
    # 1: each text against its heaviest head; 2: against its other heads, unless it hangs on the same text already
    check.try_pairs(star.groupBy("b").agg(F.max(F.struct("w", (-F.col("a")).alias("a"))).alias("h")).select((-F.col("h.a")).alias("a"), "b"))
    check.try_pairs(_apart(star, check.links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label"))))
    # 3: what shares a bucket and is still apart
    labels = check.labels()
    inside = bucket.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("l"))
    most = inside.groupBy("key", "l").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "l")).alias("top"), F.count(F.lit(1)).alias("k"))
    inside = inside.join(most.where("k > 1").select("key", F.col("top.l").alias("main")), "key")
    open_ = materialise(inside.groupBy("id").agg(F.min("l").alias("l"), F.max(F.col("l") != F.col("main")).alias("minor")), "open")
    check.try_pairs(_possible(open_, check.bags, similarity, scratch))

    labels, links = check.labels(), check.links
    degree = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    named = reps.join(labels, "id", "left").join(degree, "id", "left").withColumn("first", F.coalesce("label", "id"))
    named = named.join(reps.select(F.col("id").alias("first"), F.col("doc").alias("class_id")), "first")
    # the row that a class keeps: of its first text, as its smallest doc_id writes it
    head = F.when(F.col("first") == F.col("id"), F.struct("t1", "t2")).alias("head")
    named = named.select("d1", "d2", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), head)
    out = signed.drop("keys").join(materialise(named, "named").hint("merge"), ["d1", "d2"])
    kept = (F.col("doc_id") == F.col("class_id")) & F.struct("t1", "t2").eqNullSafe(F.col("head"))
    real = lambda c: F.when(F.col(c) != none, F.col(c)).alias(c)
    scratch.done(out)
    return out.select(real("doc_id"), real("class_id"), "n_links", kept.alias("kept"), "t1", "t2")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The documents that near-dedup keeps, with all their columns: the smallest doc_id of each class.

    Rows that repeat a kept row's id and text all stay; an empty table gives no rows; ids and nulls as in near_dedup.
    """
    columns, own = docs.columns, own_prefix(docs.columns)
    names = [f"{own}{c}" for c in ("key", "t1", "t2")]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    kept = _classes(docs.select("doc_id", "text")).where("kept").select(key.alias(names[0]), F.col("t1").alias(names[1]), F.col("t2").alias(names[2])).distinct()
    rows = docs.select("*", *[c.alias(n) for c, n in zip((key, *_text_marks()), names)]).join(kept, names, "left_semi")
    return rows.select(*[F.col(f"`{c}`") for c in columns])
