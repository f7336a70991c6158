"""Exact dedup over a persistent digest index, bucketed and sorted by digest. [DataFrame functions only]"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, exists, materialise, own_prefix, remove, repeated, shared_dir


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, lowercase hex."""
    return F.sha2(normalised(text), 256)


class DigestIndex:
    """Digests seen so far and the id that stays for each, as a bucketed, sorted Parquet table.

    New rows reach the index by a sort-merge anti-join: only the new digests are shuffled, into the
    table's own bucket layout; the index itself is read in place. The same ``path`` reopens an index in a later
    session; how many buckets it has is stored beside its data, and asking for another number raises.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or shared_dir(spark, "digests")
        layout = f"{self.path}/_layout"  # readers of the data pass over names that begin so
        held = None
        if path and exists(spark, layout):
            held = spark.read.schema("buckets int").parquet(layout).first().buckets
        if held and buckets and held != buckets:
            raise ValueError(f"the index in {self.path} has {held} buckets, not {buckets}")
        self.buckets = held or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not held:
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.parquet(layout)
        self.name = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def close(self) -> None:
        """Take the index's name out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def compact(self, path: str, buckets: int | None = None) -> "DigestIndex":
        """A copy with one file a bucket, and so sorted again as a whole, after many appends; also for another number of buckets."""
        out = DigestIndex(self.spark, path, buckets or self.buckets)
        self.table().repartition(out.buckets, "digest").write.insertInto(out.name)
        return out

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, digests: DataFrame) -> DataFrame:
        """Append the digests that are new; returns (digest, keep_id, group_size) of this batch's groups.

        ``digests``: (doc_id, digest). Of a digest seen first in this batch the smallest id stays (null
        ids only where no other exists); one that an earlier batch brought keeps that batch's id.
        """
        groups = digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        scratch = Scratch(self.spark)
        groups = scratch.write(groups, "groups")
        known = self.table().hint("merge")
        fresh = groups.join(known, "digest", "left_anti").select("digest", "keep_id")
        # the files being appended to are also read by the anti-join, so the new rows settle first
        scratch.write(fresh, "fresh").repartition(self.buckets, "digest").write.insertInto(self.name)
        # written out: the joins that follow then have exchanges on both sides, which AQE may split
        out = materialise(groups.drop("keep_id").join(self.table().hint("merge"), "digest"), "resolved")
        scratch.done()
        return out


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Equal: same text once runs of ASCII white space are one space; null is the empty text. The row with
    the smallest doc_id stays; of rows repeating that very id and text, one. A group's hot digest costs
    one partial aggregate per task, and the join that labels rows is split by AQE. doc_ids count as whole
    numbers: text that is none raises, as casts do. Extra columns are not read; an empty table gives no rows.
    """
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    digests = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digest-rows")
    resolved = index.add(digests)
    if own:
        index.close()  # what it holds has been written out
        remove(docs.sparkSession, index.path)
    counted = digests.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    out = counted.join(resolved.hint("merge"), "digest")
    return repeated(out, F.col("copies"), "copy").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_unique(docs: DataFrame) -> DataFrame:
    """The documents that exact dedup keeps, with all their columns.

    Of rows that repeat an id and, but for white space, its text, the one stays whose text comes first, then
    the one whose other columns do (as JSON). An empty table gives no rows; null texts count as empty.
    """
    columns, own = docs.columns, own_prefix(docs.columns)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(f"{own}key")
    kept = exact_dedup(docs.select("doc_id", "text")).where("kept").select(key, F.col("text_sha256").alias(f"{own}sha")).distinct()
    rows = docs.select("*", key, digest(F.col("text")).alias(f"{own}sha")).join(kept, [f"{own}key", f"{own}sha"], "left_semi")
    rest = [F.col(f"`{c}`") for c in columns if c not in ("doc_id", "text")]
    # rows that repeat an id and its text lie together already: this adds no exchange
    order = [F.col("text"), *([F.to_json(F.struct(*rest))] if rest else [])]
    first = F.row_number().over(Window.partitionBy(f"{own}key", f"{own}sha").orderBy(*order))
    return rows.withColumn(f"{own}copy", first).where(f"{own}copy = 1").select(*[F.col(f"`{c}`") for c in columns])
