"""Corpus pipeline: toxicity, exact dedup, near-dedup, source mixing, SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import exact_dedup, mixing, near_dedup, sentencepiece_codec, toxicity
from wardline.llm.common import passing, remove, shared_dir
from wardline.llm.queries import piece_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels of the documents at hand.

    Null and empty texts get the prior's score, repeated rows go or stay together, extra columns stay; no rows give none.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays; null is the empty text, ties and extra columns as in keep_unique()."""
    return exact_dedup.keep_unique(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the smallest doc_id stays; nulls and ties as in keep_representatives()."""
    return near_dedup.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: none, one or two rows; nulls and repeated rows as in mixed_documents()."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every row's text and what they decode to, as counts and digests; null is the empty text."""
    return sentencepiece_codec.digests(docs, piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The toxicity model and the near-duplicate signatures are beyond SQL; a test holds every stage's rows to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again by the next.

    What a stage wrote on its way goes once its result is written, a stage's result once the next one's is. An
    empty table passes through; null texts count as empty, rows with null ids are documents too.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        with passing(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
