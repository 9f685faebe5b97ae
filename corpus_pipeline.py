"""Corpus cleaning: toxic documents go, then copies, then near copies, then benchmark passages; what is left is
encoded. Every stage works on all that the one before it kept.

All stages: null and empty texts are texts without words; very long ones are read whole; a null id stays null;
repeated rows fare alike, but that copies go; no rows give none; columns beyond those of documents are carried to
the last stage, whatever they are called."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tideline.llm import bpe, decontaminate, near_dedup, stream_dedup, toxicity
from tideline.llm.common import materialised, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model calls toxic go. It is trained on labelled rows; without those of both classes all stay."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with the same text, but for white space, the one with the smallest id stays; null and empty texts
    are one text, so one of them stays. A row without an id only stays where none has one."""
    return stream_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8; of each group the smallest id stays. Texts without words and rows
    without an id stay."""
    return near_dedup.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of ten words are cut out and n_chars counted again; texts of which more than half the words are hit
    go as a whole. Null item texts have no windows; without items all rows stay as they are."""
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"), length_column="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids; a row for each row. Texts without characters have no ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", cut_benchmark),
    ("byte-level BPE", encode),
]
#: Trained grades and similarity groups are not SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialised(docs, name.replace(" ", "-"))
    return docs
