"""A training corpus from `documents`: five stages, each calling one operator of quirefold.llm.

Every stage works on all that its predecessor kept, and its decisions take effect: rejected documents and copies go,
repeated passages leave their documents, and what is left is packed.

Defined results of all stages: a null text counts as empty (the quality rules reject it); rows with null or repeated ids
are documents of their own, judged by their own texts; of ties the smallest id stays; very long texts are taken whole;
an empty table runs through as an empty table; extra columns are passed on unread as far as the packing stage, whatever
their names, and a table without `lang` or `n_chars` is fine.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import exact_dedup, minhash_dedup, packing, quality, substring_dedup
from quirefold.llm.store import materialize, read_table
from quirefold.sources.shared import spread


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the fertility bands reject go."""
    path = public_tokenizers.path
    return quality.keep_good(docs, path("piece_bpe_32k.model"), ranks_path=path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return minhash_dedup.drop_near_duplicates(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words or more that occur elsewhere are taken out; n_chars follows the text."""
    out = substring_dedup.remove_repeats(docs, length=35)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    path = public_tokenizers.path
    packed = packing.pack_documents(docs.select("doc_id", "text"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", packed_sequences),
]

#: Tokenisers, automata and packing have no SQL form; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spread(read_table(spark, sf_dir, "documents"))
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
