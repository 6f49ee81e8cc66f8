"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.llm import exact_dedup, langid, mixing, ngram_join, pieces
from tabwright.llm.queries import MODEL_FILE
from tabwright.storage import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those that no learned language parses, go."""
    return langid.recognised(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of at least 0.8 of their 5-word shingles, the one with the smallest doc_id stays."""
    return ngram_join.representatives(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every drawn document, segmented with merge-dropout; the copies of a document are segmented differently.

    A null text has null ids and a null ``n_pieces``, an empty text no ids; an empty table gives an empty one. Rows without an id are copies where
    their texts are equal. Columns other than ``doc_id, source, text`` are left out, whatever their names.
    """
    place = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source")) - 1
    numbered = docs.select("doc_id", "source", "text").withColumn("copy", place)
    encoded = pieces.encode(numbered, MODEL_FILE, carry=["doc_id", "source"], copy="copy")
    return encoded.select("doc_id", "source", F.array_size("ids").cast("long").alias("n_pieces"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("merge_dropout", encode_pieces),
]

#: The stages learn a model, draw from generators and use a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each works on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
