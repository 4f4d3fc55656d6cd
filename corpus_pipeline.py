"""From raw documents to encoded training text: each stage is one of the training-data operators and works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import encoding, exact_dedup, language_id, mixing, simhash
from sedimenta.llm.common import drop_folder, free_name, new_folder, table
from sedimenta.llm.queries import model_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, or unlike every language learned, go."""
    add = tuple(free_name(docs, f"pipeline_{x}") for x in ("lang", "score", "entropy", "rejected"))
    return language_id.identify(docs, language_id.learn(docs), add=add).where(~F.col(add[-1])).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the row with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out at random so that sources get weights in proportion to the square root of their sizes, in random order."""
    return mixing.mix_sources(docs, add=tuple(free_name(docs, f"pipeline_{x}") for x in ("copy", "copies", "order"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document's whole text, checked by decoding."""
    return encoding.encode_pieces(docs, model_path())


STAGES = [
    ("language identification", identify_language),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix),
    ("piece encoding", encode),
]

#: The fingerprints' components and the piece encoding have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; what each returns is written to the shared folder and read again, and removed when the next stage is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
