"""The registered queries of the training-data operators: thin calls with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding, exact_dedup, language_id, license_scan, mixing, personal_data, quality_rules, simhash, warc
from .common import table
from .sql import SQL


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.round_trip(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_pieces(table(spark, sf_dir, "documents"), model_path())


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.token_counts(table(spark, sf_dir, "documents"), model_path())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = language_id.identify(docs.select("doc_id", "text"), language_id.learn(docs))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def queries() -> dict:
    import corpus_pipeline

    own = (op1_quality_rules, op2_mixing, op3_exact_dedup, op4_license_scan, op5_personal_data, op6_simhash, op7_warc, op8_piece_encoding, op9_token_counts, op10_language_id)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
