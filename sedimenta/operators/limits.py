"""Limits, resuming and run summaries over chunks and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def limit_bytes(chunks: DataFrame, most: int) -> DataFrame:
    """The first chunks of each evidence up to ``most`` bytes read (overlap included); the last one is shortened.  For plans without content: a run has the source do the same arithmetic."""
    order = Window.partitionBy("evidence").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    out = chunks.withColumn("before", F.coalesce(F.sum("length").over(order), F.lit(0))).where(F.col("before") < most)
    left = F.lit(most) - F.col("before")
    return out.withColumn("length", F.least("length", left)).withColumn("valid_length", F.least("valid_length", left)).drop("before")


def limit_chunks(chunks: DataFrame, most: int) -> DataFrame:
    return chunks.where(F.col("chunk_id") < most)


def limit_files(carved: DataFrame, most: int) -> DataFrame:
    """The first files by place; exact, where a race between workers could keep more."""
    return carved.orderBy("evidence", "global_start", "file_type").limit(most)


def resume(chunks: DataFrame, next_offset: int) -> DataFrame:
    return chunks.where(F.col("start") >= next_offset)


def check_resume(state: dict, chunk_size: int, overlap: int, evidence_size: int) -> int:
    """The offset to go on from; the plan must be that of the run before."""
    if (state["chunk_size"], state["overlap"], state["evidence_len"]) != (chunk_size, overlap, evidence_size):
        raise ValueError("the checkpoint is of another chunk size, overlap or evidence")
    return state["next_offset"]


def summary(chunks: DataFrame, hits: DataFrame, files: DataFrame, spans: DataFrame, artefacts: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row of counts; each table is counted by itself, and the counts are added up.  ``errors``: a row for each hit or file that could not be read or interpreted."""
    names = ("bytes_scanned", "chunks", "hits", "files", "spans", "artefacts", "errors")
    parts = [chunks.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes_scanned"), F.count(F.lit(1)).alias("chunks"))]
    parts += [df.agg(F.count(F.lit(1)).alias(n)) for n, df in zip(names[2:], (hits, files, spans, artefacts, errors), strict=True) if df is not None]
    out = None
    for p in parts:
        p = p.select(*(F.col(n).cast("long") if n in p.columns else F.lit(0).cast("long").alias(n) for n in names))
        out = p if out is None else out.unionByName(p)
    return out.agg(*(F.sum(n).alias(n) for n in names))
