"""Evidence: raw images and devices as chunked rows, and byte columns of tables as the same rows."""

from __future__ import annotations

import hashlib
import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import ewf


def open_evidence(path: str):
    """(seekable stream, size).  EWF images by their first segment, else raw images and devices."""
    if path.lower().endswith(".ex01"):
        raise NotImplementedError("EWF images of version 2 are not read; convert them to raw first")
    if path.lower().endswith(ewf.SUFFIXES):
        stream = ewf.EwfStream(path, open_raw)
        return stream, stream.size
    return open_raw(path)


def open_raw(path: str):
    """(seekable stream, size).  Local files and devices, and any store that Arrow knows."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        stream = open(path, "rb", buffering=0)  # noqa: SIM115
        return stream, stream.seek(0, os.SEEK_END)  # devices have no size but their end
    from pyarrow import fs

    filesystem, at = fs.FileSystem.from_uri(path)
    stream = filesystem.open_input_file(at)
    return stream, stream.size()


def evidence_sha256(path: str, block: int = 8 << 20) -> str:
    """One pass over the evidence, in order."""
    stream, _ = open_evidence(path)
    h = hashlib.sha256()
    with stream:
        stream.seek(0)
        while data := stream.read(block):
            h.update(data)
    return h.hexdigest()


def chunk_rows(total: int, chunk: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(chunk_id, start, length, valid_length): each chunk reads into the next by the overlap; none if the chunk size is 0."""
    if chunk <= 0:
        return []
    return [(k, k * chunk, min(total - k * chunk, chunk + overlap), min(total - k * chunk, chunk)) for k in range(math.ceil(total / chunk))]


def plan_chunks(evidence: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``evidence`` (with a column total) by chunk: chunk_id, start, length, valid_length; evidence without bytes has none."""
    if chunk <= 0:
        rows = evidence.withColumn("chunk_id", F.lit(0).cast("long")).where("false")
    else:
        last = F.floor((F.col("total") - 1) / chunk)
        rows = evidence.where("total > 0").withColumn("chunk_id", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.withColumn("start", F.col("chunk_id") * F.lit(chunk))
    left = F.col("total") - F.col("start")
    return rows.withColumn("length", F.least(left, F.lit(chunk + overlap).cast("long"))).withColumn("valid_length", F.least(left, F.lit(chunk).cast("long")))


def chunks_of_column(df: DataFrame, id_col: str, data: str, chunk: int, overlap: int) -> DataFrame:
    """A table's byte column (an expression) as chunk rows with data; evidence is the row's id."""
    rows = df.select(F.col(id_col).cast("string").alias("evidence"), F.expr(data).alias("all")).withColumn("total", F.length("all").cast("long"))
    if chunk <= 0:
        return plan_chunks(rows, chunk, overlap).select("evidence", "chunk_id", "start", "length", "valid_length", F.col("all").alias("data"))
    # slices first, then rows: exploding numbers would copy the whole value to every chunk
    left = lambda k: F.col("total") - k * F.lit(chunk)
    slices = F.transform(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / chunk)),
        lambda k: F.struct(k.alias("chunk_id"), (k * F.lit(chunk)).alias("start"), F.least(left(k), F.lit(chunk + overlap).cast("long")).alias("length"), F.least(left(k), F.lit(chunk).cast("long")).alias("valid_length"), F.substring("all", (k * F.lit(chunk)).cast("int") + 1, F.least(left(k), F.lit(chunk + overlap).cast("long")).cast("int")).alias("data")),
    )
    return rows.where("total > 0").select("evidence", F.explode(slices).alias("c")).select("evidence", "c.*")


def planned(size: int, chunk: int, overlap: int, resume_at: int = 0, max_chunks: int | None = None, max_bytes: int | None = None) -> list[tuple[int, int, int, int]]:
    """The chunks of one evidence that a run reads: from ``resume_at`` on, of the first ``max_chunks``, and as many as ``max_bytes`` bytes allow (overlaps count), the last one shortened."""
    out, left = [], max_bytes
    for k, start, length, valid in chunk_rows(size, chunk, overlap):
        if start < resume_at or max_chunks is not None and k >= max_chunks:
            continue
        if left is not None:
            if left <= 0:
                break
            length, valid = min(length, left), min(valid, left)
            left -= length
        out.append((k, start, length, valid))
    return out


class ChunkPartition(InputPartition):
    def __init__(self, path: str, row: tuple):
        self.path, self.row = path, row


class EvidenceReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.chunk, self.overlap = int(options.get("chunk_size", 64 << 20)), int(options.get("overlap", 64 << 10))
        self.resume = int(options.get("resume_at", 0))
        self.max_chunks, self.max_bytes = (int(options[k]) if k in options else None for k in ("max_chunks", "max_bytes"))

    def partitions(self):
        paths = self.path.split(",")
        out = []
        for path in paths:
            stream, size = open_evidence(path)
            stream.close()
            out += [ChunkPartition(path, r) for r in planned(size, self.chunk, self.overlap, self.resume, self.max_chunks, self.max_bytes)]
        return out

    def read(self, partition):
        if partition is None:
            return
        k, start, length, valid = partition.row
        stream, _ = open_evidence(partition.path)
        with stream:
            stream.seek(start)
            parts = []
            while length > sum(map(len, parts)) and (data := stream.read(length - sum(map(len, parts)))):
                parts.append(data)
        yield partition.path, k, start, length, valid, b"".join(parts)


class EvidenceSource(DataSource):
    """format("evidence"): a partition for each chunk.  Options: path (several with commas), chunk_size, overlap, resume_at, max_chunks, max_bytes (of each evidence)."""

    @classmethod
    def name(cls):
        return "evidence"

    def schema(self):
        return "evidence string, chunk_id long, start long, length long, valid_length long, data binary"

    def reader(self, schema):
        return EvidenceReader(self.options)


def read_evidence(spark: SparkSession, path: str, chunk_size: int, overlap: int, resume_at: int = 0, max_chunks: int | None = None, max_bytes: int | None = None) -> DataFrame:
    spark.dataSource.register(EvidenceSource)
    reader = spark.read.format("evidence").option("chunk_size", chunk_size).option("overlap", overlap).option("resume_at", resume_at)
    for name, value in (("max_chunks", max_chunks), ("max_bytes", max_bytes)):
        if value is not None:
            reader = reader.option(name, value)
    return reader.load(path)
