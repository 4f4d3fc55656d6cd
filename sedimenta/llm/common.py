"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is sent to every executor only when it has been counted and has at most this many narrow rows.
BROADCAST_ROWS = 200_000
#: The most bytes of keys that join_sized() sends to every executor, and the rows of one key below which it is never called hot.
BROADCAST_BYTES, HOT_ROWS = 64 << 20, 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        at = spark.sparkContext.getCheckpointDir()
        if at:
            folder = at
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share with the driver")
        else:
            folder = "file://" + tempfile.mkdtemp(prefix="sedimenta-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of new_folder() and what it holds, through the file system that Spark wrote it with; one that is gone is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: later jobs don't recompute it, and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """Marks a side of a join for broadcast if its counted size is small enough; else the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_sized(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, key_bytes: int = 32, count: str = "n") -> DataFrame:
    """Inner join of ``rows`` (``total`` of them or fewer) with ``groups``, which has one row for each key and in its column ``count`` the number of rows with that key.

    At most ``room`` rows of groups are broadcast: all where rows are no more than that, else those of hot keys, which have over total / room rows, so that there
    can't be more than ``room`` of them.  Other keys are joined by shuffling, with at most that many rows each.  ``groups`` should be stored, as it is read more than once.
    """
    room = min(BROADCAST_ROWS, BROADCAST_BYTES // (key_bytes + 32))
    if total <= room:
        return rows.join(F.broadcast(groups), keys)
    most = max(HOT_ROWS, math.ceil(total / room)) if room else total
    hot, cold = groups.where(F.col(count) > most), groups.where(F.col(count) <= most)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys))


def with_row_ids(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` and a column that tells its rows apart.

    That is ``id_col`` where it is an integer column without nulls and repeats; else rows are written once to the shared folder with
    a number each, as numbers made while reading could change when a lost task is run again.
    """
    if dict(docs.dtypes)[id_col] in ("bigint", "int"):
        ids = docs.select(F.col(id_col).cast("long").alias("i"))
        odd = ids.groupBy("i").count().where("i is null or count > 1")
        if odd.isEmpty():
            return docs, id_col
    uid, path = free_name(docs, "row_id"), new_folder(docs.sparkSession, "rows")
    docs.withColumn(uid, F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path), uid


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until ``df`` has no such column (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(rows, text_of, most: int = 1 << 20):
    """Rows in lists of about ``most`` characters of text, in order, so that per-row working sets stay bounded."""
    block, size = [], 0
    for row in rows:
        block.append(row)
        size += len(text_of(row) or "") + 64
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def give_back() -> None:
    """Returns what this worker has freed to the system, as far as the C library and Arrow can: idle workers stay, and count beside the executor's heap."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
