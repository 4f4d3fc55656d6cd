"""Sinks: metadata tables as Parquet, JSON lines or CSV, with provenance; and the checkpoint document."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import __version__

# File types that have a Parquet category of their own; archive kinds share one, all others another.
OWN = ("jpeg", "png", "gif", "sqlite", "pdf", "zip", "webp")
IN_ZIP = ("docx", "xlsx", "pptx")


def with_provenance(df: DataFrame, config_hash: str, evidence_path: str = "", evidence_sha256: str = "") -> DataFrame:
    values = {"tool_version": __version__, "config_hash": config_hash, "evidence_path": evidence_path, "evidence_sha256": evidence_sha256}
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def file_category(file_type):
    """files_<category> of a file type."""
    return F.concat(F.lit("files_"), F.when(file_type.isin(*OWN), file_type).when(file_type.isin(*IN_ZIP), "zip").otherwise("other"))


def flat(df: DataFrame) -> DataFrame:
    """Arrays of text joined by "; " (null if empty), for formats without arrays."""
    return df.select(*(F.when(F.size(c) > 0, F.concat_ws("; ", c)).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes))


def write(df: DataFrame, folder: str, table: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """``kind``: parquet (carved files and artefacts by category), jsonl (nulls kept), csv (with a header), or dry (nothing is written)."""
    if kind == "dry":
        df.write.format("noop").mode("overwrite").save()
    elif kind == "jsonl":
        df.write.mode(mode).option("ignoreNullFields", False).json(f"{folder}/{table}")
    elif kind == "csv":
        text = df.select(*(F.concat_ws("; ", c).alias(c) if k.startswith("array") else F.col(c) for c, k in df.dtypes))
        text.write.mode(mode).option("header", True).csv(f"{folder}/{table}")
    elif kind == "parquet":
        out = flat(df)
        if table == "carved_files":
            out.withColumn("category", file_category(F.col("file_type"))).write.mode(mode).partitionBy("category").parquet(f"{folder}/{table}")
        elif table == "string_artefacts":
            out.withColumn("category", F.concat(F.lit("artefacts_"), F.col("kind"), F.when(F.col("kind").endswith("s"), "es").otherwise("s"))).write.mode(mode).partitionBy("category").parquet(f"{folder}/{table}")
        else:
            out.write.mode(mode).parquet(f"{folder}/{table}")
    else:
        raise ValueError(f"unknown sink: {kind}")


def work_folder(spark) -> str:
    """A fresh folder that the driver and all executors share: under ``spark.checkpoint.dir``, or a temporary one where it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share with the driver")
        folder = "file://" + tempfile.mkdtemp(prefix="sedimenta-")
    return f"{folder.rstrip('/')}/work-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` as Parquet and read from there: computed once, whatever is made of it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(folder: str) -> None:
    from pyarrow import fs

    filesystem, at = fs.FileSystem.from_uri(folder)
    if filesystem.get_file_info(at).type != fs.FileType.NotFound:
        filesystem.delete_dir(at)


def save_state(path: str, state: dict) -> None:
    """The checkpoint document, renamed into place when it is whole."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(tmp, "w") as f:
        json.dump({"version": 1, **state}, f)
    os.replace(tmp, path)


def load_state(path: str) -> dict:
    with open(path) as f:
        return json.load(f)
