"""Carving: hits to files.  Hits of one evidence are spread over tasks by place, and each task opens the evidence itself; no content is shuffled."""

from __future__ import annotations

import hashlib
import posixpath
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.naming import carved_path, global_end
from ..schemas import CARVED
from ..sources.evidence import open_evidence
from .extents import RULES, Limits, View

FOUND = "evidence string, file_type string, extension string, global_start long, size long, md5 string, sha256 string, validated boolean, truncated boolean, errors array<string>, pattern_id string, failed string"


def limits_of(config: EngineConfig) -> dict[str, tuple[str, str, Limits]]:
    """(rule, extension, limits) by file type."""
    out = {}
    for t in config.file_types:
        rule = "mp4" if t.carver == "mov" and config.quicktime_mode == "mp4" else t.carver
        if t.carver not in RULES:
            if not (t.headers and t.footers):
                continue
            rule = "footer"
        allowed = config.zip_kinds if t.carver == "zip" else config.ole_kinds if t.carver == "ole" else None
        out[t.id] = (rule, t.extension, Limits(t.max_size, t.min_size, headers=tuple(bytes.fromhex(h) for _, h in t.headers), footers=tuple(map(bytes.fromhex, t.footers)), require_eocd=t.require_eocd, allowed=allowed, quicktime=config.quicktime_mode))
    return out


def carve_one(view: View, file_type: str, start: int, rules: dict, hashes: bool = True):
    """(file type, extension, extent, md5, sha256) or None."""
    name, extension, lim = rules[file_type]
    extent = RULES[name](view, start, lim)
    if extent is None:
        return None
    kind = extent.kind or file_type
    if extent.kind:
        extension = extent.kind
    md5, sha = hashlib.md5(usedforsecurity=False), hashlib.sha256()
    if hashes:
        at, end = extent.start, extent.start + extent.size
        while at < end:
            data = view.read(at, min(1 << 20, end - at))
            if not data:
                break
            md5.update(data)
            sha.update(data)
            at += len(data)
    return kind, extension, extent, md5.hexdigest(), sha.hexdigest()


def attempts(hits: DataFrame, config: EngineConfig, tasks: int | None = None) -> DataFrame:
    """A row (of FOUND) for each file that a hit begins, and one for each hit whose rule or evidence fails, with the error in ``failed``; neither ever ends the run."""
    rules = limits_of(config)

    def run(batches):
        import pyarrow as pa

        opened: dict = {}
        try:
            for batch in batches:
                rows = []
                for evidence, at, kind, pattern in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if kind not in rules:
                        continue
                    try:
                        if evidence not in opened:
                            opened[evidence] = View(*open_evidence(evidence))
                        got = carve_one(opened[evidence], kind, at, rules)
                    except (OSError, ValueError, IndexError, KeyError, struct.error) as e:
                        rows.append((evidence, kind, None, at, None, None, None, None, None, None, pattern, f"{type(e).__name__}: {e}"))
                        continue
                    if got:
                        name, ext, x, md5, sha = got
                        rows.append((evidence, name, ext, x.start, x.size, md5, sha, x.validated, x.truncated, x.errors, pattern, None))
                cols = list(zip(*rows, strict=True)) or [[]] * 12
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split(" ")[0] for x in FOUND.split(", ")])
        finally:
            for view in opened.values():
                view.source.close()

    hits = hits.select("evidence", "global_offset", "file_type", "pattern_id")
    if tasks:
        hits = hits.repartitionByRange(tasks, "evidence", "global_offset")
    return hits.mapInArrow(run, FOUND)


def carved_files(found: DataFrame, config: EngineConfig) -> DataFrame:
    """The carved files of attempts(), with their paths."""
    found = found.where("failed is null").withColumn("path", carved_path(F.col("file_type"), F.col("global_start"), F.col("extension"))).withColumn("global_end", global_end(F.col("global_start"), F.col("size")))
    if config.only_validated:
        found = found.where("validated")
    return found.select(*(x.split(" ")[0] for x in CARVED.split(", ")))


def carve(hits: DataFrame, config: EngineConfig, tasks: int | None = None) -> DataFrame:
    """A row for each file that a hit begins.  A hit whose rule fails gives no row."""
    return carved_files(attempts(hits, config, tasks), config)


def materialise(carved: DataFrame, folder: str) -> DataFrame:
    """Writes each carved file to folder/path, under a temporary name first, and returns (path, size)."""

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        filesystem, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            done = []
            for evidence, path, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stream, total = open_evidence(evidence)
                to = posixpath.join(root, path)
                filesystem.create_dir(posixpath.dirname(to), recursive=True)
                tmp, view = f"{to}.{uuid.uuid4().hex}.tmp", View(stream, total)
                with stream, filesystem.open_output_stream(tmp) as out:
                    for at in range(start, start + size, 1 << 20):
                        out.write(view.read(at, min(1 << 20, start + size - at)))
                filesystem.move(tmp, to)
                done.append((path, size))
            cols = list(zip(*done, strict=True)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], names=["path", "size"])

    return carved.select("evidence", "path", "global_start", "size").mapInArrow(run, "path string, size long")
