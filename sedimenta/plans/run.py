"""A whole run: evidence to the seven metadata tables.

The evidence is scanned once, for all that the options ask; what was found is stored in the shared folder.  Hits are carved once and SQLite files read once, each stored as well, and all tables are made of these.
"""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig, new_run_id
from ..operators import browser, carve, limits, scan, sqlite_pages
from ..sources import sinks
from ..sources.evidence import evidence_sha256, open_evidence, planned, read_evidence

log = logging.getLogger("sedimenta")


class Cancelled(RuntimeError):
    """The run was asked to stop between two of its steps."""


def carved_bytes(carved: DataFrame) -> DataFrame:
    """(source_file, data) of carved files, read where they are needed."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for evidence, path, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stream, _ = open_evidence(evidence)
                with stream:
                    stream.seek(start)
                    yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([stream.read(size)], pa.binary())], names=["source_file", "data"])

    return carved.select("evidence", "path", "global_start", "size").mapInArrow(run, "source_file string, data binary")


def run_tables(spark: SparkSession, path: str, config: EngineConfig, resume_at: int = 0, tasks: int | None = None, work: str | None = None, step: Callable[[str, DataFrame, str], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables of one evidence: carved_files, string_artefacts, browser_history, browser_cookies, browser_downloads, entropy_regions, run_summary.

    What they are made of is computed at once and stored under ``work`` (a new folder of the shared one, if None), which has to stay as long as they are used.
    ``step`` stores a named table; run() gives one that logs and can be cancelled.
    """
    work = work or sinks.work_folder(spark)
    step = step or (lambda name, df, to: sinks.stored(df, to))
    keep = lambda name, df: step(name, df, f"{work}/{name}")
    chunks = read_evidence(spark, path, config.chunk_size, config.overlap, resume_at, config.max_chunks, config.max_bytes)
    kinds = [k for k, on in (("url", config.scan_urls), ("email", config.scan_emails), ("phone", config.scan_phones)) if on] if config.scan_strings else []
    strings = (config.string_min_len, config.string_max_len, config.scan_utf16) if config.scan_strings else None
    found = keep("scan", scan.scan_once(chunks, config.patterns(), strings, kinds, config.entropy_window if config.scan_entropy else None))
    hits = scan.scanned(found, "hit")
    tried = keep("carve", carve.attempts(hits, config, tasks))
    files = carve.carved_files(tried, config)
    if config.max_files is not None:
        files = keep("first_files", limits.limit_files(files, config.max_files))
    databases = files.where("file_type = 'sqlite'")
    rows = keep("sqlite", browser.read_sqlite_tables(carved_bytes(databases)))
    history = browser.history(rows)
    if config.page_recovery:
        known = history.select("source_file").distinct()
        silent = databases.join(known.withColumnRenamed("source_file", "path"), "path", "left_anti")
        history = history.unionByName(sqlite_pages.recover_history(carved_bytes(silent)))
    artefacts, windows = scan.scanned(found, "artefact"), scan.scanned(found, "window")
    errors = tried.where("failed is not null").select("evidence").unionByName(rows.where("tab = '!error'").select(F.col("source_file").alias("evidence")))
    return {
        "carved_files": files, "string_artefacts": artefacts, "browser_history": history, "browser_cookies": browser.cookies(rows), "browser_downloads": browser.downloads(rows),
        "entropy_regions": scan.entropy_regions(windows, config.entropy_window, config.entropy_threshold),
        "run_summary": limits.summary(scan.scanned(found, "chunk"), hits, files, scan.scanned(found, "span"), artefacts, errors),
    }


def run(spark: SparkSession, path: str, folder: str, config: EngineConfig | None = None, sink: str = "parquet", state: str | None = None, hash_evidence: bool = False, cancelled: Callable[[], bool] | None = None) -> str:
    """Writes all tables under ``folder``; returns the run's id.

    ``state``: a checkpoint document to go on from, and to write when limits of chunks or bytes leave chunks unread.  ``cancelled`` is asked before each step, and ends the run with
    Cancelled; Spark jobs bear the run's id as their group, so that a step itself can be stopped with ``sparkContext.cancelJobGroup``.  Each step is logged with its seconds.
    """
    config = config or EngineConfig()
    stream, size = open_evidence(path)
    stream.close()
    at = limits.check_resume(sinks.load_state(state), config.chunk_size, config.overlap, size) if state and os.path.exists(state) else 0
    digest, run_id = config.digest(), config.run_id or new_run_id(config.digest())
    spark.sparkContext.setJobGroup(run_id, f"run {run_id} of {path}", True)
    read = planned(size, config.chunk_size, config.overlap, at, config.max_chunks, config.max_bytes)
    total = sum(r[2] for r in read)
    log.info("run %s: %d of %d bytes in %d chunks", run_id, total, size, len(read), extra={"run_id": run_id})

    def timed(name, act):
        if cancelled and cancelled():
            raise Cancelled(f"run {run_id} was cancelled before {name}")
        began = time.perf_counter()
        out = act()
        took = time.perf_counter() - began
        rate = f", {total / took / (1 << 20):.1f} MiB/s" if name == "scan" else ""
        log.info("%s: %.1f s%s", name, took, rate, extra={"run_id": run_id, "step": name, "seconds": round(took, 3)})
        return out

    work = sinks.work_folder(spark)
    try:
        sha = timed("evidence hash", lambda: evidence_sha256(path)) if hash_evidence else ""
        tables = run_tables(spark, path, config, at, None, work, lambda name, df, to: timed(name, lambda: sinks.stored(df, to)))
        for name, df in tables.items():
            out = sinks.with_provenance(df.withColumn("run_id", F.lit(run_id)), digest, path, sha)
            timed(name, lambda name=name, out=out: sinks.write(out, folder, name, sink))
        summary = tables["run_summary"].first().asDict()
        log.info("summary: %s", summary, extra={"run_id": run_id, "summary": summary})
    finally:
        sinks.remove(work)
    last = read[-1] if read else None
    if state and last and last[1] + last[3] < size:
        sinks.save_state(state, {"run_id": run_id, "chunk_size": config.chunk_size, "overlap": config.overlap, "next_offset": last[1] + last[3] if last[3] == config.chunk_size else last[1], "evidence_len": size, "created_at": run_id[:16]})
    return run_id
