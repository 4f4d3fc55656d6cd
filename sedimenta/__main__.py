"""Command line of a run: ``python -m sedimenta --input disk.raw --output folder``."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from dataclasses import replace

from .config import EngineConfig, load_config


class JsonLines(logging.Formatter):
    """One object a line: time, level, message, and what a record carries beyond them."""

    def format(self, record: logging.LogRecord) -> str:
        more = {k: getattr(record, k) for k in ("run_id", "step", "seconds", "summary") if hasattr(record, k)}
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "message": record.getMessage(), **more})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sedimenta", description="Carve files and extract artefacts from raw evidence.")
    p.add_argument("--input", required=True, help="image, device or URI")
    p.add_argument("--output", required=True, help="folder of the tables")
    p.add_argument("--config", help="YAML file of options; options given here take precedence")
    p.add_argument("--sink", choices=("parquet", "jsonl", "csv"), default="parquet")
    p.add_argument("--dry-run", action="store_true", help="compute all, write nothing")
    p.add_argument("--chunk-mib", type=int)
    p.add_argument("--overlap-kib", type=int)
    for name in ("max-bytes", "max-chunks", "max-files", "string-min-len", "string-max-len", "entropy-window"):
        p.add_argument(f"--{name}", type=int)
    p.add_argument("--entropy-threshold", type=float)
    for name in ("scan-strings", "scan-utf16", "scan-urls", "scan-emails", "scan-phones", "scan-entropy", "page-recovery", "only-validated"):
        p.add_argument(f"--{name}", action=argparse.BooleanOptionalAction)
    p.add_argument("--types", help="file types or carvers, with commas")
    p.add_argument("--disable-zip", action="store_true")
    p.add_argument("--state", help="checkpoint document to go on from and to write")
    p.add_argument("--hash-evidence", action="store_true")
    p.add_argument("--log-format", choices=("text", "json"), default="text")
    return p


def options(args: argparse.Namespace) -> tuple[EngineConfig, list[str]]:
    """The run's options, and the unknown type names."""
    config = EngineConfig()
    if args.config:
        with open(args.config) as f:
            config, _ = load_config(f.read())
    given = {k: getattr(args, k) for k in ("max_bytes", "max_chunks", "max_files", "string_min_len", "string_max_len", "entropy_window", "entropy_threshold", "scan_strings", "scan_utf16", "scan_entropy", "page_recovery", "only_validated")}
    given |= {"chunk_size": args.chunk_mib and args.chunk_mib << 20, "overlap": None if args.overlap_kib is None else args.overlap_kib << 10}
    given |= {k: getattr(args, k) for k in ("scan_urls", "scan_emails", "scan_phones") if getattr(args, k) is False}
    config = replace(config, **{k: v for k, v in given.items() if v is not None})
    config = config.with_artefacts(bool(args.scan_urls), bool(args.scan_emails), bool(args.scan_phones))
    return config.only_types(args.types.split(",") if args.types else [], args.disable_zip)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonLines() if args.log_format == "json" else logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log = logging.getLogger("sedimenta")
    log.handlers, log.propagate = [handler], False
    log.setLevel(logging.INFO)
    config, unknown = options(args)
    if unknown:
        log.warning("unknown file types: %s", ", ".join(unknown))
    from pyspark.sql import SparkSession

    from .plans.run import run

    spark = SparkSession.builder.appName("sedimenta").getOrCreate()
    print(run(spark, args.input, args.output, config, "dry" if args.dry_run else args.sink, args.state, args.hash_evidence))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
