"""Schemas of the metadata tables, and the provenance columns that every written row carries."""

from __future__ import annotations

CHUNK = "evidence string, chunk_id long, start long, length long, valid_length long"
HIT = "evidence string, chunk_id long, global_offset long, file_type string, pattern_id string"
SPAN = "evidence string, chunk_id long, local_start long, length int, flags int"
ARTEFACT = "evidence string, kind string, content string, encoding string, global_start long, global_end long"
CARVED = "evidence string, file_type string, path string, extension string, global_start long, global_end long, size long, md5 string, sha256 string, validated boolean, truncated boolean, errors array<string>, pattern_id string"
HISTORY = "browser string, profile string, url string, title string, visit_time timestamp_ntz, visit_source string, source_file string"
COOKIE = "browser string, profile string, host string, name string, value string, path string, expires timestamp_ntz, last_access timestamp_ntz, created timestamp_ntz, secure boolean, http_only boolean, source_file string"
DOWNLOAD = "browser string, profile string, url string, target string, started timestamp_ntz, ended timestamp_ntz, total_bytes long, state string, source_file string"
ENTROPY = "evidence string, start long, end long, entropy double, window_size long"
SUMMARY = "bytes_scanned long, chunks long, hits long, files long, spans long, artefacts long, errors long"
SCANNED = "what string, evidence string, chunk_id long, a long, b long, name string, detail string, text string, value double"

# Bits of a span's flags.
UTF16_LE, UTF16_BE, UTF8, URL_LIKE, EMAIL_LIKE, PHONE_LIKE = 1, 2, 4, 16, 32, 64
PROVENANCE = ("tool_version", "config_hash", "evidence_path", "evidence_sha256")
