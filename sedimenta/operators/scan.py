"""Scans of chunk rows (evidence, chunk_id, start, length, valid_length, data): signatures, strings, artefacts and entropy.

Chunks overlap, so each operator keeps what begins in a chunk's own part; nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.artefacts import FORMS, URL_TAIL
from ..schemas import ARTEFACT, EMAIL_LIKE, HIT, PHONE_LIKE, SCANNED, SPAN, URL_LIKE, UTF8, UTF16_BE, UTF16_LE

COLUMNS = ("evidence", "chunk_id", "start", "valid_length", "data")


def _table(schema: str, per_chunk, chunks: DataFrame) -> DataFrame:
    """Rows of ``schema`` that ``per_chunk`` makes of each chunk (evidence, chunk_id, start, valid_length, data)."""

    def run(batches):
        from itertools import islice

        import pyarrow as pa

        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        fields = [x.split(" ") for x in schema.split(", ")]
        for batch in batches:
            for chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = iter(per_chunk(*chunk))
                while part := list(islice(rows, 50_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*part, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return chunks.select(*COLUMNS).mapInArrow(run, schema)


def chunk_hits(patterns, evidence, chunk, start, valid, data):
    for kind, name, pattern in patterns:
        at = data.find(pattern)
        while 0 <= at < valid:
            yield evidence, chunk, start + at, kind, name
            at = data.find(pattern, at + 1)


def find_hits(chunks: DataFrame, patterns: list[tuple[str, str, bytes]]) -> DataFrame:
    """Every place of every pattern (file type, pattern id, bytes), overlapping ones too."""
    return _table(HIT, lambda *chunk: chunk_hits(patterns, *chunk), chunks)


def span_patterns(least: int, most: int, utf16: bool) -> list[tuple[int, re.Pattern]]:
    """(flag, pattern) of each kind of run.  Longer runs are split at ``most`` characters, and the rest counts if it is long enough."""
    n = b"{%d,%d}" % (least, most)
    two = rb"\xc2[\xa0-\xbf]|[\xc3-\xdf][\x80-\xbf]"
    three = rb"\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    four = rb"\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
    out = [(0, re.compile(rb"[\t\x20-\x7e]" + n)), (UTF8, re.compile(rb"(?:[\t\x20-\x7e]|" + b"|".join((two, three, four)) + b")" + n))]
    if utf16:
        out += [(UTF16_LE, re.compile(rb"(?:[\t\x20-\x7e]\x00)" + n)), (UTF16_BE, re.compile(rb"(?:\x00[\t\x20-\x7e])" + n))]
    return out


def decode_span(data: bytes, flags: int) -> tuple[str, str, int]:
    """(text, encoding, bytes of a character or 0 if they vary)."""
    if flags & UTF16_LE:
        return data.decode("utf-16-le", "replace"), "utf-16le", 2
    if flags & UTF16_BE:
        return data.decode("utf-16-be", "replace"), "utf-16be", 2
    if flags & UTF8:
        return data.decode("utf-8", "replace"), "utf-8", 0
    return data.decode("ascii", "replace"), "ascii", 1


def text_hints(text: str) -> int:
    low = text.lower()
    digits = sum(c.isascii() and c.isdigit() for c in text)
    return URL_LIKE * ("http" in low or "www." in low) | EMAIL_LIKE * ("@" in text) | PHONE_LIKE * (digits >= 10)


def _spans(data: bytes, valid: int, patterns):
    for flag, pattern in patterns:
        for m in pattern.finditer(data):
            if m.start() >= valid:
                break
            if flag != UTF8 or not m[0].isascii():
                yield m.start(), m[0], flag | text_hints(decode_span(m[0], flag)[0])


def find_spans(chunks: DataFrame, least: int = 6, most: int = 1024, utf16: bool = False) -> DataFrame:
    """Printable runs that begin in the chunk's own part: ASCII, UTF-8 with other characters, and UTF-16 of ASCII in both orders."""
    patterns = span_patterns(least, most, utf16)
    return _table(SPAN, lambda e, k, _, valid, data: ((e, k, at, len(text), flags) for at, text, flags in _spans(data, valid, patterns)), chunks)


TEXT_PATTERNS = tuple((kind, bit, re.compile(FORMS[kind], flags)) for kind, bit, flags in (("url", URL_LIKE, re.I), ("email", EMAIL_LIKE, re.I), ("phone", PHONE_LIKE, 0)))


def _host_ok(host: str) -> bool:
    return "." in host and len(host.encode()) <= 253 and all(1 <= len(x.encode()) <= 63 for x in host.split("."))


def plausible(kind: str, raw: str) -> str | None:
    """The normalised artefact, or None."""
    if kind == "phone":
        digits = [c for c in raw if c in "0123456789"]
        return raw if 10 <= len(digits) <= 15 and len(set(digits)) >= 4 else None
    text = raw.rstrip(URL_TAIL)
    n = len(text.encode())
    if kind == "url":
        host = re.sub("(?i)^https?://", "", text).split("/")[0].split(":")[0]
        return text if 8 <= n <= 2048 and _host_ok(host) else None
    local, _, domain = text.partition("@")
    ok = 6 <= n <= 254 and 1 <= len(local.encode()) <= 64 and _host_ok(domain) and re.search("[A-Za-z]", domain)
    return text if ok else None


def span_artefacts(evidence, start, at, raw, flags, kinds, compat=False):
    """Artefacts of one run.  If hints are set, only the hinted kinds are looked for."""
    text, encoding, width = decode_span(raw, flags)
    hints = flags & (URL_LIKE | EMAIL_LIKE | PHONE_LIKE)
    for kind, bit, pattern in TEXT_PATTERNS:
        if kind in kinds and (not hints or hints & bit):
            for m in pattern.finditer(text):
                content = plausible(kind, m[0])
                if content is not None:
                    wide = width == 2 and not compat
                    first = start + at + (2 * m.start() if wide else len(text[: m.start()].encode()))
                    size = 2 * len(content) if wide else len(content.encode())
                    yield evidence, kind, content, encoding, first, first + max(0, size - 1)


def find_artefacts(chunks: DataFrame, least: int = 6, most: int = 1024, utf16: bool = False, kinds=("url", "email", "phone"), compat: bool = False) -> DataFrame:
    """Artefacts in printable runs, with the place of their bytes.

    ``compat``: places in UTF-16 runs count a byte a character, as older outputs do.
    """
    patterns = span_patterns(least, most, utf16)

    def per_chunk(evidence, _, start, valid, data):
        for at, raw, flags in _spans(data, valid, patterns):
            yield from span_artefacts(evidence, start, at, raw, flags, kinds, compat)

    return _table(ARTEFACT, per_chunk, chunks)


def chunk_entropy(window: int, valid: int, data: bytes):
    """Shannon entropy in bits of each whole window of the chunk's own part, in blocks of about 16 MiB of counts."""
    import numpy as np

    n, block = min(valid, len(data)) // window, 8192
    for w in range(0, n, block):
        k = min(block, n - w)
        bytes_ = np.frombuffer(data, "uint8", k * window, w * window).astype("int64").reshape(k, window)
        p = np.bincount((bytes_ + 256 * np.arange(k)[:, None]).ravel(), minlength=256 * k).reshape(k, 256) / window
        yield from enumerate((-(p * np.log2(p, where=p > 0, out=np.zeros_like(p))).sum(1)).tolist(), w)


def entropy_windows(chunks: DataFrame, window: int = 4096) -> DataFrame:
    """(evidence, chunk_id, chunk_start, w, entropy) of each whole window of a chunk's own part."""
    return _table("evidence string, chunk_id long, chunk_start long, w long, entropy double", lambda e, k, start, valid, data: ((e, k, start, w, x) for w, x in chunk_entropy(window, valid, data)), chunks)


def scan_once(chunks: DataFrame, patterns, strings: tuple[int, int, bool] | None = None, kinds=(), window: int | None = None) -> DataFrame:
    """All that a run needs of the chunks, in one pass over the evidence: rows of SCANNED, told apart by ``what``: chunk, hit, span, artefact, window."""
    runs = span_patterns(*strings) if strings else []

    def per_chunk(evidence, chunk, start, valid, data):
        yield "chunk", evidence, chunk, start, len(data), None, None, None, None
        for _, _, at, kind, name in chunk_hits(patterns, evidence, chunk, start, valid, data):
            yield "hit", evidence, chunk, at, None, kind, name, None, None
        for at, raw, flags in _spans(data, valid, runs):
            yield "span", evidence, chunk, at, len(raw), None, str(flags), None, None
            for _, kind, content, encoding, first, last in span_artefacts(evidence, start, at, raw, flags, kinds):
                yield "artefact", evidence, chunk, first, last, kind, encoding, content, None
        if window:
            for w, x in chunk_entropy(window, valid, data):
                yield "window", evidence, chunk, start, w, None, None, None, x

    return _table(SCANNED, per_chunk, chunks)


def scanned(rows: DataFrame, what: str) -> DataFrame:
    """One kind of scan_once()'s rows, in the columns of the operator that finds it alone."""
    columns = {
        "chunk": ("evidence", "chunk_id", "a as start", "b as length"),
        "hit": ("evidence", "chunk_id", "a as global_offset", "name as file_type", "detail as pattern_id"),
        "span": ("evidence", "chunk_id", "a as local_start", "int(b) as length", "int(detail) as flags"),
        "artefact": ("evidence", "name as kind", "text as content", "detail as encoding", "a as global_start", "b as global_end"),
        "window": ("evidence", "chunk_id", "a as chunk_start", "b as w", "value as entropy"),
    }
    return rows.where(F.col("what") == what).selectExpr(*columns[what])


def entropy_regions(windows: DataFrame, window: int, threshold: float, across_chunks: bool = False, chunk: int = 0) -> DataFrame:
    """Adjacent windows of at least the threshold as one region with their highest entropy; over chunk edges only if asked."""
    high = windows.where(F.col("entropy") >= threshold)
    key = ["evidence"] if across_chunks else ["evidence", "chunk_id"]
    at = F.floor((F.col("chunk_start") + F.col("w") * window) / window) if across_chunks else F.col("w")
    high = high.withColumn("at", at).withColumn("island", F.col("at") - F.row_number().over(Window.partitionBy(*key).orderBy("at")))
    first = F.min(F.col("chunk_start") + F.col("w") * window)
    out = high.groupBy(*key, "island").agg(first.alias("start"), (F.max(F.col("chunk_start") + F.col("w") * window) + window - 1).alias("end"), F.max("entropy").alias("entropy"))
    return out.select("evidence", "start", "end", "entropy", F.lit(window).cast("long").alias("window_size"))
