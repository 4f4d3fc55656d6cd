"""Carving, scanning, parsing and writing on hand-built bytes, and the registered queries against DuckDB."""

import hashlib
import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sedimenta import queries, samples
from sedimenta.config import EngineConfig, FileType, load_config, new_run_id
from sedimenta.functions import artefacts as A
from sedimenta.functions import naming as N
from sedimenta.operators import browser, carve, limits, scan, sqlite_pages
from sedimenta.operators.extents import RULES, Limits, View
from sedimenta.plans import run as plan
from sedimenta.sources import evidence, ewf, sinks
from sedimenta.streaming import watch


def view(data: bytes) -> View:
    import io

    return View(io.BytesIO(data), len(data), block=64)


def chunks(spark, data: bytes, chunk=1 << 20, overlap=0):
    df = spark.createDataFrame([("e", bytearray(data))], "id string, data binary")
    return evidence.chunks_of_column(df, "id", "data", chunk, overlap)


# rules

KIND_RULE = {"docx": "zip", "odt": "zip", "doc": "ole", "xls": "ole", "7z": "sevenz"}


@pytest.mark.parametrize("name", sorted(samples.files()))
def test_rule_finds_the_whole_file(name):
    data = samples.files()[name]
    kind = name.split(".")[0]
    tail = {"eml": b"\nFrom ", "gzip": b"\x1f\x8b\x08"}.get(kind, b"")
    start = {"tar": 257, "mobi": 60}.get(kind, 0)
    got = RULES[KIND_RULE.get(kind, kind)](view(bytes(100) + data + tail + bytes(300)), 100 + start, Limits(10 << 20, 1))
    assert got and (got.start, got.size, got.validated, got.truncated) == (100, len(data), True, False)
    assert got.kind == (kind if kind in ("docx", "odt", "doc", "xls") else None)


@pytest.mark.parametrize("name", ["jpeg", "png", "sqlite", "bmp", "wav", "7z", "elf", "lrf", "rar", "mp3", "tar", "ogg"])
def test_cut_files_are_truncated(name):
    data = samples.files()[name]
    cut = data[: len(data) - 5]
    got = RULES[KIND_RULE.get(name, name)](view(cut), {"tar": 257}.get(name, 0), Limits(10 << 20, 1))
    assert got and got.truncated and not got.validated and got.size == len(cut)


@pytest.mark.parametrize(
    "rule, data",
    [("gif", b"GIF89a short"), ("gif", b"GIF89a" + bytes(7) + b"\x99"), ("sqlite", b"SQLite format 3\0" + (1000).to_bytes(2, "big") + bytes(100)), ("zip", b"PK\3\4" + bytes(40)), ("bmp", b"BM" + bytes(60)),
     ("webp", b"RIFF\x10\0\0\0WAVE" + bytes(20)), ("mp4", b"\0\0\0\x14ftypqt  " + bytes(8)), ("xz", b"\xfd7zXZ\0" + bytes(40)), ("mp3", b"\xff\xfb\x90\0" + bytes(500)), ("eml", b"From: nobody"), ("ico", b"\0\0\1\0\1\0" + bytes(16))],
)
def test_implausible_headers(rule, data):
    got = RULES[rule](view(data), 0, Limits(1 << 20, 1))
    assert got is None or rule == "gif" and got.truncated


def test_size_limits():
    jpeg = samples.files()["jpeg"]
    assert RULES["jpeg"](view(jpeg), 0, Limits(0, len(jpeg) + 1)) is None
    got = RULES["jpeg"](view(jpeg), 0, Limits(100, 1))
    assert got.size == 100 and got.truncated and got.errors == ["max_size reached before EOI"]
    db = samples.history_db()
    got = RULES["sqlite"](view(db), 0, Limits(2048, 1))
    assert got.size == 2048 and got.validated and got.truncated


def test_footer_rule():
    lim = Limits(0, 1, headers=(b"<a>",), footers=(b"</a>", b"END"))
    assert RULES["footer"](view(b"<a> x END y </a>"), 0, lim).size == 9
    assert RULES["footer"](view(b"<b> x END"), 0, lim) is None


def test_zip_without_matching_directory():
    data = samples.files()["zip"]
    assert RULES["zip"](view(data[:-22] + b"PK\5\6" + bytes(18)), 0, Limits(1 << 20, 1)) is None
    assert RULES["zip"](view(data), 0, Limits(1 << 20, 1, allowed=("docx",))) is None


# image


@pytest.fixture(scope="module")
def image(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("image") / "a.raw")
    return path, samples.write_image(path)


def test_image_is_carved(spark, image):
    path, places = image
    config = EngineConfig(chunk_size=100_000, overlap=64)
    got = {(r["global_start"], r["file_type"]): r for r in plan.run_tables(spark, path, config, tasks=3)["carved_files"].collect()}
    for name, (at, data) in places.items():
        r = got[at, name.split(".")[0]]
        assert (r["size"], r["sha256"], r["md5"]) == (len(data), hashlib.sha256(data).hexdigest(), hashlib.md5(data).hexdigest()), name
        assert r["validated"] and r["global_end"] == at + len(data) - 1 and r["path"].startswith(f"{r['file_type']}/{r['file_type']}_{at:012X}.")


def test_run_writes_all_tables(spark, image, tmp_path):
    path, places = image
    config = EngineConfig(chunk_size=1 << 20, overlap=64, scan_strings=True, scan_entropy=True, page_recovery=True, run_id="r")
    plan.run(spark, path, str(tmp_path / "parquet"), config, hash_evidence=True)
    assert len(list((tmp_path / "parquet").iterdir())) == 7
    files = spark.read.parquet(str(tmp_path / "parquet" / "carved_files"))
    assert {"category", "tool_version", "config_hash", "evidence_sha256", "run_id"} <= set(files.columns)
    assert "files_zip" in {r[0] for r in files.select("category").distinct().collect()}
    history = spark.read.parquet(str(tmp_path / "parquet" / "browser_history"))
    assert history.where("browser = 'chrome' and visit_source = 'typed'").count() == 20
    assert history.first()["evidence_sha256"] == evidence.evidence_sha256(path)


def test_evidence_is_scanned_once(spark, image, tmp_path, monkeypatch):
    """Tables are made of stored rows: no plan reads the evidence again, and one scan, one carve and one SQLite pass were stored."""
    path, _ = image
    config = EngineConfig(chunk_size=1 << 20, overlap=64, scan_strings=True, scan_entropy=True, page_recovery=True)
    reads, kept = [], []
    monkeypatch.setattr(plan, "read_evidence", lambda *a, real=plan.read_evidence: reads.append(a) or real(*a))

    def step(name, df, to):
        kept.append((name, df._jdf.queryExecution().toString().count("evidence(")))
        return sinks.stored(df, to)

    tables = plan.run_tables(spark, path, config, work=f"file://{tmp_path}/work", step=step)
    assert [k for k, _ in kept] == ["scan", "carve", "sqlite"] and len(reads) == 1
    for name, df in tables.items():
        scans = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchScan evidence" not in scans and "PythonScan" not in scans, name
    got = tables["run_summary"].first()
    assert got["bytes_scanned"] == sum(r[2] for r in evidence.planned(os.path.getsize(path), 1 << 20, 64)) and got["files"] == tables["carved_files"].count()
    alone = evidence.read_evidence(spark, path, 1 << 20, 64)
    assert got["hits"] == scan.find_hits(alone, config.patterns()).count() and got["spans"] == scan.find_spans(alone).count() and got["artefacts"] == scan.find_artefacts(alone).count()


def test_errors_are_counted(spark, tmp_path):
    """A hit whose evidence cannot be opened, and a carved database that is none."""
    hits = spark.createDataFrame([(str(tmp_path / "missing"), 0, 5, "png", "p")], "evidence string, chunk_id long, global_offset long, file_type string, pattern_id string")
    tried = carve.attempts(hits, EngineConfig()).collect()
    assert len(tried) == 1 and "FileNotFoundError" in tried[0]["failed"] and carve.carve(hits, EngineConfig()).count() == 0
    broken = spark.createDataFrame([("f", bytearray(b"SQLite format 3\0" + b"x" * 600))], "source_file string, data binary")
    assert [r["tab"] for r in browser.read_sqlite_tables(broken).collect()] == ["!error"]
    none = spark.createDataFrame([], "length long")
    assert limits.summary(none, none, none, none, none, hits).first()["errors"] == 1


def test_cancelled_runs_stop(spark, image, tmp_path):
    with pytest.raises(plan.Cancelled):
        plan.run(spark, image[0], str(tmp_path / "out"), EngineConfig(chunk_size=1 << 20), cancelled=lambda: True)
    assert not (tmp_path / "out").exists()


def test_command_line(spark, image, tmp_path, capsys):
    from sedimenta import __main__ as cli

    args = cli.parser().parse_args(["--input", "x", "--output", "y", "--chunk-mib", "2", "--overlap-kib", "0", "--scan-urls", "--no-scan-phones", "--types", "png,what"])
    config, unknown = cli.options(args)
    assert (config.chunk_size, config.overlap, config.scan_strings, config.scan_phones, unknown) == (2 << 20, 0, True, False, ["what"]) and [t.id for t in config.file_types] == ["png"]
    import logging

    log, before = logging.getLogger("sedimenta"), list(logging.getLogger("sedimenta").handlers)
    try:
        assert cli.main(["--input", image[0], "--output", str(tmp_path / "out"), "--chunk-mib", "1", "--types", "png", "--log-format", "json"]) == 0
    finally:
        log.handlers = before
    lines = [json.loads(x) for x in capsys.readouterr().err.splitlines() if x.startswith('{"time"')]
    assert {"scan", "carve", "run_summary"} <= {x.get("step") for x in lines} and lines[-1]["summary"]["files"] == 1
    assert (tmp_path / "out" / "carved_files").is_dir()


def test_limits_are_planned():
    assert evidence.planned(100, 40, 10, max_bytes=70) == [(0, 0, 50, 40), (1, 40, 20, 20)]
    assert evidence.planned(100, 40, 10, resume_at=40, max_chunks=2) == [(1, 40, 50, 40)] and evidence.planned(0, 40, 10) == []


def test_text_sinks(spark, tmp_path):
    df = sinks.with_provenance(spark.createDataFrame([("a", None, ["x", "y"])], "p string, q string, errors array<string>").coalesce(1), "c")
    for kind in ("jsonl", "csv", "dry"):
        sinks.write(df, str(tmp_path), kind, kind)
    line = json.loads(next((tmp_path / "jsonl").glob("part-*")).read_text())
    assert line["q"] is None and line["errors"] == ["x", "y"] and line["config_hash"] == "c"
    assert next((tmp_path / "csv").glob("part-*")).read_text().splitlines()[0].startswith("p,q,errors,tool_version") and not (tmp_path / "dry").exists()
    with pytest.raises(ValueError):
        sinks.write(df, str(tmp_path), "x", "xml")


def test_resume_and_limits(spark, image, tmp_path):
    path, _ = image
    state = str(tmp_path / "state.json")
    config = EngineConfig(chunk_size=200_000, overlap=64, max_chunks=2)
    plan.run(spark, path, str(tmp_path / "a"), config, state=state)
    saved = sinks.load_state(state)
    assert saved["next_offset"] == 400_000
    at = limits.check_resume(saved, 200_000, 64, saved["evidence_len"])
    rest = plan.run_tables(spark, path, EngineConfig(chunk_size=200_000, overlap=64), at)
    hits = scan.find_hits(evidence.read_evidence(spark, path, 200_000, 64, at), config.patterns())
    assert hits.agg(F.min("global_offset")).first()[0] >= 400_000 and rest["carved_files"].count() > 0
    with pytest.raises(ValueError):
        limits.check_resume(saved, 1, 64, saved["evidence_len"])
    some = plan.run_tables(spark, path, EngineConfig(chunk_size=200_000, overlap=64, max_files=3, max_bytes=500_000))
    assert some["carved_files"].count() == 3 and some["run_summary"].first()["bytes_scanned"] == 500_000


def test_materialise(spark, image, tmp_path):
    path, places = image
    config = EngineConfig(chunk_size=1 << 20).only_types(["png", "pdf"])[0]
    files = plan.run_tables(spark, path, config)["carved_files"]
    written = carve.materialise(files, str(tmp_path)).collect()
    at, data = places["png"]
    assert len(written) == 2 and (tmp_path / "png" / f"png_{at:012X}.png").read_bytes() == data


def test_empty_evidence(spark, tmp_path):
    (tmp_path / "none").write_bytes(b"")
    tables = plan.run_tables(spark, str(tmp_path / "none"), EngineConfig(scan_strings=True, scan_entropy=True))
    assert all(df.count() == (1 if n == "run_summary" else 0) for n, df in tables.items())
    with pytest.raises(NotImplementedError):
        evidence.open_evidence("a.Ex01")


# EWF images


def write_ewf(folder, segments, first="a.E01"):
    for n, data in enumerate(segments, 1):
        (folder / ewf.segment_path(first, n)).write_bytes(data)
    return str(folder / first)


def test_segment_names():
    named = {n: ewf.segment_path("x.E01", n) for n in (1, 99, 100, 125, 126, 775, 776)}
    assert named == {1: "x.E01", 99: "x.E99", 100: "x.EAA", 125: "x.EAZ", 126: "x.EBA", 775: "x.EZZ", 776: "x.FAA"}
    assert ewf.segment_path("x.e01", 100) == "x.eaa"
    with pytest.raises(OSError):
        ewf.segment_path("x.E01", 100 + 22 * 676)


def test_ewf_bytes_at_any_place(tmp_path):
    data = b"".join(hashlib.sha256(bytes([k % 251])).digest() * 8 if k % 3 else os.urandom(256) for k in range(1200)) + bytes(300 * 512)
    data += b"s" * (512 * 3)  # the last chunk is a short one
    segments = samples.ewf_image(data, sectors=8, per_table=7, per_segment=3)
    assert len(segments) > 4
    stream, size = evidence.open_evidence(write_ewf(tmp_path, segments))
    with stream:
        assert size == len(data) and stream.read() == data and stream.read(5) == b""
        for at, n in ((0, 1), (4095, 2), (28671, 9000), (len(data) - 7, 100), (100, 0), (50_000, 200_000), (1, 3)):
            assert stream.seek(at) == at and stream.read(n) == data[at : at + n]
        assert stream.seek(-4, os.SEEK_END) == len(data) - 4 and stream.read() == data[-4:]
    assert evidence.evidence_sha256(str(tmp_path / "a.E01")) == hashlib.sha256(data).hexdigest()
    stream, size = evidence.open_evidence(write_ewf(tmp_path, samples.ewf_image(b""), "none.e01"))
    with stream:
        assert (size, stream.read()) == (0, b"")


def test_damaged_ewf_images(tmp_path):
    data = os.urandom(4096) + b"a" * 8192 + os.urandom(4096)
    good = samples.ewf_image(data, sectors=8, per_table=2, per_segment=1)

    def read(name, segments):
        stream, _ = evidence.open_evidence(write_ewf(tmp_path, segments, f"{name}.E01"))
        with stream:
            return stream.read()

    def flipped(segment, at):
        return segment[:at] + bytes([segment[at] ^ 1]) + segment[at + 1 :]

    assert read("good", good) == data
    body = 13 + 76 + 1052 + 76
    cases = {
        "plain": [flipped(good[0], body + 10), good[1]],  # a chunk with its own checksum
        "packed": [flipped(good[0], body + 4100 + 26), good[1]],  # zlib's
        "section": [flipped(good[0], 13 + 20), good[1]],
        "missing": good[:1],
        "swapped": [good[0], good[0]],
        "short": [good[0], good[1][:-80]],
        "other": [b"not an image" * 10, good[1]],
    }
    for name, segments in cases.items():
        with pytest.raises(OSError):
            read(name, segments)


def test_run_on_an_ewf_image(spark, image, tmp_path):
    """A whole run gives the same tables for an EWF image as for the raw one."""
    path, _ = image
    with open(path, "rb") as f:
        first = write_ewf(tmp_path, samples.ewf_image(f.read()))
    config = EngineConfig(chunk_size=200_000, overlap=64, scan_strings=True, scan_entropy=True, page_recovery=True)
    raw, got = plan.run_tables(spark, path, config), plan.run_tables(spark, first, config)
    for name, df in got.items():
        plain = lambda d: sorted(map(repr, d.drop("evidence").collect()))
        assert plain(df) == plain(raw[name]), name


# scans


def test_chunk_plan():
    assert evidence.chunk_rows(100, 40, 10) == [(0, 0, 50, 40), (1, 40, 50, 40), (2, 80, 20, 20)]
    assert evidence.chunk_rows(100, 0, 10) == []


def test_hits_across_chunks(spark):
    data = b"x" * 30 + b"ababa" + b"x" * 29 + b"ab"
    got = scan.find_hits(chunks(spark, data, 32, 4), [("t", "p", b"aba")]).collect()
    assert sorted(r["global_offset"] for r in got) == [30, 32]


def spans(spark, data, least, most, utf16=False):
    return sorted((r["local_start"], r["length"], r["flags"]) for r in scan.find_spans(chunks(spark, data), least, most, utf16).collect())


def test_spans(spark):
    assert spans(spark, b"abc\0defg\nxyz", 4, 100) == [(4, 4, 0)]
    assert spans(spark, b"abcdefgh", 2, 4) == [(0, 4, 0), (4, 4, 0)]
    assert spans(spark, b"caf\xc3\xa9", 4, 100) == [(0, 5, 4)]
    assert spans(spark, b"\0" + "hello".encode("utf-16-le"), 4, 100, True)[-1][2] in (1, 2)
    assert spans(spark, b"mail a@b.example", 4, 100) == [(0, 16, 32)]


def test_artefacts_in_spans(spark):
    text = "visit (https://example.com/login), or mail user@example.com. 0000000000 bad +1 (415) 555-1234 good"
    got = {(r["kind"], r["content"], r["global_start"]) for r in scan.find_artefacts(chunks(spark, b"\0\1" + text.encode())).collect()}
    assert got == {("url", "https://example.com/login", 9), ("email", "user@example.com", 2 + text.index("user@")), ("phone", "1 (415) 555-1234", 2 + text.index("1 (415)"))}
    wide = "https://example.com".encode("utf-16-le")
    got = scan.find_artefacts(chunks(spark, wide + b"\1\1"), utf16=True).where("encoding = 'utf-16le'").first()
    assert (got["content"], got["global_start"], got["global_end"]) == ("https://example.com", 0, 37)
    assert {r["kind"] for r in scan.find_artefacts(chunks(spark, text.encode()), kinds=("email",)).collect()} == {"email"}


BAD_URLS = ["http://a", "www.a..b/", "http://user:pass@host.example/", "http://" + "a" * 64 + ".b/", "http://" + "a.b" * 100 + "/", "http://a.b/" + "c" * 2048, "www.a.b"]


def test_implausible_urls(spark):
    df = spark.createDataFrame([(u,) for u in BAD_URLS], "u string")
    assert all(r[0] == [] for r in df.select(A.extract(F.col("u"), "url")).collect()) and all(scan.plausible("url", u) is None for u in BAD_URLS)
    parts = A.url_parts(F.lit("https://h.example:8080/p/q?a=b#c"))
    assert spark.range(1).select(*(v.alias(k) for k, v in parts.items())).first().asDict() == {"scheme": "https", "host": "h.example", "port": 8080, "path": "/p/q", "query": "a=b", "fragment": "c"}


def test_entropy(spark):
    w = scan.entropy_windows(chunks(spark, bytes(range(256))), 256)
    r = scan.entropy_regions(w, 256, 7.5).collect()
    assert [(x["start"], x["end"], x["entropy"]) for x in r] == [(0, 255, 8.0)]
    assert not scan.entropy_regions(scan.entropy_windows(chunks(spark, bytes(1024)), 256), 256, 7.0).collect()
    two = scan.entropy_windows(chunks(spark, bytes(range(256)) * 4, 512), 256)
    assert scan.entropy_regions(two, 256, 7.5).count() == 2 and scan.entropy_regions(two, 256, 7.5, across_chunks=True).count() == 1


# browsers


def make_db(*statements):
    import os
    import sqlite3
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        db = sqlite3.connect(os.path.join(folder, "x"))
        for s in statements:
            db.execute(s)
        db.commit()
        db.close()
        with open(os.path.join(folder, "x"), "rb") as f:
            return f.read()


def sqlite_rows(spark, **files):
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "source_file string, data binary")
    return df, browser.read_sqlite_tables(df)


def test_history_cookies_downloads(spark):
    places = make_db("create table moz_places (id integer primary key, url text, title text)", "insert into moz_places values (1, 'https://a.example/', null)", "create table moz_historyvisits (id integer primary key, place_id integer, visit_date integer, visit_type integer)", "insert into moz_historyvisits values (1, 1, 1700000000000000, 2), (2, 7, 5, 1)")
    alone = make_db("create table urls (id integer primary key, url text, title text, last_visit_time integer)", "insert into urls values (1, 'https://b.example/', 'B', 13303449600000000)")
    jar = make_db("create table cookies (host_key text, name text, value text, path text, expires_utc integer, last_access_utc integer, creation_utc integer, is_secure integer, is_httponly integer)", "insert into cookies values ('h', 'n', 'v', '/', 0, 13303449600000000, 1, 1, 0)", "create table moz_cookies (host text, name text, value text, path text, expiry integer, lastAccessed integer, creationTime integer, isSecure integer, isHttpOnly integer)", "insert into moz_cookies values ('f', 'n', 'v', '/', 1700000000, 1, 1, 0, 1)")
    loads = make_db("create table downloads (id integer, target_path text, start_time integer, end_time integer, total_bytes integer, state integer)", "insert into downloads values (1, '/t', 13303449600000000, 0, 10, 1), (2, '/u', 0, 0, 5, 0)", "create table downloads_url_chains (id integer, chain_index integer, url text)", "insert into downloads_url_chains values (1, 0, 'https://c.example/'), (1, 1, 'https://d.example/')")
    files, rows = sqlite_rows(spark, a=places, b=alone, c=jar, d=loads, e=b"no database", f=samples.history_db())
    seen = {(r["source_file"], r["url"], r["visit_source"], str(r["visit_time"])) for r in browser.history(rows).where("source_file in ('a', 'b')").collect()}
    assert seen == {("a", "https://a.example/", "typed", "2023-11-14 22:13:20"), ("b", "https://b.example/", None, "2022-07-28 02:40:00")}
    got = {r["browser"]: r for r in browser.cookies(rows).collect()}
    assert got["chrome"]["secure"] and not got["chrome"]["http_only"] and got["chrome"]["expires"] is None and str(got["firefox"]["expires"]) == "2023-11-14 22:13:20"
    assert {(r["url"], r["target"]) for r in browser.downloads(rows).collect()} == {("https://c.example/", "/t"), (None, "/u")}
    again = sqlite_pages.recover_history(files, browser.history(rows), datetime(2026, 1, 1, tzinfo=timezone.utc))
    assert again.where("source_file in ('a', 'b', 'f')").count() == 0


def test_page_recovery(spark):
    data = samples.history_db()
    files = spark.createDataFrame([("f", bytearray(data)), ("g", bytearray(b"x" * 200))], "source_file string, data binary")
    got = {r["url"]: r for r in sqlite_pages.recover_history(files, None, datetime(2026, 1, 1, tzinfo=timezone.utc)).collect()}
    assert len(got) == 21 and got["https://site3.example.com/page"]["title"] == "Title 3 of a page" and str(got["https://site3.example.com/page"]["visit_time"]).startswith("2022-07-28")
    assert got["https://long.example.com/"]["title"] is None  # too long for a title, but its overflow pages were read


# configuration, names, streams


def test_configuration():
    config, unknown = EngineConfig().only_types(["JPEG", "docx", "nope", "also"])
    assert [t.id for t in config.file_types] == ["jpeg", "zip"] and unknown == ["also", "nope"] and config.zip_kinds == ("docx",)
    assert [t.id for t in EngineConfig().only_types(["zip", "png"], disable_zip=True)[0].file_types] == ["png"]
    config, digest = load_config("chunk_size: 7\nfile_types:\n - {id: x, headers: [{id: h, hex: '41'}], footers: ['42'], carver: footer}\n")
    assert config.chunk_size == 7 and config.file_types == (FileType("x", (), (("h", "41"),), 0, 0, "footer", ("42",)),) and len(digest) == 64
    assert new_run_id("abcdef0123", datetime(2024, 1, 2, tzinfo=timezone.utc)) == "20240102T000000Z_abcdef01"
    assert EngineConfig(scan_urls=False).with_artefacts(urls=True).scan_strings and len(EngineConfig().patterns()) == 44


def test_names(spark):
    df = spark.createDataFrame([("a b/../c.", 10, 0), ("...", 10, 5)], "t string, s long, n long")
    got = df.select(N.component(F.col("t")), N.carved_path(F.lit("zip"), F.col("s"), F.lit("ZIP")), N.global_end(F.col("s"), F.col("n")), N.transition_label(F.lit(257)), N.webkit_time(F.lit(5))).collect()
    assert [tuple(r) for r in got] == [("a_b_._c", "zip/zip_00000000000A.zip", 10, "typed", None), ("unknown", "zip/zip_00000000000A.zip", 14, "typed", None)]


def test_stream_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_bytes(b"xx" + b"\xff\xd8\xff" + bytes(50))
    got = []

    def sink(df, batch):
        got.extend(scan.find_hits(df, [("jpeg", "soi", b"\xff\xd8\xff")]).select("evidence", "global_offset").collect())

    for name in ("a", "b"):
        (folder / name).write_bytes(b"xx" + b"\xff\xd8\xff" + bytes(50))
        watch.run_once(watch.watch_folder(spark, str(folder), 16, 4), sink, str(tmp_path / "state"))
    assert sorted((r["evidence"][-1], r["global_offset"]) for r in got) == [("a", 2), ("b", 2)]


# queries against DuckDB


def canon(rows, columns):
    def one(v):
        return "" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(r[c]) for c in columns) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    got = [r.asDict() for r in df.collect()]
    if name in queries.SQL:
        rel = duck.sql(queries.SQL[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert canon(got, sorted(df.columns)) == canon([dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()], sorted(df.columns))
    else:
        assert got


def test_optional_columns_rounds_halves_as_its_sql(spark, tmp_path):
    import duckdb

    amounts = {0.5: False, -0.5: False, 0.51: True, -0.51: True, 0.49: False, -0.49: False, 1.5: True, -1.5: True, 0.49999999999999994: False, 0.5000000000000001: True, 0.0: False, None: None}
    rows = [(k, f"c{k}", 1, x, "BUILDING") for k, x in enumerate(amounts)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    want = [(k, "BUILDING", None, secure) for k, secure in enumerate(amounts.values())]
    assert sorted(tuple(r) for r in queries.optional_columns(spark, str(tmp_path)).collect()) == want
    con = duckdb.connect()
    con.execute(f"create view customer as select * from read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    assert sorted(con.sql(queries.SQL["optional_columns"]).fetchall()) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(3).collect()
