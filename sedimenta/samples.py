"""Small files of every format, built from their layouts: for tests and for the carving query."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import os
import sqlite3
import struct
import tarfile
import tempfile
import wave
import zipfile
import zlib


def history_db(rows: int = 20) -> bytes:
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "h")
        db = sqlite3.connect(path)
        db.execute("pragma page_size = 1024")
        db.execute("create table urls (id integer primary key, url text, title text, last_visit_time integer)")
        db.execute("create table visits (id integer primary key, url integer, visit_time integer, transition integer)")
        for i in range(rows):
            db.execute("insert into urls values (?, ?, ?, ?)", (i + 1, f"https://site{i}.example.com/page", f"Title {i} of a page", 13303449600000000 + i))
            db.execute("insert into visits values (?, ?, ?, ?)", (i + 1, i + 1, 13303449600000000 + i, 1))
        db.execute("insert into urls values (900, 'https://long.example.com/', ?, null)", ("t" * 3000,))
        db.commit()
        db.close()
        with open(path, "rb") as f:
            return f.read()


def png() -> bytes:
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(range(72)))) + chunk(b"IEND", b"")


def office(names: dict[str, bytes], mime: bytes | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ({"mimetype": mime} if mime else {} | names).items():
            z.writestr(zipfile.ZipInfo(name), data)
        for name, data in names.items() if mime else ():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def riff(form: bytes, body: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", len(body) + 4) + form + body


def sound() -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, 8000, 0, "NONE", ""))
        w.writeframes(bytes(100))
    return out.getvalue()


def ole(name: str = "WordDocument") -> bytes:
    head = bytearray(b"\xff" * 512)
    head[:76] = bytes(76)
    head[:8] = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    struct.pack_into("<HHHHH", head, 24, 62, 3, 0xFFFE, 9, 6)
    struct.pack_into("<II", head, 44, 1, 1)
    struct.pack_into("<I", head, 76, 0)
    fat = struct.pack("<4I", 0xFFFFFFFD, 0xFFFFFFFE, 3, 0xFFFFFFFE) + b"\xff" * (512 - 16)
    entry = bytearray(128)
    text = name.encode("utf-16-le") + b"\0\0"
    entry[: len(text)] = text
    struct.pack_into("<H", entry, 64, len(text))
    entry[66] = 2
    return bytes(head) + fat + bytes(entry) + bytes(384) + b"d" * 1024


def box(kind: bytes, data: bytes = b"") -> bytes:
    return struct.pack(">I", 8 + len(data)) + kind + data


def tiff(order: str = "<") -> bytes:
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    strips = struct.pack(order + "H", 2) + struct.pack(order + "HHII", 273, 4, 1, 38) + struct.pack(order + "HHII", 279, 4, 1, 20) + struct.pack(order + "I", 0)
    return head + strips + b"s" * 20


def tar() -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        info = tarfile.TarInfo("a.txt")
        info.size = 600
        t.addfile(info, io.BytesIO(b"x" * 600))
    return out.getvalue()[: 512 + 1024 + 1024]


def ogg() -> bytes:
    page = lambda flags, data: b"OggS\0" + bytes([flags]) + bytes(20) + bytes([1, len(data)]) + data
    return page(2, b"first") + page(4, b"last page")


def webm() -> bytes:
    doc = b"\x42\x82\x84webm"
    return b"\x1a\x45\xdf\xa3" + bytes([0x80 | len(doc)]) + doc + b"\x18\x53\x80\x67\x40\x64" + b"w" * 100


def wmv() -> bytes:
    prop = bytes.fromhex("a1dcab8c47a9cf118ee400c00c205365") + struct.pack("<Q", 104) + bytes(16) + struct.pack("<Q", 300) + bytes(56)
    head = bytes.fromhex("3026b2758e66cf11a6d900aa0062ce6c") + struct.pack("<QIBB", 30 + len(prop), 1, 1, 2) + prop
    return head + b"v" * (300 - len(head))


def ico() -> bytes:
    image = struct.pack("<I", 40) + bytes(60)
    return b"\0\0\1\0\1\0" + bytes([16, 16, 0, 0, 1, 0, 32, 0]) + struct.pack("<II", len(image), 22) + image


def elf() -> bytes:
    head = bytearray(64)
    head[:6] = b"\x7fELF\x02\x01"
    struct.pack_into("<QQ", head, 32, 64, 120)
    struct.pack_into("<HHHHH", head, 52, 64, 56, 1, 64, 1)
    return bytes(head) + bytes(56) + bytes(64)


def mobi() -> bytes:
    head = b"book".ljust(60, b"\0") + b"BOOKMOBI" + bytes(8) + struct.pack(">H", 2)
    return head + struct.pack(">IIII", 94, 0, 194, 0) + b"m" * 200


def files() -> dict[str, bytes]:
    """Name (the expected type, then a number where there are several) and content."""
    frame = b"\xff\xfb\x90\x00" + b"\x55" * 413
    bmp = b"BM" + struct.pack("<IIIIiiHH", 58 + 200, 0, 54, 40, 8, 8, 1, 24) + bytes(24) + b"p" * 204
    return {
        "jpeg": b"\xff\xd8\xff\xe0\0\x10JFIF\0" + b"j" * 600 + b"\xff\xd9",
        "png": png() + b"" if len(png()) >= 100 else png(),
        "gif": b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + b"rgbrgb" + b"\x21\xfe\x64" + b"c" * 100 + b"\0" + b"\x2c" + bytes(9) + b"\x02\x03abc\0" + b"\x3b",
        "sqlite": history_db(),
        "pdf": b"%PDF-1.4\n" + b"1 0 obj << >> endobj\n" * 5 + b"%%EOF\r\n",
        "zip": office({"a.txt": b"some text", "b.txt": b"more"}),
        "docx": office({"word/document.xml": b"<w/>"}),
        "odt": office({"content.xml": b"<c/>"}, b"application/vnd.oasis.opendocument.text"),
        "webp": riff(b"WEBP", b"VP8 " + bytes(40)),
        "wav": sound(),
        "avi": riff(b"AVI ", b"LIST" + bytes(200)),
        "bmp": bmp[: 58 + 200],
        "tiff": tiff("<"),
        "tiff.2": tiff(">"),
        "mp4": box(b"ftyp", b"isom\0\0\0\1mp41")[:0] + struct.pack(">I", 20) + b"ftypisom\0\0\0\1mp41" + box(b"moov", b"m" * 40) + box(b"mdat", b"d" * 60),
        "mov": struct.pack(">I", 20) + b"ftypqt  \0\0\0\1qt  " + box(b"moov", b"m" * 40),
        "rar": b"Rar!\x1a\x07\0" + struct.pack("<HBHH", 0, 0x73, 0, 13) + bytes(6) + struct.pack("<HBHH", 0, 0x7B, 0, 12) + bytes(5),
        "rar.2": b"Rar!\x1a\x07\x01\0" + b"crc0" + bytes([20, 1, 0]) + bytes(18) + b"crc0" + bytes([3, 5, 0, 0]),
        "7z": b"7z\xbc\xaf\x27\x1c\0\4" + bytes(4) + struct.pack("<QQ", 50, 18) + bytes(4) + b"7" * 68,
        "mp3": b"ID3\3\0\0\0\0\0\x14" + bytes(20) + frame * 4,
        "doc": ole(),
        "xls": ole("Workbook"),
        "tar": tar(),
        "gzip": gzip.compress(b"gzip " * 50, mtime=0),
        "bzip2": b"BZh9" + b"b" * 30 + b"\x17\x72\x45\x38\x50\x90" + b"crc4",
        "xz": lzma.compress(b"xz " * 100),
        "ogg": ogg(),
        "webm": webm(),
        "wmv": wmv(),
        "rtf": b"{\\rtf1 text {\\b bold} \\} brace \\bin3 }}} end}",
        "ico": ico(),
        "elf": elf(),
        "eml": b"From: a@b.example\r\nTo: c@d.example\r\nSubject: hello\r\n\r\nbody text\r\n",
        "mobi": mobi(),
        "fb2": b"<?xml version='1.0'?><FictionBook>" + b"book " * 20 + b"</FICTIONBOOK>",
        "lrf": b"LRF\0" + bytes(4) + struct.pack("<I", 100) + b"l" * 88,
    }


def image(step: int = 32 << 10) -> tuple[bytes, dict[str, tuple[int, bytes]]]:
    """An image of whole sectors with each file at a multiple of the step, and where each lies."""
    out, places, at = bytearray(), {}, step
    for name, data in files().items():
        out += bytes(at - len(out)) + data
        places[name] = (at, data)
        at = -(-(len(out) + 1) // step) * step
        if name == "eml":  # its end is the next mail of a mailbox
            out += b"\nFrom next"
        if name == "gzip":
            out += b"\x1f\x8b\x08"
    return bytes(out) + bytes(step + -len(out) % 512), places


def write_image(path: str) -> dict[str, tuple[int, bytes]]:
    data, places = image()
    with open(path, "wb") as f:
        f.write(data)
    return places


def ewf_section(kind: bytes, at: int, body: bytes, last: bool = False) -> bytes:
    size = 76 + len(body)
    head = kind.ljust(16, b"\0") + struct.pack("<QQ40x", at if last else at + size, size)
    return head + struct.pack("<I", zlib.adler32(head)) + body


def ewf_image(data: bytes, sectors: int = 64, per_table: int = 5, per_segment: int = 2) -> list[bytes]:
    """The segment files of an EWF image of ``data`` (whole sectors of 512 bytes), with few chunks in a table and few tables in a segment; chunks are compressed where that makes them smaller."""
    step, segments = 512 * sectors, []
    chunks = [data[i : i + step] for i in range(0, len(data), step)]
    tables = [chunks[i : i + per_table] for i in range(0, len(chunks), per_table)]
    volume = struct.pack("<B3xIIIQ", 1, len(chunks), sectors, 512, len(data) // 512).ljust(1048, b"\0")
    parts = [tables[i : i + per_segment] for i in range(0, len(tables), per_segment)] or [[]]
    for n, groups in enumerate(parts, 1):
        out = b"EVF\x09\x0d\x0a\xff\0\1" + struct.pack("<HH", n, 0)
        if n == 1:
            out += ewf_section(b"volume", len(out), volume + struct.pack("<I", zlib.adler32(volume)))
        for group in groups:
            base, stored, entries = len(out), b"", []
            for chunk in group:
                packed = zlib.compress(chunk)
                small = len(packed) < len(chunk)
                entries.append((76 + len(stored)) | small << 31)
                stored += packed if small else chunk + struct.pack("<I", zlib.adler32(chunk))
            out += ewf_section(b"sectors", base, stored)
            head = struct.pack("<I4xQ4x", len(entries), base)
            listed = struct.pack(f"<{len(entries)}I", *entries)
            table = head + struct.pack("<I", zlib.adler32(head)) + listed + struct.pack("<I", zlib.adler32(listed))
            out += ewf_section(b"table", len(out), table)
            out += ewf_section(b"table2", len(out), table)
        segments.append(out + ewf_section(b"done" if n == len(parts) else b"next", len(out), b"", True))
    return segments
