"""EWF images (E01, and S01 with the same sections) as one seekable stream, after the format's published description.

An image is a row of segment files; each is a chain of sections with checked heads.  A volume (or disk) section gives the sizes, table sections give the places of compressed or plain
chunks, mostly 32 KiB each.  Opening reads the sections' heads only, once for each worker process and image; a read touches the table and the chunks that it needs, and keeps one of each.
A missing segment, a chunk that no table names, a wrong checksum or a chunk that doesn't decompress is an OSError: bytes are never made up.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

# Fixed values of the format.
SIGNATURE, SIGNATURE_2 = b"EVF\x09\x0d\x0a\xff\x00", b"EVF2\x0d\x0a\x81\x00"
FILE_HEAD, SECTION_HEAD, TABLE_HEAD, VOLUME_LONG = 13, 76, 24, 1052
SUFFIXES = (".e01", ".s01")


class Group(NamedTuple):
    """The chunks of one table: from number ``first`` on, in segment file ``path``."""

    first: int
    count: int
    path: str
    entries: int
    base: int
    end: int


class Index(NamedTuple):
    size: int
    chunk: int
    groups: tuple[Group, ...]


def segment_path(first: str, n: int) -> str:
    """The name of segment n (from 1): E01 to E99, EAA to EZZ, FAA and so on to ZZZ, in the case of the first one's letter."""
    if n < 100:
        return f"{first[:-2]}{n:02d}"
    letter, (third, rest) = first[-3], divmod(n - 100, 26 * 26)
    if ord(letter.upper()) + third > ord("Z"):
        raise OSError(f"{first}: segment {n} has no name")
    name = "".join(chr(x) for x in (ord(letter.upper()) + third, ord("A") + rest // 26, ord("A") + rest % 26))
    return first[:-3] + (name if letter.isupper() else name.lower())


def read_exactly(stream, at: int, n: int, path: str) -> bytes:
    stream.seek(at)
    parts, left = [], n
    while left and (data := stream.read(left)):
        parts.append(data)
        left -= len(data)
    if left:
        raise OSError(f"{path}: ends {left} bytes before {at + n}")
    return b"".join(parts)


def checked(data: bytes, n: int, path: str, what: str) -> bytes:
    if zlib.adler32(data[:n]) != struct.unpack_from("<I", data, n)[0]:
        raise OSError(f"{path}: the checksum of {what} doesn't hold")
    return data


def sections(stream, path: str):
    """(kind, place, size) of each section of a segment, to the one that ends it."""
    at = FILE_HEAD
    while True:
        head = checked(read_exactly(stream, at, SECTION_HEAD, path), 72, path, f"the section at {at}")
        kind, (after, size) = head[:16].rstrip(b"\0").decode("latin-1"), struct.unpack_from("<QQ", head, 16)
        yield kind, at, size
        if kind in ("next", "done"):
            return
        if after <= at:
            raise OSError(f"{path}: the section at {at} leads back to {after}")
        at = after


@lru_cache(maxsize=16)
def index(first: str, opener: Callable) -> Index:
    """Sizes and tables of the image that begins with segment ``first``; ``opener`` gives (stream, size) of a path."""
    size = chunk = None
    groups, chunks, n, last = [], 0, 1, "next"
    while last == "next":
        path = segment_path(first, n)
        stream, _ = opener(path)
        with stream:
            head = read_exactly(stream, 0, FILE_HEAD, path)
            if head[:8] != SIGNATURE or struct.unpack_from("<H", head, 9)[0] != n:
                raise OSError(f"{path}: {'version 2 of the format is not read' if head[:8] == SIGNATURE_2 else f'not segment {n} of an EWF image'}")
            data_end = None
            for kind, at, length in sections(stream, path):
                last = kind
                if kind in ("volume", "disk") and size is None:
                    wide = length - SECTION_HEAD >= VOLUME_LONG
                    per_chunk, per_sector, count = struct.unpack("<II" + ("Q" if wide else "I"), read_exactly(stream, at + SECTION_HEAD + 8, 16 if wide else 12, path))
                    size, chunk = count * per_sector, per_chunk * per_sector
                elif kind == "sectors":
                    data_end = at + length
                elif kind == "table":
                    count, base = struct.unpack_from("<I4xQ", checked(read_exactly(stream, at + SECTION_HEAD, TABLE_HEAD, path), 20, path, f"the table at {at}"))
                    if count:
                        # the oldest images hold their chunks in the table section itself
                        groups.append(Group(chunks, count, path, at + SECTION_HEAD + TABLE_HEAD, base, at + length if data_end is None else data_end))
                    chunks += count
        n += 1
    if size is None or size and not chunk or size and chunks < -(-size // chunk):
        raise OSError(f"{first}: the image has {chunks} chunks, which is not all of it")
    return Index(size, chunk or 1, tuple(groups))


class EwfStream(io.RawIOBase):
    """The bytes of the imaged medium.  One segment is open at a time."""

    def __init__(self, first: str, opener: Callable):
        super().__init__()
        self.opener, self.at = opener, 0
        self.file = self.file_path = self.table = self.table_of = self.kept = self.kept_number = None
        self.size, self.chunk, self.groups = index(first, opener)
        self.firsts = [g.first for g in self.groups]

    def readable(self):
        return True

    def seekable(self):
        return True

    def tell(self):
        return self.at

    def seek(self, offset, whence=os.SEEK_SET):
        at = offset + {os.SEEK_SET: 0, os.SEEK_CUR: self.at, os.SEEK_END: self.size}[whence]
        if at < 0:
            raise ValueError("a place before the start")
        self.at = at
        return at

    def close(self):
        if self.file is not None:
            self.file.close()
            self.file = None
        super().close()

    def segment(self, path: str):
        if self.file_path != path or self.file is None:
            if self.file is not None:
                self.file.close()
            self.file, self.file_path = self.opener(path)[0], path
        return self.file

    def chunk_bytes(self, number: int) -> bytes:
        if self.kept_number == number:
            return self.kept
        g = self.groups[bisect_right(self.firsts, number) - 1]
        stream, k = self.segment(g.path), number - g.first
        if self.table_of != g.first:
            self.table, self.table_of = struct.unpack(f"<{g.count}I", read_exactly(stream, g.entries, 4 * g.count, g.path)), g.first
        place = lambda i: g.base + (self.table[i] & 0x7FFFFFFF)  # noqa: E731  (the highest bit tells that a chunk is compressed)
        start, end, want = place(k), place(k + 1) if k + 1 < g.count else g.end, min(self.chunk, self.size - number * self.chunk)
        if not start < end <= g.end:
            raise OSError(f"{g.path}: chunk {number} would lie from {start} to {end}")
        data = read_exactly(stream, start, end - start, g.path)
        if self.table[k] >> 31:
            unpack = zlib.decompressobj()
            try:
                data = unpack.decompress(data, self.chunk + 1)
            except zlib.error as e:
                raise OSError(f"{g.path}: chunk {number}: {e}") from e
            if not unpack.eof:  # its checksum comes last
                raise OSError(f"{g.path}: chunk {number} doesn't end")
        elif len(data) >= want + 4:
            checked(data, want, g.path, f"chunk {number}")
        if len(data) < want:
            raise OSError(f"{g.path}: chunk {number} has {len(data)} of {want} bytes")
        self.kept, self.kept_number = data[:want], number
        return self.kept

    def readinto(self, buffer):
        done, n = 0, max(0, min(len(buffer), self.size - self.at))
        while done < n:
            number, skip = divmod(self.at, self.chunk)
            part = self.chunk_bytes(number)[skip : skip + n - done]
            buffer[done : done + len(part)] = part
            done += len(part)
            self.at += len(part)
        return done
