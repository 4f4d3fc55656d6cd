"""Where embedded files end: one rule for each format.

A rule gets a view of the evidence, the offset of a header and the format's limits, and returns an Extent or None (no file here).  Rules read only what they
need; nothing is copied, and content is hashed or written later from (start, size).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from dataclasses import dataclass, field

BLOCK = 64 << 10


class View:
    """Random reads of ``size`` bytes of evidence with a small block cache."""

    def __init__(self, source, size: int, block: int = BLOCK, blocks: int = 64):
        self.source, self.size, self.block, self.blocks, self.cache = source, size, block, blocks, {}

    def read(self, at: int, n: int) -> bytes:
        """Up to n bytes; fewer at the end."""
        n = max(0, min(n, self.size - at))
        if n <= 0 or at < 0:
            return b""
        if n > 4 * self.block:
            self.source.seek(at)
            return self.source.read(n)
        first, last = at // self.block, (at + n - 1) // self.block
        data = b"".join(map(self._load, range(first, last + 1)))
        return data[at - first * self.block : at - first * self.block + n]

    def _load(self, k: int) -> bytes:
        data = self.cache.get(k)
        if data is None:
            if len(self.cache) >= self.blocks:
                self.cache.pop(next(iter(self.cache)))
            self.source.seek(k * self.block)
            data = self.cache[k] = self.source.read(min(self.block, self.size - k * self.block))
        return data

    def exact(self, at: int, n: int) -> bytes | None:
        data = self.read(at, n)
        return data if len(data) == n else None

    def find(self, pattern: bytes, at: int, end: int, fold: bool = False) -> int:
        """The first place of a pattern that lies within [at, end), or -1."""
        end, step = min(end, self.size), 1 << 20
        while at < end:
            data = self.read(at, min(step + len(pattern) - 1, end - at))
            hit = (data.lower() if fold else data).find(pattern)
            if hit >= 0:
                return at + hit
            at += step
        return -1


@dataclass
class Extent:
    start: int
    size: int
    validated: bool
    truncated: bool
    errors: list[str] = field(default_factory=list)
    kind: str | None = None


@dataclass(frozen=True)
class Limits:
    max_size: int = 0
    min_size: int = 0
    header: bytes = b""
    headers: tuple[bytes, ...] = ()
    footers: tuple[bytes, ...] = ()
    require_eocd: bool = True
    allowed: tuple[str, ...] | None = None
    quicktime: str = "mov"


class Stop(Exception):
    """The walk met the size limit or the end of the evidence."""


class Walk:
    """Reads on from a start, within the limit."""

    def __init__(self, view: View, start: int, most: int):
        self.view, self.start, self.at, self.most = view, start, start, most

    def skip(self, n: int) -> None:
        if self.most and self.at - self.start + n > self.most:
            raise Stop("truncated output")
        if self.at + n > self.view.size:
            self.at = max(self.at, self.view.size)
            raise Stop("unexpected eof")
        self.at += n

    def take(self, n: int) -> bytes:
        at = self.at
        self.skip(n)
        return self.view.read(at, n)

    @property
    def size(self) -> int:
        return self.at - self.start


def walked(rule):
    """A rule that moves a Walk and returns whether the file is whole (None: no file); stops count as truncation."""

    def run(view: View, start: int, lim: Limits) -> Extent | None:
        walk = Walk(view, start, lim.max_size)
        try:
            whole = rule(walk, lim)
            if whole is None:
                return None
            out = Extent(start, walk.size, bool(whole), False)
        except Stop as e:
            out = Extent(start, walk.size, False, True, [str(e)])
        return out if out.size >= lim.min_size else None

    run.__doc__ = rule.__doc__
    return run


def cut_at_limit(extent: Extent | None, lim: Limits) -> Extent | None:
    """Marks a file that fills the limit."""
    if extent and lim.max_size and extent.size >= lim.max_size:
        extent.truncated = True
        if not any("max_size" in e for e in extent.errors):
            extent.errors.append("max_size reached")
    return extent


def ranged(view: View, start: int, end: int, lim: Limits, name: str = "", valid: bool = True, mark_limit: bool = True) -> Extent | None:
    """[start, end) within the limit and the evidence.  ``name`` given: the reasons are reported."""
    errors, truncated = [], False
    if lim.max_size and end - start > lim.max_size:
        end = start + lim.max_size
        if mark_limit:
            truncated = True
            errors += [f"max_size reached before {name} end"] if name else []
    if end > view.size:
        end, truncated = view.size, True
        errors += [f"eof before {name} end"] if name else []
    size = max(0, end - start)
    return Extent(start, size, valid and not truncated, truncated, errors) if size >= lim.min_size else None


def until(view: View, start: int, lim: Limits, patterns: tuple[bytes, ...], name: str, skip: int = 0, fold: bool = False) -> Extent | None:
    """Up to and with the first of some patterns."""
    end = min(view.size, start + lim.max_size) if lim.max_size else view.size
    best = min(((p, x) for x in patterns if (p := view.find(x, start + skip, end, fold)) >= 0), default=None, key=lambda h: h[0])
    if best:
        out = Extent(start, best[0] + len(best[1]) - start, True, False)
    else:
        full = lim.max_size and start + lim.max_size <= view.size
        out = Extent(start, end - start, False, True, [f"max_size reached before {name}" if full else f"eof before {name}"])
    return out if out.size >= lim.min_size else None


def jpeg(view, start, lim):
    """To the first end-of-image marker."""
    return until(view, start, lim, (b"\xff\xd9",), "EOI")


@walked
def png(w, lim):
    """Chunks up to IEND."""
    if w.take(8) != b"\x89PNG\r\n\x1a\n":
        return None
    while True:
        n = int.from_bytes(w.take(4), "big")
        kind = w.take(4)
        try:
            kind.decode()
        except UnicodeDecodeError:
            return None
        if lim.max_size and n > lim.max_size:
            raise Stop("truncated output")
        w.skip(n)
        w.skip(4)
        if kind == b"IEND":
            return True


@walked
def gif(w, lim):
    """Blocks up to the trailer."""

    def blocks():
        while n := w.take(1)[0]:
            w.skip(n)

    def colours(packed):
        if packed & 0x80:
            w.skip(3 << ((packed & 7) + 1))

    if w.take(6) not in (b"GIF87a", b"GIF89a"):
        return None
    colours(w.take(7)[4])
    while True:
        block = w.take(1)[0]
        if block == 0x3B:
            return True
        if block == 0x21:
            w.skip(1)
        elif block == 0x2C:
            colours(w.take(9)[8])
            w.skip(1)
        else:
            return None
        blocks()


def sqlite(view, start, lim):
    """Page size by page count of the header."""

    @walked
    def rule(w, lim):
        head = w.take(100)
        page, pages = int.from_bytes(head[16:18], "big"), int.from_bytes(head[28:32], "big")
        page = 65536 if page == 1 else page
        if head[:16] != b"SQLite format 3\0" or not 512 <= page <= 65536 or page & (page - 1):
            return None
        total = max(100, page * (pages or 1))
        w.skip(min(total, lim.max_size or total) - 100)
        return True

    return cut_at_limit(rule(view, start, lim), lim)


def pdf(view, start, lim):
    """To the first %%EOF and the line end after it."""
    out = until(view, start, lim, (b"%%EOF",), "EOF")
    if out and out.validated:
        tail = view.read(start + out.size, 2)
        more = 2 if tail == b"\r\n" else 1 if tail[:1] in (b"\r", b"\n") else 0
        out.size = min(out.size + more, lim.max_size or out.size + more)
    return out


def zip_kind(view: View, start: int, directory: int, size: int) -> str | None:
    """docx, xlsx or pptx by the names of entries, else odt, ods, odp or epub by a stored mimetype."""
    if size > 16 << 20:
        return None
    data, at, names, mime = view.read(directory, size), 0, [], None
    while data[at : at + 4] == b"PK\1\2" and at + 46 <= len(data):
        method, packed = struct.unpack_from("<H", data, at + 10)[0], struct.unpack_from("<I", data, at + 20)[0]
        name, extra, comment = struct.unpack_from("<HHH", data, at + 28)
        text = data[at + 46 : at + 46 + name]
        names.append(text)
        if text == b"mimetype" and method == 0 and packed <= 1024 and mime is None:
            local = start + struct.unpack_from("<I", data, at + 42)[0]
            head = view.exact(local, 30)
            if head and head[:4] == b"PK\3\4":
                n, e = struct.unpack_from("<HH", head, 26)
                mime = view.read(local + 30 + n + e, packed).strip()
        at += 46 + name + extra + comment
    for prefix, kind in ((b"word/", "docx"), (b"xl/", "xlsx"), (b"ppt/", "pptx")):
        if any(n.startswith(prefix) for n in names):
            return kind
    return {
        b"application/vnd.oasis.opendocument.text": "odt", b"application/vnd.oasis.opendocument.spreadsheet": "ods",
        b"application/vnd.oasis.opendocument.presentation": "odp", b"application/epub+zip": "epub",
    }.get(mime)


def zip_archive(view, start, lim):
    """To the last end record within the limit whose directory ends where it begins; without that demand, to the first end record."""
    end = min(view.size, start + lim.max_size) if lim.max_size else view.size
    at, best = start, None
    while (at := view.find(b"PK\5\6", at, end)) >= 0:
        record = view.exact(at, 22)
        if record is None:
            break
        size, offset, comment = struct.unpack_from("<IIH", record, 12)
        if start + offset + size == at or not lim.require_eocd:
            best = at, offset, size, comment
            if not lim.require_eocd:
                break
        at += 4
    if best is None:
        if lim.require_eocd:
            return None
        return ranged(view, start, end, Limits(0, lim.min_size), "EOCD", valid=False)
    at, offset, size, comment = best
    out = ranged(view, start, at + 22 + comment, lim, "zip")
    if out:
        out.kind = zip_kind(view, start, start + offset, size)
        if lim.require_eocd and lim.allowed is not None and (out.kind or "zip") not in lim.allowed:
            return None
    return out


def riff(form: bytes):
    def rule(view, start, lim):
        """Size of the header plus 8."""
        head = view.exact(start, 12)
        if head is None or head[:4] != b"RIFF" or head[8:] != form:
            return None
        return ranged(view, start, start + 8 + int.from_bytes(head[4:8], "little"), lim, form.decode().strip())

    return rule


def bmp(view, start, lim):
    """Size of the header, if its fields are plausible."""
    head = view.read(start, 58)
    if len(head) < 26 or head[:2] != b"BM":
        return None
    size, pixels, dib = (int.from_bytes(head[i : i + 4], "little") for i in (2, 10, 14))
    if size < 14 or not 14 <= pixels <= size or dib not in (12, 40, 52, 56, 108, 124) or pixels < 14 + dib:
        return None
    if dib >= 40:
        width, height = struct.unpack_from("<ii", head, 18)
        if not 0 < width <= 32768 or abs(height) > 32768:
            return None
        if len(head) >= 30:
            depth = int.from_bytes(head[28:30], "little")
            if depth not in (1, 4, 8, 16, 24, 32) or size < pixels + (width * depth + 31) // 32 * 4 * abs(height) - 1024:
                return None
    return ranged(view, start, start + size, lim, "BMP")


def tiff(view, start, lim):
    """The furthest end of all directories and of the data, strips and tiles that they point to."""
    head = view.exact(start, 8)
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(head[:4]) if head else None
    if order is None:
        return None
    widths = {**dict.fromkeys((1, 2, 6, 7), 1), **dict.fromkeys((3, 8), 2), **dict.fromkeys((4, 9, 11), 4), **dict.fromkeys((5, 10, 12), 8)}
    first = struct.unpack_from(order + "I", head, 4)[0]
    end, todo, seen, errors = 8, deque([first] if first >= 8 else []), set(), []

    def values(kind, count, field, size):
        if count > 100_000:
            raise ValueError("tiff array too large")
        if kind not in (3, 4):
            return ()
        if size > 4:
            if size > 4 << 20:
                raise ValueError("tiff data too large")
            field = view.exact(start + struct.unpack(order + "I", field)[0], size)
            if field is None:
                raise EOFError
        return struct.unpack_from(f"{order}{min(count, len(field) // widths[kind])}{'H' if kind == 3 else 'I'}", field)

    while todo and not errors:
        at = todo.popleft()
        if not at or at in seen:
            continue
        seen.add(at)
        try:
            count = view.exact(start + at, 2)
            count = struct.unpack(order + "H", count)[0] if count else None
            if count is None:
                raise EOFError
            if count > 4096:
                raise ValueError("tiff IFD entry count too large")
            data = view.exact(start + at, 6 + 12 * count)
            if data is None:
                raise EOFError
            end, lists = max(end, at + len(data)), {}
            for i in range(count):
                tag, kind, n = struct.unpack_from(order + "HHI", data, 2 + 12 * i)
                field = data[10 + 12 * i : 14 + 12 * i]
                if not n or kind not in widths:
                    continue
                size = n * widths[kind]
                if size > 4:
                    end = max(end, struct.unpack(order + "I", field)[0] + size)
                if tag in (330, 34665, 34853):
                    todo.extend(o for o in values(kind, n, field, size) if o >= 8)
                elif tag in (273, 279, 324, 325):
                    lists[tag] = values(kind, n, field, size)
            todo.append(struct.unpack_from(order + "I", data, 2 + 12 * count)[0])
            for offsets, counts in ((273, 279), (324, 325)):
                end = max([end, *(o + c for o, c in zip(lists.get(offsets, ()), lists.get(counts, ()), strict=False))])
        except EOFError:
            errors.append("eof while reading TIFF IFD")
        except ValueError as e:
            errors.append(str(e))
    out = ranged(view, start, start + end, lim, "TIFF")
    if out and errors:
        out.errors[:0] = errors
        out.truncated, out.validated = True, False
    return out


def boxes(movie: bool):
    def rule(view, start, lim):
        """Boxes until one is impossible; ftyp and moov must be among them, with the brand of the format."""
        at, seen, errors, truncated = start, set(), [], False
        end = start + lim.max_size if lim.max_size else 1 << 62
        while at < view.size:
            head = view.exact(at, 8)
            if head is None:
                break
            size, kind, least = int.from_bytes(head[:4], "big"), head[4:], 8
            if size == 1:
                wide = view.exact(at + 8, 8)
                if wide is None:
                    break
                size, least = int.from_bytes(wide, "big"), 16
            elif size == 0:
                size = view.size - at
            if size < least or not re.fullmatch(rb"[\x20-\x7e\xa9]{4}", kind):
                break
            if kind == b"ftyp":
                brand = view.read(at + least, 4)
                if (brand == b"qt  ") != movie and not (lim.quicktime == "mp4" and not movie):
                    return None
            elif not seen:
                return None
            seen.add(kind)
            if at + size > min(end, view.size):
                truncated, at = True, min(end, view.size)
                errors.append("max_size reached before box end" if at == end else "eof before box end")
                break
            at += size
        if not {b"ftyp", b"moov"} <= seen:
            return None
        out = Extent(start, at - start, not truncated, truncated, errors)
        return out if out.size >= lim.min_size else None

    return rule


def _vint7(data: bytes, at: int) -> tuple[int, int] | None:
    value = 0
    for k in range(10):
        if at + k >= len(data):
            return None
        value |= (data[at + k] & 0x7F) << 7 * k
        if not data[at + k] & 0x80:
            return value, at + k + 1
    return None


def rar(view, start, lim):
    """Blocks up to the end block, in either version."""
    sig = view.read(start, 8)
    if sig[:7] == b"Rar!\x1a\x07\x00":
        at, new = start + 7, False
    elif sig == b"Rar!\x1a\x07\x01\x00":
        at, new = start + 8, True
    else:
        return None
    errors, most = [], lim.max_size or 1 << 62
    while True:
        if at - start >= most:
            errors.append("max_size reached before RAR end")
            break
        if new:
            size = _vint7(view.read(at + 4, 10), 0)
            if view.exact(at, 4) is None or size is None:
                errors.append("eof before RAR end")
                break
            size, used = size
            if not 0 < size <= 1 << 20:
                return None
            head = view.exact(at + 4 + used, size)
            if head is None:
                errors.append("eof while reading RAR header")
                break
            kind = _vint7(head, 0)
            flags = kind and _vint7(head, kind[1])
            if not flags:
                return None
            kind, (flags, pos), data = kind[0], flags, 0
            if flags & 1:
                pos = (_vint7(head, pos) or (0, pos))[1]
            if flags & 2:
                data = (_vint7(head, pos) or (0, 0))[0]
            total, last = 4 + used + size + data, kind == 5
        else:
            head = view.exact(at, 7)
            if head is None:
                errors.append("eof before RAR end")
                break
            kind, flags, total = struct.unpack_from("<BHH", head, 2)
            if total < 7:
                return None
            size, last = total, kind == 0x7B
            if kind == 0x74:
                packed = view.exact(at + 7, 4)
                high = view.exact(at + 32, 4) if flags & 0x100 else b"\0\0\0\0"
                if flags & 0x100 and size < 36:
                    return None
                if packed is None or high is None:
                    errors.append("eof while reading RAR file header")
                    break
                total += int.from_bytes(packed + high, "little")
        if at - start + (total if new else size) > most:
            errors.append("max_size reached before RAR end")
            break
        at += total
        if last:
            break
    out = ranged(view, start, at, lim, "RAR")
    if out and errors:
        out.errors[:0] = errors
        out.truncated, out.validated = True, False
    return out


def sevenz(view, start, lim):
    """Header, then offset and size of the next header."""
    head = view.exact(start, 32)
    if head is None or head[:6] != b"7z\xbc\xaf\x27\x1c":
        return None
    offset, size = struct.unpack_from("<QQ", head, 12)
    return ranged(view, start, start + 32 + offset + size, lim, "7z")


# Bit rates (kbit/s) and sample rates (Hz) of MPEG audio; index 0 of a row is "free".
RATES_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
RATES_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def mpeg_frame(head: bytes) -> int:
    """Bytes of the frame that a header begins, 0 if it is none."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return 0
    version, layer, rate, sample, pad = head[1] >> 3 & 3, head[1] >> 1 & 3, head[2] >> 4, head[2] >> 2 & 3, head[2] >> 1 & 1
    if version == 1 or layer == 0 or rate in (0, 15) or sample == 3:
        return 0
    bits, hertz = (RATES_1 if version == 3 else RATES_2)[rate] * 1000, SAMPLE_RATES[version][sample]
    return (12 * bits // hertz + pad) * 4 if layer == 3 else (144 if version == 3 else 72) * bits // hertz + pad


def mp3(view, start, lim):
    """An ID3v2 tag, frames, an ID3v1 tag; without the first, three frames at least."""

    @walked
    def rule(w, lim):
        head, tagged, frames = w.take(10), False, 0
        if head[:3] == b"ID3":
            size = 0
            for b in head[6:10]:
                size = size << 7 | b & 0x7F
            w.skip(size)
            tagged = True
        else:
            n = mpeg_frame(head)
            if not n:
                return None
            w.skip(max(0, n - 10))
            frames = 1
        while frames < 100_000 and w.size < (lim.max_size or 500 << 20):
            head = view.exact(w.at, 4)
            if head is None:
                break
            if head[:3] == b"TAG":
                w.skip(128)
                break
            n = mpeg_frame(head)
            if not n:
                break
            w.skip(n)
            frames += 1
        return True if tagged or frames >= 3 else None

    return cut_at_limit(rule(view, start, lim), lim)


FREE_SECTOR = 0xFFFFFFFA


def ole(view, start, lim):
    """The highest sector that the allocation table uses; the kind is that of the directory's streams."""
    head, most = view.exact(start, 512), lim.max_size or 512 << 20
    if head is None or head[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return None
    version, _, power = struct.unpack_from("<HHH", head, 26)
    if (version, power) not in ((3, 9), (4, 12)):
        return None
    sector = 1 << power
    tables = []
    for s in struct.unpack_from("<109I", head, 76):
        if s >= FREE_SECTOR:
            break
        tables.append(s)
    directory = struct.unpack_from("<I", head, 48)[0]
    fat: list[int] = []
    for s in tables:
        data = view.exact(start + 512 + s * sector, sector)
        if 512 + (s + 1) * sector > most or data is None:
            break
        fat += struct.unpack(f"<{sector // 4}I", data)
    highest = max([*tables, *([directory] if directory < FREE_SECTOR else []), 0])
    for i, e in enumerate(fat):
        if e != 0xFFFFFFFF:
            highest = max(highest, i, e if e < FREE_SECTOR else 0)
    size = 512 + (highest + 1) * sector if tables else 512 + sector
    out = ranged(view, start, start + min(size, most), Limits(0, lim.min_size))
    if out is None:
        return None
    out.validated, out.truncated = True, False
    names, current, visited = set(), directory, 0
    while current < FREE_SECTOR and visited < 1024 and 512 + (current + 1) * sector <= most:
        data = view.exact(start + 512 + current * sector, sector)
        if data is None:
            break
        for i in range(0, sector, 128):
            n = int.from_bytes(data[i + 64 : i + 66], "little")
            if data[i + 66] == 2 and 2 <= n <= 64:
                names.add(data[i : i + n - 2].decode("utf-16-le", "replace"))
        current, visited = fat[current] if current < len(fat) else 0xFFFFFFFE, visited + 1
    out.kind = "doc" if "WordDocument" in names else "xls" if names & {"Workbook", "Book"} else "ppt" if "PowerPoint Document" in names else None
    if lim.allowed is not None and (out.kind or "ole") not in lim.allowed:
        return None
    return cut_at_limit(out, lim)


def tar(view, hit, lim):
    """Members with correct checksums up to two blocks of zeros; the hit is 257 bytes into the first header."""
    start = hit - 257
    if start < 0:
        return None

    @walked
    def rule(w, lim):
        members = zeros = 0
        while True:
            head = w.take(512)
            if not head.strip(b"\0"):
                zeros += 1
                if zeros == 2:
                    return True if members else None
                continue
            zeros = 0
            try:
                told, size = (int(head[a:b].strip(b" \0") or b"0", 8) for a, b in ((148, 156), (124, 136)))
            except ValueError:
                return None
            if told != sum(head) - sum(head[148:156]) + 8 * 32:
                return None
            members += 1
            w.skip(-(-size // 512) * 512)

    return cut_at_limit(rule(view, start, lim), lim)


def gzip(view, start, lim):
    """Up to the next header or the end of the evidence."""
    head = view.exact(start, 10)
    if head is None or head[:3] != b"\x1f\x8b\x08":
        return None
    at, flags = start + 10, head[3]
    if flags & 4:
        extra = view.exact(at, 2)
        if extra is None:
            return None
        at += 2 + int.from_bytes(extra, "little")
    for _ in range((flags >> 3 & 1) + (flags >> 4 & 1)):
        at = view.find(b"\0", at, min(view.size, at + (1 << 20))) + 1
        if not at:
            return None
    at += flags & 2
    end = start + lim.max_size if lim.max_size else 1 << 62
    following = view.find(b"\x1f\x8b\x08", at, min(end, view.size))
    stop = following if following >= 0 else min(view.size, end)
    out = Extent(start, max(0, stop - start), following >= 0 or view.size < end, False)
    if lim.max_size and stop >= end:
        out.truncated, out.errors = True, ["max_size reached before gzip end"]
    return out if out.size >= lim.min_size else None


def bzip2(view, start, lim):
    """To the end marker and its checksum, at a byte's boundary."""
    head = view.exact(start, 4)
    if head is None or head[:3] != b"BZh" or head[3] not in b"123456789":
        return None
    end = min(view.size, start + lim.max_size) if lim.max_size else view.size
    at = view.find(b"\x17\x72\x45\x38\x50\x90", start + 4, end)
    if at >= 0:
        return ranged(view, start, at + 10, lim, "bzip2")
    full = bool(lim.max_size) and start + lim.max_size <= view.size
    out = Extent(start, end - start, False, full, ["max_size reached before bzip2 end"] if full else [])
    return out if out.size >= lim.min_size else None


def xz(view, start, lim):
    """To a footer whose checksum holds."""
    head = view.exact(start, 12)
    if head is None or head[:6] != b"\xfd7zXZ\0" or zlib.crc32(head[6:8]) != int.from_bytes(head[8:12], "little"):
        return None
    end = min(view.size, start + lim.max_size) if lim.max_size else view.size
    at = start + 12
    while (at := view.find(b"YZ", at, end)) >= 0:
        foot = view.exact(at - 10, 12)
        if foot and at - 10 >= start + 12 and zlib.crc32(foot[4:10]) == int.from_bytes(foot[:4], "little"):
            return ranged(view, start, at + 2, lim, "xz")
        at += 1
    full = bool(lim.max_size) and start + lim.max_size <= view.size
    out = Extent(start, end - start, False, True, ["max_size reached before xz end" if full else "eof before xz end"])
    return out if out.size >= lim.min_size else None


@walked
def ogg(w, lim):
    """Pages up to the one that ends the stream."""
    for _ in range(1_000_000):
        head = w.take(27)
        if head[:4] != b"OggS":
            return None
        w.skip(sum(w.take(head[26])))
        if head[5] & 4:
            return True
    return None


def _vint(data: bytes, at: int, keep: bool):
    """(value, next, unknown) of a variable-length number; ids keep their length bits."""
    if at >= len(data) or not data[at]:
        return None
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        return None
    value = int.from_bytes(data[at : at + n], "big")
    value = value if keep else value & (1 << 7 * n) - 1
    return value, at + n, value == (1 << 7 * n) - 1


def webm(view, start, lim):
    """The header's document type, then the segment's size."""
    head = view.read(start, 64 << 10)
    size = _vint(head, 4, False)
    if head[:4] != b"\x1a\x45\xdf\xa3" or size is None or size[1] + size[0] > len(head):
        return None
    body, at, kind = head[size[1] : size[1] + size[0]], 0, None
    while kind is None and (i := _vint(body, at, True)) and (n := _vint(body, i[1], False)):
        if i[0] == 0x4282:
            kind = body[n[1] : n[1] + n[0]].lower().rstrip(b"\0")
        at = n[1] + n[0]
    if kind not in (b"webm", b"matroska"):
        return None
    at, last = start + size[1] + size[0], start + size[1] + size[0] + (1 << 20)
    while at < last:
        head = view.read(at, 16)
        i = _vint(head, 0, True)
        n = i and _vint(head, i[1], False)
        if not n:
            return None
        if i[0] == 0x18538067:
            known = not n[2]
            end = at + n[1] + n[0] if known else start + lim.max_size if lim.max_size else view.size
            out = ranged(view, start, end, lim, valid=known)
            if out and lim.max_size and end >= start + lim.max_size:
                out.truncated, out.validated = True, False
            return out
        at += n[1] + n[0]
    return None


def wmv(view, start, lim):
    """The size in the file properties, else that of the header."""
    head = view.exact(start, 30)
    if head is None or head[:16].hex() != "3026b2758e66cf11a6d900aa0062ce6c":
        return None
    end = start + int.from_bytes(head[16:24], "little")
    if end < start + 30:
        return None
    at, total = start + 30, end
    while at + 24 <= end:
        item = view.exact(at, 24)
        if item is None:
            return None
        size = int.from_bytes(item[16:], "little")
        if size < 24:
            break
        if item[:16].hex() == "a1dcab8c47a9cf118ee400c00c205365":
            told = view.exact(at + 40, 8)
            total = start + int.from_bytes(told, "little") if told else total
            break
        at += size
    return ranged(view, start, total, lim, mark_limit=False)


def rtf(view, start, lim):
    """To the brace that closes the first one; control words, escapes and binary runs are passed over."""
    if view.read(start, 5) != b"{\\rtf":
        return None
    token = re.compile(rb"\\bin ?([0-9]+)[ ]?|\\[{}\\]|\\[A-Za-z]*|[{}]")
    end, depth, at = min(view.size, start + lim.max_size) if lim.max_size else view.size, 0, start
    while at < end:
        data = view.read(at, min(1 << 20, end - at))
        used = len(data)
        for m in token.finditer(data):
            if m.end() > len(data) - 32 and at + len(data) < end:
                used = m.start()
                break
            if m[1]:
                used = m.end() + int(m[1])
                break
            if m[0] == b"{":
                depth += 1
            elif m[0] == b"}":
                depth -= 1
                if depth <= 0:
                    return cut_at_limit(ranged(view, start, at + m.end(), Limits(0, lim.min_size)), lim)
        at += max(1, used)
    full = bool(lim.max_size) and start + lim.max_size <= view.size
    out = Extent(start, end - start, False, True, ["truncated output" if full else "unexpected eof"])
    return cut_at_limit(out, lim) if out.size >= lim.min_size else None


def ico(view, start, lim):
    """The furthest image, if one at least is a bitmap or PNG."""
    head = view.exact(start, 6)
    if head is None or head[:2] != b"\0\0" or head[2:4] not in (b"\1\0", b"\2\0"):
        return None
    count = int.from_bytes(head[4:], "little")
    entries = view.exact(start + 6, 16 * count) if 0 < count <= 64 else None
    if entries is None:
        return None
    end, real = 0, False
    for i in range(count):
        size, offset = struct.unpack_from("<II", entries, 16 * i + 8)
        if not 0 < size <= 512 << 10 or offset < 6 + 16 * count:
            return None
        image = view.read(start + offset, 8)
        real = real or size >= 8 and (image == b"\x89PNG\r\n\x1a\n" or image[:4] in (b"\x28\0\0\0", b"\x0c\0\0\0", b"\x6c\0\0\0", b"\x7c\0\0\0"))
        end = max(end, offset + size)
    return ranged(view, start, start + min(end, 4 << 20), lim, mark_limit=False) if real else None


def elf(view, start, lim):
    """The furthest end of the program and section header tables."""
    head = view.exact(start, 64) or view.exact(start, 52)
    if head is None or head[:4] != b"\x7fELF" or head[4] not in (1, 2) or head[5] not in (1, 2) or head[4] == 2 and len(head) < 64:
        return None
    order = "<" if head[5] == 1 else ">"
    ph, sh = struct.unpack_from(order + ("QQ" if head[4] == 2 else "II"), head, 32 if head[4] == 2 else 28)
    ph_size, ph_count, sh_size, sh_count = struct.unpack_from(order + "HHHH", head, 54 if head[4] == 2 else 42)
    end = max(ph + ph_size * ph_count if ph else 0, sh + sh_size * sh_count if sh else 0)
    return ranged(view, start, start + (end or 64), lim, mark_limit=False)


# Header names that mail has.
MAIL_HEADERS = (b"From:", b"To:", b"Subject:", b"Date:", b"Message-ID:", b"Received:")


def eml(view, start, lim):
    """Two header names, an address and a line end near the start; to the next mail of a mailbox or the end."""
    head = view.read(start, 2048)
    if sum(h in head for h in MAIL_HEADERS) < 2 or b"@" not in head or b"\n" not in head or any(x in head for x in (b"{{", b"${", b"<%", b"%s")):
        return None
    end = start + lim.max_size if lim.max_size else view.size
    at = view.find(b"\nFrom ", start, end)
    return ranged(view, start, at if at > start else min(end, view.size), lim)


def mobi(view, hit, lim):
    """The last record's offset and, for its size, the distance of the one before; the hit is 60 bytes into the header."""
    start = hit - 60
    head = view.exact(start, 78) if start >= 0 else None
    count = int.from_bytes(head[76:78], "big") if head else 0
    table = view.exact(start + 78, 8 * count) if 0 < count <= 4096 else None
    if table is None:
        return None
    offsets = sorted(struct.unpack_from(">I", table, 8 * i)[0] for i in range(count))
    if offsets[0] < 78 + 8 * count:
        return None
    last = max(1, offsets[-1] - offsets[-2]) if count > 1 else 4096
    return ranged(view, start, start + offsets[-1] + last, lim, mark_limit=False)


def fb2(view, start, lim):
    """The root's name near the start; to its closing tag, in any case."""
    if b"fictionbook" not in view.read(start, 4096).lower():
        return None
    return until(view, start, lim, (b"</fictionbook>",), "fb2 end", fold=True)


def lrf(view, start, lim):
    """The size at byte 8, else the limit."""
    head = view.exact(start, 12)
    if head is None or head[:4] != b"LRF\0":
        return None
    size = int.from_bytes(head[8:], "little") or lim.max_size or 1024
    return ranged(view, start, start + size, lim, mark_limit=False)


def footer(view, start, lim):
    """Configured headers and footers: to the first footer."""
    if not any(view.read(start, len(h)) == h for h in lim.headers):
        return None
    return until(view, start, lim, lim.footers, "footer")


RULES = {
    "jpeg": jpeg, "png": png, "gif": gif, "sqlite": sqlite, "pdf": pdf, "zip": zip_archive, "webp": riff(b"WEBP"), "wav": riff(b"WAVE"), "avi": riff(b"AVI "),
    "bmp": bmp, "tiff": tiff, "mp4": boxes(False), "mov": boxes(True), "rar": rar, "sevenz": sevenz, "mp3": mp3, "ole": ole, "tar": tar, "gzip": gzip,
    "bzip2": bzip2, "xz": xz, "ogg": ogg, "webm": webm, "wmv": wmv, "rtf": rtf, "ico": ico, "elf": elf, "eml": eml, "mobi": mobi, "fb2": fb2, "lrf": lrf,
    "footer": footer,
}
