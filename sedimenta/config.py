"""Engine options and the table of file types.  The same options can be read from YAML."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

MIB = 1 << 20

# File types as (id, extensions, header patterns (id, hex), largest size, smallest size, carver).
FILE_TYPES = (
    ("jpeg", ("jpg", "jpeg"), (("jpeg_soi", "FFD8FF"),), 100 * MIB, 500, "jpeg"),
    ("png", ("png",), (("png_sig", "89504E470D0A1A0A"),), 100 * MIB, 100, "png"),
    ("gif", ("gif",), (("gif87a", "474946383761"), ("gif89a", "474946383961")), 100 * MIB, 100, "gif"),
    ("sqlite", ("sqlite",), (("sqlite_header", "53514C69746520666F726D6174203300"),), 512 * MIB, 100, "sqlite"),
    ("pdf", ("pdf",), (("pdf_header", "255044462D"),), 100 * MIB, 64, "pdf"),
    ("zip", ("zip",), (("zip_header", "504B0304"),), 100 * MIB, 32, "zip"),
    ("webp", ("webp",), (("webp_header", "52494646"),), 100 * MIB, 20, "webp"),
    ("bmp", ("bmp",), (("bmp_header", "424D"),), 100 * MIB, 200, "bmp"),
    ("tiff", ("tiff", "tif"), (("tiff_le_header", "49492A00"), ("tiff_be_header", "4D4D002A")), 100 * MIB, 8, "tiff"),
    ("mp4", ("mp4", "m4a", "m4v"), (("mp4_ftyp_14", "0000001466747970"), ("mp4_ftyp_18", "0000001866747970"), ("mp4_ftyp_1c", "0000001C66747970"), ("mp4_ftyp_20", "0000002066747970")), 1024 * MIB, 16, "mp4"),
    ("rar", ("rar",), (("rar4_header", "526172211A0700"), ("rar5_header", "526172211A070100")), 1024 * MIB, 32, "rar"),
    ("7z", ("7z",), (("7z_header", "377ABCAF271C"),), 1024 * MIB, 32, "sevenz"),
    ("wav", ("wav",), (("wav_riff", "52494646"),), 1024 * MIB, 44, "wav"),
    ("avi", ("avi",), (("avi_riff", "52494646"),), 4096 * MIB, 128, "avi"),
    ("mp3", ("mp3",), (("mp3_id3v2", "494433"), ("mp3_sync_fb", "FFFB"), ("mp3_sync_fa", "FFFA")), 100 * MIB, 128, "mp3"),
    ("ole", ("ole",), (("ole_cfb", "D0CF11E0A1B11AE1"),), 512 * MIB, 512, "ole"),
    ("tar", ("tar",), (("tar_ustar", "7573746172"),), 1024 * MIB, 1024, "tar"),
    ("gzip", ("gz",), (("gzip_header", "1F8B08"),), 1024 * MIB, 18, "gzip"),
    ("bzip2", ("bz2",), (("bzip2_header", "425A68"),), 1024 * MIB, 14, "bzip2"),
    ("xz", ("xz",), (("xz_header", "FD377A585A00"),), 1024 * MIB, 32, "xz"),
    ("ogg", ("ogg", "oga", "ogv"), (("ogg_sync", "4F676753"),), 1024 * MIB, 28, "ogg"),
    ("mov", ("mov", "qt"), (("mov_ftyp_qt", "000000146674797071742020"), ("mov_ftyp_qt_18", "000000186674797071742020"), ("mov_ftyp_qt_1c", "0000001C6674797071742020"), ("mov_ftyp_qt_20", "000000206674797071742020")), 10240 * MIB, 16, "mov"),
    ("webm", ("webm", "mkv"), (("webm_ebml", "1A45DFA3"),), 10240 * MIB, 64, "webm"),
    ("wmv", ("wmv", "wma", "asf"), (("wmv_asf", "3026B2758E66CF11A6D900AA0062CE6C"),), 10240 * MIB, 64, "wmv"),
    ("rtf", ("rtf",), (("rtf_header", "7B5C727466"),), 100 * MIB, 7, "rtf"),
    ("ico", ("ico", "cur"), (("ico_header", "00000100"), ("cur_header", "00000200")), 10 * MIB, 22, "ico"),
    ("elf", ("elf", "so"), (("elf_magic", "7F454C46"),), 1024 * MIB, 52, "elf"),
    ("eml", ("eml",), (("eml_from", "46726F6D3A20"), ("eml_received", "52656365697665643A")), 50 * MIB, 32, "eml"),
    ("mobi", ("mobi", "azw", "azw3", "prc"), (("mobi_pdb", "424F4F4B4D4F4249"),), 512 * MIB, 68, "mobi"),
    ("fb2", ("fb2",), (("fb2_xml", "3C3F786D6C"),), 100 * MIB, 64, "fb2"),
    ("lrf", ("lrf",), (("lrf_header", "4C524600"),), 100 * MIB, 64, "lrf"),
)
# Kinds that are found inside archives and compound documents.
ZIP_KINDS = ("docx", "xlsx", "pptx", "odt", "ods", "odp", "epub")
OLE_KINDS = ("doc", "xls", "ppt")


@dataclass(frozen=True)
class FileType:
    id: str
    extensions: tuple[str, ...]
    headers: tuple[tuple[str, str], ...]
    max_size: int
    min_size: int
    carver: str
    footers: tuple[str, ...] = ()
    require_eocd: bool = True

    @property
    def extension(self) -> str:
        return self.extensions[0] if self.extensions else self.id


@dataclass(frozen=True)
class EngineConfig:
    """All options of a run; defaults are production values."""

    run_id: str = ""
    chunk_size: int = 512 * MIB
    overlap: int = 64 << 10
    max_files: int | None = None
    max_bytes: int | None = None
    max_chunks: int | None = None
    scan_strings: bool = False
    scan_urls: bool = True
    scan_emails: bool = True
    scan_phones: bool = True
    scan_utf16: bool = False
    string_min_len: int = 6
    string_max_len: int = 1024
    scan_entropy: bool = False
    entropy_window: int = 4096
    entropy_threshold: float = 7.5
    page_recovery: bool = False
    quicktime_mode: str = "mov"
    zip_kinds: tuple[str, ...] | None = None
    ole_kinds: tuple[str, ...] | None = None
    only_validated: bool = False
    file_types: tuple[FileType, ...] = field(default_factory=lambda: tuple(FileType(*t) for t in FILE_TYPES))

    def with_artefacts(self, urls: bool = False, emails: bool = False, phones: bool = False) -> EngineConfig:
        """Asking for any artefact kind turns the string scan on."""
        if not (urls or emails or phones):
            return self
        return replace(self, scan_strings=True, scan_urls=self.scan_urls or urls, scan_emails=self.scan_emails or emails, scan_phones=self.scan_phones or phones)

    def only_types(self, names: list[str], disable_zip: bool = False) -> tuple[EngineConfig, list[str]]:
        """The types named by id or carver, in any case, and the unknown names, sorted.  Kinds inside archives keep the archive and restrict it."""
        wanted = {n.strip().lower() for n in names if n.strip()}
        zips, oles = tuple(k for k in ZIP_KINDS if k in wanted), tuple(k for k in OLE_KINDS if k in wanted)
        known = {n for t in self.file_types for n in (t.id.lower(), t.carver.lower())} | {*ZIP_KINDS, *OLE_KINDS}
        kept = tuple(t for t in self.file_types if {t.id.lower(), t.carver.lower()} & wanted or zips and t.carver == "zip" or oles and t.carver == "ole") if wanted else self.file_types
        if disable_zip:
            kept = tuple(t for t in kept if t.carver != "zip")
        out = replace(self, file_types=kept, zip_kinds=zips if zips and "zip" not in wanted else self.zip_kinds, ole_kinds=oles if oles and "ole" not in wanted else self.ole_kinds)
        return out, sorted(wanted - known)

    def patterns(self) -> list[tuple[str, str, bytes]]:
        """(file type, pattern id, bytes) of every header."""
        return [(t.id, p, bytes.fromhex(h)) for t in self.file_types for p, h in t.headers]

    def digest(self) -> str:
        return hashlib.sha256(repr(self).encode()).hexdigest()


def load_config(text: str) -> tuple[EngineConfig, str]:
    """Options from YAML text and the SHA-256 of the text.  Keys are the fields' names; file_types may be given in full."""
    import yaml

    raw = yaml.safe_load(text) or {}
    types = raw.pop("file_types", None)
    config = EngineConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
    if types is not None:
        config = replace(config, file_types=tuple(FileType(t["id"], tuple(t.get("extensions", ())), tuple((h["id"], h["hex"]) for h in t.get("headers", ())), t.get("max_size", 0), t.get("min_size", 0), t.get("carver", "footer"), tuple(t.get("footers", ())), t.get("require_eocd", True)) for t in types))
    return config, hashlib.sha256(text.encode()).hexdigest()


def new_run_id(digest: str, now: datetime | None = None) -> str:
    """UTC time and eight hex digits."""
    return (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%SZ_") + digest[:8]
