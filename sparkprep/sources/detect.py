"""Format, codec, encoding and delimiter of a file, from its name and its first bytes."""

from __future__ import annotations

import codecs
import os

FORMATS = {
    "csv": "csv", "tsv": "csv", "jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "bson": "bson", "xml": "xml",
    "xls": "xls", "xlsx": "xlsx", "parquet": "parquet", "pq": "parquet", "orc": "orc", "avro": "avro", "docx": "docx",
}
CODECS = {"gz": "gzip", "gzip": "gzip", "bz2": "bzip2", "xz": "xz", "lzma": "xz", "zip": "zip", "zst": "zstd", "zstd": "zstd", "lz4": "lz4", "snappy": "snappy", "deflate": "deflate", "7z": "7z"}
DELIMITERS = ",;\t|"
SNIFF = 1_000_000


def suffixes(path: str) -> list[str]:
    return os.path.basename(path.rstrip("/")).lower().split(".")[1:]


def codec_of(path: str) -> str | None:
    ends = suffixes(path)
    return CODECS.get(ends[-1]) if ends else None


def format_of(path: str) -> str | None:
    """Format by extension, looking behind a codec's extension; None if unknown."""
    ends = suffixes(path)
    if ends and ends[-1] in CODECS:
        ends = ends[:-1]
    return FORMATS.get(ends[-1]) if ends else None


def head(path: str, limit: int = SNIFF) -> bytes:
    """First bytes of a file, or of a folder's first file, decompressed, on any file system that pyarrow knows; b"" if there is none."""
    import glob

    from pyarrow import fs

    from .archives import decompressed

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    if "://" in path:
        system, at = fs.FileSystem.from_uri(path)
    else:
        system, at = fs.LocalFileSystem(), os.path.abspath(path)
        if not os.path.exists(at):
            at = next(iter(sorted(glob.glob(at))), at)
    info = system.get_file_info(at)
    if info.type == fs.FileType.Directory:
        names = [x.path for x in system.get_file_info(fs.FileSelector(at)) if x.is_file and not x.base_name.startswith(("_", "."))]
        if not names:
            return b""
        at = min(names)
    elif info.type == fs.FileType.NotFound:
        return b""
    with system.open_input_file(at) as raw, decompressed(raw, codec_of(at)) as f:
        return f.read(limit)


def encoding_of(data: bytes) -> str:
    """BOM, then strict UTF-8, then cp1251 where high bytes come in runs, else latin-1."""
    for bom, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(bom):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(data, final=False)  # a character cut off at the end is fine
        return "utf-8"
    except UnicodeDecodeError:
        pass
    # Cyrillic words are runs of high bytes, accented letters stand alone
    high = sum(b >= 0xC0 or b in (0xA8, 0xB8) for b in data)
    paired = sum(a >= 0xC0 and b >= 0xC0 for a, b in zip(data, data[1:]))
    return "cp1251" if 2 * paired > high else "latin-1"


def delimiter_of(line: str) -> str:
    """The candidate found most often in the first line; ties go by the order of ``DELIMITERS``."""
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def sniff(path: str) -> tuple[str, str]:
    """(encoding, delimiter) of a delimited text file."""
    data = head(path)
    enc = encoding_of(data)
    first = data.decode(enc, errors="replace").lstrip("﻿").split("\n", 1)[0]
    return enc, delimiter_of(first)
