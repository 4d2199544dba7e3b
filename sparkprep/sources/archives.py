"""Byte streams of compressed files, for codecs that Spark's text sources don't read (zip, xz, zstd)."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import zipfile
from typing import BinaryIO

from .detect import codec_of


class UnsupportedCodec(ValueError):
    pass


def decompressed(raw: BinaryIO, codec: str | None) -> BinaryIO:
    if codec is None:
        return raw
    if codec == "gzip":
        return gzip.open(raw)
    if codec == "bzip2":
        return bz2.open(raw)
    if codec == "xz":
        return lzma.open(raw)
    if codec == "zstd":
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True))
    if codec == "zip":  # the first member counts
        z = zipfile.ZipFile(raw)
        return z.open(next(n for n in z.namelist() if not n.endswith("/")))
    raise UnsupportedCodec(codec)


def open_bytes(path: str) -> BinaryIO:
    return decompressed(open(path, "rb"), codec_of(path))  # noqa: SIM115
