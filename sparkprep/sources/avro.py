"""Avro object container files: reading of any schema, writing of records of nullable texts."""

from __future__ import annotations

import io
import itertools
import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

from pyspark.sql import types as T

from .records import merge

MAGIC = b"Obj\x01"


def _long(f: BinaryIO) -> int:
    shift = n = 0
    while True:
        b = f.read(1)
        if not b:
            raise EOFError
        n |= (b[0] & 0x7F) << shift
        if b[0] < 0x80:
            return (n >> 1) ^ -(n & 1)
        shift += 7


def _bytes(f: BinaryIO) -> bytes:
    return f.read(_long(f))


def _put_long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n & ~0x7F:
        out.append((n & 0x7F) | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _put(raw: bytes) -> bytes:
    return _put_long(len(raw)) + raw


def _blocks(f: BinaryIO):
    while n := _long(f):
        if n < 0:
            _long(f)
            n = -n
        for _ in range(n):
            yield


def _read(f: BinaryIO, kind, named: dict):
    if isinstance(kind, list):
        return _read(f, kind[_long(f)], named)
    if isinstance(kind, dict):
        t = kind["type"]
        if t in ("record", "enum", "fixed"):
            named[kind["name"]] = kind
        if t in ("record", "error"):
            return {x["name"]: _read(f, x["type"], named) for x in kind["fields"]}
        if t == "enum":
            return kind["symbols"][_long(f)]
        if t == "fixed":
            return f.read(kind["size"])
        if t == "array":
            return [_read(f, kind["items"], named) for _ in _blocks(f)]
        if t == "map":
            return {_bytes(f).decode(): _read(f, kind["values"], named) for _ in _blocks(f)}
        return _read(f, t, named)
    if kind == "null":
        return None
    if kind == "boolean":
        return f.read(1) == b"\x01"
    if kind in ("int", "long"):
        return _long(f)
    if kind == "float":
        return struct.unpack("<f", f.read(4))[0]
    if kind == "double":
        return struct.unpack("<d", f.read(8))[0]
    if kind == "bytes":
        return _bytes(f)
    if kind == "string":
        return _bytes(f).decode()
    return _read(f, named[kind] if kind in named else named[kind.rpartition(".")[2]], named)


def _inflate(raw: bytes, codec: str) -> bytes:
    if codec == "null":
        return raw
    if codec == "deflate":
        return zlib.decompress(raw, -15)
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    raise ValueError(f"avro codec {codec}")


def _meta(f: BinaryIO) -> dict[str, bytes]:
    if f.read(4) != MAGIC:
        raise ValueError("not an Avro container")
    meta = {}
    for _ in _blocks(f):
        key = _bytes(f).decode()
        meta[key] = _bytes(f)
    return meta


_KINDS = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.LongType(), "long": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}


def _kind(kind, named: dict) -> T.DataType | None:
    """Spark's type of a schema; None where only the data tell it (maps, records within themselves)."""
    if isinstance(kind, list):
        out: T.DataType = T.NullType()
        for x in kind:
            one = _kind(x, named)
            if one is None:
                return None
            out = merge(out, one)
        return out
    if isinstance(kind, dict):
        t = kind["type"]
        if t in ("record", "error"):
            named[kind["name"]] = None
            fields = [(x["name"], _kind(x["type"], named)) for x in kind["fields"]]
            named[kind["name"]] = out = None if any(k is None for _, k in fields) else T.StructType([T.StructField(n, k) for n, k in fields])
            return out
        if t in ("enum", "fixed"):
            named[kind["name"]] = T.StringType() if t == "enum" else T.BinaryType()
            return named[kind["name"]]
        if t == "array":
            of = _kind(kind["items"], named)
            return None if of is None else T.ArrayType(of)
        return None if t == "map" else _kind(t, named)
    if kind in _KINDS:
        return _KINDS[kind]
    return named[kind] if kind in named else named.get(kind.rpartition(".")[2])


def schema_type(f: BinaryIO) -> T.StructType | None:
    """The records' type as the file's own schema has it; None where only the data tell it."""
    return _kind(json.loads(_meta(f)["avro.schema"]), {})


def records(f: BinaryIO) -> Iterator[dict]:
    meta = _meta(f)
    sync = f.read(16)
    schema, codec = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode()
    while True:
        try:
            n = _long(f)
        except EOFError:
            return
        data = io.BytesIO(_inflate(_bytes(f), codec))
        named: dict = {}
        for _ in range(n):
            yield _read(data, schema, named)
        if f.read(16) != sync:
            raise ValueError("Avro block without its marker")


def write_texts(f: BinaryIO, names: list[str], rows: Iterable[tuple], codec: str = "deflate", block: int = 1000, name: str = "Record") -> None:
    encoded = (b"".join(b"\x00" if v is None else b"\x02" + _put(str(v).encode()) for v in r) for r in rows)
    write_blocks(f, names, ((len(held), b"".join(held)) for held in iter(lambda: list(itertools.islice(encoded, block)), [])), codec, name)


def text_blocks(batch, block: int = 1000) -> Iterator[tuple[int, bytes]]:
    """Records of an Arrow batch of texts, as ``write_blocks`` takes them."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from .bson_columns import joined, span

    kind, columns = pa.large_binary(), []
    for column in batch.columns:
        raw = pc.fill_null(column.cast(kind), b"")
        sizes, which = np.unique(pc.binary_length(raw).to_numpy(), return_inverse=True)
        out = joined(pa.array([b"\x02" + _put_long(n) for n in sizes.tolist()], kind).take(pa.array(which)), raw)
        columns.append(pc.if_else(pc.is_null(column), pa.scalar(b"\x00", kind), out) if column.null_count else out)
    whole = joined(*columns, b"") if columns else None
    for k in range(0, batch.num_rows, block):
        end = min(k + block, batch.num_rows)
        yield end - k, b"" if whole is None else span(whole, k, end)


def write_blocks(f: BinaryIO, names: list[str], blocks: Iterable[tuple[int, bytes]], codec: str = "deflate", name: str = "Record") -> None:
    """``blocks``: numbers of records of nullable texts, and the records' bytes."""
    if codec not in ("deflate", "null"):
        raise ValueError(f"avro codec {codec}")
    schema = {"type": "record", "name": name, "namespace": "data.avro", "fields": [{"name": n, "type": ["null", "string"]} for n in names]}
    sync = os.urandom(16)
    f.write(MAGIC + _put_long(2) + _put(b"avro.schema") + _put(json.dumps(schema).encode()) + _put(b"avro.codec") + _put(codec.encode()) + b"\x00" + sync)
    for n, raw in blocks:
        if codec == "deflate":
            z = zlib.compressobj(6, zlib.DEFLATED, -15)
            raw = z.compress(raw) + z.flush()
        f.write(_put_long(n) + _put_long(len(raw)))
        f.write(raw)
        f.write(sync)
