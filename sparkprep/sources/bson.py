"""BSON documents: a decoder and encoder on the standard library."""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator
from typing import BinaryIO

_UTC = dt.timezone.utc
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=_UTC)


def documents(stream: BinaryIO) -> Iterator[dict]:
    while head := stream.read(4):
        if len(head) < 4:
            raise ValueError("truncated BSON length")
        size = struct.unpack("<i", head)[0]
        body = stream.read(size - 4)
        if len(body) != size - 4:
            raise ValueError("truncated BSON document")
        yield decode(head + body)


def decode(data: bytes) -> dict:
    return _doc(data, 0)[0]


def _cstring(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(b"\x00", at)
    return data[at:end].decode(), end + 1


def _doc(data: bytes, at: int) -> tuple[dict, int]:
    end = at + struct.unpack_from("<i", data, at)[0]
    at += 4
    out = {}
    while data[at]:
        kind = data[at]
        name, at = _cstring(data, at + 1)
        out[name], at = _value(data, at, kind)
    return out, end


def _value(data: bytes, at: int, kind: int):
    if kind == 0x01:
        return struct.unpack_from("<d", data, at)[0], at + 8
    if kind in (0x02, 0x0D, 0x0E):
        n = struct.unpack_from("<i", data, at)[0]
        return data[at + 4 : at + 3 + n].decode(), at + 4 + n
    if kind == 0x03:
        return _doc(data, at)
    if kind == 0x04:
        x, at = _doc(data, at)
        return list(x.values()), at
    if kind == 0x05:
        n = struct.unpack_from("<i", data, at)[0]
        return data[at + 5 : at + 5 + n], at + 5 + n
    if kind == 0x07:
        return data[at : at + 12].hex(), at + 12
    if kind == 0x08:
        return bool(data[at]), at + 1
    if kind == 0x09:
        return _EPOCH + dt.timedelta(milliseconds=struct.unpack_from("<q", data, at)[0]), at + 8
    if kind in (0x06, 0x0A, 0x7F, 0xFF):
        return None, at
    if kind == 0x0B:
        a, at = _cstring(data, at)
        b, at = _cstring(data, at)
        return f"/{a}/{b}", at
    if kind == 0x10:
        return struct.unpack_from("<i", data, at)[0], at + 4
    if kind in (0x11, 0x12):
        return struct.unpack_from("<q", data, at)[0], at + 8
    if kind == 0x13:
        return "decimal128:" + data[at : at + 16].hex(), at + 16
    raise ValueError(f"BSON type 0x{kind:02x}")


def encode(record: dict) -> bytes:
    body = b"".join(_element(str(k), v) for k, v in record.items())
    return struct.pack("<i", len(body) + 5) + body + b"\x00"


def _element(name: str, v) -> bytes:
    key = name.encode() + b"\x00"
    if v is None:
        return b"\x0a" + key
    if isinstance(v, bool):
        return b"\x08" + key + bytes([v])
    if isinstance(v, int):
        return b"\x10" + key + struct.pack("<i", v) if -(2**31) <= v < 2**31 else b"\x12" + key + struct.pack("<q", v)
    if isinstance(v, float):
        return b"\x01" + key + struct.pack("<d", v)
    if isinstance(v, dt.datetime):
        at = v if v.tzinfo else v.replace(tzinfo=_UTC)
        return b"\x09" + key + struct.pack("<q", (at - _EPOCH) // dt.timedelta(milliseconds=1))
    if isinstance(v, (bytes, bytearray)):
        return b"\x05" + key + struct.pack("<i", len(v)) + b"\x00" + bytes(v)
    if isinstance(v, dict):
        return b"\x03" + key + encode(v)
    if isinstance(v, (list, tuple)):
        return b"\x04" + key + encode({str(k): x for k, x in enumerate(v)})
    raw = str(v).encode()
    return b"\x02" + key + struct.pack("<i", len(raw) + 1) + raw + b"\x00"
