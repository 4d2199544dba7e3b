"""BSON files a block at a time: documents with the same fields in the same order are read together, as columns, and written so too.

What doesn't fit that (regular expressions, doubled names, damaged documents) goes through ``bson.decode`` one by one, with the
same results and errors.
"""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

from . import bson
from .records import fit, merge, plain, row, signature, type_of, union

BLOCK, DOCUMENTS, SHAPES, LONGEST = 4 << 20, 20_000, 64, 1000

_NULLS, _INTS, _TEXTS = {0x06, 0x0A, 0x7F, 0xFF}, {0x10, 0x11, 0x12}, {0x02, 0x0D, 0x0E}
_KINDS = dict.fromkeys(_NULLS, T.NullType()) | dict.fromkeys(_INTS, T.LongType()) | dict.fromkeys({*_TEXTS, 0x07, 0x13}, T.StringType())
_KINDS |= {0x01: T.DoubleType(), 0x05: T.BinaryType(), 0x08: T.BooleanType(), 0x09: T.TimestampType()}
#: Bytes of a value by its type, or what its own length leaves out, and the least that this length may be; -1: neither.
_SIZE, _MORE, _LEAST = np.full(256, -1), np.full(256, -1), np.zeros(256, np.int64)
for _k, _n in {0x01: 8, 0x06: 0, 0x07: 12, 0x08: 1, 0x09: 8, 0x0A: 0, 0x10: 4, 0x11: 8, 0x12: 8, 0x13: 16, 0x7F: 0, 0xFF: 0}.items():
    _SIZE[_k] = _n
for _k, _n, _m in ((0x02, 4, 1), (0x0D, 4, 1), (0x0E, 4, 1), (0x03, 0, 5), (0x04, 0, 5), (0x05, 5, 0)):
    _MORE[_k], _LEAST[_k] = _n, _m
_DATES = [(dt.datetime(y, m, d, tzinfo=dt.timezone.utc) - bson._EPOCH) // dt.timedelta(milliseconds=1) for y, m, d in ((1, 1, 1), (9999, 12, 31))]


def readable(schema: T.StructType) -> bool:
    """Whether all types are such that records have by themselves."""

    def known(k: T.DataType) -> bool:
        if isinstance(k, T.StructType):
            return len(set(k.names)) == len(k.names) and all(known(f.dataType) for f in k.fields)
        return known(k.elementType) if isinstance(k, T.ArrayType) else type(k) in (T.LongType, T.DoubleType, T.StringType, T.BooleanType, T.TimestampType, T.BinaryType)

    return known(schema)


def blocks(stream: BinaryIO, size: int | None = None) -> Iterator[tuple[bytes, list[int]]]:
    """Bytes of whole documents, and where each of some documents begins and the last ends; ``size``: of the stream, where it isn't all."""
    rest, want, left = b"", BLOCK, size
    while True:
        asked = want if left is None else min(want, left)
        got = []
        while asked and (part := stream.read(asked)):
            got.append(part)
            asked -= len(part)
        data = b"".join([rest, *got])
        ends, at, n, long = [0], 0, len(data), 0
        while at + 4 <= n:
            long = struct.unpack_from("<i", data, at)[0]
            if long < 5:
                raise ValueError(f"BSON length {long}")
            if at + long > n:
                break
            at += long
            ends.append(at)
        for k in range(0, len(ends) - 1, DOCUMENTS):
            yield data, ends[k : k + DOCUMENTS + 1]
        rest, over = data[at:], asked > 0
        if left is not None:
            left -= sum(map(len, got))
            over = over or not left
        if over:
            if rest or left:
                raise ValueError("truncated BSON length" if len(rest) < 4 else "truncated BSON document")
            return
        want = max(BLOCK, long - len(rest)) if len(rest) >= 4 else BLOCK


def survey(stream: BinaryIO, every: int, typed: bool = True) -> tuple[T.StructType, list[int]]:
    """The type of all documents, if asked for, and where documents begin that are about ``every`` bytes apart, with the stream's end."""
    out, at, seen = T.StructType([]), [0], set()
    begin = last = 0
    held = None
    for data, ends in blocks(stream):
        if held is not data:
            begin, held = last, data
        if typed:
            out = union([out, *_kinds(data, ends, seen)])
        for end in ends[1:]:
            if begin + end - at[-1] >= every:
                at.append(begin + end)
        last = begin + ends[-1]
    return out, at if at[-1] == last else [*at, last]


def _kinds(data: bytes, ends: list[int], seen: set) -> list[T.DataType]:
    """The documents' types, as often as needed, in the order of the documents that first show them."""
    groups, rest = _groups(data, ends)
    found = []

    def add(k: int, name: str | None, v) -> None:
        if (key := (name, signature(v))) not in seen:
            if len(seen) >= 10_000:
                seen.clear()
            seen.add(key)
            found.append((k, type_of(v) if name is None else T.StructType([T.StructField(name, type_of(v))])))

    for k in rest:
        add(k, None, bson.decode(data[ends[k] : ends[k + 1]]))
    for ids, fields in groups:
        kinds = []
        for name, (codes, at) in fields.items():
            kind: T.DataType = T.NullType()
            for code in _codes(codes):
                kind = merge(kind, _KINDS.get(code, T.NullType()))
            kinds.append(T.StructField(name, kind))
        found.append((ids[0], T.StructType(kinds)))
        for name, (codes, at) in fields.items():
            for k in np.flatnonzero((codes == 0x03) | (codes == 0x04)).tolist():
                add(ids[k], name, bson._value(data, int(at[k]), int(codes[k]))[0])
    return [kind for _, kind in sorted(found, key=lambda x: x[0])]


def batches(stream: BinaryIO, schema: T.StructType, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The documents as rows of a ``readable`` schema, in their order; what doesn't fit is an error."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = pa.schema([pa.field(f.name, f.type) for f in to_arrow_schema(schema)])
    for data, ends in blocks(stream, size):
        groups, rest = _groups(data, ends)
        parts = [pa.RecordBatch.from_arrays([_column(data, *fields[f.name], f.dataType, a.type) if f.name in fields else pa.nulls(len(ids), a.type) for f, a in zip(schema.fields, kind)], schema=kind) for ids, fields in groups]
        if rest:
            rows = [row(bson.decode(data[ends[k] : ends[k + 1]]), schema) for k in rest]
            parts.append(pa.RecordBatch.from_arrays([pa.array([plain(r[k], f.dataType) for r in rows], a.type) for k, (f, a) in enumerate(zip(schema.fields, kind))], schema=kind))
        if len(parts) > 1:
            order = np.argsort(np.concatenate([*(ids for ids, _ in groups), np.array(rest, np.int64)]))
            parts = pa.Table.from_batches(parts).take(pa.array(order)).combine_chunks().to_batches()
        yield from parts


def _groups(data: bytes, ends: list[int]) -> tuple[list[tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]], list[int]]:
    """Documents that share names and their order: their numbers, and by name the values' types and places. Also the numbers of the others."""
    buf = _padded(data)
    starts, stops = np.array(ends[:-1]), np.array(ends[1:])
    left, groups, rest = np.arange(len(starts)), [], []
    while len(left):
        names = _names(data, int(starts[left[0]])) if len(groups) + len(rest) < SHAPES else None
        if names is None:
            if len(groups) + len(rest) >= SHAPES:
                rest += left.tolist()
                break
            rest.append(int(left[0]))
            left = left[1:]
            continue
        at, ok, fields = starts[left] + 4, np.ones(len(left), bool), {}
        for name in names:
            codes, want = buf[at], np.frombuffer(name + b"\x00", np.uint8)
            ok &= (buf[at[:, None] + np.arange(1, len(want) + 1)] == want).all(axis=1)
            at = np.minimum(at + 1 + len(want), len(data))
            size, more = _SIZE[codes], _MORE[codes]
            led = more >= 0
            if led.any():
                long = _at(buf, at[led], "<i4").astype(np.int64)
                size[led] = np.where(long >= _LEAST[codes[led]], long + more[led], -1)
            ok &= size >= 0
            fields[name.decode()] = (codes, at)
            at = np.clip(at + size, 0, len(data))
        ok &= (at == stops[left] - 1) & (buf[at] == 0)
        if not ok[0]:
            rest.append(int(left[0]))
            ok[0], left = False, left[1:]
            ok, fields = ok[1:], {n: (c[1:], a[1:]) for n, (c, a) in fields.items()}
        if ok.any():
            groups.append((left[ok], {n: (c[ok], a[ok]) for n, (c, a) in fields.items()}))
        left = left[~ok]
    return groups, rest


def _padded(data: bytes) -> np.ndarray:
    return np.frombuffer(data + bytes(LONGEST + 32), np.uint8)


def _names(data: bytes, at: int) -> list[bytes] | None:
    """A document's names; None where it can't be a pattern for others."""
    out: list[bytes] = []
    try:
        at += 4
        while data[at]:
            end = data.index(b"\x00", at + 1)
            out.append(data[at + 1 : end])
            at = bson._value(data, end + 1, data[at])[1]
            out[-1].decode()
    except (ValueError, IndexError, OverflowError, struct.error):
        return None
    return out if len(set(out)) == len(out) and max(map(len, out), default=0) < LONGEST else None


def _codes(codes: np.ndarray) -> set[int]:
    return set(np.flatnonzero(np.bincount(codes, minlength=256)).tolist())


def _at(buf: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    return buf[at[:, None] + np.arange(np.dtype(kind).itemsize)].view(kind)[:, 0]


def _column(data: bytes, codes: np.ndarray, at: np.ndarray, kind: T.DataType, arrow: pa.DataType) -> pa.Array:
    have = _codes(codes)
    null = np.isin(codes, list(_NULLS)) if have & _NULLS else None
    have -= _NULLS
    buf = np.frombuffer(data, np.uint8)
    if isinstance(kind, (T.LongType, T.DoubleType)) and have <= _INTS | ({0x01} if isinstance(kind, T.DoubleType) else set()):
        out = np.zeros(len(at), np.int64 if isinstance(kind, T.LongType) else np.float64)
        for code in have:
            there = codes == code
            out[there] = _at(buf, at[there], "<f8" if code == 0x01 else "<i4" if code == 0x10 else "<i8")
        return pa.array(out, arrow, mask=null)
    there = slice(None) if null is None else ~null
    if isinstance(kind, T.BooleanType) and have <= {0x08}:
        flags = np.zeros(len(at), bool)
        flags[there] = buf[at[there]] != 0
        return pa.array(flags, mask=null)
    if isinstance(kind, T.TimestampType) and have <= {0x09}:
        ms = np.zeros(len(at), np.int64)
        ms[there] = _at(buf, at[there], "<i8")
        if ((ms >= _DATES[0]) & (ms < _DATES[1])).all():
            return pa.array(ms * 1000, mask=null).cast(arrow)
    if isinstance(kind, T.StringType) and have <= {0x07}:
        return _spans(np.frombuffer(buf[at[there][:, None] + np.arange(12)].tobytes().hex().encode(), np.uint8), np.full(len(at), 24), null, arrow)
    if isinstance(kind, T.StringType) and have <= _TEXTS or isinstance(kind, T.BinaryType) and have <= {0x05}:
        sizes, head = np.zeros(len(at), np.int64), 4 if isinstance(kind, T.StringType) else 5
        sizes[there] = _at(buf, at[there], "<i4")
        if head == 4:
            sizes[there] -= 1
        begin, size = at[there] + head, sizes[there]
        total = int(size.sum())
        if total > 48 * len(begin):
            raw = np.frombuffer(b"".join([data[a : a + n] for a, n in zip(begin.tolist(), size.tolist())]), np.uint8)
        else:
            raw = buf[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)]
        return _spans(raw, sizes, null, arrow)
    return pa.array([plain(fit(bson._value(data, a, c)[0], kind), kind) for a, c in zip(at.tolist(), codes.tolist())], arrow)


def _spans(raw: np.ndarray, sizes: np.ndarray, null: np.ndarray | None, arrow: pa.DataType) -> pa.Array:
    """Texts or bytes that lie one after another; nulls take none."""
    if null is not None:
        sizes = np.where(null, 0, sizes)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    valid = None if null is None else pa.array(~null).buffers()[1]
    out = pa.Array.from_buffers(arrow, len(sizes), [valid, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    out.validate(full=True)  # UTF-8
    return out


_BYTES = pa.large_binary()


def joined(*parts) -> pa.Array:
    """Row by row the parts' bytes, where a part may be the same for all rows."""
    return pc.binary_join_element_wise(*[pa.scalar(x, _BYTES) if isinstance(x, bytes) else x for x in parts], pa.scalar(b"", _BYTES))


def _fixed(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int64) * values.dtype.itemsize
    return pa.Array.from_buffers(_BYTES, len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def span(values: pa.Array, first: int, end: int) -> memoryview:
    """The bytes of consecutive values, one after another."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)
    return memoryview(values.buffers()[2])[int(offsets[values.offset + first]) : int(offsets[values.offset + end])]


def encode(batch: pa.RecordBatch, others: list[Callable[[object], bytes]]) -> memoryview | bytes:
    """A batch's rows as documents; ``others`` encode the values of a column whose type isn't a plain one."""
    columns = [_elements(name.encode() + b"\x00", column, other) for name, column, other in zip(batch.schema.names, batch.columns, others)]
    if not batch.num_rows:
        return b""
    body = joined(*columns, b"\x00") if columns else _fixed(np.zeros(batch.num_rows, np.uint8))
    out = joined(_fixed(pc.binary_length(body).to_numpy().astype("<i4") + np.int32(4)), body)
    return span(out, 0, len(out))


def _elements(name: bytes, column: pa.Array, other: Callable[[object], bytes]) -> pa.Array:
    kind = column.type
    if pa.types.is_signed_integer(kind):
        values = pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype("<i8")
        short = (values >= -(2**31)) & (values < 2**31)
        out = joined(b"\x10" + name, _fixed(values.astype("<i4")))
        out = out if short.all() else pc.if_else(pa.array(short), out, joined(b"\x12" + name, _fixed(values)))
    elif pa.types.is_float32(kind) or pa.types.is_float64(kind):
        out = joined(b"\x01" + name, _fixed(pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False).astype("<f8")))
    elif pa.types.is_boolean(kind):
        out = joined(b"\x08" + name, _fixed(pc.fill_null(column, False).to_numpy(zero_copy_only=False).astype(np.uint8)))
    elif pa.types.is_string(kind) or pa.types.is_large_string(kind):
        raw = pc.fill_null(column.cast(_BYTES), b"")
        out = joined(b"\x02" + name, _fixed(pc.binary_length(raw).to_numpy().astype("<i4") + np.int32(1)), raw, b"\x00")
    else:
        return pa.array([other(v) for v in column.to_pylist()], _BYTES)
    return pc.if_else(pc.is_null(column), pa.scalar(b"\x0a" + name, _BYTES), out) if column.null_count else out
