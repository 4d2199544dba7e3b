"""Spark schemas for Python records, and records as rows of a schema."""

from __future__ import annotations

import datetime as dt
import decimal
import json
from collections.abc import Iterable

from pyspark.sql import types as T


def type_of(v) -> T.DataType:
    if v is None:
        return T.NullType()
    if isinstance(v, bool):
        return T.BooleanType()
    if isinstance(v, int):
        return T.LongType() if -(2**63) <= v < 2**63 else T.StringType()
    if isinstance(v, float):
        return T.DoubleType()
    if isinstance(v, dt.datetime):
        return T.TimestampType()
    if isinstance(v, dt.date):
        return T.DateType()
    if isinstance(v, decimal.Decimal):
        return T.StringType()
    if isinstance(v, (bytes, bytearray)):
        return T.BinaryType()
    if isinstance(v, dict):
        return T.StructType([T.StructField(str(k), type_of(x)) for k, x in v.items()])
    if isinstance(v, (list, tuple)):
        kind: T.DataType = T.NullType()
        for x in v:
            kind = merge(kind, type_of(x))
        return T.ArrayType(kind)
    return T.StringType()


def signature(v):
    """The same for values of the same type and order of keys, and cheaper than the type."""
    if isinstance(v, dict):
        return tuple((k, signature(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return (list, *dict.fromkeys(map(signature, v)))
    return str if isinstance(v, int) and not -(2**63) <= v < 2**63 else type(v)


def types_of(records: Iterable) -> T.DataType:
    """``union`` of all records' types; records alike count once."""
    seen: set = set()

    def new(v) -> bool:
        if (key := signature(v)) in seen:
            return False
        if len(seen) >= 10_000:
            seen.clear()
        seen.add(key)
        return True

    return union(type_of(v) for v in records if new(v))


def merge(a: T.DataType, b: T.DataType) -> T.DataType:
    """Narrowest type for both; values of different kinds become text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        kinds = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            kinds[f.name] = merge(kinds.get(f.name, T.NullType()), f.dataType)
        return T.StructType([T.StructField(n, k) for n, k in kinds.items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merge(a.elementType, b.elementType))
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    return T.StringType()


def settle(kind: T.DataType) -> T.DataType:
    """Types that were only ever null become text."""
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, settle(f.dataType)) for f in kind.fields])
    return T.ArrayType(settle(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def union(kinds: Iterable[T.DataType]) -> T.DataType:
    """Union of the records' keys in first-seen order; types that were only null so far stay void."""
    out: T.DataType = T.StructType([])
    for kind in kinds:
        out = merge(out, kind)
    return out


def merged(parts: Iterable[str]) -> T.StructType:
    """The schema of all records from the schemas (JSON) of parts of them."""
    return settle(union(T.StructType.fromJson(json.loads(x)) for x in parts))


def as_text(v) -> str:
    if isinstance(v, str):
        return v
    if isinstance(v, (dict, list, tuple)):
        return json.dumps(v, ensure_ascii=False, default=str)
    return v.decode("utf-8", "replace") if isinstance(v, (bytes, bytearray)) else str(v)


def fit(v, kind: T.DataType):
    """The value in the form that Spark takes for this type; what doesn't fit is an error."""
    if v is None:
        return None
    if isinstance(kind, T.StringType):
        return as_text(v)
    if isinstance(kind, T.StructType) and isinstance(v, dict):
        return tuple(fit(v.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType) and isinstance(v, (list, tuple)):
        return [fit(x, kind.elementType) for x in v]
    if isinstance(kind, T.DoubleType) and isinstance(v, (int, float)):
        return float(v)
    if isinstance(kind, T.LongType) and isinstance(v, int) and -(2**63) <= v < 2**63:
        return int(v)
    if isinstance(kind, (T.StructType, T.ArrayType, T.DoubleType, T.LongType)) or isinstance(kind, T.BooleanType) and not isinstance(v, bool):
        raise ValueError(f"{as_text(v)[:100]!r} doesn't fit {kind.simpleString()[:100]}")
    return v


def row(record: dict, schema: T.StructType) -> tuple:
    return tuple(fit(record.get(f.name), f.dataType) for f in schema.fields)


def plain(v, kind: T.DataType):
    """``fit``'s value with its records as dicts, as Arrow takes them."""
    if isinstance(v, tuple) and isinstance(kind, T.StructType):
        return {f.name: plain(x, f.dataType) for f, x in zip(kind.fields, v)}
    return [plain(x, kind.elementType) for x in v] if isinstance(v, list) and isinstance(kind, T.ArrayType) else v
