"""Dotted paths over nested schemas, resolved on the schema and expressed as Columns.

* ``values``: all values a path leads to, arrays of structs fanning out; a list at the end of the path is one value.
  A null under an existing parent is one null value; under a missing (null) parent there is none.
* ``leaves``: the scalar leaves of a schema. ``_id`` is skipped at every level, lists of scalars and empty structs have no
  leaf, lists of structs pass their leaves on under the same prefix.
* ``project``: a record with only the requested paths, as a tree; ``legacy=True`` keeps, level by level, every name that
  is requested at that level anywhere.
* ``melt``: one row per leaf value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pystr import kind_label, py_str

SKIP = "_id"


class PathError(ValueError):
    pass


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _field(kind: T.DataType, name: str) -> T.DataType | None:
    if isinstance(kind, T.StructType):
        return next((f.dataType for f in kind.fields if f.name == name), None)
    return kind.valueType if isinstance(kind, T.MapType) else None


def _get(x: Column, kind: T.DataType, name: str) -> Column:
    return F.try_element_at(x, F.lit(name)) if isinstance(kind, T.MapType) else x.getField(name)


def _getter(kind: T.DataType, name: str):
    return lambda v: _get(v, kind, name)


def _with_key(name: str):
    return lambda v: F.map_contains_key(v, name)


@dataclass
class Values:
    """``column`` holds an array of values of type ``kind``; ``scalar`` is the plain Column where nothing fans out."""

    column: Column
    kind: T.DataType
    scalar: Column | None


def path_type(schema: T.StructType, path: str) -> T.DataType:
    kind: T.DataType = schema
    for name in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        found = _field(kind, name)
        if found is None:
            raise PathError(f"no field {path!r}")
        kind = found
    return kind


def values(df: DataFrame, path: str) -> Values:
    names = path.split(".")
    if path in df.columns and len(names) > 1:  # a flat column whose name has dots
        x = F.col(quoted(path))
        return Values(F.array(x), df.schema[path].dataType, x)
    kind = _field(df.schema, names[0])
    if kind is None:
        raise PathError(f"no field {path!r} among {df.columns}")
    x, parent, many = F.col(quoted(names[0])), None, False
    for name in names[1:]:
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
            if many:
                x = F.flatten(F.filter(x, lambda v: v.isNotNull()))
            x, many = F.filter(x, lambda v: v.isNotNull()), True
        found = _field(kind, name)
        if found is None:
            raise PathError(f"no field {path!r}")
        if many:
            if isinstance(kind, T.MapType):
                x = F.filter(x, _with_key(name))
            x = F.transform(x, _getter(kind, name))
        else:
            parent = F.map_contains_key(x, name) if isinstance(kind, T.MapType) else x.isNotNull()
            x = _get(x, kind, name)
        kind = found
    if many:
        return Values(F.coalesce(x, F.array().cast(T.ArrayType(kind))), kind, None)
    one = F.array(x)
    return Values(one if parent is None else F.when(parent, one).otherwise(F.array().cast(T.ArrayType(kind))), kind, x)


@dataclass(frozen=True)
class Leaf:
    path: str
    kind: T.DataType


def leaves(schema: T.StructType, prefix: str = "") -> list[Leaf]:
    """In schema order; maps are left out, their keys aren't in the schema."""
    out = []
    for f in schema.fields:
        if f.name == SKIP:
            continue
        path, kind = prefix + f.name, f.dataType
        if isinstance(kind, T.ArrayType):
            kind = kind.elementType
            if not isinstance(kind, T.StructType):
                continue
        if isinstance(kind, T.StructType):
            out += leaves(kind, path + ".")
        elif not isinstance(kind, T.MapType):
            out.append(Leaf(path, kind))
    return out


def _leaf_row(pos: int, leaf: Leaf):
    def row(v):
        kind = F.when(v.isNull(), F.lit("empty")).otherwise(F.lit(kind_label(leaf.kind)))
        text = F.when(v.isNotNull(), py_str(v, leaf.kind))
        return F.struct(F.lit(pos).alias("pos"), F.lit(leaf.path).alias("key"), kind.alias("kind"), text.alias("value"))

    return row


def melt(df: DataFrame) -> DataFrame:
    """(pos, key, kind, value): every leaf value as text, with the type label of its column; null values stay rows."""
    parts = []
    flat = []
    for pos, leaf in enumerate(leaves(df.schema)):
        row = _leaf_row(pos, leaf)
        if "." not in leaf.path or leaf.path in df.columns:
            flat.append(row(F.col(quoted(leaf.path))))
        else:
            parts.append(F.transform(values(df, leaf.path).column, row))
    if flat:
        parts.insert(0, F.array(*flat))
    if not parts:
        return df.sparkSession.createDataFrame([], "pos int, key string, kind string, value string")
    return df.select(F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("m")).select("m.*")


def _tree(paths: list[str]) -> dict:
    root: dict = {}
    for p in paths:
        at = root
        for name in p.split("."):
            at = at.setdefault(name, {})
    return root


def _rebuild(x: Column, kind: T.DataType, tree: dict) -> Column:
    if not tree:
        return x
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: _rebuild(v, kind.elementType, tree))
    if not isinstance(kind, T.StructType):
        return x
    fields = [_rebuild(x.getField(n), _field(kind, n), t).alias(n) for n, t in tree.items() if _field(kind, n) is not None]
    return F.when(x.isNotNull(), F.struct(*fields)) if fields else x


def project(df: DataFrame, paths: list[str], legacy: bool = False) -> DataFrame:
    """Only the requested fields, in the order requested; unknown fields raise PathError."""
    for p in paths:
        if p not in df.columns:
            path_type(df.schema, p)
    if legacy:
        levels: list[set[str]] = []
        for p in paths:
            for k, name in enumerate(p.split(".")):
                while len(levels) <= k:
                    levels.append(set())
                levels[k].add(name)

        def keep(kind: T.DataType, level: int) -> dict:
            if not isinstance(kind, T.StructType) or level >= len(levels):
                return {}
            return {f.name: keep(f.dataType, level + 1) for f in kind.fields if f.name in levels[level]}

        tree = keep(df.schema, 0)
    else:
        tree = _tree([p for p in paths if p not in df.columns])
        for p in paths:
            if p in df.columns:
                tree[p] = {}
        order = list(dict.fromkeys(p if p in df.columns else p.split(".")[0] for p in paths))
        tree = {n: tree[n] for n in order}
    return df.select(*[_rebuild(F.col(quoted(n)), df.schema[n].dataType, t).alias(n) for n, t in tree.items()])
