"""Schemas: description, analysis with counts, keys for comparison, bulk extraction, record schemes."""

from __future__ import annotations

import datetime as dt
import glob
import json
import os
from collections import OrderedDict
from collections.abc import Callable

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.paths import quoted
from ..sources.detect import FORMATS, codec_of, format_of, head, sniff
from ..sources.readers import read

_NAMES = {T.StringType: "VARCHAR", T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.ShortType: "SMALLINT", T.ByteType: "TINYINT", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP WITH TIME ZONE", T.BinaryType: "BLOB", T.StructType: "STRUCT", T.VariantType: "VARCHAR", T.NullType: '"NULL"'}
FIELD = "pos int, name string, type string, is_array boolean, description string"


def report_type(kind: T.DataType) -> tuple[str, bool]:
    """Reported name of a type and whether it is an array; of arrays of arrays the inner brackets stay in the name."""
    if isinstance(kind, T.ArrayType):
        name, inner = report_type(kind.elementType)
        return (name + "[]" if inner else name), True
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})", False
    if isinstance(kind, T.MapType):
        return f"MAP({report_type(kind.keyType)[0]}, {report_type(kind.valueType)[0]})", False
    return _NAMES.get(type(kind), kind.simpleString().upper()), False


def schema_fields(schema: T.StructType, naming: str = "full", prefix: str = "", root: str = "") -> list[tuple[str, T.DataType]]:
    """(name, type), nested fields after their parent with their full dotted path; ``collapsed`` keeps the first and last part."""
    out = []
    for f in schema.fields:
        path = prefix + f.name
        shown = path if naming == "full" or not root else f"{root}.{f.name}"
        inner = f.dataType
        while isinstance(inner, T.ArrayType):
            inner = inner.elementType
        nested = isinstance(inner, T.StructType)
        if not (naming == "collapsed" and nested and root and not isinstance(f.dataType, T.ArrayType)):
            out.append((shown, f.dataType))
        if nested:
            out += schema_fields(inner, naming, path + ".", root or f.name)
    return out


def describe(df: DataFrame, naming: str = "full", describe_field: Callable[[str, str], str] | None = None) -> DataFrame:
    """One row per field, nested ones included; reads nothing. ``describe_field`` may add descriptions."""
    rows = []
    for k, (name, kind) in enumerate(schema_fields(df.schema, naming)):
        text, many = report_type(kind)
        rows.append((k, name, text, many, describe_field(name, text) if describe_field else ""))
    return df.sparkSession.createDataFrame(rows, FIELD)


def is_flat(df: DataFrame) -> bool:
    return not any(isinstance(f.dataType, (T.StructType, T.ArrayType)) for f in df.schema.fields)


def summarize(df: DataFrame, limit: int | None = None, exact: bool = False) -> DataFrame:
    """(pos, name, type, is_array, n_unique, count, uniq_share) per field in one aggregation over the input.

    Nested fields are reached by their path; those inside arrays count distinct arrays of their values. Approximate
    distinct counts by default; ``exact`` shuffles the values.
    """
    spark = df.sparkSession
    src = df.limit(limit) if limit else df
    found, cols = [], []
    for k, (name, kind) in enumerate(schema_fields(df.schema)):
        x = _reach(df, name)
        if _has_map(kind):
            x = F.to_json(x) if not isinstance(kind, T.VariantType) else x.cast("string")
        n = F.count_distinct(x) if exact else F.approx_count_distinct(x) if not isinstance(kind, (T.ArrayType, T.StructType)) else F.approx_count_distinct(F.when(x.isNotNull(), F.xxhash64(x)))
        text, many = report_type(kind)
        found.append((k, name, text, many))
        cols.append(n.alias(f"u{k}"))
    whole = src.agg(F.count(F.lit(1)).alias("n"), *cols)
    rows = [F.struct(F.lit(k).alias("pos"), F.lit(name).alias("name"), F.lit(t).alias("type"), F.lit(a).alias("is_array"), F.col(f"u{k}").alias("n_unique"), F.col("n").alias("count"), F.when(F.col("n") > 0, F.format_string("%.2f", F.lit(100.0) * F.col(f"u{k}") / F.col("n"))).otherwise(F.lit("0")).alias("uniq_share")) for k, name, t, a in found]
    if not rows:
        return spark.createDataFrame([], "pos int, name string, type string, is_array boolean, n_unique long, count long, uniq_share string")
    return whole.select(F.inline(F.array(*rows)))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def _part(name: str):
    return lambda v: v.getField(name)


def _reach(df: DataFrame, name: str):
    if name in df.columns:
        return F.col(quoted(name))
    first, *rest = name.split(".")
    x, kind = F.col(quoted(first)), df.schema[first].dataType
    for part in rest:
        depth = 0
        while isinstance(kind, T.ArrayType):
            kind, depth = kind.elementType, depth + 1
        for _ in range(depth - 1):
            x = F.flatten(x)
        x = F.transform(x, _part(part)) if depth else x.getField(part)
        kind = T.ArrayType(kind[part].dataType) if depth else kind[part].dataType
    return x


def schema_key(names: list[str]) -> str:
    """Hash of the set of field names, equal for files with the same fields in any order."""
    return xxhash.xxh64("|".join(sorted(names)).encode()).hexdigest()


def analyze(spark: SparkSession, path: str, limit: int | None = None, exact: bool = False, describe_table: Callable[[dict], str] | None = None, **options) -> dict:
    """Report on one file: type, codec, encoding and, for each table in it, records, fields, types and distinct counts.

    ``limit``: distinct counts of so many records only, where that is enough; the number of records is always that of all.
    """
    fmt = options.pop("fmt", None) or format_of(path)
    report: dict = {"filename": os.path.basename(path.rstrip("/")), "file_size": _size(path), "file_type": fmt, "compression": codec_of(path), "tables": [], "error": None}
    try:
        if fmt == "csv":
            report["encoding"], report["delimiter"] = sniff(path)
        for name, df in tables(spark, path, fmt, **options):
            fields = [{"name": r["name"], "ftype": r["type"], "is_array": r["is_array"], "n_unique": r["n_unique"], "uniq_share": r["uniq_share"], "description": ""} for r in summarize(df, limit, exact).orderBy("pos").collect()]
            table = {"id": name, "num_records": df.count(), "num_cols": len(df.columns), "is_flat": is_flat(df), "fields": fields, "description": ""}
            if describe_table is not None:
                table["description"] = describe_table(table)
            report["tables"].append(table)
        report["success"] = True
    except (ValueError, OSError) as e:
        report["error"], report["success"] = str(e), False
    report["num_tables"], report["total_records"] = len(report["tables"]), sum(t["num_records"] for t in report["tables"])
    return report


def _size(path: str) -> int | None:
    path = path[7:] if path.startswith("file://") else path
    if os.path.isdir(path):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)
    return os.path.getsize(path) if os.path.exists(path) else None


def tables(spark: SparkSession, path: str, fmt: str | None, **options) -> list[tuple[str, DataFrame]]:
    """Named tables of a file: sheets, document tables, or lists of records in a JSON or XML document."""
    name = os.path.basename(path.rstrip("/"))
    if fmt == "xlsx":
        from ..sources.office import sheets

        with open(path, "rb") as f:
            found = sheets(f)
        return [(s, read(spark, path, fmt, page=k, **options)) for k, (s, _) in enumerate(found)]
    if fmt == "docx":
        from ..sources.office import docx_tables

        with open(path, "rb") as f:
            n = len(docx_tables(f))
        return [(f"{name}:{k + 1}", read(spark, path, fmt, page=k, **options)) for k in range(n)]
    if fmt == "json" and not options.get("tag"):
        df = read(spark, path, fmt, **options)
        lists = candidates(df.schema)
        return [(p, df.select(F.inline(F.col(p)))) for p in lists] if lists and df.count() == 1 else [(name, df)]
    if fmt == "xml" and not options.get("tag"):
        tag = repeated_tag(head(path))
        if tag is None:
            raise ValueError("no repeated element")
        return [(tag, read(spark, path, fmt, tag=tag, **options))]
    return [(name, read(spark, path, fmt, infer_types=True, **options))]


def candidates(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted keys that hold lists of records, outside of other lists."""
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out.append(prefix + f.name)
        elif isinstance(f.dataType, T.StructType):
            out += candidates(f.dataType, prefix + f.name + ".")
    return out


def candidate_sizes(df: DataFrame) -> DataFrame:
    """(key, total): number of records in each candidate list, over all documents."""
    keys = candidates(df.schema)
    if not keys:
        return df.sparkSession.createDataFrame([], "key string, total long")
    sums = df.agg(*[F.sum(F.greatest(F.lit(0), F.coalesce(F.size(F.col(k)), F.lit(0)))).alias(f"c{n}") for n, k in enumerate(keys)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"c{n}").alias("total")) for n, k in enumerate(keys)])))


def repeated_tag(data: bytes) -> str | None:
    """The element found most often under one parent in the head of an XML file, outermost first."""
    from xml.etree import ElementTree as ET

    pull = ET.XMLPullParser(["start", "end"])
    counts: dict[tuple[int, str], int] = {}
    depth = 0
    try:
        pull.feed(data)
        for event, e in pull.read_events():
            tag = e.tag.rpartition("}")[2]
            if event == "start":
                depth += 1
                counts[depth, tag] = counts.get((depth, tag), 0) + 1
            else:
                depth -= 1
    except ET.ParseError:
        pass
    found = [(d, -n, t) for (d, t), n in counts.items() if n > 1]
    return min(found)[2] if found else None


def schema_bulk(spark: SparkSession, pattern: str, mode: str = "distinct", output: str | None = None, **options) -> list[dict]:
    """Schemas of all files under a folder or glob: one per distinct set of fields with its files, or one per file."""
    files = sorted(f for f in (glob.glob(pattern) if glob.has_magic(pattern) else glob.glob(os.path.join(pattern, "*"))) if format_of(f) in set(FORMATS.values()))
    found: OrderedDict[str, dict] = OrderedDict()
    for path in files:
        df = read(spark, path, infer_types=True, **options)
        fields = [{"name": r["name"], "ftype": r["type"], "is_array": r["is_array"]} for r in describe(df).orderBy("pos").collect()]
        key = schema_key([f["name"] for f in fields])
        slot = key if mode == "distinct" else path
        found.setdefault(slot, {"key": key, "num_cols": len(df.columns), "is_flat": is_flat(df), "fields": fields, "files": []})["files"].append(path)
    out = list(found.values())
    if output:
        os.makedirs(output, exist_ok=True)
        for s in out:
            name = s["key"] if mode == "distinct" else os.path.basename(s["files"][0])
            with open(os.path.join(output, f"{name}.yaml"), "w") as f:
                f.write(to_yaml(s))
    return out


def to_yaml(x, indent: int = 0) -> str:
    """Plain YAML of dicts, lists and scalars."""
    pad = "  " * indent
    if isinstance(x, dict):
        if not x:
            return pad + "{}\n"
        return "".join(f"{pad}{k}:\n{to_yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f"{pad}{k}: {_scalar(v)}\n" for k, v in x.items())
    if isinstance(x, list):
        return "".join(f"{pad}- {to_yaml(v, indent + 1).lstrip()}" if isinstance(v, (dict, list)) and v else f"{pad}- {_scalar(v)}\n" for v in x)
    return pad + _scalar(x) + "\n"


def _scalar(v) -> str:
    return "[]" if v == [] else "{}" if v == {} else json.dumps(v, ensure_ascii=False, default=str)


# Record schemes: the type of every key as the first records show it.


def record_scheme(record: dict) -> OrderedDict:
    out: OrderedDict = OrderedDict()
    for k, v in record.items():
        out[k] = _scheme_of(v)
    return out


def _scheme_of(v) -> dict:
    if isinstance(v, dict):
        return {"type": "dict", "schema": record_scheme(v)}
    if isinstance(v, (list, tuple)):
        if not v:
            return {"type": "array", "subtype": "string"}
        first = _scheme_of(v[0])
        if first["type"] == "dict":
            whole: OrderedDict = OrderedDict()
            for x in v:
                if isinstance(x, dict):
                    whole = merge_schemes(whole, record_scheme(x))
            return {"type": "array", "subtype": "dict", "schema": whole}
        return {"type": "array", "subtype": first["type"]}
    if isinstance(v, bool):
        return {"type": "boolean"}
    if isinstance(v, int):
        return {"type": "integer"}
    if isinstance(v, float):
        return {"type": "float"}
    return {"type": "datetime"} if isinstance(v, (dt.datetime, dt.date)) else {"type": "string"}


def merge_schemes(a: OrderedDict, b: OrderedDict) -> OrderedDict:
    """Keys of both, each with the type seen first; nested schemes are merged."""
    out = OrderedDict(a)
    for k, v in b.items():
        if k not in out:
            out[k] = v
        elif "schema" in out[k] and "schema" in v:
            out[k] = {**out[k], "schema": merge_schemes(out[k]["schema"], v["schema"])}
    return out


def scheme(df: DataFrame, limit: int = 1000, raw: str | None = None) -> OrderedDict | None:
    """Scheme of the first ``limit`` records (from JSON texts in column ``raw``, or typed rows); None without records."""
    if raw is not None:
        records = [json.loads(r[0]) for r in df.select(quoted(raw)).limit(limit).collect()]
    else:
        records = [_plain(r) for r in df.limit(limit).collect()]
    out: OrderedDict | None = None
    for r in records:
        out = record_scheme(r) if out is None else merge_schemes(out, record_scheme(r))
    return out


def _plain(v):
    if hasattr(v, "asDict"):
        return OrderedDict((k, _plain(x)) for k, x in v.asDict().items())
    return [_plain(x) for x in v] if isinstance(v, list) else v


def scheme_fields(found: OrderedDict, prefix: str = "") -> list[dict]:
    """A scheme as a flat list: name, type, class."""
    out = []
    for k, v in found.items():
        name = prefix + k
        many = v["type"] == "array"
        out.append({"name": name, "type": f"list of [{v['subtype']}]" if many else v["type"], "class": "nested" if "schema" in v else "field"})
        if "schema" in v:
            out += scheme_fields(v["schema"], name + ".")
    return out
