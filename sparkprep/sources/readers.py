"""One entry point for all formats: ``read(spark, path, ...)`` gives a lazy DataFrame.

CSV, JSON, XML, Parquet and ORC are Spark's own sources. BSON, Avro, XLSX, DOCX and text behind zip, xz or zstd are read
file by file inside tasks. Without a given schema a first pass, in tasks too, merges the types of all records of all files;
Avro files say their own.
"""

from __future__ import annotations

import csv
import io
import itertools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.paths import quoted
from . import avro, bson, bson_columns, office
from .archives import UnsupportedCodec, decompressed
from .detect import codec_of, format_of, sniff
from .records import merged, plain, row, types_of, union

_NATIVE_CODECS = {None, "gzip", "bzip2", "deflate", "lz4", "snappy"}


class UnsupportedFormat(ValueError):
    pass


def read(
    spark: SparkSession,
    path: str | list[str],
    fmt: str | None = None,
    delimiter: str | None = None,
    encoding: str | None = None,
    tag: str | None = None,
    page: int | None = None,
    start_line: int = 0,
    fields: list[str] | None = None,
    infer_types: bool = False,
    dynamic: bool = False,
    schema: str | T.StructType | None = None,
    ignore_errors: bool = False,
    multiline: bool | None = None,
) -> DataFrame:
    """``dynamic`` reads JSON records into one column ``value`` of raw text, so that missing and null stay apart.

    ``delimiter`` and ``encoding`` are detected where they aren't given. ``tag``: the XML element, or the key of a JSON
    document that holds the records. ``page``: sheet or table number. An explicit ``fields`` list replaces the header.
    ``multiline``: CSV values may hold line ends, so that files can't be split. If not given, a pass over the lines, which can be
    split, looks for one with an open quote and stops at the first.
    """
    paths = [path] if isinstance(path, str) else list(path)
    first = paths[0]
    fmt = fmt or format_of(first)
    if fmt is None:
        raise UnsupportedFormat(f"no format known for {first!r}")
    codec = codec_of(first)
    if codec == "7z":
        raise UnsupportedCodec("7z")
    if fmt in ("bson", "avro", "xlsx", "docx", "xls") or (codec not in _NATIVE_CODECS and fmt in ("csv", "json", "jsonl", "xml")):
        return _read_files(spark, paths, fmt, codec, delimiter, encoding, tag, page, start_line, fields, schema)
    mode = "DROPMALFORMED" if ignore_errors else "FAILFAST"
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        if encoding is None or delimiter is None:
            enc, sep = sniff(first)
            encoding, delimiter = encoding or enc, delimiter or sep
        table = _letters(encoding)
        if table is None and _plain_name(encoding) not in _CHARSETS:
            return _read_files(spark, paths, fmt, codec, delimiter, encoding, tag, page, start_line, fields, schema)
        encoding = "iso-8859-1" if table else encoding
        r = r.options(header=fields is None, sep=delimiter, encoding=encoding, inferSchema=infer_types, quote='"', escape='"', multiLine=_open_quotes(spark, paths, encoding) if multiline is None else multiline, mode="DROPMALFORMED" if ignore_errors else "PERMISSIVE")
        df = r.csv(paths)
        if table:
            df = df.select(*[(F.translate(x, *table) if isinstance(f.dataType, T.StringType) else x).alias(f.name.translate(str.maketrans(*table))) for f in df.schema.fields for x in [F.col(quoted(f.name))]])
        if fields is not None:
            df = df.toDF(*fields, *[f"column{k + 1}" for k in range(len(fields), len(df.columns))])
        if start_line:
            from ..operators.select import skip

            return skip(df, start_line)
        return df
    if fmt == "jsonl":
        if dynamic:
            return r.text(paths).filter(F.trim("value") != "")
        return r.options(mode=mode, encoding=encoding or "utf-8").json(paths)
    if fmt == "json":
        df = r.options(multiLine=True, mode=mode).json(paths)
        if tag:
            return df.select(F.inline(F.col(tag)))
        return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")) if dynamic else df
    if fmt == "xml":
        if not tag:
            raise ValueError("XML needs the record's tag")
        return r.format("xml").options(rowTag=tag, attributePrefix="@", valueTag="#text", inferSchema=infer_types, ignoreNamespace=True, encoding=encoding or "utf-8").load(paths if len(paths) > 1 else first)
    if fmt in ("parquet", "orc"):
        return r.format(fmt).load(paths)
    raise UnsupportedFormat(fmt)


_CHARSETS = {"utf-8", "utf-16", "utf-16le", "utf-16be", "utf-32", "us-ascii", "iso-8859-1"}


def _plain_name(encoding: str) -> str:
    name = encoding.lower().replace("_", "-")
    return {"latin-1": "iso-8859-1", "latin1": "iso-8859-1", "utf8": "utf-8", "ascii": "us-ascii", "utf16": "utf-16"}.get(name, name)


def _letters(encoding: str) -> tuple[str, str] | None:
    """For an encoding of one byte a character: what its bytes are in Latin-1, and what they mean. Spark reads few encodings, so such
    files are read as Latin-1, which keeps every byte and can be split, and their letters are replaced."""
    if _plain_name(encoding).startswith("utf"):
        return None
    high = [bytes([b]) for b in range(128, 256)]
    try:
        if any(bytes([b]).decode(encoding) != chr(b) for b in range(128)):
            return None
        meant = [b.decode(encoding, errors="replace") for b in high]
    except (LookupError, UnicodeDecodeError):
        return None
    multi = len(b"".join(high[64:66]).decode(encoding, errors="replace")) != 2 or sum(x == "\ufffd" for x in meant) > 40
    return None if multi else ("".join(b.decode("latin-1") for b in high), "".join(meant))


def _open_quotes(spark: SparkSession, paths: list[str], encoding: str) -> bool:
    """Whether any quoted value goes over a line's end: some line then has an odd number of quotes."""
    if encoding.lower().replace("_", "-").startswith(("utf-16", "utf-32")):
        return True
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not spark.read.text(paths).filter(quotes % 2 == 1).isEmpty()


def _records(stream, fmt, delimiter, encoding, tag, page, start_line, fields):
    """Python records of one open file."""
    if fmt == "bson":
        return bson.documents(stream)
    if fmt == "avro":
        return avro.records(stream)
    if fmt == "xlsx":
        return iter(office.sheet_records(io.BytesIO(stream.read()), page, start_line, fields))
    if fmt == "docx":
        return iter(office.docx_records(io.BytesIO(stream.read()), page or 0))
    if fmt == "xls":
        import pandas as pd  # needs the optional xlrd

        frame = pd.read_excel(io.BytesIO(stream.read()), sheet_name=page or 0, skiprows=start_line, dtype=object)
        return (dict(zip(frame.columns.map(str), [None if v != v else v for v in r])) for r in frame.itertuples(index=False, name=None))
    text = io.TextIOWrapper(stream, encoding=encoding or "utf-8", newline="" if fmt == "csv" else None)
    if fmt == "csv":
        return itertools.islice(csv.DictReader(text, fieldnames=fields, restkey="null", delimiter=delimiter or ","), start_line, None)
    if fmt == "jsonl":
        return (json.loads(x) for x in text if x.strip())
    if fmt == "json":
        whole = json.load(text)
        whole = whole[tag] if tag else whole
        return iter(whole if isinstance(whole, list) else [whole])
    raise UnsupportedFormat(f"{fmt} in this compression")


def _read_files(spark, paths, fmt, codec, delimiter, encoding, tag, page, start_line, fields, schema) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    if fmt == "csv" and delimiter is None:
        encoding, delimiter = (encoding or sniff(paths[0])[0], sniff(paths[0])[1])
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if fmt == "bson" and (schema is None or bson_columns.readable(schema)):
        return _read_bson(spark, files, codec, schema)
    opts = (fmt, delimiter, encoding, tag, page, start_line, fields)
    names = files.select("path")
    names = names.repartitionByRange(max(1, min(names.count(), 4 * spark.sparkContext.defaultParallelism)), "path")

    def kinds(batches):
        import pandas as pd

        found = []
        for path in sorted(p for pdf in batches for p in pdf["path"]):
            with _open(path) as raw:
                kind = avro.schema_type(decompressed(raw, codec)) if fmt == "avro" else None
            if kind is None:
                with _open(path) as raw:
                    kind = types_of(_records(decompressed(raw, codec), *opts))
            found.append(kind)
        if found:
            yield pd.DataFrame({"path": [path], "kind": [union(found).json()]})

    if schema is None:
        schema = merged(r.kind for r in sorted(names.mapInPandas(kinds, "path string, kind string").collect()))

    def stream(batches):
        import pandas as pd

        for pdf in batches:
            for path in pdf["path"]:
                with _open(path) as raw:
                    rows = (row(r, schema) for r in _records(decompressed(raw, codec), *opts))
                    while part := list(itertools.islice(rows, 5000)):
                        yield pd.DataFrame({f.name: pd.Series([plain(p[k], f.dataType) for p in part], dtype=object) for k, f in enumerate(schema.fields)})

    if not schema.fields:
        return spark.createDataFrame([], schema)
    return names.mapInPandas(stream, schema)


def _read_bson(spark, files: DataFrame, codec: str | None, schema: T.StructType | None) -> DataFrame:
    """Files that aren't compressed are read in parts of the size that Spark gives its own files; the first pass finds where
    documents begin."""
    conf, tasks = spark._jsparkSession.sessionState().conf(), spark.sparkContext.defaultParallelism
    sizes = files.select("path", "length").persist()
    n, total = sizes.agg(F.count("path"), F.coalesce(F.sum("length"), F.lit(0))).first()
    every = int(min(conf.filesMaxPartitionBytes(), max(conf.filesOpenCostInBytes(), total // tasks)))
    whole = schema is not None and (codec is not None or sizes.filter(F.col("length") > every).isEmpty())
    typed = schema is None

    def survey(batches):
        import pandas as pd

        found, parts = [], []
        for path in sorted(p for pdf in batches for p in pdf["path"]):
            with _open(path) as raw:
                kind, at = bson_columns.survey(decompressed(raw, codec), every, typed)
            found.append(kind)
            parts += [(path, None, a, b - a) for a, b in zip(at, at[1:])] if codec is None else [(path, None, 0, -1)]
        if found:
            yield pd.DataFrame([(path, union(found).json(), 0, 0), *parts], columns=["path", "kind", "start", "size"])

    if whole:
        parts = sizes.select("path", F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("size"))
    else:
        got = sizes.select("path").repartitionByRange(max(1, min(n, 4 * tasks)), "path").mapInPandas(survey, "path string, kind string, start long, size long").collect()
        parts = [(r.path, r.start, r.size) for r in got if r.kind is None]
        n = len(parts)
        if typed:
            schema = merged(r.kind for r in sorted(r for r in got if r.kind is not None))
        parts = spark.createDataFrame(parts, "path string, start long, size long")
    sizes.unpersist()
    if not schema.fields:
        return spark.createDataFrame([], schema)

    def stream(batches):
        for batch in batches:
            for path, start, size in zip(*(batch[k].to_pylist() for k in ("path", "start", "size"))):
                with _open(path) as raw:
                    if start:
                        raw.seek(start)
                    yield from bson_columns.batches(decompressed(raw, codec), schema, None if size < 0 else size)

    return parts.repartitionByRange(max(1, min(n, max(4 * tasks, -(-total // every)))), "path", "start").mapInArrow(stream, schema)


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)  # zip needs to seek
