"""One entry point for all output formats: ``write(df, path, ...)``.

Native formats go through Spark's writers. BSON, Avro and Parquet with brotli are written by tasks, one file a partition, in a
folder with a ``_SUCCESS`` mark; a task that runs again overwrites its own part. XLSX is one file, hence one task.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pystr import py_str
from ..plans.paths import leaves, quoted, values
from . import avro, bson, bson_columns, office
from .detect import format_of
from .readers import UnsupportedFormat

PARQUET_CODECS = {"snappy", "gzip", "zstd", "lz4", "lz4_raw", "none", "uncompressed"}
ORC_CODECS = {"zstd", "snappy", "zlib", "lzo", "lz4", "none"}


def flat_texts(df: DataFrame) -> DataFrame:
    """Leaves as columns named by their dotted path; several values of one leaf become a JSON list."""
    cols = []
    for leaf in leaves(df.schema):
        v = values(df, leaf.path)
        cols.append((v.scalar if v.scalar is not None else F.to_json(v.column)).alias(leaf.path))
    return df.select(*cols)


def _csv_ready(df: DataFrame) -> DataFrame:
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    return df.select(*[F.to_json(quoted(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(quoted(f.name)) for f in df.schema.fields])


def write(df: DataFrame, path: str, fmt: str | None = None, compression: str | None = None, delimiter: str = ",", encoding: str = "utf-8", flatten: bool = False, mode: str = "overwrite", row_tag: str = "row") -> None:
    fmt = fmt or format_of(path)
    if flatten:
        df = flat_texts(df)
    w = df.write.mode(mode)
    codec = None if compression in (None, "None", "none") else compression
    if fmt == "csv":
        w = _csv_ready(df).write.mode(mode).options(header=True, sep=delimiter, encoding=encoding, quote='"', escape='"', emptyValue="", nullValue="")
        (w.option("compression", codec) if codec else w).csv(path)
    elif fmt in ("jsonl", "json"):
        w = w.option("ignoreNullFields", False)
        (w.option("compression", codec) if codec else w).json(path)
    elif fmt == "xml":
        w.format("xml").options(rowTag=row_tag, rootTag="rows", attributePrefix="@", valueTag="#text").save(path)
    elif fmt == "parquet":
        if codec == "brotli":
            _by_task(df, path, ".br.parquet", _brotli(df.schema), mode)
        elif codec and codec not in PARQUET_CODECS:
            raise UnsupportedFormat(f"parquet compression {codec}")
        else:
            w.option("compression", codec or "none" if compression else "zstd").parquet(path)
    elif fmt == "orc":
        w.option("compression", codec if codec in ORC_CODECS else "none").orc(path)
    elif fmt == "bson":
        _by_task(df, path, ".bson", *((_bson(df.schema), mode) if _in_arrow(df.schema) else (_bson_rows, mode, False)))
    elif fmt == "avro":
        texts = df.select(*[F.when(F.col(quoted(f.name)).isNotNull(), py_str(F.col(quoted(f.name)), f.dataType)).alias(f.name) for f in df.schema.fields])
        _by_task(texts, path, ".avro", _avro(texts.columns, codec or "deflate"), mode)
    elif fmt == "xlsx":
        with open(path, "wb") as f:
            office.write_sheet(f, df.columns, (tuple(_cell(v) for v in r) for r in df.toLocalIterator()))
    else:
        raise UnsupportedFormat(str(fmt))


def _cell(v):
    return json.dumps(v, default=str, ensure_ascii=False) if isinstance(v, (list, dict)) else v.asDict() if hasattr(v, "asDict") else v


_SCALARS = (T.NullType, T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _in_arrow(kind: T.DataType) -> bool:
    """Whether Arrow's values are those of rows; variants and intervals aren't, nor are records with doubled names."""
    if isinstance(kind, T.StructType):
        return len(set(kind.names)) == len(kind.names) and all(_in_arrow(f.dataType) for f in kind.fields)
    if isinstance(kind, T.MapType):
        return isinstance(kind.keyType, (T.StringType, T.IntegerType, T.LongType)) and _in_arrow(kind.valueType)
    return _in_arrow(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, _SCALARS)


def _row_record(v):
    if hasattr(v, "asDict"):
        return {k: _row_record(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {str(k): _row_record(x) for k, x in v.items()}
    return [_row_record(x) for x in v] if isinstance(v, list) else v


def _bson_rows(f, rows: Iterator) -> None:
    for r in rows:
        f.write(bson.encode(_row_record(r)))


def _record(v, kind: T.DataType):
    """An Arrow value as plain Python: its maps are lists of pairs."""
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _record(v[f.name], f.dataType) for f in kind.fields}
    if isinstance(kind, T.MapType):
        return {str(k): _record(x, kind.valueType) for k, x in v}
    return [_record(x, kind.elementType) for x in v] if isinstance(kind, T.ArrayType) else v


def _bson(schema: T.StructType):
    def put(f, batches: Iterator) -> None:
        for batch in batches:
            f.write(bson_columns.encode(batch, [lambda v, n=x.name, k=x.dataType: bson._element(n, _record(v, k)) for x in schema.fields]))

    return put


def _avro(names: list[str], codec: str):
    def put(f, batches: Iterator) -> None:
        avro.write_blocks(f, names, (x for b in batches for x in avro.text_blocks(b)), codec if codec in ("deflate", "null") else "deflate")

    return put


def _brotli(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)

    def put(f, batches: Iterator) -> None:
        import pyarrow as pa
        import pyarrow.parquet as pq

        with pq.ParquetWriter(f, kind, compression="brotli") as w:
            for batch in batches:
                w.write_table(pa.Table.from_batches([batch]).cast(kind))

    return put


def _by_task(df: DataFrame, path: str, suffix: str, put: Callable, mode: str, arrow: bool = True) -> None:
    """``put`` gets a partition's Arrow batches, or its rows."""
    from pyarrow import fs as pafs

    uri = path if "://" in path else "file://" + os.path.abspath(path)
    fs, root = pafs.FileSystem.from_uri(uri)
    if fs.get_file_info(root).type != pafs.FileType.NotFound:
        if mode != "overwrite":
            raise FileExistsError(path)
        (fs.delete_dir if fs.get_file_info(root).type == pafs.FileType.Directory else fs.delete_file)(root)
    fs.create_dir(root, recursive=True)

    def task(part: Iterator) -> int:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(uri)
        ctx = TaskContext.get()
        tmp = f"{root}/.part-{ctx.partitionId():05d}-{ctx.attemptNumber()}"
        with fs.open_output_stream(tmp, compression=None) as f:
            put(f, part)
        fs.move(tmp, f"{root}/part-{ctx.partitionId():05d}{suffix}")
        return ctx.partitionId()

    def batches(part: Iterator):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"part": pa.array([task(part)], pa.int32())})

    if arrow:
        df.mapInArrow(batches, "part int").collect()
    else:
        df.foreachPartition(task)
    with fs.open_output_stream(f"{root}/_SUCCESS"):
        pass
