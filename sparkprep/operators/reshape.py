"""Flattening, splitting, scripts per record, conversion and batched ingestion."""

from __future__ import annotations

import json
import os
import runpy
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pystr import py_str, safe_file_name
from ..plans.filterlang import apply_filter
from ..plans.paths import leaves, melt, quoted, values
from ..sources.readers import read
from ..sources.records import merged, row, type_of, union
from ..sources.writers import flat_texts, write
from ..session import materialised
from .select import field_list, project
from .select import skip as skip_rows


def flatten(df: DataFrame, filter: str | None = None) -> DataFrame:  # noqa: A002
    """(key, value): one row per leaf value of each record, null values as null."""
    return melt(apply_filter(df, filter)).select("key", "value")


def flatten_columns(df: DataFrame) -> DataFrame:
    """Nested leaves as columns named by their path."""
    return flat_texts(df)


def with_chunks(df: DataFrame, size: int, order: list[str], filter: str | None = None) -> DataFrame:  # noqa: A002
    """A column ``chunk`` (1, 2, ...): ``size`` rows each in the given order, counted over the rows that pass the filter.

    Ranks are global without a global window: rows are range-sorted into partitions and written once (ranges come from a sample, and
    another pass might draw another one), only the partitions' sizes go to the driver, and each row adds its rank within its partition.
    """
    spark = df.sparkSession
    df = apply_filter(df, filter)
    part = materialised(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    sizes = part.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()
    before, total = {}, 0
    for r in sizes:
        before[r["__part"]] = total
        total += r["n"]
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "__p int, __before long")
    ranked = part.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    ranked = ranked.join(F.broadcast(starts), F.col("__part") == F.col("__p"))
    chunk = F.floor((F.col("__rank") - 1 + F.col("__before")) / size).cast("long") + 1
    return ranked.withColumn("chunk", chunk).drop("__part", "__p", "__before", "__rank")


def with_value_key(df: DataFrame, field: str, filter: str | None = None, name: str = "part") -> DataFrame:  # noqa: A002
    """A column with the first value of ``field`` as a safe file name; rows without a value are left out."""
    df = apply_filter(df, filter)
    v = values(df, field)
    one = v.scalar if v.scalar is not None else F.get(v.column, 0)
    return df.filter(one.isNotNull()).withColumn(name, safe_file_name(py_str(one, v.kind)))


def split(df: DataFrame, path: str, fmt: str = "jsonl", fields: str | list[str] | None = None, size: int = 10_000, order: list[str] | None = None, filter: str | None = None) -> None:  # noqa: A002
    """Write one folder per chunk of ``size`` rows, or per value of the first of ``fields``."""
    names = field_list(fields)
    if names:
        keyed, key = with_value_key(df, names[0], filter), "part"
        keyed = keyed.repartition("part", F.pmod(F.xxhash64(*[quoted(c) for c, t in df.dtypes if "map<" not in t and t != "variant"]), F.lit(16)))  # few files a value, and a common one is spread
    else:
        keyed, key = with_chunks(df, size, order or df.columns[:1], filter), "chunk"
    w = keyed.write.mode("overwrite").partitionBy(key)
    (w.option("header", True).csv if fmt == "csv" else w.parquet if fmt == "parquet" else w.orc if fmt == "orc" else w.option("ignoreNullFields", False).json)(path)


def load_script(path: str) -> Callable[[dict], dict]:
    """The function ``process`` of a Python file. It is the user's own code and runs on driver and executors."""
    return runpy.run_path(path)["process"]


def apply(df: DataFrame, process: Callable[[dict], dict], schema: str | T.StructType | None = None, filter: str | None = None, fields: str | list[str] | None = None) -> DataFrame:  # noqa: A002
    """Each record through a Python function that may add, rename or drop keys; None drops the record.

    Without a schema, a first pass runs the function on all records to learn the output's.
    """
    df = apply_filter(df, filter)
    if fields:
        df = project(df, field_list(fields))
    if schema is None:
        def kinds(batches: Iterator) -> Iterator:
            import pyarrow as pa

            found = union(type_of(p) for batch in batches for r in batch.to_pylist() if (p := process(r)) is not None)
            yield pa.RecordBatch.from_pylist([{"kind": found.json()}])

        parts = df.mapInArrow(kinds, "kind string").select(F.spark_partition_id().alias("part"), "kind")
        schema = merged(r.kind for r in sorted(parts.collect()))
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for batch in batches:
            out = [p for r in batch.to_pylist() if (p := process(r)) is not None]
            rows = [dict(zip(schema.names, _named(row(p, schema), schema))) for p in out]
            yield from pa.Table.from_pylist(rows, kind).to_batches()

    return df.mapInArrow(run, schema)


def _named(values_: tuple, schema: T.StructType) -> tuple:
    def name(v, kind):
        if isinstance(kind, T.StructType) and v is not None:
            return dict(zip(kind.names, _named(v, kind)))
        return [name(x, kind.elementType) for x in v] if isinstance(kind, T.ArrayType) and v is not None else v

    return tuple(name(v, f.dataType) for v, f in zip(values_, schema.fields))


def _plain(v):
    if hasattr(v, "asDict"):
        return {k: _plain(x) for k, x in v.asDict().items()}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def convert(spark: SparkSession, source: str, target: str, fmt_in: str | None = None, fmt_out: str | None = None, compression: str | None = None, flatten: bool = False, fields: str | list[str] | None = None, sort_columns: bool = False, **options) -> None:
    """Read one file or folder and write it in another format."""
    infer_types = options.pop("infer_types", None)
    fmt_out = fmt_out or _format(target)
    df = read(spark, source, fmt=fmt_in, infer_types=fmt_out == "parquet" if infer_types is None else infer_types, **options)
    if fields:
        df = project(df, field_list(fields))
    if sort_columns:
        df = df.select(*[quoted(c) for c in sorted(df.columns)])
    nested = any(isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) for f in df.schema.fields)
    write(df, target, fmt_out, compression, flatten=flatten or nested and fmt_out in ("csv", "avro", "xlsx") and bool(leaves(df.schema)))


def _format(path: str) -> str | None:
    from ..sources.detect import format_of

    return format_of(path)


class Sink(Protocol):
    """Where batches of records go. ``put`` runs in tasks; a task that is repeated sends the same keys again."""

    def prepare(self, drop: bool) -> None: ...

    def put(self, batch: list[dict], keys: list[str]) -> None: ...


class _Client:
    """Makes its client once a process, and is sent to tasks without it."""

    _made = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def client(self):
        if self._made is None:
            self._made = self.connect()
        return self._made


class LocalJsonSink:
    """JSON lines in a local folder, one file a batch; a stand-in for a database, for local runs."""

    def __init__(self, folder: str):
        self.folder = folder

    def prepare(self, drop: bool) -> None:
        os.makedirs(self.folder, exist_ok=True)
        if drop:
            for name in os.listdir(self.folder):
                os.remove(os.path.join(self.folder, name))

    def put(self, batch: list[dict], keys: list[str]) -> None:
        with open(os.path.join(self.folder, f"{keys[0]}.jsonl"), "w") as f:
            f.writelines(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in batch)


class MongoSink(_Client):
    """Inserts into a MongoDB collection; needs pymongo. What is there already, from an earlier try of a task, is left alone."""

    def __init__(self, uri: str, db: str, table: str):
        self.uri, self.db, self.table = uri, db, table

    def connect(self):
        from pymongo import MongoClient

        return MongoClient(self.uri)

    def prepare(self, drop: bool) -> None:
        if drop:
            self.client()[self.db][self.table].drop()

    def put(self, batch: list[dict], keys: list[str]) -> None:
        try:
            self.client()[self.db][self.table].insert_many([{"_id": k} | r for k, r in zip(keys, batch)], ordered=False)
        except Exception as e:
            errors = (getattr(e, "details", None) or {}).get("writeErrors")
            if not errors or any(x.get("code") != 11000 for x in errors):
                raise


class ElasticSink(_Client):
    """Bulk indexing into Elasticsearch with certificates verified; needs the elasticsearch client. Refused documents are an error."""

    def __init__(self, uri: str, index: str, api_key: str | None = None, doc_id: str | None = None, pipeline: str | None = None):
        self.uri, self.index, self.api_key, self.doc_id, self.pipeline = uri, index, api_key, doc_id, pipeline

    def connect(self):
        from elasticsearch import Elasticsearch

        return Elasticsearch(self.uri, api_key=self.api_key)

    def prepare(self, drop: bool) -> None:
        if drop:
            self.client().indices.delete(index=self.index, ignore_unavailable=True)

    def put(self, batch: list[dict], keys: list[str]) -> None:
        ops: list[dict] = []
        for k, r in zip(keys, batch):
            ops += [{"index": {"_index": self.index, "_id": r[self.doc_id] if self.doc_id else k}}, r]
        got = self.client().bulk(operations=ops, pipeline=self.pipeline)
        if got.get("errors"):
            bad = [x["index"] for x in got["items"] if x["index"].get("error")]
            raise RuntimeError(f"{len(bad)} of {len(batch)} documents refused, the first: {bad[0]}" if bad else "the bulk request failed")


def _batches(rows: Iterable, n: int) -> Iterator[list[dict]]:
    held: list[dict] = []
    for r in rows:
        held.append(_plain(r))
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held


def ingest(df: DataFrame, sink: Sink, batch: int = 1000, skip: int = 0, order: list[str] | None = None, drop: bool = False) -> None:
    """Send all records but the first ``skip`` to the sink, in batches, from the tasks that hold them."""
    if skip:
        df = skip_rows(df, skip, order)
    sink.prepare(drop)
    run = uuid.uuid4().hex[:12]

    def send(rows: Iterator) -> None:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for some in _batches(rows, batch):
            sink.put(some, [f"{run}-{part:05d}-{n + k:09d}" for k in range(len(some))])
            n += len(some)

    df.foreachPartition(send)
