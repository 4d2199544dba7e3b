"""The stateless operators on streams, and counts in update or complete mode; an extension of the batch operators.

``select``, filters, ``apply``, ``flatten`` and validation are the batch functions unchanged; the wrappers here differ only where
a stream needs it (no sort, no collected sample, batches for sinks).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators.reshape import Sink, _batches
from ..operators.select import select
from ..operators.validate import checked
from ..operators.values import value_rows


def read_stream(spark: SparkSession, path: str, fmt: str, schema: str | T.StructType, **options) -> DataFrame:
    """New files of a folder as a stream; the schema is needed beforehand."""
    return spark.readStream.format({"jsonl": "json"}.get(fmt, fmt)).schema(schema).options(**options).load(path)


def select_stream(stream: DataFrame, fields=None, filter: str | None = None) -> DataFrame:  # noqa: A002
    return select(stream, fields, filter)


def validate_stream(stream: DataFrame, fields, rule: str, filter: str | None = None) -> DataFrame:  # noqa: A002
    """Invalid values as they arrive."""
    rows = checked(stream, fields, rule, filter)
    return rows.filter(~F.col(f"`{rows.columns[1]}`"))


def frequency_stream(stream: DataFrame, fields, filter: str | None = None, time: str | None = None, window: str | None = None, late: str = "10 minutes") -> DataFrame:  # noqa: A002
    """Counts per combination; with ``time`` and ``window`` per event-time window, closed by a watermark."""
    if time is None:
        rows = value_rows(stream, fields, filter)
        return rows.groupBy(*[f"`{c}`" for c in rows.columns]).count()
    stream = stream.withWatermark(time, late)
    names = fields.split(",") if isinstance(fields, str) else list(fields)
    at = F.window(F.col(time), window).alias("window")
    return select(stream, None, filter).groupBy(at, *[F.col(f"`{n}`").cast("string").alias(n) for n in names]).count()


def uniq_stream(stream: DataFrame, fields, filter: str | None = None) -> DataFrame:  # noqa: A002
    """Combinations when first seen; state grows with their number."""
    return value_rows(stream, fields, filter).dropDuplicates()


def ingest_stream(stream: DataFrame, sink: Sink, batch: int = 1000) -> DataStreamWriter:
    """Each micro-batch to the sink, from the tasks that hold it."""

    run = uuid.uuid4().hex[:12]

    def send(df: DataFrame, epoch: int) -> None:
        def put(rows):
            from pyspark import TaskContext

            part, n = TaskContext.get().partitionId(), 0
            for some in _batches(rows, batch):
                sink.put(some, [f"{run}-{epoch:09d}-{part:05d}-{n + k:09d}" for k in range(len(some))])
                n += len(some)

        df.foreachPartition(put)

    return stream.writeStream.foreachBatch(send)
