"""Projection, filtering, record queries, counts and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.filterlang import apply_filter
from ..plans.paths import PathError, path_type, project, quoted, values
from ..plans.recordlang import compile_query, truthy
from ..session import materialised


def field_list(fields: str | list[str] | None) -> list[str]:
    if fields is None:
        return []
    return [f.strip() for f in fields.split(",")] if isinstance(fields, str) else list(fields)


def known_fields(df: DataFrame, fields: list[str]) -> list[str]:
    """Fields that exist; an unknown one is left out, as a record without that key would."""
    out = []
    for f in fields:
        try:
            if f not in df.columns:
                path_type(df.schema, f)
            out.append(f)
        except PathError:
            continue
    return out


def select(df: DataFrame, fields: str | list[str] | None = None, filter: str | None = None, legacy_projection: bool = False) -> DataFrame:  # noqa: A002
    """Rows that pass the filter, with the requested fields only. The filter may use other fields than those kept."""
    df = apply_filter(df, filter)
    names = field_list(fields)
    return project(df, known_fields(df, names), legacy_projection) if names else df


def query(df: DataFrame, expression: str, fields: str | list[str] | None = None) -> DataFrame:
    """``result``: JSON text of the expression for each record; falsy results (null, false, 0, "", []) are dropped."""
    names = field_list(fields)
    if names:
        df = project(df, known_fields(df, names))
    column, kind = compile_query(df, expression)
    found = df.select(column.alias("x")).filter(truthy(F.col("x"), kind))
    text = F.to_json(F.struct("x"), {"ignoreNullFields": "false"})
    return found.select(F.substring(text, F.lit(6), F.char_length(text) - 6).alias("result"))


def query_column(df: DataFrame, expression: str, name: str = "result") -> DataFrame:
    """``df`` with the typed value of the expression as a further column, all rows kept."""
    return df.withColumn(name, compile_query(df, expression)[0])


def unnest(df: DataFrame, path: str, keep: str | list[str] | None = None) -> DataFrame:
    """One row per record of the list at ``path``, with its fields as columns, after those of the document that ``keep`` names."""
    v = values(df, path)
    kind, x = v.kind, v.column
    while isinstance(kind, T.ArrayType):
        kind, x = kind.elementType, F.flatten(F.filter(x, lambda v: v.isNotNull()))
    if not isinstance(kind, T.StructType):
        raise PathError(f"{path!r} holds no records")
    names = field_list(keep)
    rows = df.select(*[F.col(quoted(c)) for c in names], F.explode(x).alias("__record"))
    return rows.filter("__record is not null").select(*[F.col(quoted(c)) for c in names], "__record.*")


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def sample(df: DataFrame, n: int = 200, order: list[str] | None = None) -> DataFrame:
    """First n records; their order is only defined by ``order``."""
    return (df.orderBy(*order) if order else df).limit(n)


def skip(df: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """All but the first n records, in the given order or that of the source.

    Rows keep their partitions: only the partitions' sizes reach the driver, and one comparison with the row's number drops the
    first n. With an order, rows are range-sorted and written once, so that counting and reading see the same partitions.
    """
    if not n:
        return df
    if order:
        df = materialised(df.repartitionByRange(*order).sortWithinPartitions(*order))
    part, row = (next(c for k in range(len(df.columns) + 1) if (c := f"{name}{k or ''}") not in df.columns) for name in ("__part", "__row"))
    sizes = df.select(F.spark_partition_id().alias(part)).groupBy(part).agg(F.count(F.lit(1)).alias("n")).orderBy(part).collect()
    at, before = None, 0
    for r in sizes:
        if before + r["n"] > n:
            at = (r[part] << 33) + n - before  # how monotonically_increasing_id numbers rows
            break
        before += r["n"]
    if at is None:
        return df.filter(F.lit(False))
    return df.withColumn(row, F.monotonically_increasing_id()).filter(F.col(row) >= at).drop(row)
