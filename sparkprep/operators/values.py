"""Distinct values, frequency tables and headers over dotted paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pystr import py_str
from ..plans.filterlang import apply_filter
from ..plans.paths import leaves, values
from .dynamic import melt_records
from .select import field_list


def _to_text(kind):
    return lambda x: py_str(x, kind)


def value_rows(df: DataFrame, fields: str | list[str], filter: str | None = None) -> DataFrame:  # noqa: A002
    """One row per value of the first field, the others zipped to it by position, all as text.

    A record without a value in the first field gives no row; a shorter field gives null ("None" after text conversion is
    kept for explicit nulls). Flat fields need no array at all, so that plain columns reach the scan.
    """
    df = apply_filter(df, filter)
    names = field_list(fields)
    found = [values(df, f) for f in names]
    if all(v.scalar is not None and "." not in f or f in df.columns for v, f in zip(found, names)):
        return df.select(*[py_str(v.scalar, v.kind).alias(f) for v, f in zip(found, names)])
    texts = [F.transform(v.column, _to_text(v.kind)) for v in found]
    zipped = F.slice(F.arrays_zip(*[t.alias(f"c{k}") for k, t in enumerate(texts)]), F.lit(1), F.size(texts[0]))
    rows = df.select(F.explode(zipped).alias("z"))
    return rows.select(*[F.col("z")[f"c{k}"].alias(f) for k, f in enumerate(names)])


def uniq(df: DataFrame, fields: str | list[str], filter: str | None = None) -> DataFrame:  # noqa: A002
    """Distinct combinations of the fields' values."""
    return value_rows(df, fields, filter).distinct()


def frequency(df: DataFrame, fields: str | list[str], filter: str | None = None, sort: bool = True) -> DataFrame:  # noqa: A002
    """Combinations with their number, rarest first."""
    names = field_list(fields)
    counted = value_rows(df, names, filter).groupBy(*[f"`{n}`" for n in names]).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy("count", *[f"`{n}`" for n in names]) if sort else counted


def headers(df: DataFrame, limit: int | None = None, dynamic: str | None = None) -> DataFrame:
    """(pos, key): leaf keys. From the schema alone, or from raw JSON records in column ``dynamic`` in first-seen order."""
    spark = df.sparkSession
    if dynamic is None:
        return spark.createDataFrame([(k, leaf.path) for k, leaf in enumerate(leaves(df.schema))], "pos int, key string")
    rows = melt_records(df.limit(limit) if limit else df, dynamic)
    seen = rows.groupBy("key").agg(F.min(F.struct("row", "pos")).alias("at"))
    return seen.orderBy("at").select(F.col("at.row").alias("row"), F.col("at.pos").alias("pos"), "key")
