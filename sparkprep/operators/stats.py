"""Column statistics with guessed types.

One row per leaf value, then two hash aggregations: by (key, value), where partial aggregation absorbs repeated values, and by
key. Texts, lengths and type guesses are made once per distinct value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pystr import float_repr, guess_text, kind_label, py_str
from ..plans.paths import leaves, quoted, values
from .dynamic import melt_records

DICT_SHARE = 70.0
_KINDS = ("int", "float", "typed", "date", "str")


def _typed_values(df: DataFrame, skip_short_keys: bool) -> DataFrame:
    """(key, kind, value, n, at) per distinct leaf value. Values are counted as they are; only distinct ones become text."""
    found = [(pos, leaf) for pos, leaf in enumerate(leaves(df.schema)) if not skip_short_keys or len(top := leaf.path.split(".")[0]) > 1 and not top.isdecimal()]

    def row(pos: int, kind: T.DataType):
        def make(v):
            whole, real = isinstance(kind, T.IntegralType), isinstance(kind, (T.DoubleType, T.FloatType))
            number = v.cast("string").cast("double") if isinstance(kind, T.FloatType) else v
            return F.struct(F.lit(pos).alias("at"), (v if whole else F.lit(None)).cast("long").alias("l"), (number if real else F.lit(None)).cast("double").alias("d"), (F.lit(None).cast("string") if whole or real else F.when(v.isNotNull(), py_str(v, kind))).alias("t"))

        return make

    flat = [row(pos, leaf.kind)(F.col(quoted(leaf.path))) for pos, leaf in found if "." not in leaf.path or leaf.path in df.columns]
    parts = [F.array(*flat)] if flat else []
    parts += [F.transform(values(df, leaf.path).column, row(pos, leaf.kind)) for pos, leaf in found if "." in leaf.path and leaf.path not in df.columns]
    if not parts:
        return df.sparkSession.createDataFrame([], "key string, kind string, value string, n long, at int")
    rows = df.select(F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("m")).select("m.*")
    counted = rows.groupBy("at", "l", "d", "t").agg(F.count(F.lit(1)).alias("n"))
    label = lambda f: F.element_at(F.create_map(*[F.lit(x) for pos, leaf in found for x in (pos, f(leaf))]), F.col("at"))
    value = F.coalesce("t", F.col("l").cast("string"), F.when(F.col("d").isNotNull(), float_repr(F.col("d"))))
    counted = counted.select(label(lambda x: x.path).alias("key"), label(lambda x: kind_label(x.kind)).alias("of"), value.alias("value"), "n", "at")
    return counted.select("key", F.when(F.col("value").isNull(), F.lit("empty")).otherwise(F.col("of")).alias("kind"), "value", "n", "at")


def _record_values(df: DataFrame, column: str, skip_short_keys: bool) -> DataFrame:
    rows = melt_records(df, column)
    if skip_short_keys:
        top = F.substring_index("key", ".", 1)
        rows = rows.filter((F.char_length(top) > 1) & ~top.rlike(r"^\p{Nd}+$"))
    return rows.groupBy("key", "canon", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "pos")).alias("at"))


def _summary(values: DataFrame, canon: str, dict_share: float, check_dates: bool) -> DataFrame:
    text = F.coalesce("value", F.lit("None"))
    guess = F.when(F.col("kind") == "str", guess_text(F.col("value"), check_dates)).otherwise(F.col("kind"))
    values = values.withColumn("len", F.char_length(text)).withColumn("guess", guess)
    flags = [F.max(F.when(F.col("guess") == k, 1).otherwise(0)).alias(f"has_{k}") for k in _KINDS]
    one = values.groupBy("key", canon).agg(F.sum("n").alias("n"), F.min("len").alias("lo"), F.max("len").alias("hi"), F.sum(F.col("len") * F.col("n")).alias("chars"), F.min("at").alias("at"), *flags) if canon != "value" else values.select("key", F.col("n"), F.col("len").alias("lo"), F.col("len").alias("hi"), (F.col("len") * F.col("n")).alias("chars"), "at", *[F.when(F.col("guess") == k, 1).otherwise(0).alias(f"has_{k}") for k in _KINDS])
    keys = one.groupBy("key").agg(
        F.sum("n").cast("long").alias("total"),
        F.count(F.lit(1)).alias("n_uniq"),
        F.min("lo").cast("long").alias("minlen"),
        F.max("hi").cast("long").alias("maxlen"),
        F.sum("chars").cast("long").alias("chars"),
        F.min("at").alias("at"),
        *[F.max(f"has_{k}").alias(f"has_{k}") for k in _KINDS],
    )
    kinds = sum((F.col(f"has_{k}") for k in _KINDS), F.lit(0))
    named = F.coalesce(*[F.when(F.col(f"has_{k}") == 1, F.lit(k)) for k in _KINDS])
    share = F.lit(100.0) * F.col("n_uniq") / F.col("total")
    out = keys.select(
        "key",
        F.when(kinds == 1, named).otherwise(F.lit("str")).alias("ftype"),
        (share < dict_share).alias("is_dictkey"),
        (share >= 100).alias("is_uniq"),
        "n_uniq",
        share.alias("share_uniq"),
        "minlen",
        "maxlen",
        (F.col("chars") / F.col("total")).alias("avglen"),
        "total",
        "at",
    )
    return out.orderBy("at").drop("at")


def stats(df: DataFrame, dict_share: float = DICT_SHARE, check_dates: bool = True, skip_short_keys: bool = True) -> DataFrame:
    """(key, ftype, is_dictkey, is_uniq, n_uniq, share_uniq, minlen, maxlen, avglen, total) per leaf, in schema order."""
    return _summary(_typed_values(df, skip_short_keys), "value", dict_share, check_dates)


def stats_records(df: DataFrame, column: str = "value", dict_share: float = DICT_SHARE, check_dates: bool = True, skip_short_keys: bool = True) -> DataFrame:
    """``stats`` over raw JSON records: keys may be missing and a key's values may differ in type."""
    return _summary(_record_values(df, column, skip_short_keys), "canon", dict_share, check_dates)


def guess_types(df: DataFrame, column: str, check_dates: bool = True) -> DataFrame:
    """How many values of a text column look like which type."""
    kind = F.when(F.col(f"`{column}`").isNull(), F.lit("empty")).otherwise(guess_text(F.col(f"`{column}`"), check_dates))
    return df.groupBy(kind.alias("guess")).agg(F.count(F.lit(1)).alias("count"))
