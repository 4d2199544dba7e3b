"""Validation of one field by a named rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pystr import py_str
from ..functions.rules import RULES
from ..plans.filterlang import apply_filter
from ..plans.paths import values
from .select import field_list


def checked(df: DataFrame, fields: str | list[str], rule: str, filter: str | None = None) -> DataFrame:  # noqa: A002
    """(field, field_valid): the first value of the first field of each record; both null where there is no value."""
    if rule not in RULES:
        raise ValueError(f"no rule {rule!r}; there are {sorted(RULES)}")
    df = apply_filter(df, filter)
    name = field_list(fields)[0]
    v = values(df, name)
    one = v.scalar if v.scalar is not None else F.get(v.column, 0)
    text = F.when(one.isNotNull(), py_str(one, v.kind))
    return df.select(text.alias(name), F.when(one.isNotNull(), RULES[rule](text)).alias(f"{name}_valid"))


def validate(df: DataFrame, fields: str | list[str], rule: str, mode: str = "invalid", filter: str | None = None) -> DataFrame:  # noqa: A002
    """``invalid``: rows that fail; ``all``: all rows with a value; ``stats``: total, invalid, novalue and share."""
    name = field_list(fields)[0]
    rows = checked(df, fields, rule, filter)
    ok = F.col(f"`{name}_valid`")
    if mode == "stats":
        bad, gone = F.count(F.when(~ok, 1)), F.count(F.when(ok.isNull(), 1))
        return rows.agg(F.count(F.lit(1)).alias("total"), bad.alias("invalid"), gone.alias("novalue"), F.try_divide(F.lit(100.0) * bad, F.count(F.lit(1))).alias("share"))
    if mode == "invalid":
        return rows.filter(~ok)
    if mode == "all":
        return rows.filter(ok.isNotNull())
    raise ValueError(f"mode {mode!r}")
