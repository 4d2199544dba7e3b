"""Validation rules as boolean Columns; null and wrongly formed values are invalid."""

from __future__ import annotations

from collections.abc import Callable
from email.utils import parseaddr

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

_INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
_INN11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
_INN12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
_URL = (
    r"^(?i)(?:https?|ftps?)://(?:[^\s:@/]+(?::[^\s:@/]*)?@)?"
    r"(?:localhost|(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)|\[[0-9a-f:.]+\]"
    r"|(?:[\p{L}\p{N}_](?:[\p{L}\p{N}_-]{0,61}[\p{L}\p{N}_])?\.)+(?:xn--[a-z0-9-]+|\p{L}{2,63}))\.?"
    r"(?::\d{1,5})?(?:[/?#]\S*)?$"
)


def _digit(s: Column, k: int) -> Column:
    return F.substring(s, k, 1).try_cast("int")


def _check(s: Column, weights: tuple[int, ...]) -> Column:
    total = sum((_digit(s, k + 1) * w for k, w in enumerate(weights)), F.lit(0))
    return total % 11 % 10 == _digit(s, len(weights) + 1)


@arrow_udf(T.BooleanType())
def _has_address(s: pa.Array) -> pa.Array:
    return pa.array([v is not None and "@" in parseaddr(v)[1] for v in s.to_pylist()], pa.bool_())


def email(s: Column) -> Column:
    """An address with an @ in it, by Python's own mail parser, in Arrow batches: no expression follows all its rules."""
    return F.coalesce(F.instr(s, "@") > 0, F.lit(False)) & _has_address(s.cast("string"))


def url(s: Column) -> Column:
    return F.coalesce(s.rlike(_URL), F.lit(False))


def inn(s: Column) -> Column:
    ok = F.when(s.rlike(r"^[0-9]{10}$"), _check(s, _INN10)).when(s.rlike(r"^[0-9]{12}$"), _check(s, _INN11) & _check(s, _INN12))
    return F.coalesce(ok, F.lit(False))


def ogrn(s: Column) -> Column:
    short = F.substring(s, 1, 12).try_cast("bigint") % 11 % 10 == _digit(s, 13)
    long = F.substring(s, 1, 14).try_cast("bigint") % 13 % 10 == _digit(s, 15)
    return F.coalesce(F.when(s.rlike(r"^[0-9]{13}$"), short).when(s.rlike(r"^[0-9]{15}$"), long), F.lit(False))


RULES: dict[str, Callable[[Column], Column]] = {"common.email": email, "common.url": url, "ru.org.inn": inn, "ru.org.ogrn": ogrn}
