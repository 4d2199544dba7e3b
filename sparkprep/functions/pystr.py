"""Text of values as Python's ``str`` writes it, and guesses of what type a text holds, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dates import is_date

FLOAT_RE = r"^\s*[+-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?\s*$|^\s*[+-]?(?i:inf|infinity|nan)\s*$"
INT_RE = r"^\p{Nd}+$"


def float_repr(x: Column) -> Column:
    """Shortest decimal text: positional from 1e-4 up to 1e16, otherwise with an exponent of two digits at least."""
    s = x.cast("string")
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    mant = F.regexp_extract(s, r"^-?(\d+)\.(\d+)E(-?\d+)$", 1)
    frac = F.regexp_replace(F.regexp_extract(s, r"^-?(\d+)\.(\d+)E(-?\d+)$", 2), "0$", "")
    exp = F.regexp_extract(s, r"^-?(\d+)\.(\d+)E(-?\d+)$", 3).cast("int")
    size = F.char_length(frac)
    large = F.when(size <= exp, F.concat(mant, frac, F.repeat(F.lit("0"), exp - size), F.lit(".0"))).otherwise(
        F.concat(mant, F.substring(frac, F.lit(1), exp), F.lit("."), F.substring(frac, exp + 1, size))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), mant, frac)
    head = F.when(size > 0, F.concat(mant, F.lit("."), frac)).otherwise(mant)
    power = F.concat(F.lit("e"), F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(exp).cast("string"), 2, "0"))
    power = F.when(F.abs(exp) >= 100, F.concat(F.lit("e"), F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")), F.abs(exp).cast("string"))).otherwise(power)
    body = F.when((exp >= 0) & (exp < 16), large).when((exp < 0) & (exp >= -4), small).otherwise(F.concat(head, power))
    return F.when(F.isnan(x), F.lit("nan")).when(s == "Infinity", F.lit("inf")).when(s == "-Infinity", F.lit("-inf")).when(F.instr(s, "E") > 0, F.concat(sign, body)).otherwise(s)


def _text(x: Column) -> Column:
    quote = F.when((F.instr(x, "'") > 0) & (F.instr(x, '"') == 0), F.lit('"')).otherwise(F.lit("'"))
    inner = F.replace(F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    both = (F.instr(x, "'") > 0) & (F.instr(x, '"') > 0)
    return F.concat(quote, F.when(both, F.replace(inner, F.lit("'"), F.lit("\\'"))).otherwise(inner), quote)


def py_str(x: Column, kind: T.DataType, nested: bool = False) -> Column:
    """``str(value)``; inside lists and dicts (``nested``) texts are quoted."""
    if isinstance(kind, T.NullType):
        return F.lit("None")
    if isinstance(kind, T.BooleanType):
        out = F.when(x, F.lit("True")).otherwise(F.lit("False"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = float_repr(x.cast("double") if isinstance(kind, T.DoubleType) else x.cast("string").cast("double"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: py_str(v, kind.elementType, True)), ", "), F.lit("]"))
    elif isinstance(kind, T.StructType):
        parts = [F.concat(_text(F.lit(f.name)), F.lit(": "), py_str(x.getField(f.name), f.dataType, True)) for f in kind.fields]
        out = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        pair = lambda e: F.concat(py_str(e["key"], kind.keyType, True), F.lit(": "), py_str(e["value"], kind.valueType, True))
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(x), pair), ", "), F.lit("}"))
    elif isinstance(kind, T.StringType):
        out = _text(x) if nested else x
    else:
        out = x.cast("string")
    return F.coalesce(out, F.lit("None"))


def kind_label(kind: T.DataType) -> str:
    """What Python type a value of this Spark type would have been: int, float, str, typed (bool, dates, ...)."""
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(kind, T.StringType):
        return "str"
    return "empty" if isinstance(kind, T.NullType) else "typed"


def guess_text(s: Column, check_dates: bool = True) -> Column:
    """int, float, date, empty or str of a text. Blank texts are ``empty`` only where dates are looked for."""
    out = F.when(s.rlike(INT_RE), F.lit("int")).when(s.rlike(FLOAT_RE), F.lit("float"))
    if check_dates:
        out = out.when(is_date(s), F.lit("date")).when(F.trim(F.regexp_replace(s, r"\s+", " ")) == "", F.lit("empty"))
    return out.otherwise(F.lit("str"))


def guess_type(x: Column, kind: T.DataType, check_dates: bool = True) -> Column:
    if not isinstance(kind, T.StringType):
        return F.when(x.isNull(), F.lit("empty")).otherwise(F.lit(kind_label(kind)))
    return F.when(x.isNull(), F.lit("empty")).otherwise(guess_text(x, check_dates))


def int_width(s: Column) -> Column:
    """Label of the least unsigned width for a text of digits."""
    n = F.when(s.rlike(INT_RE), s).cast("decimal(38,0)")
    return F.when(~s.rlike(INT_RE), F.lit(None)).when(n < 255, F.lit("uint8")).when(n < 65535, F.lit("uint16")).otherwise(F.lit("uint32"))


def safe_file_name(s: Column) -> Column:
    return F.replace(F.translate(s, "\\/?<>", "-----"), F.lit("\n"), F.lit(""))
