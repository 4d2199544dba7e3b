"""Filter language over records, compiled to one boolean Column.

    `o_orderstatus` == 'F' and `o_totalprice` > 100000
    name LIKE 'a*' OR tags CONTAINS 'x' AND NOT (id IN (1, 2, 3))

Keys are bare or in backticks and may be dotted; a key that fans out over a list is true if any of its values is.
Literals: numbers, 'text' or "text", TRUE, FALSE, NONE, NOW, /regex/.  Operators, loosest first: OR; AND; NOT;
== = != <> < <= > >= IN, CONTAINS, LIKE (* and ?), MATCH (anchored at the start).  A key alone is a test for a value
that is neither missing, null, false, zero nor empty.  Comparisons with a missing value are false. Texts compare as
numbers where the other side is a number. Plain comparisons stay plain, so they reach the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import PathError, values


class FilterError(ValueError):
    pass


_TOKEN = re.compile(
    r"""\s*(?:
    (?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])
  | '(?P<sq>(?:[^'\\]|\\.)*)' | "(?P<dq>(?:[^"\\]|\\.)*)"
  | `(?P<key>[^`]+)`
  | (?P<op>==|!=|<>|<=|>=|=|<|>|\(|\)|\[|\]|,)
  | /(?P<re>(?:[^/\\]|\\.)*)/
  | (?P<word>[^\W\d][\w]*(?:\.\w+)*)
  )""",
    re.X,
)
_WORDS = {"AND", "OR", "NOT", "IN", "CONTAINS", "LIKE", "MATCH", "TRUE", "FALSE", "NONE", "NULL", "NOW"}


@dataclass
class Tok:
    kind: str
    value: object


def tokens(text: str) -> list[Tok]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"can't read {text[at:at + 20]!r} at {at}")
        kind, raw = m.lastgroup, m[m.lastgroup]
        if kind == "num":
            out.append(Tok("lit", float(raw) if re.search("[.eE]", raw) else int(raw)))
        elif kind in ("sq", "dq"):
            out.append(Tok("lit", re.sub(r"\\(.)", r"\1", raw)))
        elif kind == "re":
            out.append(Tok("re", raw.replace("\\/", "/")))
        elif kind == "word" and raw.upper() in _WORDS:
            out.append(Tok("word", raw.upper()))
        elif kind == "op":
            out.append(Tok("op", raw))
        else:
            out.append(Tok("key", raw))
        at = m.end()
    return [*out, Tok("end", None)]


def glob_regex(glob: str) -> str:
    return "^(?s)" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


class _Parser:
    def __init__(self, df: DataFrame, text: str):
        self.df, self.toks, self.at = df, tokens(text), 0

    def peek(self, *want) -> bool:
        t = self.toks[self.at]
        return t.kind in ("word", "op") and t.value in want

    def take(self) -> Tok:
        self.at += 1
        return self.toks[self.at - 1]

    def expect(self, what: str) -> None:
        if not self.peek(what):
            raise FilterError(f"expected {what!r}, found {self.toks[self.at].value!r}")
        self.at += 1

    def parse(self) -> Column:
        out = self.either()
        if self.toks[self.at].kind != "end":
            raise FilterError(f"unexpected {self.toks[self.at].value!r}")
        return out

    def either(self) -> Column:
        out = self.both()
        while self.peek("OR"):
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.negation()
        while self.peek("AND"):
            self.take()
            out = out & self.negation()
        return out

    def negation(self) -> Column:
        if self.peek("NOT"):
            self.take()
            return ~F.coalesce(self.negation(), F.lit(False))
        return self.test()

    def test(self) -> Column:
        if self.peek("("):
            self.take()
            out = self.either()
            self.expect(")")
            return out
        left = self.operand()
        if self.peek("NOT"):  # x NOT IN ...
            self.take()
            return ~F.coalesce(self.relation(left), F.lit(False))
        return self.relation(left)

    def relation(self, left) -> Column:
        t = self.toks[self.at]
        if t.kind == "op" and t.value in ("==", "=", "!=", "<>", "<", "<=", ">", ">="):
            self.take()
            return self.any_pair(left, self.operand(), _compare(t.value))
        if self.peek("IN"):
            self.take()
            return self.contains(self.operand(), left)
        if self.peek("CONTAINS"):
            self.take()
            return self.contains(left, self.operand())
        if self.peek("LIKE", "MATCH"):
            word, right = self.take().value, self.take()
            if right.kind not in ("lit", "re"):
                raise FilterError(f"{word} needs a text or /regex/")
            pattern = glob_regex(str(right.value)) if word == "LIKE" and right.kind == "lit" else f"^(?:{right.value})"
            return self.any_one(left, lambda x, k: x.cast("string").rlike(pattern))
        if isinstance(left, _Lit):
            return F.lit(bool(left.value))
        return self.any_one(left, _truth)

    def operand(self):
        t = self.take()
        if t.kind == "key":
            return _Key(self.df, str(t.value))
        if t.kind in ("lit", "re"):
            return _Lit(t.value)
        if t.kind == "word" and t.value in ("TRUE", "FALSE", "NONE", "NULL"):
            return _Lit({"TRUE": True, "FALSE": False}.get(t.value))
        if t.kind == "word" and t.value == "NOW":
            return _Now()
        if t.kind == "op" and t.value in ("(", "["):
            out, close = [], ")" if t.value == "(" else "]"
            while not self.peek(close):
                x = self.operand()
                if not isinstance(x, _Lit):
                    raise FilterError("a list holds literals only")
                out.append(x.value)
                if self.peek(","):
                    self.take()
            self.take()
            return _List(out)
        raise FilterError(f"unexpected {t.value!r}")

    def any_one(self, key, test) -> Column:
        if not isinstance(key, _Key):
            raise FilterError("the left side must be a key")
        v = key.values
        if v is None:
            return F.lit(False)
        return test(v.scalar, v.kind) if v.scalar is not None else F.exists(v.column, lambda x: F.coalesce(test(x, v.kind), F.lit(False)))

    def any_pair(self, a, b, test) -> Column:
        if isinstance(a, _Key) and isinstance(b, _Key):
            return self.any_one(a, lambda x, kx: self.any_one(b, lambda y, ky: test(x, kx, y, ky)))
        if isinstance(a, _Key):
            return self.any_one(a, lambda x, k: test(x, k, b.column(), b.kind))
        if isinstance(b, _Key):
            return self.any_one(b, lambda y, k: test(a.column(), a.kind, y, k))
        return test(a.column(), a.kind, b.column(), b.kind)

    def contains(self, whole, part) -> Column:
        if isinstance(whole, _List):
            return self.any_one(part, lambda x, k: _is_in(x, k, whole.values))
        if not isinstance(part, _Lit):
            raise FilterError("CONTAINS and IN need a literal on one side")

        def test(x, kind):
            if isinstance(kind, T.ArrayType):
                return F.exists(x, lambda e: F.coalesce(_compare("==")(e, kind.elementType, part.column(), part.kind), F.lit(False)))
            if isinstance(kind, T.MapType):
                return F.map_contains_key(x, part.value)
            return F.contains(x.cast("string"), F.lit(str(part.value)))

        return self.any_one(whole, test)


class _Key:
    def __init__(self, df: DataFrame, path: str):
        try:
            self.values = values(df, path)
        except PathError:
            self.values = None  # a key that no record has: every test of it is false


class _Lit:
    def __init__(self, value):
        self.value = value
        kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
        self.kind = kinds.get(type(value), T.NullType())

    def column(self) -> Column:
        return F.lit(self.value)


class _Now:
    kind = T.TimestampType()

    def column(self) -> Column:
        return F.current_timestamp()


class _List:
    def __init__(self, found: list):
        self.values = found


def _compare(op: str):
    def test(x, kx, y, ky):
        if isinstance(ky, T.NullType) or isinstance(kx, T.NullType):
            other = x if isinstance(ky, T.NullType) else y
            return other.isNull() if op in ("==", "=") else other.isNotNull() if op in ("!=", "<>") else F.lit(False)
        if isinstance(kx, T.StringType) and isinstance(ky, T.NumericType):
            x = x.try_cast("double")
        elif isinstance(ky, T.StringType) and isinstance(kx, T.NumericType):
            y = y.try_cast("double")
        elif isinstance(kx, T.BooleanType) and isinstance(ky, T.NumericType):
            x = x.cast("int")
        elif isinstance(kx, (T.TimestampType, T.TimestampNTZType, T.DateType)) and isinstance(ky, T.StringType):
            y = y.try_cast(kx)
        return {"==": x == y, "=": x == y, "!=": x != y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    return test


def _is_in(x, kind, found: list) -> Column:
    texts = [v for v in found if isinstance(v, str)]
    numbers = [v for v in found if isinstance(v, (int, float)) and not isinstance(v, bool)]
    out = F.lit(False)
    if isinstance(kind, T.StringType):
        out = x.isin(texts) if texts else out
        return out | x.try_cast("double").isin(numbers) if numbers else out
    if isinstance(kind, T.BooleanType):
        return x.isin([v for v in found if isinstance(v, bool)] or [None])
    if isinstance(kind, T.NumericType):
        return x.isin(numbers) if numbers else out
    return x.cast("string").isin([str(v) for v in found])


def _truth(x, kind) -> Column:
    if isinstance(kind, T.BooleanType):
        return x
    if isinstance(kind, T.NumericType):
        return x != 0
    if isinstance(kind, T.StringType):
        return x != ""
    return F.size(x) > 0 if isinstance(kind, (T.ArrayType, T.MapType)) else x.isNotNull()


def compile_filter(df: DataFrame, text: str) -> Column:
    return _Parser(df, text).parse()


def apply_filter(df: DataFrame, text: str | None) -> DataFrame:
    return df.filter(compile_filter(df, text)) if text and text.strip() else df
