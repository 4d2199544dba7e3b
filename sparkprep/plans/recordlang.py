"""Record query language (a subset of MistQL), compiled to Columns.

    events | filter type == "click" | count
    name + "!"           turns[0].text           {who: role, n: (count words)}

``@`` is the value at hand; names are its fields.  ``a | f x`` passes ``a`` as f's last argument.  Functions that take an
expression (filter, map, find, sortby, groupby, mapvalues, filtervalues, apply) evaluate it with ``@`` bound to each
element.  Types are known from the schema, so everything becomes built-in expressions, higher-order functions included.

Supported functions: apply count entries filter filtervalues find flatten float fromentries groupby if index keys map
mapvalues match range regexmatch replace reverse sequence sort sortby split string stringjoin sum summarize values withindices,
any all. Not supported: reduce with a two-argument lambda, log, user-defined functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pystr import py_str
from .paths import quoted

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|"(?P<str>(?:[^"\\]|\\.)*)"|'(?P<sq>(?:[^'\\]|\\.)*)'|(?P<op>==|!=|<=|>=|=~|&&|\|\||[-+*/%<>!|@()\[\]{},:.?])|(?P<name>[^\W\d]\w*))""")


class QueryError(ValueError):
    pass


class Node(tuple):
    """(kind, ...): lit value | at | name n | get a n | call f args | op o a b | neg a | not a | index a i | slice a i j | list xs | dict kvs"""


def parse(text: str) -> Node:
    toks: list[tuple[str, str]] = []
    at, text = 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"can't read {text[at:at + 20]!r}")
        kind = m.lastgroup
        toks.append((kind if kind != "sq" else "str", m[kind]))
        at = m.end()
    toks.append(("end", ""))
    p = _Parser(toks)
    out = p.pipe()
    if p.toks[p.at][0] != "end":
        raise QueryError(f"unexpected {p.toks[p.at][1]!r}")
    return out


_LEVELS = [["||"], ["&&"], ["==", "!=", "=~"], ["<", "<=", ">", ">="], ["+", "-"], ["*", "/", "%"]]


class _Parser:
    def __init__(self, toks):
        self.toks, self.at = toks, 0

    def is_op(self, *ops) -> bool:
        return self.toks[self.at][0] == "op" and self.toks[self.at][1] in ops

    def take(self, *ops):
        if ops and not self.is_op(*ops):
            raise QueryError(f"expected {' or '.join(ops)}, found {self.toks[self.at][1]!r}")
        self.at += 1
        return self.toks[self.at - 1]

    def pipe(self) -> Node:
        out = self.call()
        while self.is_op("|"):
            self.take()
            right = self.call(piped=True)
            if right[0] == "name":
                right = Node(("call", right[1], []))
            if right[0] != "call":
                raise QueryError("a pipe leads into a function")
            out = Node(("call", right[1], [*right[2], out]))
        return out

    def call(self, piped=False) -> Node:
        kind, name = self.toks[self.at]
        if kind == "name" and name in FUNCTIONS and (piped or not (self.toks[self.at + 1][0] == "op" and self.toks[self.at + 1][1] == ".")):
            self.at += 1
            args = []
            while not (self.toks[self.at][0] == "end" or self.is_op("|", ")", "]", "}", ",", ":")):
                args.append(self.binary(0))
            return Node(("call", name, args)) if args or piped else Node(("name", name))
        return self.binary(0)

    def binary(self, level: int) -> Node:
        if level == len(_LEVELS):
            return self.unary()
        out = self.binary(level + 1)
        while self.is_op(*_LEVELS[level]):
            op = self.take()[1]
            out = Node(("op", op, out, self.binary(level + 1)))
        return out

    def unary(self) -> Node:
        if self.is_op("!"):
            self.take()
            return Node(("not", self.unary()))
        if self.is_op("-"):
            self.take()
            return Node(("neg", self.unary()))
        return self.suffix()

    def suffix(self) -> Node:
        out = self.atom()
        while True:
            if self.is_op("."):
                self.take()
                kind, name = self.take()
                if kind != "name":
                    raise QueryError("a name must follow the dot")
                out = Node(("get", out, name))
            elif self.is_op("[") and out[0] != "lit":
                self.take()
                a = None if self.is_op(":") else self.pipe()
                if self.is_op(":"):
                    self.take()
                    b = None if self.is_op("]") else self.pipe()
                    out = Node(("slice", out, a, b))
                else:
                    out = Node(("index", out, a))
                self.take("]")
            else:
                return out

    def atom(self) -> Node:
        kind, raw = self.take()
        if kind == "num":
            return Node(("lit", float(raw) if "." in raw else int(raw)))
        if kind == "str":
            return Node(("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), raw)))
        if kind == "name":
            if raw in ("true", "false", "null"):
                return Node(("lit", {"true": True, "false": False, "null": None}[raw]))
            return Node(("name", raw))
        if raw == "@":
            return Node(("at",))
        if raw == "(":
            out = self.pipe()
            self.take(")")
            return out
        if raw == "[":
            items = []
            while not self.is_op("]"):
                items.append(self.pipe())
                if not self.is_op("]"):
                    self.take(",")
            self.take()
            return Node(("list", items))
        if raw == "{":
            items = []
            while not self.is_op("}"):
                key = self.take()[1]
                self.take(":")
                items.append((key, self.pipe()))
                if not self.is_op("}"):
                    self.take(",")
            self.take()
            return Node(("dict", items))
        raise QueryError(f"unexpected {raw!r}")


class Value:
    """A Column with its Spark type."""

    def __init__(self, column: Column, kind: T.DataType):
        self.column, self.kind = column, kind


class Compiler:
    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.root = df.schema
        self.empty = None

    def kind_of(self, make: Callable[[Column], Column], at: T.DataType) -> T.DataType:
        """Type of an expression over a value of type ``at``; analysis only, no job."""
        frame = self.spark.createDataFrame([], T.StructType([T.StructField("__at", at)]))
        return frame.select(make(F.col("__at")).alias("x")).schema["x"].dataType

    def value(self, node: Node, at: Value) -> Value:
        column = self.build(node, at.column, at.kind)
        return Value(column, self.kind_of(lambda c: self.build(node, c, at.kind), at.kind))

    def build(self, node: Node, at: Column, kind: T.DataType) -> Column:
        what = node[0]
        here = Value(at, kind)
        if what == "lit":
            return F.lit(node[1])
        if what == "at":
            return at
        if what == "name":
            return self.field(here, node[1])
        if what == "get":
            return self.field(self.value(node[1], here), node[2])
        if what == "not":
            return ~self.truth(self.value(node[1], here))
        if what == "neg":
            return -self.build(node[1], at, kind)
        if what == "list":
            return F.array(*[self.build(x, at, kind) for x in node[1]])
        if what == "dict":
            return F.struct(*[self.build(x, at, kind).alias(k) for k, x in node[1]])
        if what == "index":
            x, i = self.value(node[1], here), node[2]
            if i[0] == "lit" and isinstance(i[1], str) or isinstance(x.kind, (T.StructType, T.MapType)):
                return self.field(x, i[1])
            n = self.build(i, at, kind).cast("int")
            if isinstance(x.kind, T.StringType):
                n = F.when(n < 0, F.char_length(x.column) + n).otherwise(n)
                return F.substring(x.column, n + 1, F.lit(1))
            return F.try_element_at(x.column, F.when(n < 0, n).otherwise(n + 1))
        if what == "slice":
            x = self.value(node[1], here)
            size = F.char_length(x.column) if isinstance(x.kind, T.StringType) else F.size(x.column)
            a = F.lit(0) if node[2] is None else self.build(node[2], at, kind).cast("int")
            b = size if node[3] is None else self.build(node[3], at, kind).cast("int")
            a, b = (F.greatest(F.lit(0), F.least(size, F.when(v < 0, size + v).otherwise(v))) for v in (a, b))
            n = F.greatest(F.lit(0), b - a)
            return F.substring(x.column, a + 1, n) if isinstance(x.kind, T.StringType) else F.slice(x.column, a + 1, n)
        if what == "op":
            return self.operator(node[1], self.value(node[2], here), self.value(node[3], here))
        if what == "call":
            if node[1] not in FUNCTIONS:
                raise QueryError(f"no function {node[1]!r}")
            return FUNCTIONS[node[1]](self, node[2], here)
        raise QueryError(what)

    def field(self, x: Value, name: str) -> Column:
        if isinstance(x.kind, T.StructType):
            if name not in x.kind.names:
                return F.lit(None).cast("string")
            return x.column.getField(name) if x.column is not None else F.col(quoted(name))
        if isinstance(x.kind, T.MapType):
            return F.try_element_at(x.column, F.lit(name))
        return F.lit(None).cast("string")

    def operator(self, op: str, a: Value, b: Value) -> Column:
        x, y = a.column, b.column
        if op in ("&&", "||"):
            p, q = self.truth(a), self.truth(b)
            return p & q if op == "&&" else p | q
        if op == "=~":
            return F.regexp_like(x.cast("string"), y)
        if op == "+" and isinstance(a.kind, (T.StringType, T.ArrayType)):
            return F.concat(x, y)
        if op in ("==", "!="):
            same = F.coalesce(x.eqNullSafe(y), F.lit(False)) if self.comparable(a.kind, b.kind) else F.lit(False)
            return same if op == "==" else ~same
        if op == "%":
            return F.try_mod(x, y)
        if op == "/":
            return F.try_divide(x.cast("double"), y)
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op]()

    @staticmethod
    def comparable(a: T.DataType, b: T.DataType) -> bool:
        if isinstance(a, T.NullType) or isinstance(b, T.NullType):
            return True
        return isinstance(a, T.NumericType) == isinstance(b, T.NumericType) and isinstance(a, T.BooleanType) == isinstance(b, T.BooleanType)

    @staticmethod
    def truth(x: Value) -> Column:
        c, k = x.column, x.kind
        test = c if isinstance(k, T.BooleanType) else c != 0 if isinstance(k, T.NumericType) else c != "" if isinstance(k, T.StringType) else F.size(c) > 0 if isinstance(k, (T.ArrayType, T.MapType)) else F.lit(False) if isinstance(k, T.NullType) else c.isNotNull()
        return F.coalesce(test, F.lit(False))


def _args(n: int):
    def wrap(f):
        def call(c: Compiler, args: list[Node], at: Value) -> Column:
            if len(args) != n:
                raise QueryError(f"{f.__name__} takes {n} arguments, not {len(args)}")
            return f(c, *args, at)

        return call

    return wrap


def _plain(n: int, make: Callable[..., Column]):
    """A function of plain values."""

    def call(c: Compiler, args: list[Node], at: Value) -> Column:
        if len(args) != n:
            raise QueryError(f"expected {n} arguments, got {len(args)}")
        return make(*[c.value(a, at) for a in args])

    return call


def _each(make: Callable[[Column, Callable[[Column], Value]], Column]):
    """A function of an expression and an array: the expression sees each element as @."""

    def call(c: Compiler, args: list[Node], at: Value) -> Column:
        if len(args) != 2:
            raise QueryError("expected an expression and a list")
        x = c.value(args[1], at)
        if not isinstance(x.kind, T.ArrayType):
            raise QueryError("expected a list")
        kind = x.kind.elementType
        result = c.kind_of(lambda v: c.build(args[0], v, kind), kind)
        return make(x.column, lambda v: Value(c.build(args[0], v, kind), result))

    return call


def _entries(make: Callable[[Column, Callable[[Column], Value]], Column]):
    """A function of an expression and a map or record: the expression sees each value as @."""

    def call(c: Compiler, args: list[Node], at: Value) -> Column:
        x = c.value(args[1], at)
        m = _as_map(x)
        kind = c.kind_of(lambda v: F.map_values(_as_map(Value(v, x.kind)))[0], x.kind)
        result = c.kind_of(lambda v: c.build(args[0], v, kind), kind)
        return make(m, lambda v: Value(c.build(args[0], v, kind), result))

    return call


def _as_map(x: Value) -> Column:
    if isinstance(x.kind, T.MapType):
        return x.column
    if isinstance(x.kind, T.StructType):
        pick = (lambda n: x.column.getField(n)) if x.column is not None else (lambda n: F.col(quoted(n)))
        return F.create_map(*[y for n in x.kind.names for y in (F.lit(n), pick(n))])
    raise QueryError("expected a record")


def _count(x: Value) -> Column:
    return (F.char_length(x.column) if isinstance(x.kind, T.StringType) else F.size(x.column)).cast("long")


def _sum(x: Value) -> Column:
    zero = F.lit(0.0) if isinstance(x.kind, T.ArrayType) and isinstance(x.kind.elementType, (T.DoubleType, T.FloatType)) else F.lit(0).cast("long")
    return F.aggregate(x.column, zero, lambda a, v: a + F.coalesce(v.cast("double") if isinstance(x.kind.elementType, (T.DoubleType, T.FloatType)) else v.cast("long"), zero))


def _sort_by(x, key):
    pairs = F.transform(x, lambda v: F.struct(key(v).column.alias("k"), v.alias("v")))
    return F.transform(F.array_sort(pairs, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)), lambda p: p["v"])


def _group_by(x, key):
    keys = F.array_distinct(F.transform(x, lambda v: key(v).column.cast("string")))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(x, lambda v: key(v).column.cast("string").eqNullSafe(k))))


def _summarize(x: Value) -> Column:
    d = F.transform(F.filter(x.column, lambda v: v.isNotNull()), lambda v: v.cast("double"))
    n = F.size(d)
    mean = F.try_divide(F.aggregate(d, F.lit(0.0), lambda a, v: a + v), n)
    s = F.array_sort(d)
    median = F.when(n % 2 == 1, F.get(s, F.floor(n / 2).cast("int"))).otherwise((F.get(s, F.floor(n / 2).cast("int") - 1) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
    variance = F.try_divide(F.aggregate(d, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)), n)
    return F.struct(F.array_max(d).alias("max"), F.array_min(d).alias("min"), mean.alias("mean"), median.alias("median"), variance.alias("variance"), F.sqrt(variance).alias("stddev"))


def _range(c: Compiler, args: list[Node], at: Value) -> Column:
    xs = [c.build(a, at.column, at.kind).cast("long") for a in args]
    start, stop, step = (F.lit(0).cast("long"), xs[0], F.lit(1).cast("long")) if len(xs) == 1 else (xs[0], xs[1], xs[2] if len(xs) > 2 else F.lit(1).cast("long"))
    return F.when((stop - start) * step > 0, F.sequence(start, stop - F.when(step > 0, F.lit(1)).otherwise(F.lit(-1)), step)).otherwise(F.array().cast("array<bigint>"))


def _if(c: Compiler, args: list[Node], at: Value) -> Column:
    if len(args) != 3:
        raise QueryError("if takes a test and two values")
    return F.when(c.truth(c.value(args[0], at)), c.build(args[1], at.column, at.kind)).otherwise(c.build(args[2], at.column, at.kind))


def _apply(c: Compiler, args: list[Node], at: Value) -> Column:
    x = c.value(args[1], at)
    return c.build(args[0], x.column, x.kind)


FUNCTIONS: dict[str, Callable[[Compiler, list[Node], Value], Column]] = {
    "apply": _apply,
    "all": _each(lambda x, f: F.forall(x, lambda v: Compiler.truth(f(v)))),
    "any": _each(lambda x, f: F.exists(x, lambda v: Compiler.truth(f(v)))),
    "count": _plain(1, _count),
    "entries": _plain(1, lambda x: F.map_entries(_as_map(x))),
    "filter": _each(lambda x, f: F.filter(x, lambda v: Compiler.truth(f(v)))),
    "filtervalues": _entries(lambda m, f: F.map_filter(m, lambda k, v: Compiler.truth(f(v)))),
    "find": _each(lambda x, f: F.get(F.filter(x, lambda v: Compiler.truth(f(v))), 0)),
    "flatten": _plain(1, lambda x: F.flatten(x.column)),
    "float": _plain(1, lambda x: x.column.try_cast("double")),
    "fromentries": _plain(1, lambda x: F.map_from_entries(x.column)),
    "groupby": _each(_group_by),
    "if": _if,
    "index": _plain(2, lambda i, x: F.try_element_at(x.column, F.when(i.column < 0, i.column.cast("int")).otherwise(i.column.cast("int") + 1))),
    "keys": _plain(1, lambda x: F.map_keys(_as_map(x))),
    "map": _each(lambda x, f: F.transform(x, lambda v: f(v).column)),
    "mapvalues": _entries(lambda m, f: F.transform_values(m, lambda k, v: f(v).column)),
    "match": _plain(2, lambda p, x: F.regexp_like(x.column, p.column)),
    "regexmatch": _plain(2, lambda p, x: F.regexp_like(x.column, p.column)),
    "range": _range,
    "replace": _plain(3, lambda p, r, x: F.regexp_replace(x.column, p.column, r.column)),
    "reverse": _plain(1, lambda x: F.reverse(x.column)),
    "sequence": _range,
    "sort": _plain(1, lambda x: F.array_sort(x.column)),
    "sortby": _each(_sort_by),
    "split": _plain(2, lambda s, x: F.split(x.column, F.concat(F.lit("\\Q"), s.column, F.lit("\\E")))),
    "string": _plain(1, lambda x: py_str(x.column, x.kind) if not isinstance(x.kind, (T.ArrayType, T.StructType, T.MapType)) else F.to_json(x.column)),
    "stringjoin": _plain(2, lambda s, x: F.concat_ws("", F.aggregate(x.column, F.lit(None).cast("string"), lambda a, v: F.when(a.isNull(), v.cast("string")).otherwise(F.concat(a, s.column, v.cast("string")))))),
    "sum": _plain(1, _sum),
    "summarize": _plain(1, _summarize),
    "values": _plain(1, lambda x: F.map_values(_as_map(x))),
    "withindices": _plain(1, lambda x: F.transform(x.column, lambda v, i: F.struct(i.alias("index"), v.alias("value")))),
}


def compile_query(df: DataFrame, text: str) -> tuple[Column, T.DataType]:
    """The expression over ``df``'s rows and its type."""
    node = parse(text)
    c = Compiler(df)
    whole = F.struct(*[F.col(quoted(n)) for n in df.columns])
    column = c.build(node, whole, df.schema)
    return column, df.select(column.alias("x")).schema["x"].dataType


def truthy(x: Column, kind: T.DataType) -> Column:
    return Compiler.truth(Value(x, kind))
