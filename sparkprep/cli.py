"""Command line: every command reads a file, runs one operator and prints or writes the result."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame

from .operators import reshape, schema, stats, values
from .operators import select as sel
from .operators.validate import validate
from .session import get_session
from .sources.detect import format_of
from .sources.readers import read
from .sources.writers import write


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sparkprep", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *extra: str, source: bool = True):
        c = sub.add_parser(name)
        if source:
            c.add_argument("input")
        if "output" in extra:
            c.add_argument("output", nargs="?" if "optional" in extra else None)
        c.add_argument("-f", "--fields")
        c.add_argument("-d", "--delimiter")
        c.add_argument("-e", "--encoding")
        c.add_argument("--format-in")
        c.add_argument("--format-out")
        c.add_argument("--filter")
        c.add_argument("--tagname")
        c.add_argument("--start-line", type=int, default=0)
        c.add_argument("--start-page", type=int)
        c.add_argument("-v", "--verbose", action="store_true")
        if "output" not in extra:
            c.add_argument("-o", "--output")
        return c

    for name in ("convert", "convertold"):
        c = command(name, "output")
        c.add_argument("--compression")
        c.add_argument("--flatten", action="store_true")
    for name in ("uniq", "frequency", "select", "flatten"):
        command(name)
    command("headers").add_argument("--limit", type=int, default=10_000)
    c = command("stats")
    c.add_argument("--dictshare", type=float, default=stats.DICT_SHARE)
    c.add_argument("--checkdates", action=argparse.BooleanOptionalAction, default=True)
    c = command("split")
    c.add_argument("--chunksize", type=int, default=10_000)
    c.add_argument("--dirname", default=".")
    c = command("validate")
    c.add_argument("--rule", required=True)
    c.add_argument("--mode", choices=("invalid", "all", "stats"), default="invalid")
    command("apply").add_argument("--script", required=True)
    command("scheme").add_argument("--stype", default="cerberus")
    c = command("analyze")
    c.add_argument("--outtype", choices=("text", "json", "yaml"), default="text")
    for name in ("schema", "schema_bulk"):
        c = command(name)
        c.add_argument("--outtype", choices=("text", "json", "yaml"), default="text")
        c.add_argument("--mode", choices=("distinct", "perfile"), default="distinct")
    c = command("ingest")
    c.add_argument("uri")
    c.add_argument("db")
    c.add_argument("table")
    c.add_argument("--batch", type=int, default=1000)
    c.add_argument("--dbtype", choices=("mongodb", "elastic", "local"), default="mongodb")
    c.add_argument("--totals", action="store_true")
    c.add_argument("--drop", action="store_true")
    c.add_argument("--skip", type=int, default=0)
    c.add_argument("--api-key")
    c.add_argument("--doc-id")
    command("query").add_argument("--query", required=True)
    return p


def _emit(df: DataFrame, a: argparse.Namespace) -> None:
    if a.output:
        write(df, a.output, a.format_out, delimiter=a.delimiter or ",")
        return
    sep = a.delimiter or "\t"
    print(sep.join(df.columns))
    for r in df.toLocalIterator():
        print(sep.join("" if v is None else str(v) for v in r))


def _text(x, kind: str) -> str:
    if kind == "json":
        return json.dumps(x, ensure_ascii=False, indent=2, default=str)
    return schema.to_yaml(json.loads(json.dumps(x, default=str)))


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = get_session()
    load = {"fmt": a.format_in, "delimiter": a.delimiter, "encoding": a.encoding, "tag": a.tagname, "page": a.start_page, "start_line": a.start_line}
    fmt = a.format_in or format_of(a.input)

    def source(**more) -> DataFrame:
        return read(spark, a.input, **{**load, **more})

    if a.command in ("convert", "convertold"):
        options = {k: v for k, v in load.items() if k != "fmt"}
        reshape.convert(spark, a.input, a.output, a.format_in, a.format_out, a.compression, a.flatten, a.fields, **options)
    elif a.command == "uniq":
        _emit(values.uniq(source(), a.fields, a.filter), a)
    elif a.command == "frequency":
        _emit(values.frequency(source(), a.fields, a.filter), a)
    elif a.command == "select":
        _emit(sel.select(source(), a.fields, a.filter), a)
    elif a.command == "flatten":
        _emit(reshape.flatten(source(), a.filter), a)
    elif a.command == "headers":
        dynamic = fmt == "jsonl"
        _emit(values.headers(source(dynamic=dynamic), a.limit, "value" if dynamic else None).select("key"), a)
    elif a.command == "stats":
        if fmt == "jsonl":
            _emit(stats.stats_records(source(dynamic=True), "value", a.dictshare, a.checkdates), a)
        else:
            _emit(stats.stats(source(), a.dictshare, a.checkdates), a)
    elif a.command == "split":
        reshape.split(source(), a.output or a.dirname, a.format_out or fmt, a.fields, a.chunksize, filter=a.filter)
    elif a.command == "validate":
        _emit(validate(source(), a.fields, a.rule, a.mode, a.filter), a)
    elif a.command == "apply":
        got = reshape.apply(source(), reshape.load_script(a.script), filter=a.filter, fields=a.fields)
        write(got, a.output, a.format_out) if a.output else print(*got.toJSON().toLocalIterator(), sep="\n")
    elif a.command == "scheme":
        dynamic = fmt == "jsonl"
        text = json.dumps(schema.scheme(source(dynamic=dynamic), raw="value" if dynamic else None), ensure_ascii=False, indent=2)
        _put(text, a.output)
    elif a.command == "analyze":
        options = {k: v for k, v in load.items() if v is not None and k != "start_line"}
        _put(_text(schema.analyze(spark, a.input, **options), a.outtype), a.output)
    elif a.command == "schema":
        rows = [r.asDict() for r in schema.describe(source(infer_types=True)).orderBy("pos").collect()]
        _put(_text(rows, a.outtype), a.output)
    elif a.command == "schema_bulk":
        _put(_text(schema.schema_bulk(spark, a.input, a.mode, a.output), a.outtype), None)
    elif a.command == "ingest":
        sink = {"mongodb": lambda: reshape.MongoSink(a.uri, a.db, a.table), "elastic": lambda: reshape.ElasticSink(a.uri, a.table, a.api_key, a.doc_id), "local": lambda: reshape.LocalJsonSink(a.uri)}[a.dbtype]()
        df = source()
        if a.totals:
            print(df.count(), file=sys.stderr)
        reshape.ingest(df, sink, a.batch, a.skip, drop=a.drop)
    elif a.command == "query":
        got = sel.query(source(), a.query, a.fields)
        write(got, a.output, a.format_out) if a.output else print(*(r[0] for r in got.toLocalIterator()), sep="\n")
    return 0


def _put(text: str, output: str | None) -> None:
    if output:
        with open(output, "w") as f:
            f.write(text + "\n")
    else:
        print(text)


if __name__ == "__main__":
    sys.exit(main())
