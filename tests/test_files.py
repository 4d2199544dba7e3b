import bz2
import gzip
import io
import json
import lzma
import zipfile

import pytest

from sparkprep.operators import reshape, schema
from sparkprep.sources import avro, bson, detect, office, read, write
from sparkprep.sources.archives import UnsupportedCodec
from sparkprep.sources.readers import UnsupportedFormat

ROWS = [("1", "John"), ("2", "Mary, \"M\""), ("3", "Иван\nдва"), ("4", None)]


@pytest.fixture()
def table(spark):
    return spark.createDataFrame(ROWS, "id string, name string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("fmt", ["jsonl", "parquet", "orc", "bson", "avro", "xlsx", "xml"])
def test_round_trips(spark, table, tmp_path, fmt):
    path = str(tmp_path / f"t.{fmt}")
    write(table.filter("name is not null") if fmt == "xml" else table, path, fmt)
    got = read(spark, path + "/part-*" if fmt in ("bson", "avro") else path, fmt, tag="row" if fmt == "xml" else None)
    want = [tuple(str(x) if x is not None else None for x in r) for r in ROWS if fmt != "xml" or r[1]]
    assert sorted((r["id"] if isinstance(r["id"], str) else str(r["id"]), r["name"]) for r in got.collect()) == sorted(want, key=str) or rows(got) == sorted(want, key=str)


def test_csv_keeps_quotes_and_lines(spark, table, tmp_path):
    path = str(tmp_path / "t.csv")
    write(table, path)
    got = read(spark, path, delimiter=",", encoding="utf-8")
    assert {tuple(r) for r in got.collect()} == {(a, b) for a, b in ROWS}


def test_brotli_parquet(table, tmp_path):
    import pyarrow.parquet as pq

    write(table, str(tmp_path / "t"), "parquet", compression="brotli")
    assert sorted(x["id"] for f in (tmp_path / "t").glob("*.parquet") for x in pq.read_table(f).to_pylist()) == ["1", "2", "3", "4"]


@pytest.mark.parametrize("codec", ["gz", "bz2", "xz", "zip", "zst"])
@pytest.mark.parametrize("fmt", ["csv", "jsonl"])
def test_compressed_inputs(spark, tmp_path, codec, fmt):
    raw = "id;name\n1;a\n2;ж\n".encode() if fmt == "csv" else b'{"id": "1", "name": "a"}\n{"id": "2", "name": "\xd0\xb6"}\n'
    path = tmp_path / f"x.{fmt}.{codec}"
    if codec == "zip":
        with zipfile.ZipFile(path, "w") as z:
            z.writestr(f"x.{fmt}", raw)
    elif codec == "zst":
        import zstandard

        path.write_bytes(zstandard.compress(raw))
    else:
        path.write_bytes({"gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress}[codec](raw))
    assert rows(read(spark, str(path))) == [("1", "a"), ("2", "ж")]


def test_detection(tmp_path):
    assert [detect.format_of(x) for x in ("a.csv", "b.jsonl.gz", "c.ndjson", "d.bin", "e.XML")] == ["csv", "jsonl", "jsonl", None, "xml"]
    assert detect.delimiter_of("a;b;c,d") == ";" and detect.delimiter_of("ab") == ","
    assert detect.encoding_of("Привет мир".encode("cp1251")) == "cp1251"
    assert detect.encoding_of("Привет".encode()) == "utf-8" and detect.encoding_of("﻿a".encode()) == "utf-8"
    assert detect.encoding_of("déjà".encode("latin-1")) == "latin-1"


def test_crlf_and_tabs(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("a\tb\r\r\n1\tx\r\r\n2\r\r\n".encode())
    df = read(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["a", "b"] and rows(df) == [("1", "x"), ("2", None)]


def test_json_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"meta": {"n": 1}, "people": [{"id": 1}, {"id": 2}]}))
    assert rows(read(spark, str(tmp_path / "d.json"), tag="people")) == [(1,), (2,)]
    report = schema.analyze(spark, str(tmp_path / "d.json"))
    assert report["success"] and [(t["id"], t["num_records"]) for t in report["tables"]] == [("people", 2)]


def test_xml(spark, tmp_path):
    (tmp_path / "b.xml").write_text('<s><book category="web"><title lang="en">Q</title><author>A</author><author>B</author></book><book category="x"><title lang="de">R</title><author>C</author></book></s>')
    df = read(spark, str(tmp_path / "b.xml"), tag="book")
    assert {r["@category"]: (r["title"]["#text"], r["title"]["@lang"], r["author"]) for r in df.collect()} == {"web": ("Q", "en", ["A", "B"]), "x": ("R", "de", ["C"])}
    assert schema.repeated_tag((tmp_path / "b.xml").read_bytes()) == "book"


def test_bson_values():
    import datetime as dt

    record = {"i": 5, "l": 2**40, "f": 1.5, "s": "ж", "n": None, "b": True, "a": [1, {"x": 2}], "d": {"k": "v"}, "t": dt.datetime(2020, 1, 2, tzinfo=dt.timezone.utc), "y": b"\x00\x01"}
    assert list(bson.documents(io.BytesIO(bson.encode(record) * 2))) == [record, record]
    with pytest.raises(ValueError):
        list(bson.documents(io.BytesIO(bson.encode(record)[:-3])))


def test_avro_and_docx():
    f = io.BytesIO()
    avro.write_texts(f, ["a", "b"], [("1", None), ("ж", "2")], block=1)
    f.seek(0)
    assert list(avro.records(f)) == [{"a": "1", "b": None}, {"a": "ж", "b": "2"}]
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t, p="": f"<w:tc>{p and f'<w:tcPr>{p}</w:tcPr>'}<w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f'<w:document xmlns:w="{w}"><w:body><w:tbl><w:tr>{cell("a")}{cell("b")}</w:tr><w:tr>{cell("x", "<w:vMerge w:val=\'restart\'/>")}{cell("1")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("2")}</w:tr><w:tr>{cell("wide", "<w:gridSpan w:val=\'2\'/>")}</w:tr></w:tbl></w:body></w:document>'
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("word/document.xml", body)
    assert office.docx_tables(f) == [[["a", "b"], ["x", "1"], ["x", "2"], ["wide", "wide"]]]
    assert office.docx_records(f)[1] == {"a": "x", "b": "2"}


def test_errors(spark, tmp_path):
    with pytest.raises(UnsupportedFormat):
        read(spark, "x.bin")
    with pytest.raises(UnsupportedCodec):
        read(spark, "x.csv.7z")
    assert schema.analyze(spark, str(tmp_path / "none.bin"))["success"] is False


def test_schema_bulk_and_describe(spark, tmp_path):
    for name, text in (("a.csv", "x,y\n1,2\n"), ("b.csv", "y,x\n1,2\n"), ("c.csv", "x,z\n1,2\n")):
        (tmp_path / name).write_text(text)
    found = schema.schema_bulk(spark, str(tmp_path), output=str(tmp_path / "out"))
    assert sorted(len(s["files"]) for s in found) == [1, 2] and len(list((tmp_path / "out").glob("*.yaml"))) == 2
    assert len(schema.schema_bulk(spark, str(tmp_path / "*.csv"), mode="perfile")) == 3
    df = spark.createDataFrame([(1, (2, (3,)), [(4,)])], "id int, s struct<x:int,y:struct<z:int>>, items array<struct<k:int>>")
    assert [r.name for r in schema.describe(df).orderBy("pos").collect()] == ["id", "s", "s.x", "s.y", "s.y.z", "items", "items.k"]
    assert [r.name for r in schema.describe(df, "collapsed").orderBy("pos").collect()] == ["id", "s", "s.x", "s.z", "items", "items.k"]
    assert [r.n_unique for r in schema.summarize(df, exact=True).orderBy("pos").collect()] == [1] * 7
    assert not schema.is_flat(df)


def test_scheme():
    a = schema.record_scheme({"a": 1, "b": None, "c": {"d": 1.5}, "e": [{"f": True}, {"g": "x"}], "h": []})
    b = schema.merge_schemes(a, schema.record_scheme({"a": "x", "c": {"k": 1}}))
    assert b["a"] == {"type": "integer"} and list(b["c"]["schema"]) == ["d", "k"] and list(b["e"]["schema"]) == ["f", "g"] and b["h"]["subtype"] == "string"


def test_split_apply_ingest_convert(spark, tmp_path):
    df = spark.range(1, 2502).selectExpr("id", "concat('g', id % 3) as g")
    chunks = {r.chunk: r["count"] for r in reshape.with_chunks(df, 1000, ["id"]).groupBy("chunk").count().collect()}
    assert chunks == {1: 1000, 2: 1000, 3: 501}
    reshape.split(df, str(tmp_path / "s"), fields="g", filter="id < 10")
    assert sorted(p.name for p in (tmp_path / "s").glob("part=*")) == ["part=g0", "part=g1", "part=g2"]
    (tmp_path / "p.py").write_text("def process(item):\n    if item['id'] % 2:\n        return None\n    item['twice'] = [item['id']] * 2\n    del item['g']\n    return item\n")
    got = reshape.apply(df, reshape.load_script(str(tmp_path / "p.py")))
    assert got.columns == ["id", "twice"] and got.count() == 1250 and got.filter("id = 4").first().twice == [4, 4]
    sink = reshape.LocalJsonSink(str(tmp_path / "sink"))
    reshape.ingest(df, sink, batch=100, skip=1001, order=["id"])
    reshape.ingest(df, sink, batch=100, skip=2501, order=["id"], drop=False)
    assert spark.read.json(str(tmp_path / "sink")).count() == 1500
    (tmp_path / "n.jsonl").write_text('{"a": {"b": 1}, "c": [{"d": 2}, {"d": 3}]}\n')
    reshape.convert(spark, str(tmp_path / "n.jsonl"), str(tmp_path / "n.csv"))
    assert read(spark, str(tmp_path / "n.csv"), delimiter=",", encoding="utf-8").first().asDict() == {"a.b": "1", "c.d": "[2,3]"}


def test_command_line(spark, tmp_path, capsys):
    from sparkprep.cli import main

    (tmp_path / "t.csv").write_text("id,kind\n1,a\n2,b\n3,a\n")
    path = str(tmp_path / "t.csv")
    assert main(["frequency", path, "-f", "kind"]) == 0
    assert capsys.readouterr().out.splitlines()[-3:] == ["kind\tcount", "b\t1", "a\t2"]
    main(["select", path, "-f", "id", "--filter", "`kind` == 'a'"])
    assert capsys.readouterr().out.splitlines()[-3:] == ["id", "1", "3"]
    main(["convert", path, str(tmp_path / "o.jsonl")])
    assert spark.read.json(str(tmp_path / "o.jsonl")).count() == 3
    main(["headers", path])
    main(["stats", path])
    main(["schema", path])
    main(["analyze", path, "--outtype", "json"])
    main(["query", path, "--query", "kind"])
    main(["validate", path, "-f", "id", "--rule", "ru.org.inn", "--mode", "stats"])
    assert '"num_records": 3' in capsys.readouterr().out


def test_schema_of_all_records_of_all_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    many = [{"n": k} for k in range(1500)] + [{"n": 1.5, "late": "x", "deep": {"a": 1}}]
    (tmp_path / "d" / "a.bson").write_bytes(b"".join(map(bson.encode, many)))
    (tmp_path / "d" / "b.bson").write_bytes(bson.encode({"n": 7, "other": True, "deep": {"b": [2]}}))
    got = read(spark, str(tmp_path / "d"), "bson")
    assert got.columns == ["n", "late", "deep", "other"] and got.count() == 1502
    assert sorted(r.n for r in got.collect()) == sorted([*map(float, range(1500)), 1.5, 7.0])
    assert [r.asDict(True) for r in got.filter("deep is not null").orderBy("n").collect()] == [{"n": 1.5, "late": "x", "deep": {"a": 1, "b": None}, "other": None}, {"n": 7.0, "late": None, "deep": {"a": None, "b": [2]}, "other": True}]
    with pytest.raises(Exception, match="doesn't fit bigint"):
        read(spark, str(tmp_path / "d"), "bson", schema="n long").collect()


def test_avro_says_its_schema(spark, tmp_path):
    def container(fields, raw):
        kind = json.dumps({"type": "record", "name": "R", "fields": fields}).encode()
        sync = bytes(16)
        return avro.MAGIC + avro._put_long(1) + avro._put(b"avro.schema") + avro._put(kind) + b"\x00" + sync + avro._put_long(1) + avro._put(raw) + sync

    (tmp_path / "a.avro").write_bytes(container([{"name": "n", "type": ["null", "long"]}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["x", "y"]}}, {"name": "f", "type": "E"}], b"\x00\x02\x00"))
    (tmp_path / "b.avro").write_bytes(container([{"name": "n", "type": "double"}, {"name": "m", "type": {"type": "map", "values": "int"}}], bytes(8) + b"\x02" + avro._put(b"k") + b"\x0a\x00"))
    assert read(spark, str(tmp_path / "a.avro")).dtypes == [("n", "bigint"), ("e", "string"), ("f", "string")]
    both = read(spark, str(tmp_path / "*.avro"), "avro")
    assert both.dtypes == [("n", "double"), ("e", "string"), ("f", "string"), ("m", "struct<k:bigint>")]
    assert sorted(map(tuple, both.collect()), key=repr) == [(0.0, None, None, (5,)), (None, "y", "x", None)]


def test_apply_learns_from_all_rows(spark):
    got = reshape.apply(spark.range(3000).coalesce(1), lambda r: {"id": r["id"]} if r["id"] < 2000 else {"id": r["id"] + 0.5, "late": [r["id"]]})
    assert got.dtypes == [("id", "double"), ("late", "array<bigint>")] and got.filter("late[0] = id - 0.5").count() == 1000


def test_bson_files_are_read_in_parts(spark, tmp_path):
    raw = b"".join(bson.encode({"n": k, "s": "ж" * (k % 7), "x": float("nan") if k == 5 else k / 2, "deep": {"k": [k]} if k % 3 else None}) for k in range(2000)) + bson.encode({"late": True})
    (tmp_path / "a.bson").write_bytes(raw)
    (tmp_path / "b.bson.gz").write_bytes(gzip.compress(raw))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for schema_ in (None, "n long, s string, x double, deep struct<k:array<bigint>>, late boolean"):
            got = read(spark, str(tmp_path / "a.bson"), schema=schema_)
            assert got.rdd.getNumPartitions() > 4 and got.columns == ["n", "s", "x", "deep", "late"]
            assert [r.n for r in got.orderBy("n").collect()] == [None, *range(2000)]
            assert got.filter("isnan(x)").first().n == 5 and got.filter("n = 8").first().asDict(True) == {"n": 8, "s": "ж", "x": 4.0, "deep": {"k": [8]}, "late": None}
            assert read(spark, str(tmp_path / "b.bson.gz"), schema=schema_).exceptAll(got).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.mark.parametrize("block, documents, shapes", [(10, 3, 64), (300, 7, 2), (1 << 20, 20_000, 64)])
def test_bson_columns_are_those_of_records(monkeypatch, block, documents, shapes):
    import datetime as dt
    import random
    import struct

    from sparkprep.sources import bson_columns, records

    for name, n in (("BLOCK", block), ("DOCUMENTS", documents), ("SHAPES", shapes)):
        monkeypatch.setattr(bson_columns, name, n)
    # object ids, regular expressions, decimals, doubled names, undefined
    odd = [b"\x07_id\x00" + bytes(range(12)), b"\x0br\x00ab\x00i\x00", b"\x13z\x00" + bytes(16), b"\x10q\x00\x01\x00\x00\x00\x12q\x00\x02" + bytes(7), b"\x06u\x00"]
    for seed in range(20):
        rnd, raw = random.Random(seed), b""
        alike = [lambda: rnd.choice([1, -(2**40), None]), lambda: rnd.choice([1, 0.5]), lambda: "ж" * rnd.randrange(90), lambda: rnd.choice([True, None]), lambda: dt.datetime(rnd.choice([1, 1969, 9999]), 12, 31, 5, tzinfo=dt.timezone.utc), lambda: bytes(rnd.randrange(3)), lambda: {rnd.choice("xy"): rnd.choice([1, "s", [2.5]])}, lambda: [rnd.choice([1, {"p": 1}])]]
        kinds = {k: rnd.choice(alike) for k in "abcdef"}
        for _ in range(100):
            body = bson.encode({k: (rnd.choice(alike) if rnd.random() < 0.02 else make)() for k, make in kinds.items() if rnd.random() < 0.9})[4:-1]
            body += rnd.choice(odd) if rnd.random() < 0.2 else b""
            raw += struct.pack("<i", len(body) + 5) + body + b"\x00"
        want = list(bson.documents(io.BytesIO(raw)))
        kind, cuts = bson_columns.survey(io.BytesIO(raw), 500)
        assert kind == records.union(map(records.type_of, want)) == records.types_of(want) and len(cuts) > 3
        schema_, got = records.settle(kind), []
        for a, b in zip(cuts, cuts[1:]):
            got += [tuple(r.values()) for x in bson_columns.batches(io.BytesIO(raw[a:]), schema_, b - a) for r in x.to_pylist()]
        assert got == [tuple(records.plain(x, f.dataType) for x, f in zip(records.row(r, schema_), schema_.fields)) for r in want]
        for bad, why in ((raw[:-3], "document"), (raw + b"\x01", "length")):
            with pytest.raises(ValueError, match=f"truncated BSON {why}"):
                list(bson_columns.blocks(io.BytesIO(bad)))


def test_bson_of_batches_is_that_of_records(spark, tmp_path):
    df = spark.sql("SELECT bigint(1099511627776) a, 2147483647 b, double('NaN') c, float(1.5) d, 'жé' e, true f, timestamp'2020-01-02 03:04:05.678' g, date'2020-01-02' h, 1.50BD i, x'0001' j, array(struct(1 AS x, null AS y), null) k, map('q', 1) l, null m UNION ALL SELECT 2147483648, -1, -0.0, 0, '', false, timestamp'1969-12-31 23:59:59.999', date'0001-01-01', -0.01, x'', array(), map(), null UNION ALL SELECT null, null, null, null, null, null, null, null, null, null, null, null, null")
    write(df.coalesce(1), str(tmp_path / "t.bson"))
    (part,) = (tmp_path / "t.bson").glob("part-*.bson")
    got = list(bson.documents(io.BytesIO(part.read_bytes())))
    assert b"".join(map(bson.encode, got)) == part.read_bytes()
    assert [(r["a"], r["b"], r["d"], r["e"], r["f"], r["h"], r["i"], r["j"], r["k"], r["l"], r["m"]) for r in got] == [
        (2**40, 2**31 - 1, 1.5, "жé", True, "2020-01-02", "1.50", b"\x00\x01", [{"x": 1, "y": None}, None], {"q": 1}, None),
        (2**31, -1, 0.0, "", False, "0001-01-01", "-0.01", b"", [], {}, None),
        (None,) * 11,
    ]
    assert [r["g"] and r["g"].isoformat() for r in got] == ["2020-01-02T03:04:05.678000+00:00", "1969-12-31T23:59:59.999000+00:00", None] and got[0]["c"] != got[0]["c"]
    write(spark.sql("SELECT parse_json('{\"a\":1}') v, 1 n"), str(tmp_path / "v.bson"))
    assert [list(bson.documents(io.BytesIO(p.read_bytes()))) for p in (tmp_path / "v.bson").glob("part-*.bson")] == [[{"v": '{"a":1}', "n": 1}]]
    write(spark.createDataFrame([], "n int"), str(tmp_path / "e.bson"))
    assert (tmp_path / "e.bson" / "_SUCCESS").exists()


@pytest.mark.parametrize("codec", ["deflate", "null"])
def test_avro_of_batches_is_that_of_records(codec):
    import pyarrow as pa

    texts = [("a" * (k % 90), None if k % 3 else "ж") for k in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*texts)], ["a", "b"])
    f = io.BytesIO()
    avro.write_blocks(f, ["a", "b"], (x for b in (batch.slice(0, 1), batch.slice(1), batch.slice(0, 0)) for x in avro.text_blocks(b)), codec)
    f.seek(0)
    assert [tuple(r.values()) for r in avro.records(f)] == texts
