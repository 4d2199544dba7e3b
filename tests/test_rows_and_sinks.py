import json
import pickle
from email.utils import parseaddr

import pytest
from pyspark.sql import functions as F

from sparkprep.functions.rules import RULES
from sparkprep.operators import reshape, schema, select, stats
from sparkprep.plans.paths import PathError
from sparkprep.sources import read


def test_skip_by_order_and_by_source(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("__row", F.lit(1))
    for n in (0, 1, 142, 143, 500, 999, 1000, 5000):
        assert sorted(r.id for r in select.skip(df, n).collect()) == list(range(n, 1000))
        assert sorted(r.id for r in select.skip(df.repartition(5), n, ["id"]).collect()) == list(range(n, 1000))
    got = select.skip(df, 5)
    assert got.columns == df.columns and "Limit" not in got._jdf.queryExecution().executedPlan().toString()
    assert select.skip(df.limit(0), 3, ["id"]).count() == 0


def test_chunks_over_many_partitions(spark):
    df = spark.range(0, 20_000, 1, 6).select((F.col("id") * 7919 % 20_000).alias("id"))
    rows = reshape.with_chunks(df, 300, ["id"]).collect()
    assert sorted((r.id, r.chunk) for r in rows) == [(k, k // 300 + 1) for k in range(20_000)]


def test_unnest(spark):
    rows = [(1, [("a", 1), ("b", None)]), (2, []), (3, None), (4, [None, ("c", 2)])]
    df = spark.createDataFrame(rows, "id int, list array<struct<k string, v int>>")
    assert sorted(map(tuple, select.unnest(df, "list", "id").collect())) == [(1, "a", 1), (1, "b", None), (4, "c", 2)]
    assert select.unnest(df, "list").columns == ["k", "v"]
    with pytest.raises(PathError):
        select.unnest(df, "id")


MAILS = ["a@b.c", "Name <a@b.c>", "a b", "", None, "<x>", "(c@d) e", '"q, r" <s@t>', "a@b, c", "@", "x <y", "A (b@c) <d>"]


def test_mail_by_the_library(spark):
    df = spark.createDataFrame([(m,) for m in MAILS], "m string").select("m", RULES["common.email"](F.col("m")).alias("ok"))
    assert {r.m: r.ok for r in df.collect()} == {m: m is not None and "@" in parseaddr(m)[1] for m in MAILS}


@pytest.mark.parametrize("encoding,tail", [("cp1251", "страна"), ("koi8-r", "страна"), ("cp1252", "€ naïve"), ("utf-16", "日本"), ("shift_jis", "日本")])
def test_csv_encodings(spark, tmp_path, encoding, tail):
    path = tmp_path / "t.csv"
    path.write_bytes(f"id,{tail}\n1,{tail}\n2,plain\n".encode(encoding))
    got = read(spark, str(path), encoding=encoding, delimiter=",")
    assert got.columns == ["id", tail] and sorted(map(tuple, got.collect())) == [("1", tail), ("2", "plain")]


def test_csv_is_split_unless_values_hold_line_ends(spark, tmp_path):
    from sparkprep.sources.readers import _open_quotes

    (tmp_path / "a.csv").write_text('k,v\n1,"x ""y"""\n')
    (tmp_path / "b.csv").write_text('k,v\n2,"x\ny"\n')
    assert not _open_quotes(spark, [str(tmp_path / "a.csv")], "utf-8") and _open_quotes(spark, [str(tmp_path)], "utf-8")
    got = read(spark, str(tmp_path), "csv", delimiter=",", encoding="utf-8")
    assert sorted(map(tuple, got.collect())) == [("1", 'x "y"'), ("2", "x\ny")]


def test_statistics_plan_and_values(spark):
    rows = [(1, 0.5, "a", [("x", 1)]), (1, -0.0, None, [("x", 2), ("y", 2)]), (2, 0.0, "7", None), (None, 1e20, "a", [])]
    df = spark.createDataFrame(rows, "id int, num double, txt string, sub array<struct<kk string, vv long>>")
    out = stats.stats(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    got = {r.key: r for r in out.collect()}
    assert list(got) == ["id", "num", "txt", "sub.kk", "sub.vv"]
    assert [(got[k].ftype, got[k].n_uniq, got[k].total) for k in got] == [("int", 3, 4), ("float", 3, 4), ("str", 3, 4), ("str", 2, 3), ("int", 2, 3)]
    assert (got["num"].minlen, got["num"].maxlen, got["id"].maxlen) == (3, 5, 4)


def test_report_counts_all_records(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text("".join(json.dumps({"id": k}) + "\n" for k in range(12_000)))
    table = schema.analyze(spark, str(path), exact=True)["tables"][0]
    assert table["num_records"] == 12_000 == table["fields"][0]["n_unique"]


class FakeElastic:
    def __init__(self, bad=()):
        self.kept, self.bad = {}, bad

    def bulk(self, operations, pipeline=None):
        items = []
        for at, r in zip(operations[::2], operations[1::2]):
            key = at["index"]["_id"]
            error = {"reason": "no"} if r["id"] in self.bad else None
            if not error:
                self.kept[key] = r
            items.append({"index": {"_id": key, "error": error}})
        return {"errors": any(i["index"]["error"] for i in items), "items": items}


def test_elastic_sink():
    sink = reshape.ElasticSink("http://x", "i")
    sink._made = FakeElastic()
    batch, keys = [{"id": k} for k in range(3)], ["a", "b", "c"]
    sink.put(batch, keys)
    sink.put(batch, keys)  # a task that runs again
    assert sink._made.kept == dict(zip(keys, batch))
    sink._made = FakeElastic(bad={1})
    with pytest.raises(RuntimeError, match="1 of 3"):
        sink.put(batch, keys)
    assert "_made" not in pickle.loads(pickle.dumps(sink)).__dict__


class FakeTable(dict):
    code = 11000

    def insert_many(self, rows, ordered):
        twice = [r for r in rows if r["_id"] in self]
        self.update((r["_id"], r) for r in rows if r["_id"] not in self)
        if twice:
            e = RuntimeError("bulk write")
            e.details = {"writeErrors": [{"code": self.code} for _ in twice]}
            raise e


def test_mongo_sink():
    table = FakeTable()
    sink = reshape.MongoSink("mongodb://x", "db", "t")
    sink._made = {"db": {"t": table}}
    for _ in range(2):
        sink.put([{"id": 1}, {"id": 2}], ["a", "b"])
    assert {k: r["id"] for k, r in table.items()} == {"a": 1, "b": 2}
    table.code = 121
    with pytest.raises(RuntimeError):
        sink.put([{"id": 1}], ["a"])


def test_keys_of_batches(spark, tmp_path):
    reshape.ingest(spark.range(0, 50, 1, 3), reshape.LocalJsonSink(str(tmp_path / "out")), batch=7, skip=5, order=["id"])
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "out")).collect()) == list(range(5, 50))
