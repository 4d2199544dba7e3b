import datetime as dt

import pytest

from sparkprep import streaming
from sparkprep.operators import reshape

SCHEMA = "id long, kind string, inn string, ts timestamp"


@pytest.fixture()
def source(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 10, m)
    rows = [(1, "a", "6154064277", at(1)), (2, "b", "1", at(2)), (3, "a", None, at(7)), (4, "a", "1", at(8))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    return streaming.read_stream(spark, str(tmp_path / "in"), "parquet", SCHEMA)


def run(spark, stream, name, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return sorted((tuple(r) for r in spark.table(name).collect()), key=repr)


def test_stateless(spark, source):
    assert run(spark, streaming.select_stream(source, "id", "kind == 'a'"), "s_select") == [(1,), (3,), (4,)]
    assert run(spark, streaming.validate_stream(source, "inn", "ru.org.inn"), "s_validate") == [("1", False), ("1", False)]
    assert len(run(spark, reshape.flatten(source), "s_flatten")) == 16


def test_stateful(spark, source):
    assert run(spark, streaming.uniq_stream(source, "kind"), "s_uniq") == [("a",), ("b",)]
    assert run(spark, streaming.frequency_stream(source, "kind"), "s_freq", "complete") == [("a", 3), ("b", 1)]
    windows = run(spark, streaming.frequency_stream(source, "kind", time="ts", window="5 minutes"), "s_window", "complete")
    assert sorted((w["start"].minute, k, n) for w, k, n in windows) == [(0, "a", 1), (0, "b", 1), (5, "a", 2)]


def test_ingest(spark, source, tmp_path):
    sink = reshape.LocalJsonSink(str(tmp_path / "out"))
    sink.prepare(False)
    streaming.ingest_stream(source, sink, batch=3).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 4
