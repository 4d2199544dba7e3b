import json
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkprep.operators import reshape
from sparkprep.operators.dynamic import canonical, leaf_values
from sparkprep.operators.values import frequency, headers, uniq
from sparkprep.plans.paths import PathError, leaves, project, values
from tests.model import leaf_rows
from tests.model import values as model_values

SCHEMA = "id long, _id string, a struct<b:array<struct<c:long,d:string>>,e:string>, t array<string>"
RECORDS = [
    {"id": 1, "_id": "x", "a": {"b": [{"c": 1, "d": "p"}, {"c": 2, "d": None}], "e": "u"}, "t": ["x", "y"]},
    {"id": 2, "_id": "y", "a": {"b": [], "e": None}, "t": []},
    {"id": 3, "_id": None, "a": None, "t": None},
]


def frame(spark, records=RECORDS):
    return spark.read.schema(SCHEMA).json(spark.createDataFrame([(json.dumps(r),) for r in records], "v string").rdd.map(lambda r: r[0]))


def test_values_fan_out_like_the_model(spark):
    df = frame(spark)
    for path in ("id", "a.b.c", "a.b.d", "a.e", "t"):
        got = [r[0] for r in df.select(values(df, path).column).collect()]
        assert got == [model_values(r, path) for r in RECORDS], path


def test_leaves_skip_ids_and_scalar_lists(spark):
    assert [x.path for x in leaves(frame(spark).schema)] == ["id", "a.b.c", "a.b.d", "a.e"]
    assert [r.key for r in headers(frame(spark)).collect()] == ["id", "a.b.c", "a.b.d", "a.e"]


def test_melt_like_the_model(spark):
    got = Counter((r.key, r.value) for r in reshape.flatten(frame(spark)).collect())
    # typed records have every key of an existing parent
    want = Counter(x for r in RECORDS for x in leaf_rows({k: v for k, v in r.items() if v is not None}))
    assert got == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.fixed_dictionaries({"id": st.integers(0, 5), "_id": st.just("k"), "a": st.one_of(st.none(), st.fixed_dictionaries({"b": st.lists(st.fixed_dictionaries({"c": st.integers(-3, 3), "d": st.sampled_from(["x", "y"])}), max_size=3), "e": st.one_of(st.none(), st.text("ab", max_size=2))})), "t": st.lists(st.text("ab", max_size=2), max_size=2)}), min_size=1, max_size=6))
def test_values_property(spark, records):
    df = frame(spark, records)
    for path in ("a.b.c", "a.e", "t"):
        assert [r[0] for r in df.select(values(df, path).column).collect()] == [model_values(r, path) for r in records]


def test_uniq_and_frequency_zip_values(spark):
    df = frame(spark)
    assert {tuple(r) for r in uniq(df, "a.b.c,a.b.d").collect()} == {("1", "p"), ("2", "None")}
    assert [tuple(r) for r in frequency(df, "a.e").collect()] == [("None", 1), ("u", 1)]
    # a scalar beside a list: values pair by position
    assert {tuple(r) for r in uniq(df, "a.b.c,id").collect()} == {("1", "1"), ("2", None)}


def test_project_is_a_tree(spark):
    df = spark.createDataFrame([((1, 2), (3, 4))], "a struct<b:int,d:int>, c struct<b:int,d:int>")
    assert project(df, ["a.b", "c.d"]).first().asDict(True) == {"a": {"b": 1}, "c": {"d": 4}}
    assert project(df, ["a.b", "c.d"], legacy=True).first().asDict(True) == {"a": {"b": 1, "d": 2}, "c": {"b": 3, "d": 4}}
    assert project(df, ["c", "a.d"]).columns == ["c", "a"]
    with pytest.raises(PathError):
        project(df, ["a.x"])


def test_names_with_dots(spark):
    df = spark.createDataFrame([("v",)], "`a.b` string")
    assert frequency(df, "a.b").first().asDict() == {"a.b": "v", "count": 1}


def test_dynamic_leaves_and_equality():
    rows = list(leaf_values({"_id": 1, "b": {"_id": 2, "x": None}, "l": [1, 2], "m": [{"x": 1}, {"x": 1.0}], "z": {}}))
    assert rows == [(("b", "x"), None), (("m", "x"), 1), (("m", "x"), 1.0)]
    assert canonical(1) == canonical(1.0) == canonical(True) != canonical("1")


def test_headers_of_records_keep_order_and_late_keys(spark):
    lines = [json.dumps({"b": 1})] * 150 + [json.dumps({"z": 1, "b": {"c": 2}})]
    df = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    assert [r.key for r in headers(df, dynamic="value").collect()] == ["b", "z", "b.c"]
