import json

import pytest
from pyspark.sql import functions as F

from sparkprep.functions.dates import date_pattern, is_date
from sparkprep.functions.pystr import guess_text, int_width, py_str, safe_file_name
from sparkprep.functions.rules import RULES
from sparkprep.operators import select as sel
from sparkprep.operators.stats import stats, stats_records
from sparkprep.operators.validate import validate
from sparkprep.plans.filterlang import FilterError, compile_filter
from sparkprep.plans.recordlang import QueryError


def one(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_py_str_of_floats_is_repr(spark):
    xs = [0.0, 1.0, -1.5, 1e7, 12345678.9, 1.5e15, 1e16, 1.5e22, 0.001, 0.0001234, 1e-5, 1.5e-7, 123456789012345.6, float("nan"), float("inf"), -2e300, 1e100]
    df = one(spark, xs, "double")
    assert [r[0] for r in df.select(py_str(df.v, df.schema["v"].dataType)).collect()] == [repr(x) for x in xs]


def test_py_str_of_other_values(spark):
    df = spark.createDataFrame([(True, None, ["a", "b'c", None], (1, 2.5))], "b boolean, n string, l array<string>, s struct<x:int,y:double>")
    got = df.select(*[py_str(df[c], df.schema[c].dataType) for c in df.columns]).first()
    assert tuple(got) == ("True", "None", str(["a", "b'c", None]), str({"x": 1, "y": 2.5}))


def test_guesses(spark):
    cases = {"0012": "int", "1_000": "float", " 1.5 ": "float", "nan": "float", "inf": "float", "1e5": "float", "1d": "str", "²": "str", "": "empty", "  ": "empty", "12.05.2020": "date", "2020-01-31": "date", "2020-13-45": "str", "x": "str", "١٢": "int"}
    df = one(spark, list(cases))
    assert [r[0] for r in df.select(guess_text(df.v)).collect()] == list(cases.values())
    assert df.filter("v = '  '").select(guess_text(df.v, False)).first()[0] == "str"
    widths = one(spark, ["7", "300", "70000", "x"])
    assert [r[0] for r in widths.select(int_width(widths.v)).collect()] == ["uint8", "uint16", "uint32", None]


def test_dates(spark):
    df = one(spark, ["01.02.2020", "31.02.2020", "2020-01-01T10:00:00", "Fri, 20 Sep 2013 12:45:00 +0400", "5 мая 2019", "May 5, 2019", "12/31/2020", "31/12/2020", "no 5"])
    got = [tuple(r) for r in df.select(is_date(df.v), date_pattern(df.v)).collect()]
    assert [g[0] for g in got] == [True, False, True, True, True, True, True, True, False]
    assert got[6][1] == "mm/dd/yyyy" and got[7][1] == "dd/mm/yyyy"


def test_rules(spark):
    cases = {
        "ru.org.inn": [("6154064277", True), ("6154064278", False), ("500100732259", True), ("61540642", False), ("abc", False), (None, False)],
        "ru.org.ogrn": [("1026102584771", True), ("1026900539767", False), ("304500116000157", True), ("1,05E+12", False), ("", False)],
        "common.email": [("a@b.c", True), ("Joe <joe@x.org>", True), ("nobody", False), (None, False)],
        "common.url": [("http://example.com/a?b", True), ("https://localhost:80", True), ("ftp://1.2.3.4/x", True), ("example.com", False), ("http://a b.c", False)],
    }
    for rule, rows in cases.items():
        df = one(spark, [v for v, _ in rows])
        assert [r[0] for r in df.select(RULES[rule](df.v)).collect()] == [ok for _, ok in rows], rule


def test_validate_modes(spark):
    df = spark.createDataFrame([("6154064277",), ("1",), (None,)], "inn string")
    assert validate(df, "inn", "ru.org.inn", "stats").first().asDict() == {"total": 3, "invalid": 1, "novalue": 1, "share": pytest.approx(100 / 3)}
    assert [tuple(r) for r in validate(df, "inn", "ru.org.inn").collect()] == [("1", False)]
    assert validate(df, "inn", "ru.org.inn", "all").count() == 2
    assert validate(df.limit(0), "inn", "ru.org.inn", "stats").first()["share"] is None
    with pytest.raises(ValueError):
        validate(df, "inn", "nope")


def test_safe_names(spark):
    df = one(spark, ["a/b\\c?<d>\n"])
    assert df.select(safe_file_name(df.v)).first()[0] == "a-b-c--d-"


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "ann", "31", ["x", "y"], [(1, "u")], True, 1.5), (2, "Bob", "7", [], [(2, "v"), (3, "u")], False, None), (3, None, "", None, None, None, 2.0)]
    return spark.createDataFrame(rows, "id int, name string, age string, tags array<string>, jobs array<struct<n:int,k:string>>, ok boolean, w double")


@pytest.mark.parametrize(
    "text,ids",
    [
        ("id == 1", [1]), ("`age` > 12", [1]), ("age != '7'", [1, 3]), ("name LIKE 'B*'", [2]), ("name LIKE '?nn'", [1]), ("name MATCH /[a-z]n/", [1]),
        ("tags CONTAINS 'x'", [1]), ("'x' IN tags", [1]), ("id IN (1, 3)", [1, 3]), ("id NOT IN (1, 3)", [2]), ("jobs.k == 'u'", [1, 2]), ("jobs.n > 2", [2]),
        ("name", [1, 2]), ("NOT name", [3]), ("ok", [1]), ("w == NONE", [2]), ("missing == 1", []), ("NOT missing == 1", [1, 2, 3]), ("id < 3 AND (ok OR name == 'Bob')", [1, 2]),
        ("ok == TRUE or id = 3", [1, 3]), ("w >= 1.5", [1, 3]), ("name CONTAINS 'o'", [2]), ("2 < id", [3]),
    ],
)
def test_filters(people, text, ids):
    assert sorted(r.id for r in people.filter(compile_filter(people, text)).collect()) == ids


def test_filter_errors(people):
    for text in ("id ==", "(id == 1", "id == 1 )", "id LIKE name", "== 3", "id # 3"):
        with pytest.raises(FilterError):
            compile_filter(people, text)


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 as k", "'x' as pad").write.parquet(str(tmp_path / "t"))
    plan = sel.select(spark.read.parquet(str(tmp_path / "t")), "id", "k == 3")._jdf.queryExecution().toString()
    assert "EqualTo(k,3)" in plan and "pad" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize(
    "text,want",
    [
        ("id + 1", ["2", "3", "4"]), ("name", ['"ann"', '"Bob"']), ("jobs | count", ["1", "2"]), ("jobs | map n | sum", ["1", "5"]), ("jobs[0].k", ['"u"', '"v"']), ("jobs[-1].n", ["1", "3"]),
        ('jobs | filter k == "u" | count', ["1", "1"]), ("tags | reverse", ['["y","x"]']), ('stringjoin "-" tags', ['"x-y"']), ("jobs | sortby (-n) | map n", ["[1]", "[3,2]"]), ("{a: id, b: name}", ['{"a":1,"b":"ann"}', '{"a":2,"b":"Bob"}', '{"a":3,"b":null}']),
        ("tags[0:1]", ['["x"]']), ("name[0:2]", ['"an"', '"Bo"']), ("if ok 1 0", ["1"]), ("float age", ["31.0", "7.0"]), ('name =~ "^a"', ["true"]), ("!ok", ["true", "true"]), ("range id", ["[0]", "[0,1]", "[0,1,2]"]),
        ("jobs | groupby k | keys", ['["u"]', '["v","u"]']), ('split "n" name', ['["a","",""]', '["Bob"]']), ("jobs | any n > 2", ["true"]), ("id % 2 == 1 && ok", ["true"]), ("jobs | find n > 1 | apply @.k", ['"v"']), ("(jobs | map n | summarize).max", ["1.0", "3.0"]), ("withindices tags | map index", ["[0,1]"]),
    ],
)
def test_record_queries(people, text, want):
    assert sorted(r[0] for r in sel.query(people, text).collect()) == sorted(want)


def test_record_query_errors(people):
    for text in ("id +", "jobs | 3", "count", "(id", "nofunction | nofunction x"):
        try:
            sel.query(people, text).collect()
        except (QueryError, Exception) as e:  # noqa: B014
            assert str(e)


def test_stats(spark):
    df = spark.createDataFrame([("a", 1, "1.5", None), ("b", 2, "2", None), ("a", 3, "x", None)], "name string, num int, mixed string, void string")
    got = {r.key: r for r in stats(df).collect()}
    assert (got["name"].n_uniq, got["name"].is_dictkey, got["name"].ftype) == (2, True, "str")
    assert (got["num"].is_uniq, got["num"].ftype, got["num"].minlen) == (True, "int", 1)
    assert got["mixed"].ftype == "str" and got["mixed"].avglen == pytest.approx(5 / 3)
    assert (got["void"].ftype, got["void"].minlen, got["void"].n_uniq) == ("str", 4, 1)
    assert stats(df.limit(0)).count() == 0


def test_stats_of_mixed_records(spark):
    lines = [json.dumps({"val": v}) for v in (1, 1.0, True, "1", None, "")] + [json.dumps({"x": 1, "12": 2, "name": 3})]
    got = {r.key: r for r in stats_records(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert set(got) == {"val", "name"}
    assert (got["val"].total, got["val"].n_uniq, got["val"].ftype, got["val"].maxlen) == (6, 4, "str", 4)


def test_select_skip_sample(people):
    assert [r.id for r in sel.skip(people, 1, ["id"]).collect()] == [2, 3]
    assert sel.sample(people, 2, ["id"]).count() == 2 and sel.total(people).first().total == 3
    assert sel.select(people, "jobs.k,id,unknown").columns == ["jobs", "id"]
