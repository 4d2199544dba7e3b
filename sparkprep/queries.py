"""Registered queries for the operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import is_date
from .operators import reshape, schema, stats, values
from .operators import select as sel
from .operators.validate import validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _add(name: str, table: str, make: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: make(_t(spark, d, table))
    if sql is not None:
        ORACLE[name] = sql


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with their turns as an array of records."""
    return _t(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def nested_events(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select("event_id", F.struct("user_id", F.struct("event_type", "value").alias("what")).alias("who"), F.from_json("props", "k BIGINT").alias("props"))


# Projection and filters
_add("select_fields", "orders", lambda df: sel.select(df, "o_orderkey,o_orderpriority"), "SELECT o_orderkey, o_orderpriority FROM orders")
_add("select_filter", "orders", lambda df: sel.select(df, ["o_orderkey", "o_totalprice"], "`o_orderstatus` == 'F' AND `o_totalprice` > 100000"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
_add("filter_like", "part", lambda df: sel.select(df, "p_partkey,p_name", "p_name LIKE '*a?*'"), "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_%'")
_add("filter_in", "customer", lambda df: sel.select(df, "c_custkey", "c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey in (1, 2, 3)"), "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3)")
_add("filter_contains", "events", lambda df: sel.select(df, "event_id", "props CONTAINS '\"k\": 6'"), "SELECT event_id FROM events WHERE contains(props, '\"k\": 6')")
_add("filter_match", "customer", lambda df: sel.select(df, "c_custkey,c_name", "c_name MATCH /Customer#0+1\\d*$/"), "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '^(?:Customer#0+1[0-9]*$)')")
_add("filter_not", "orders", lambda df: sel.select(df, "o_orderkey", "NOT (o_orderstatus == 'F' OR o_totalprice < 50000) AND o_orderpriority != '5-LOW'"), "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000) AND o_orderpriority <> '5-LOW'")


@_query("filter_nested_any", "SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'")
def _(spark, d):
    return sel.select(turns(spark, d), "conv_id", "turns.role == 'system'")


@_query("select_nested", "SELECT event_id, user_id, value FROM events")
def _(spark, d):
    return sel.select(nested_events(spark, d), ["event_id", "who.user_id", "who.what.value"]).select("event_id", "who.user_id", "who.what.value")


# Distinct values and frequencies
_add("uniq_single", "lineitem", lambda df: values.uniq(df, "l_returnflag"), "SELECT DISTINCT l_returnflag FROM lineitem")
_add("uniq_multi", "lineitem", lambda df: values.uniq(df, "l_returnflag,l_linestatus,l_linenumber"), "SELECT DISTINCT l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber FROM lineitem")
_add("uniq_filter", "lineitem", lambda df: values.uniq(df, "l_suppkey", "l_quantity >= 49 and l_returnflag == 'R'"), "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS l_suppkey FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R'")
_add("frequency_single", "orders", lambda df: values.frequency(df, "o_orderpriority"), "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
_add("frequency_multi", "lineitem", lambda df: values.frequency(df, ["l_returnflag", "l_shipdate"]), "SELECT l_returnflag, CAST(l_shipdate AS VARCHAR) AS l_shipdate, count(*) AS count FROM lineitem GROUP BY 1, 2")
_add("frequency_filter", "events", lambda df: values.frequency(df, "event_type,user_id", "value > 50"), "SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, count(*) AS count FROM events WHERE value > 50 GROUP BY 1, 2")
_add("frequency_double", "orders", lambda df: values.frequency(df, "o_totalprice"), "SELECT CAST(o_totalprice AS VARCHAR) AS o_totalprice, count(*) AS count FROM orders GROUP BY 1")


@_query("uniq_nested", 'SELECT DISTINCT role AS turns_role FROM conversations')
def _(spark, d):
    return values.uniq(turns(spark, d), "turns.role").toDF("turns_role")


@_query("frequency_nested", 'SELECT role AS turns_role, CAST(turn AS VARCHAR) AS turns_turn, count(*) AS count FROM conversations GROUP BY 1, 2')
def _(spark, d):
    return values.frequency(turns(spark, d), "turns.role,turns.turn").toDF("turns_role", "turns_turn", "count")


@_query("json_path_frequency", """SELECT json_extract_string(props, '$.k') AS props_k, count(*) AS count FROM events GROUP BY 1""")
def _(spark, d):
    return values.frequency(nested_events(spark, d), "props.k").toDF("props_k", "count")


# Headers and flattening
def _named(names: list[str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}')" for k, n in enumerate(names)) + ") t(pos, key)"


_add("headers_lineitem", "lineitem", values.headers, _named("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()))
_add("headers_embeddings", "embeddings", values.headers, _named(["vec_id", "label"]))


@_query("headers_nested", _named(["event_id", "who.user_id", "who.what.event_type", "who.what.value", "props.k"]))
def _(spark, d):
    return values.headers(nested_events(spark, d))


@_query("headers_records", "SELECT 'k' AS key, count(*) > 0 AS found FROM events")
def _(spark, d):
    return values.headers(_t(spark, d, "events").select("props"), dynamic="props").select("key", F.lit(True).alias("found"))


_add("flatten", "nation", reshape.flatten, "SELECT key, value FROM (SELECT 'n_nationkey' AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT 'n_name', n_name FROM nation UNION ALL SELECT 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation)")


@_query("flatten_nested", "SELECT 'turns.turn' AS key, CAST(turn AS VARCHAR) AS value FROM conversations UNION ALL SELECT 'turns.role', role FROM conversations UNION ALL SELECT 'turns.text', text FROM conversations UNION ALL SELECT DISTINCT 'conv_id', CAST(conv_id AS VARCHAR) FROM (SELECT DISTINCT conv_id FROM conversations)")
def _(spark, d):
    return reshape.flatten(turns(spark, d))


# Statistics
def _stats_sql(table: str, cols: dict[str, str]) -> str:
    one = "SELECT '{c}' AS key, '{t}' AS ftype, 100.0 * u / n < 70 AS is_dictkey, 100.0 * u / n >= 100 AS is_uniq, CAST(u AS BIGINT) AS n_uniq, CAST(100.0 AS DOUBLE) * u / n AS share_uniq, lo AS minlen, hi AS maxlen, CAST(c AS DOUBLE) / n AS avglen, n AS total FROM (SELECT count(*) AS n, count(DISTINCT x) AS u, min(length(x)) AS lo, max(length(x)) AS hi, sum(length(x)) AS c FROM (SELECT CAST({c} AS VARCHAR) AS x FROM {table}))"
    return " UNION ALL ".join(one.format(c=c, t=t, table=table) for c, t in cols.items())


_add("stats_lineitem", "lineitem", stats.stats, _stats_sql("lineitem", {c: "int" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")} | {c: "float" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")} | {"l_returnflag": "str", "l_linestatus": "str", "l_shipdate": "typed"}))
_add("stats_orders", "orders", stats.stats, _stats_sql("orders", {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "str", "o_totalprice": "float", "o_orderdate": "typed", "o_orderpriority": "str"}))
_add("stats_events", "events", stats.stats, _stats_sql("events", {"event_id": "int", "ts": "typed", "user_id": "int", "event_type": "str", "value": "float", "props": "str"}))
_add("stats_dictkeys", "orders", lambda df: stats.stats(df).filter("is_dictkey").select("key"), "SELECT key FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS key, 100.0 * count(DISTINCT {c}) / count(*) AS s FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + ") WHERE s < 70")
_add("stats_records", "events", lambda df: stats.stats_records(df.select("props"), "props", skip_short_keys=False).select("key", "ftype", "n_uniq", "minlen", "maxlen", "total"), "SELECT 'k' AS key, 'int' AS ftype, count(DISTINCT x) AS n_uniq, CAST(min(length(x)) AS BIGINT) AS minlen, CAST(max(length(x)) AS BIGINT) AS maxlen, count(*) AS total FROM (SELECT json_extract_string(props, '$.k') AS x FROM events)")

_MIXED = "CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN CAST(o_totalprice AS VARCHAR) WHEN 2 THEN o_orderpriority WHEN 3 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 4 THEN ' ' ELSE '1_000' END"


@_query("guess_types", f"""SELECT CASE WHEN regexp_full_match(v, '[0-9]+') THEN 'int' WHEN regexp_full_match(v, '\\s*[+-]?[0-9]+(_[0-9]+)*(\\.[0-9]*)?\\s*') THEN 'float' WHEN regexp_full_match(v, '[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}') THEN 'date' WHEN trim(v) = '' THEN 'empty' ELSE 'str' END AS guess, count(*) AS count FROM (SELECT {_MIXED} AS v FROM orders) GROUP BY 1""")
def _(spark, d):
    mixed = F.expr("CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN CAST(o_totalprice AS STRING) WHEN 2 THEN o_orderpriority WHEN 3 THEN date_format(o_orderdate, 'dd.MM.yyyy') WHEN 4 THEN ' ' ELSE '1_000' END")
    return stats.guess_types(_t(spark, d, "orders").select(mixed.alias("v")), "v")


@_query("date_detect", "SELECT count(*) AS total, count(*) AS dates FROM orders")
def _(spark, d):
    text = _t(spark, d, "orders").select(F.date_format("o_orderdate", "dd.MM.yyyy").alias("v"))
    return text.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(is_date(F.col("v")), 1)).alias("dates"))


# Schemas
def _schema_sql(rows: list[tuple[str, str, bool]]) -> str:
    return "SELECT pos, name, type, is_array, '' AS description FROM (VALUES " + ", ".join(f"({k}, '{n}', '{t}', {str(a).lower()})" for k, (n, t, a) in enumerate(rows)) + ") t(pos, name, type, is_array)"


_add("schema_describe", "orders", schema.describe, _schema_sql([("o_orderkey", "BIGINT", False), ("o_custkey", "BIGINT", False), ("o_orderstatus", "VARCHAR", False), ("o_totalprice", "DOUBLE", False), ("o_orderdate", "TIMESTAMP", False), ("o_orderpriority", "VARCHAR", False)]))
_add("schema_arrays", "embeddings", schema.describe, _schema_sql([("vec_id", "BIGINT", False), ("embedding", "FLOAT", True), ("label", "INTEGER", False)]))


@_query("schema_nested", _schema_sql([("conv_id", "BIGINT", False), ("turns", "STRUCT", True), ("turns.turn", "BIGINT", False), ("turns.role", "VARCHAR", False), ("turns.text", "VARCHAR", False)]))
def _(spark, d):
    return schema.describe(turns(spark, d))


@_query("is_flat", "SELECT * FROM (VALUES ('orders', true), ('embeddings', false)) t(name, is_flat)")
def _(spark, d):
    return spark.createDataFrame([(n, schema.is_flat(_t(spark, d, n))) for n in ("orders", "embeddings")], "name string, is_flat boolean")


def _analyze_sql(table: str, cols: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS pos, '{c}' AS name, '{t}' AS type, false AS is_array, count(DISTINCT {c}) AS n_unique, count(*) AS count, printf('%.2f', 100.0 * count(DISTINCT {c}) / count(*)) AS uniq_share FROM {table}" for k, (c, t) in enumerate(cols))


_CUSTOMER = [("c_custkey", "BIGINT"), ("c_name", "VARCHAR"), ("c_nationkey", "INTEGER"), ("c_acctbal", "DOUBLE"), ("c_mktsegment", "VARCHAR")]
_add("analyze_exact", "customer", lambda df: schema.summarize(df, exact=True), _analyze_sql("customer", _CUSTOMER))
_add("analyze_approx", "customer", schema.summarize)


@_query("scheme", "SELECT * FROM (VALUES ('conv_id', 'integer', 'field'), ('turns', 'list of [dict]', 'nested'), ('turns.turn', 'integer', 'field'), ('turns.role', 'string', 'field'), ('turns.text', 'string', 'field')) t(name, type, class)")
def _(spark, d):
    rows = schema.scheme_fields(schema.scheme(turns(spark, d)))
    return spark.createDataFrame([(r["name"], r["type"], r["class"]) for r in rows], "name string, type string, class string")


@_query("candidates", "SELECT 'turns' AS key, count(*) AS total FROM conversations")
def _(spark, d):
    return schema.candidate_sizes(turns(spark, d))


@_query("schema_key", "SELECT * FROM (VALUES ('region', '2dc2cfd3f2da6368', true), ('nation', 'b6fe73d71ee5f7a5', true)) t(name, key, same)")
def _(spark, d):
    names = {t: _t(spark, d, t).columns for t in ("region", "nation")}
    return spark.createDataFrame([(t, schema.schema_key(c), schema.schema_key(c) == schema.schema_key(c[::-1])) for t, c in names.items()], "name string, key string, same boolean")


@_query("analyze_file", "SELECT name, n_unique, count AS num_records, uniq_share FROM (" + _analyze_sql("customer", _CUSTOMER) + ")")
def _(spark, d):
    report = schema.analyze(spark, f"{d}/customer.parquet", exact=True)
    rows = [(f["name"], f["n_unique"], t["num_records"], f["uniq_share"]) for t in report["tables"] for f in t["fields"]]
    return spark.createDataFrame(rows, "name string, n_unique long, num_records long, uniq_share string")


@_query("schema_bulk", "SELECT * FROM (VALUES ('nation', 3), ('region', 2)) t(name, num_cols)")
def _(spark, d):
    found = schema.schema_bulk(spark, f"{d}/*ion.parquet")
    return spark.createDataFrame([(os.path.basename(f).split(".")[0], s["num_cols"]) for s in found for f in s["files"]], "name string, num_cols int")


@_query("build_schema", _schema_sql([("event_id", "BIGINT", False), ("who", "STRUCT", False), ("who.user_id", "BIGINT", False), ("who.what", "STRUCT", False), ("who.what.event_type", "VARCHAR", False), ("who.what.value", "DOUBLE", False), ("props", "STRUCT", False), ("props.k", "BIGINT", False)]))
def _(spark, d):
    return schema.describe(nested_events(spark, d))


@_query("merge_schemes", "SELECT * FROM (VALUES ('a', 'integer', 'field'), ('b', 'dict', 'nested'), ('b.c', 'string', 'field'), ('b.d', 'float', 'field'), ('e', 'list of [string]', 'field')) t(name, type, class)")
def _(spark, d):
    one, two = schema.record_scheme({"a": 1, "b": {"c": "x"}}), schema.record_scheme({"a": "later", "b": {"d": 0.5}, "e": ["y"]})
    rows = schema.scheme_fields(schema.merge_schemes(one, two))
    return spark.createDataFrame([(r["name"], r["type"], r["class"]) for r in rows], "name string, type string, class string")


# Validation
_V10 = "lpad(CAST(o_orderkey * 7919 + 1234567 AS {t}), 10, '0')"
_V13 = "lpad(CAST(o_orderkey * 7919 + 1026102584771 AS {t}), 13, '0')"


def _d(k: int) -> str:
    return f"CAST(substr(v, {k}, 1) AS INTEGER)"


_INN_OK = "(" + " + ".join(f"{w} * {_d(k + 1)}" for k, w in enumerate((2, 4, 10, 3, 5, 9, 4, 6, 8))) + f") % 11 % 10 = {_d(10)}"
_OGRN_OK = f"CAST(substr(v, 1, 12) AS BIGINT) % 11 % 10 = {_d(13)}"


def _codes(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.expr(text.format(t="STRING")).alias("v"))


_add("validate_inn_all", "orders", lambda df: validate(_codes(df, _V10), "v", "ru.org.inn", "all"), f"SELECT v, {_INN_OK} AS v_valid FROM (SELECT {_V10.format(t='VARCHAR')} AS v FROM orders)")
_add("validate_inn_invalid", "orders", lambda df: validate(_codes(df, _V10), "v", "ru.org.inn"), f"SELECT v, false AS v_valid FROM (SELECT {_V10.format(t='VARCHAR')} AS v FROM orders) WHERE NOT ({_INN_OK})")
_add("validate_inn_stats", "orders", lambda df: validate(_codes(df, _V10), "v", "ru.org.inn", "stats"), f"SELECT count(*) AS total, count(*) FILTER (NOT ({_INN_OK})) AS invalid, CAST(0 AS BIGINT) AS novalue, CAST(100.0 AS DOUBLE) * count(*) FILTER (NOT ({_INN_OK})) / count(*) AS share FROM (SELECT {_V10.format(t='VARCHAR')} AS v FROM orders)")
_add("validate_ogrn", "orders", lambda df: validate(_codes(df, _V13), "v", "ru.org.ogrn", "all"), f"SELECT v, {_OGRN_OK} AS v_valid FROM (SELECT {_V13.format(t='VARCHAR')} AS v FROM orders)")
_add("validate_email", "customer", lambda df: validate(df.select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("@example.com"))).alias("m")), "m", "common.email", "all"), "SELECT m, position('@' IN m) > 0 AS m_valid FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || '@example.com' END AS m FROM customer)")
_add("validate_url", "pages", lambda df: validate(df, "url", "common.url", "all"), "SELECT url, regexp_matches(url, '^https?://([a-z0-9-]+\\.)+[a-z]{2,}(:[0-9]+)?([/?#]\\S*)?$') AS url_valid FROM pages")


# Splitting, scripts, queries
_add("split_by_size", "orders", lambda df: reshape.with_chunks(df, 1000, ["o_orderkey"]).select("o_orderkey", "chunk"), "SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS BIGINT) + 1 AS chunk FROM orders")
_add("split_by_value", "events", lambda df: reshape.with_value_key(df, "event_type").groupBy("part").agg(F.count(F.lit(1)).alias("count")), "SELECT event_type AS part, count(*) AS count FROM events GROUP BY 1")


def _rename(item: dict) -> dict:
    item["name"] = item.pop("p_name")
    return item


_add("apply_rename", "part", lambda df: reshape.apply(df.select("p_partkey", "p_name"), _rename, "p_partkey bigint, name string"), "SELECT p_partkey, p_name AS name FROM part")
_add("apply_inferred", "nation", lambda df: reshape.apply(df, lambda r: {"nation": r["n_name"].lower(), "twice": 2 * r["n_nationkey"]}), "SELECT lower(n_name) AS nation, CAST(2 * n_nationkey AS BIGINT) AS twice FROM nation")
_add("query_arithmetic", "orders", lambda df: sel.query(df, "o_orderkey * 2 + 1"), "SELECT CAST(o_orderkey * 2 + 1 AS VARCHAR) AS result FROM orders")
_add("query_if", "orders", lambda df: sel.query_column(df, 'if (o_totalprice > 100000) "high" "low"', "band").groupBy("band").agg(F.count(F.lit(1)).alias("count")), "SELECT CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS band, count(*) AS count FROM orders GROUP BY 1")


@_query("query_pipe", "SELECT CAST(count(*) FILTER (role = 'user') AS VARCHAR) AS result FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0")
def _(spark, d):
    return sel.query(turns(spark, d), 'turns | filter role == "user" | count')


@_query("query_map", "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def _(spark, d):
    return sel.query_column(turns(spark, d), "turns | map (count text) | sum", "chars").select("conv_id", "chars")


_add("count_total", "lineitem", sel.total, "SELECT count(*) AS total FROM lineitem")
_add("limit_sample", "orders", lambda df: sel.sample(df, 200, ["o_orderkey"]), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 200")
_add("skip_rows", "customer", lambda df: sel.skip(df, 100, ["c_custkey"]), "SELECT * FROM customer ORDER BY c_custkey OFFSET 100")


# Conversions: written and read again
def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    from .session import shared_dir

    base = shared_dir(spark)
    base = "file://" + base[5:] if base.startswith("file:/") and not base.startswith("file://") else base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _round_trip(fmt: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        from .sources import read, write

        df = _t(spark, d, "nation")
        path = f"{_folder(spark, 'convert')}.{fmt}"
        write(df, path, fmt, **options)
        plain = path[7:] if fmt == "csv" and path.startswith("file://") else path
        at = plain + "/part-*" if fmt in ("bson", "avro") else plain
        got = read(spark, at, fmt, **({"tag": "row"} if fmt == "xml" else {"delimiter": ",", "encoding": "utf-8"} if fmt == "csv" else {}))
        return got.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in df.columns])

    return run


for _fmt in ("csv", "jsonl", "parquet", "orc", "xml", "bson", "avro"):
    QUERIES[f"convert_{_fmt}"] = _round_trip(_fmt)
    ORACLE[f"convert_{_fmt}"] = "SELECT * FROM nation"


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _converted(table: str, first: str, second: str, make: Callable[[DataFrame], DataFrame] | None = None, **options) -> Callable[[SparkSession, str], DataFrame]:
    """The table written as one format, converted to another, and read."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        from .sources import read, write

        df = make(_t(spark, d, table)) if make else _t(spark, d, table)
        at, to = f"{_folder(spark, 'convert')}.{first}", f"{_folder(spark, 'convert')}.{second}"
        write(df, at, first)
        reshape.convert(spark, at + ("/part-*" if first in ("bson", "avro") else ""), to, first, second, infer_types=False, **({"tag": "row"} if first == "xml" else {}), **options)
        got = read(spark, to + ("/part-*" if second in ("bson", "avro") else ""), second, **({"tag": "row"} if second == "xml" else {}))
        return got.select(*[F.col(f"`{c}`").cast(df.schema[c].dataType).alias(c) for c in df.columns])

    return run


for _a, _b in (("csv", "parquet"), ("jsonl", "csv"), ("parquet", "jsonl"), ("csv", "avro"), ("jsonl", "bson"), ("bson", "csv"), ("orc", "xml"), ("avro", "orc"), ("xml", "jsonl")):
    QUERIES[f"convert_{_a}_{_b}"] = _converted("orders", _a, _b, lambda df: df.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))
    ORACLE[f"convert_{_a}_{_b}"] = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


@_query("convert_nested", 'SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(value AS VARCHAR) AS value FROM events')
def _(spark, d):
    """Nested JSON lines to flat CSV."""
    from .sources import read, write

    at, to = f"{_folder(spark, 'nested')}.jsonl", f"{_folder(spark, 'flat')}.csv"
    write(nested_events(spark, d), at, "jsonl")
    reshape.convert(spark, at, to, flatten=True)
    return read(spark, to, delimiter=",", encoding="utf-8").select(F.col("event_id").cast("long").alias("event_id"), F.col("`who.user_id`").alias("user_id"), F.col("`who.what.value`").alias("value"))


@_query("flatten_columns", "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, d):
    flat = reshape.flatten_columns(nested_events(spark, d))
    return flat.select(F.col("event_id").cast("string").alias("event_id"), F.col("`who.user_id`").cast("string").alias("user_id"), F.col("`who.what.event_type`").alias("event_type"), F.col("`props.k`").cast("string").alias("k"))


@_query("unnest", "SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations")
def _(spark, d):
    return sel.unnest(turns(spark, d), "turns", "conv_id").withColumn("turn", F.col("turn").cast("long"))


def _files(spark: SparkSession, d: str, name: str, data: Callable[[list[list[str]]], bytes]) -> str:
    """One file of the nation table as made by other programs."""
    at = _local(_folder(spark, "file")) + name
    rows = [[str(v) for v in r] for r in _t(spark, d, "nation").orderBy("n_nationkey").collect()]
    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(at, "wb") as f:
        f.write(data([["n_nationkey", "n_name", "n_regionkey"], *rows]))
    return at


def _delimited(rows: list[list[str]], sep: str = ",") -> bytes:
    return "".join(sep.join(r) + "\n" for r in rows).encode()


def _zipped(data: bytes) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("table.csv", data)
    return out.getvalue()


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


def _nation(df: DataFrame) -> DataFrame:
    return df.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


_NATION = "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM nation"


def _read_file(name: str, make: Callable[[list[list[str]]], bytes], sql: str = _NATION, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        from .sources import read

        return _nation(read(spark, _files(spark, d, name, make), **options))

    return run


for _ext, _pack in (("gz", gzip.compress), ("bz2", bz2.compress), ("xz", lzma.compress), ("zip", _zipped), ("zst", _zstd)):
    QUERIES[f"read_csv_{_ext}"] = _read_file(f".csv.{_ext}", lambda rows, pack=_pack: pack(_delimited(rows)))
    ORACLE[f"read_csv_{_ext}"] = _NATION
for _name, _sep in (("semicolon", ";"), ("tab", "\t"), ("pipe", "|")):
    QUERIES[f"detect_{_name}"] = _read_file(".csv", lambda rows, sep=_sep: _delimited(rows, sep))
    ORACLE[f"detect_{_name}"] = _NATION
for _name, _enc, _tail in (("cp1251", "cp1251", "страна"), ("latin1", "latin-1", "é à"), ("utf16", "utf-16", "日本")):
    QUERIES[f"detect_{_name}"] = _read_file(".csv", lambda rows, enc=_enc, tail=_tail: _delimited([rows[0], *([a, b + " " + tail, c] for a, b, c in rows[1:])]).decode().encode(enc))
    ORACLE[f"detect_{_name}"] = _NATION.replace("n_name,", f"n_name || ' {_tail}' AS n_name,")
QUERIES["read_json_document"] = _read_file(".json", lambda rows: json.dumps({"about": "x", "rows": [dict(zip(rows[0], r)) for r in rows[1:]]}).encode(), tag="rows")
QUERIES["read_csv_fields"] = _read_file(".csv", lambda rows: _delimited(rows[1:]), fields=["n_nationkey", "n_name", "n_regionkey"])
ORACLE |= {"read_json_document": _NATION, "read_csv_fields": _NATION}


@_query("read_xlsx", _NATION)
def _(spark, d):
    from .sources import read, write

    at = _local(_folder(spark, "sheet")) + ".xlsx"
    os.makedirs(os.path.dirname(at), exist_ok=True)
    write(_t(spark, d, "nation"), at)
    return _nation(read(spark, at))


@_query("read_many_files", _NATION + " UNION ALL " + _NATION)
def _(spark, d):
    from .sources import read

    return _nation(read(spark, [_files(spark, d, f"-{k}.csv", _delimited) for k in range(2)]))


@_query("read_csv_lines", "SELECT o_orderkey, o_orderpriority || chr(10) || '\"x\", y' AS note FROM orders")
def _(spark, d):
    """Quoted values with line ends are found without being told."""
    from .sources import read, write

    at = f"{_folder(spark, 'lines')}.csv"
    write(_t(spark, d, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit('\n"x", y')).alias("note")), at)
    return read(spark, at).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "note")


@_query("file_types", "SELECT * FROM (VALUES ('a.csv', 'csv', NULL), ('b.TSV.gz', 'csv', 'gzip'), ('c.jsonl.zst', 'jsonl', 'zstd'), ('d.xlsx', 'xlsx', NULL), ('e.unknown', NULL, NULL)) t(name, format, codec)")
def _(spark, d):
    from .sources.detect import codec_of, format_of

    return spark.createDataFrame([(n, format_of(n), codec_of(n)) for n in ("a.csv", "b.TSV.gz", "c.jsonl.zst", "d.xlsx", "e.unknown")], "name string, format string, codec string")


@_query("split_files", "SELECT event_type AS part, event_id FROM events")
def _(spark, d):
    at = _folder(spark, "split")
    reshape.split(_t(spark, d, "events").select("event_id", "event_type"), at, "csv", fields="event_type")
    return spark.read.option("header", True).csv(at).select("part", F.col("event_id").cast("long").alias("event_id"))


@_query("split_files_by_size", "SELECT CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 5000) AS BIGINT) + 1 AS chunk, o_orderkey FROM orders")
def _(spark, d):
    at = _folder(spark, "split")
    reshape.split(_t(spark, d, "orders").select("o_orderkey"), at, "jsonl", size=5000, order=["o_orderkey"])
    return spark.read.json(at).select(F.col("chunk").cast("long").alias("chunk"), "o_orderkey")


@_query("ingest_local", "SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey OFFSET 2")
def _(spark, d):
    folder = _folder(spark, "ingest").removeprefix("file://")
    reshape.ingest(_t(spark, d, "region"), reshape.LocalJsonSink(folder), batch=2, skip=2, order=["r_regionkey"])
    return spark.read.schema("r_regionkey int, r_name string").json(folder)


@_query("streaming_frequency", "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def _(spark, d):
    from .streaming import frequency_stream, read_stream

    schema_ = _t(spark, d, "events").schema
    name = "freq_" + _folder(spark, "q").rsplit("-", 1)[1]
    stream = read_stream(spark, d, "parquet", schema_, pathGlobFilter="events*.parquet")
    q = frequency_stream(stream, "event_type").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of all orders' columns."""
    return stats.stats(_t(spark, d, "orders"))
