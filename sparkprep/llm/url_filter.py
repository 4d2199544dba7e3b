"""Temporal list join: captures against dated domain lists, as the lists stood at fetch time.

Dated entries (list, domain, date, action) become validity intervals [from, to): several actions on one date count as an
addition if any is one, repeated states are dropped, an addition holds until the next removal. A host matches an entry for itself
or for any parent domain. The as-of join is an equi-join on (domain, period of days) with a date condition: intervals are
laid out over the periods they touch, up to the last fetch date, so that a very common domain spreads over time.

Captures are first reduced to distinct (host, day); verdicts are materialised and joined back, so a host with a third of
all captures costs one row a day up to that join, which adaptive execution may split.

Defined results: a null or hostless url, or a null fetch date, matches nothing; entries with a null in any field are
ignored; repeated captures are judged each; empty lists block nothing; an empty table gives no rows; other columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, fresh

PERIOD = 32  # days


def host_of(url):
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def validity(entries: DataFrame) -> DataFrame:
    """(list, domain, since, until) of entries (list, domain, date, action 'add' or 'remove'); until is null while open."""
    e = entries.select("list", F.lower("domain").alias("domain"), F.col("date").cast("date").alias("date"), (F.col("action") == "add").alias("on")).dropna()
    e = e.groupBy("list", "domain", "date").agg(F.max("on").alias("on"))
    w = Window.partitionBy("list", "domain").orderBy("date")
    e = e.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).filter("on <> was")
    return e.withColumn("until", F.lead("date").over(w)).filter("on").select("list", "domain", F.col("date").alias("since"), "until")


def match_lists(captures: DataFrame, entries: DataFrame, url_col="url", fetched_col="fetched", out="lists") -> DataFrame:
    """``captures`` with a column ``out``: sorted names of the lists that held the host or a parent domain at fetch time."""
    (out, host, day, h, d) = fresh(captures, out, "__host", "__day", "__h", "__d")
    c = captures.withColumn(host, host_of(F.col(f"`{url_col}`"))).withColumn(day, F.col(f"`{fetched_col}`").cast("date"))
    seen = c.select(F.col(host).alias("h"), F.col(day).alias("d")).dropna().distinct()
    seen = cut(seen)
    last = seen.agg(F.max("d")).first()[0]
    period = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / PERIOD).cast("int")
    labels = F.split("h", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    probes = seen.withColumn("p", period(F.col("d"))).withColumn("domain", F.explode(parents))
    spans = validity(entries).filter(F.col("since") <= F.lit(last))
    to = F.least(F.date_sub(F.coalesce("until", F.lit(last)), 1), F.lit(last))
    to = F.when(F.col("until").isNull(), F.lit(last)).otherwise(to)
    spans = spans.withColumn("p", F.explode(F.sequence(period(F.col("since")), F.greatest(period(F.col("since")), period(to)))))
    hits = probes.join(spans, ["domain", "p"]).filter((F.col("since") <= F.col("d")) & (F.col("until").isNull() | (F.col("d") < F.col("until"))))
    verdicts = cut(hits.groupBy("h", "d").agg(F.array_sort(F.collect_set("list")).alias(out)))
    verdicts = verdicts.select(F.col("h").alias(h), F.col("d").alias(d), out)
    joined = c.join(verdicts, (F.col(host) == F.col(h)) & (F.col(day) == F.col(d)), "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.array().cast("array<string>"))).drop(host, day, h, d)


def _number(text):
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def op5_url_filters(spark, sf_dir):
    """Pages have no fetch date and no lists come with them; both are derived from page ids and hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    hosts = pages.select(host_of(F.col("url")).alias("h")).dropna().distinct()
    labels = F.split("h", r"\.")
    domains = hosts.select("h", F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 2), 3), ".").alias("parent")).withColumn("n", _number(F.col("h")))
    start = F.date_add(F.lit("2023-12-01").cast("date"), F.pmod("n", F.lit(300)).cast("int"))
    one = domains.filter("n % 4 = 0").select(F.lit("spam").alias("list"), F.col("h").alias("domain"), start.alias("date"), F.lit("add").alias("action"))
    off = domains.filter("n % 12 = 0").select(F.lit("spam"), "h", F.date_add(start, 45), F.lit("remove"))
    two = domains.filter("n % 5 = 1").select(F.lit("adult"), "parent", start, F.lit("add"))
    again = domains.filter("n % 24 = 0").select(F.lit("spam"), "h", F.date_add(start, 90), F.lit("add"))
    got = match_lists(pages.withColumn("fetched", fetched), one.union(off).union(two).union(again))
    return got.select("page_id", F.col("fetched").cast("string").alias("fetched"), F.array_join("lists", ",").alias("lists"), (F.size("lists") > 0).alias("blocked"))


OP5_SQL = r"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched,
  nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS h FROM pages),
hosts AS (SELECT h, array_to_string(string_split(h, '.')[greatest(1, len(string_split(h, '.')) - 2):], '.') AS parent, CAST('0x' || substr(md5(h), 1, 6) AS BIGINT) AS n FROM (SELECT DISTINCT h FROM c WHERE h IS NOT NULL)),
s AS (SELECT *, DATE '2023-12-01' + CAST(n % 300 AS INTEGER) AS d FROM hosts),
e AS (SELECT 'spam' AS list, h AS domain, d AS date, 1 AS act FROM s WHERE n % 4 = 0 UNION ALL SELECT 'spam', h, d + 45, 0 FROM s WHERE n % 12 = 0
  UNION ALL SELECT 'adult', parent, d, 1 FROM s WHERE n % 5 = 1 UNION ALL SELECT 'spam', h, d + 90, 1 FROM s WHERE n % 24 = 0),
x AS (SELECT c.page_id, e.list, max_by(e.act, e.date * 2 + e.act) AS act
  FROM (SELECT list, domain, CAST(date - DATE '2000-01-01' AS BIGINT) AS date, date AS day, act FROM e) e JOIN c ON (c.h = e.domain OR ends_with(c.h, '.' || e.domain)) AND e.day <= c.fetched GROUP BY c.page_id, e.list, e.domain),
m AS (SELECT page_id, string_agg(list, ',' ORDER BY list) AS lists FROM (SELECT DISTINCT page_id, list FROM x WHERE act = 1) GROUP BY 1)
SELECT c.page_id, CAST(c.fetched AS VARCHAR) AS fetched, coalesce(m.lists, '') AS lists, m.lists IS NOT NULL AS blocked FROM c LEFT JOIN m ON m.page_id = c.page_id
"""
