"""Quality rules: document statistics and cross-document line frequency.

Base statistics come from one Arrow UDF over the whole text.  The method proper counts lines across documents:
``\n``-split lines are normalised (lower case; each run of characters that are neither letters nor digits becomes one
space; digits become 0), hashed, and for every (host, line) the number of distinct documents is counted, exact copies of a text
counting once.  A line in more than ``max(min_docs, max_share * documents of the host)`` documents of a host is
boilerplate there and its words are removed; a document that keeps fewer than ``min_words`` words or less than
``min_left`` of its words is depleted and rejected.

Scale: per document lines are made distinct before anything moves, the shuffle carries hashes only, and the distinct
count shuffles first by (host, line, text) and then, pre-aggregated, by (host, line): a line that a third of all
documents hold is one partial row a task.  Texts are never shuffled.

Defined results: a null text has no words and fails the base rule; a null host is a host of its own; rows that repeat
an id and text give the same verdict each; an empty table gives no rows; further columns are ignored here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._common import apart, as_bytes, fresh, hashes, id_key, rolling

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOLS = b"#*$%&|<>"
_CONT = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\r\x0b\x0c"


def text_stats(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    chars = len(text.translate(None, _CONT + _SPACE))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat, n = 0, len(words) - 4
    if n > 1:
        h = rolling(hashes(words), 5)
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        if len(count) < n:
            mark = np.zeros(n + 5, np.int32)
            at = np.flatnonzero(count[back] > 1)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + 5, -1)
            repeat = int((np.cumsum(mark) > 0).sum())
    return len(words), chars, symbols, dup, repeat


def _stats(text: pa.Array) -> pa.Array:
    rows = np.array([text_stats(t) for t in as_bytes(text)], np.int64).reshape(-1, len(STATS))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(STATS))], STATS)


def normalised_line(line):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{Nd}", "0"), r"[^\p{L}\p{N}]+", " "))


def _word_count(line):
    return F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def frequent_lines(docs: DataFrame, text_col="text", host_col="source", min_docs=10, max_share=0.01) -> DataFrame:
    """(host, h1, h2, n_docs) of the lines above the host's limit."""
    host, text = F.col(f"`{host_col}`").cast("string"), F.col(f"`{text_col}`")
    lines = F.array_distinct(F.transform(F.split(text, "\n"), lambda x: normalised_line(x)))
    exploded = docs.select(host.alias("host"), F.xxhash64(text).alias("t"), F.explode(lines).alias("line")).filter("line <> ''")
    exploded = exploded.select("host", "t", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))
    n_lines = exploded.groupBy("host", "h1", "h2", "t").agg(F.lit(1).alias("one")).groupBy("host", "h1", "h2").agg(F.count("*").alias("n_docs"))
    hosts = docs.select(host.alias("hh")).groupBy("hh").agg(F.count("*").alias("host_docs"))
    limit = F.greatest(F.lit(float(min_docs)), F.lit(float(max_share)) * F.col("host_docs"))
    return n_lines.filter(F.col("n_docs") > min_docs).join(hosts, F.col("host").eqNullSafe(F.col("hh"))).filter(F.col("n_docs") > limit).select("host", apart(F.col("h1")).alias("h1"), apart(F.col("h2")).alias("h2"), "n_docs")


def quality_rules(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", min_docs=10, max_share=0.01, min_words=10, min_left=0.3) -> DataFrame:
    """(id, the five statistics, n_removed words in frequent lines, base_failed, kept), one row per input row."""
    host, text = F.col(f"`{host_col}`").cast("string"), F.col(f"`{text_col}`")
    stats_udf = arrow_udf(_stats, "struct<" + ",".join(f"{c}:bigint" for c in STATS) + ">").asNondeterministic()
    stats = docs.select(F.col(f"`{id_col}`"), id_key(id_col).alias("k"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("t"), stats_udf(text).alias("s")).select(f"`{id_col}`", "k", "t", "s.*")
    per_line = F.transform(F.split(text, "\n"), lambda x: F.struct(normalised_line(x).alias("line"), _word_count(x).alias("w")))
    lines = docs.select(host.alias("dh"), id_key(id_col).alias("k"), F.xxhash64(text).alias("t"), F.posexplode(per_line).alias("p", "x")).filter("x.line <> ''")
    lines = lines.select("dh", "k", "t", "p", F.xxhash64("x.line").alias("g1"), F.hash("x.line").alias("g2"), F.col("x.w").alias("w"))
    hot = frequent_lines(docs, text_col, host_col, min_docs, max_share)
    found = lines.join(hot, (F.col("g1") == F.col("h1")) & (F.col("g2") == F.col("h2")) & F.col("dh").eqNullSafe(F.col("host")))
    # rows that repeat an id and a text have the same lines: each position counts once
    gone = found.groupBy("k", "t", "p").agg(F.max("w").alias("w")).groupBy("k", "t").agg(F.sum("w").alias("n_removed"))
    out = stats.join(gone, ["k", "t"], "left")
    removed = F.coalesce(F.col("n_removed"), F.lit(0)).cast("long")
    left = F.col("n_words") - removed
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed & (left >= min_words) & (left >= F.lit(float(min_left)) * F.col("n_words"))
    return out.select(f"`{id_col}`", *STATS, failed.alias("base_failed"), kept.alias("kept"), removed.alias("n_removed"))


def without_lines(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", min_docs=10, max_share=0.01) -> DataFrame:
    """``docs`` with frequent lines taken out of the text, all other columns as they were."""
    host, text = F.col(f"`{host_col}`").cast("string"), F.col(f"`{text_col}`")
    key, mark, k, t, gone_at = fresh(docs, "__dk", "__dt", "__k", "__t", "__gone")
    hot = frequent_lines(docs, text_col, host_col, min_docs, max_share)
    lines = docs.select(host.alias("dh"), id_key(id_col).alias(k), F.xxhash64(text).alias(t), F.posexplode(F.split(text, "\n")).alias("p", "x"))
    lines = lines.withColumn("line", normalised_line(F.col("x"))).filter("line <> ''").withColumns({"g1": F.xxhash64("line"), "g2": F.hash("line")})
    gone = lines.join(hot, (F.col("g1") == F.col("h1")) & (F.col("g2") == F.col("h2")) & F.col("dh").eqNullSafe(F.col("host"))).groupBy(k, t).agg(F.collect_set("p").alias(gone_at))
    keyed = docs.withColumn(key, id_key(id_col)).withColumn(mark, F.xxhash64(text))
    joined = keyed.join(gone, (F.col(key) == F.col(k)) & (F.col(mark) == F.col(t)), "left")
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone_at, i))
    return joined.withColumn(text_col, F.when(F.col(gone_at).isNull(), text).otherwise(F.array_join(kept, "\n"))).select(*[f"`{c}`" for c in docs.columns])


def op2_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return quality_rules(docs)


OP2_SQL = r"""
WITH w AS (SELECT doc_id, source, text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS p FROM documents WHERE text IS NOT NULL),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
vr AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM v) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM vr) GROUP BY 1),
nl AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '\p{Nd}', '0', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS norm FROM l),
freq AS (SELECT source, norm, count(DISTINCT text) AS n_docs FROM nl WHERE norm <> '' GROUP BY 1, 2),
hosts AS (SELECT source, count(*) AS host_docs FROM documents GROUP BY 1),
hot AS (SELECT f.source, f.norm FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n_docs > greatest(10.0, 0.01 * h.host_docs)),
gone AS (SELECT nl.doc_id, sum(len(regexp_extract_all(nl.line, '[^\x20\x09-\x0D]+'))) AS n FROM nl JOIN hot ON nl.source IS NOT DISTINCT FROM hot.source AND nl.norm = hot.norm GROUP BY 1),
s AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed
  FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed >= 10 AND n_words - n_removed >= 0.3 * n_words) AS kept, n_removed
FROM s
"""
