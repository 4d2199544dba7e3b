"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set are the hashes of its distinct ``n``-word shingles.  Documents with equal sets form a class, and only
classes are joined.  All sets are put into one global order, rare shingles first.  If two sets overlap in at least t
elements, their prefixes of length size - t + l share at least l elements: the l-prefix filter.  Each class picks its own
l by estimated cost: postings touched by the longer prefix, plus verifications expected from what l matches leave
(sum of posting lengths / l).  A pair of sizes n1 <= n2 that must overlap in t12 elements is a candidate when its
min(l)-prefixes share at least min(l) + t12 - t2: what follows a prefix of the larger set can add t2 - min(l) at most.  Sizes
are bounded by joining on the size's logarithm as well.  Candidates are verified on their whole sets, for which only texts
that a Bloom filter of the candidates' keys lets through are moved.

Order: chunks of documents count their shingles and hand on what they saw twice; these counts are summed, and the most
frequent ``max_frequent`` at most (a threshold is found from the histogram) are broadcast as 8-byte hashes, to be sorted
behind all others. The order is the same for all documents, so the result doesn't depend on it.

What is broadcast is bounded by ``max_frequent``; posting lists are joined as rows, not gathered; classes absorb groups of
copies before anything is paired.

Defined results: texts that are null or without words have an empty set and link with nothing; a text with fewer than
``n`` words has its whole word sequence as one element; repeated rows are separate documents with equal sets; a
null id is returned as null and never becomes a component's id while another id is there; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from ._common import LOWER_TABLE, as_bytes, cut, hashes, id_key, in_arrow, key_filter, rolling, slices
from .components import connected_components

MAX_L = 8


def shingle_set(text: bytes | None, n: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    if not text:
        return np.zeros(0, np.uint64)
    words = text.translate(LOWER_TABLE).split()
    if len(words) >= n:
        return np.unique(rolling(hashes(words), n))
    return np.array([xxh3_64_intdigest(b" ".join(words))], np.uint64) if words else np.zeros(0, np.uint64)


def least_overlap(size, percent: int):
    """Elements that a set of this size shares with any partner at least: ceil(percent * size / 100)."""
    return -(-percent * size // 100)


def frequent_shingles(docs: DataFrame, text_col: str, n: int, max_frequent: int, chunk=2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted hashes) and the base-2 logarithm of their counts."""

    def count(batches):
        held, seen, size = [], set(), 0

        def flush():
            nonlocal held, seen, size
            if held:
                s = np.sort(np.concatenate(held))
                at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
                c = np.diff(np.concatenate((at, [len(s)])))
                held, seen, size = [], set(), 0
                yield pa.RecordBatch.from_arrays([pa.array(s[at[c > 1]].view(np.int64)), pa.array(c[c > 1].astype(np.int64))], ["s", "c"])

        for batch in batches:
            for t in as_bytes(batch["t"]):
                key = xxh3_128_digest(t) if t else b""
                if key not in seen:
                    seen.add(key)
                    held.append(shingle_set(t, n))
                    size += len(held[-1])
                    if size >= chunk:
                        yield from flush()
        yield from flush()

    counts = docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(count, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).filter("c >= 8")
    counts = cut(counts.withColumn("b", F.floor(F.log2("c")).cast("int")))
    total, least = 0, 64
    for r in sorted(counts.groupBy("b").count().collect(), reverse=True):  # at most 63 rows
        total += r["count"]
        if total > max_frequent:
            break
        least = r.b
    rows = counts.filter(F.col("b") >= least).select("s", "b").toPandas().sort_values("s", key=lambda s: s.to_numpy(np.int64, copy=True).view(np.uint64))
    return rows["s"].to_numpy(np.int64, copy=True).view(np.uint64), rows["b"].to_numpy(np.uint8)


def _signatures(order, n: int, percent: int):
    def sign(text: pa.Array) -> pa.Array:
        hot, rank = order.value
        size, key, prefix = [], [], []
        for t in as_bytes(text):
            s = shingle_set(t, n)
            size.append(len(s))
            key.append(xxh3_128_digest(s.tobytes()))
            length = min(len(s), len(s) - least_overlap(len(s), percent) + MAX_L)
            if len(hot) and len(s):
                at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                often = np.where(hot[at] == s, rank[at], 0)
                if often.any():
                    s = s[np.argsort(often, kind="stable")]
            prefix.append(s[:length].view(np.int64))
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
        flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["n", "key", "prefix"])

    return arrow_udf(sign, "struct<n:bigint,key:binary,prefix:array<bigint>>").asNondeterministic()


def _set_udf(n: int):
    return arrow_udf(lambda text: in_arrow((shingle_set(t, n).tobytes() for t in as_bytes(text)), pa.binary()), "binary").asNondeterministic()


def _overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in ((x, y) for p, q in zip(slices(a), slices(b)) for x, y in zip(p.to_pylist(), q.to_pylist())):
        out.append(len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)))
    return pa.array(out, pa.int64())


def _choose(percent: int, verify_cost: float):
    """l per class from its postings: (position, document frequency) of the shared elements in its longest prefix."""

    def choose(n: pa.Array, pos: pa.Array, df: pa.Array) -> pa.Array:
        out = []
        for size, ps, ds in zip(n.to_pylist(), pos.to_pylist(), df.to_pylist()):
            t = least_overlap(size, percent)
            best = None
            for l in range(1, min(MAX_L, t) + 1):  # noqa: E741
                touched = sum(d - 1 for p, d in zip(ps, ds) if p < size - t + l)
                cost = touched + verify_cost * touched / l
                if best is None or cost < best[0]:
                    best = (cost, l)
            out.append(best[1])
        return pa.array(out, pa.int32())

    return arrow_udf(choose, "int").asNondeterministic()


def jaccard_classes(docs: DataFrame, id_col="doc_id", text_col="text", n=5, percent=90, max_frequent=200_000, verify_cost=20.0):
    """Classes (c, key, n, m, first row), membership (id, x, key, n; x: the text's hash) and links between classes (a, b)."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(frequent_shingles(docs, text_col, n, max_frequent))
    text = F.col(f"`{text_col}`")
    signed = docs.select(F.col(f"`{id_col}`").alias("id"), id_key(id_col).alias("k"), F.xxhash64(text).alias("x"), _signatures(order, n, percent)(text).alias("s")).select("id", "k", "x", "s.*")
    signed = cut(signed)
    classes = signed.filter("n > 0").groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "x")).alias("first"), F.min(F.struct("k", "x", "n", "prefix")).alias("r"))
    classes = cut(classes.select("key", "m", "first", F.col("r.k").alias("rk"), F.col("r.x").alias("rx"), F.col("r.n").alias("n"), F.col("r.prefix").alias("prefix")).withColumn("c", F.monotonically_increasing_id()))
    members = signed.select("id", "x", "n", "key")

    posts = classes.select("c", F.posexplode("prefix").alias("p", "s"))
    shared = posts.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1").withColumnRenamed("s", "ss")
    shared = cut(shared)
    posts = posts.join(shared, F.col("s") == F.col("ss")).groupBy("c").agg(F.collect_list(F.struct("p", "df", "s")).alias("ps"))
    posts = posts.join(classes.select(F.col("c").alias("cc"), "n"), F.col("c") == F.col("cc")).drop("cc")
    posts = posts.withColumn("l", _choose(percent, verify_cost)("n", F.col("ps.p"), F.col("ps.df")))
    t = F.ceil(F.col("n") * percent / 100)
    rows = posts.select("c", "n", "l", F.inline("ps")).withColumn("t", t).filter("p < n - t + l")
    rows = cut(rows.select("s", "c", "n", "l", F.greatest(F.lit(1), F.col("p") - (F.col("n") - F.col("t")) + 1).cast("int").alias("v"), F.floor(F.log("n") / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int").alias("z")))
    small = rows.select("s", "z", *[F.col(x).alias(x + "1") for x in ("c", "n", "l", "v")])
    large = rows.select("s", F.explode(F.array("z", F.col("z") - 1)).alias("z"), *[F.col(x).alias(x + "2") for x in ("c", "n", "l", "v")])
    pairs = small.join(large, ["s", "z"]).filter("(n1 < n2 or (n1 = n2 and c1 < c2)) and 100 * n1 >= %d * n2 and greatest(v1, v2) <= least(l1, l2)" % percent)
    pairs = pairs.groupBy("c1", "c2").agg(F.count("*").alias("shared"), F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.first(F.least("l1", "l2")).alias("l"))
    need = F.ceil((F.col("n1") + F.col("n2")) * percent / (100 + percent)) - F.ceil(F.col("n2") * percent / 100)
    pairs = cut(pairs.filter(F.col("shared") >= F.col("l") + F.greatest(need, F.lit(0))).select("c1", "c2", "n1", "n2"))

    wanted = pairs.select(F.col("c1").alias("c")).union(pairs.select(F.col("c2").alias("c"))).distinct()
    reps = cut(classes.select("c", "rk", "rx").join(wanted, "c"))
    may = key_filter(reps, "rk", "rx")
    sets = docs.select(id_key(id_col).alias("k"), F.xxhash64(text).alias("x"), text.alias("t")).filter(may("k", "x")).join(reps, (F.col("k") == F.col("rk")) & (F.col("x") == F.col("rx"))).select("c", "t").withColumn("set", _set_udf(n)(F.col("t"))).select("c", "set")
    sets = cut(sets)
    checked = pairs.join(sets.select(F.col("c").alias("c1"), F.col("set").alias("set1")), "c1").join(sets.select(F.col("c").alias("c2"), F.col("set").alias("set2")), "c2")
    checked = checked.select("c1", "c2", "n1", "n2", arrow_udf(_overlap, "bigint").asNondeterministic()("set1", "set2").alias("o"))
    links = cut(checked.filter(f"100 * o >= {percent} * (n1 + n2 - o)").select(F.col("c1").alias("a"), F.col("c2").alias("b")).distinct())
    return classes, members, links


def similar_rows(docs: DataFrame, id_col="doc_id", text_col="text", n=5, percent=90, **options) -> DataFrame:
    """(id, x, n, similar, first), one row per input row: x is the text's xxhash64, first (none, id, x) the row that stands for
    the component, that with the smallest id, then hash; one without an id only where no row has one. Null for an empty set."""
    classes, members, links = jaccard_classes(docs, id_col, text_col, n, percent, **options)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("c").alias("b"), "m")
    near = both.join(sizes, "b").groupBy("a").agg(F.sum("m").alias("near")).withColumnRenamed("a", "c")
    roots = connected_components(links, "a", "b").withColumnRenamed("node", "c")
    firsts = roots.join(classes.select("c", "first"), "c").groupBy("root").agg(F.min("first").alias("component"))
    about = classes.select("c", "key", "m", "first").join(near, "c", "left").join(roots.join(firsts, "root").select("c", "component"), "c", "left")
    about = about.select("key", (F.col("m") - 1 + F.coalesce("near", F.lit(0))).alias("similar"), F.coalesce("component", "first").alias("component"))
    return members.join(about, "key", "left").select("id", "x", "n", "similar", F.col("component").alias("first"))


def similar_documents(docs: DataFrame, id_col="doc_id", text_col="text", n=5, percent=90, **options) -> DataFrame:
    """(doc_id, n_shingles, n_similar, component_id), one row per input row."""
    out = similar_rows(docs, id_col, text_col, n, percent, **options)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("first.id", "id").cast("long").alias("component_id"))


def op7_ngram_jaccard_join(spark, sf_dir):
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r(doc_id, root) AS (SELECT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY 1),
k AS (SELECT a AS doc_id, count(*) AS n FROM l GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(k.n, 0) AS BIGINT) AS n_similar, coalesce(c.root, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""
