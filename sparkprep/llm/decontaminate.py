"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words, not bytes: a text becomes a vector of 64-bit word hashes.  All patterns of one length m form
a matcher with a *shift table* over blocks of two words (how far the window may jump when its last block ends a known
block m-2-j words before the pattern's end), *suffix buckets* (patterns by hash of their last block, thinned by the
hash of their first block) and a *direct comparison* of the words.  Texts of a batch are laid end to end, separated by
a word that no pattern holds, and scanned in lanes that advance side by side in numpy, each by its own shifts.

Patterns are windows of ``window`` consecutive words of a benchmark item; an item of fewer words is one window.
Only patterns are broadcast: in blocks of ``block_bytes`` of benchmark text (counted before anything is collected).
With more than one block, every block is run against all documents and the findings are merged per document by one
shuffle of the findings; with one block there is no shuffle at all.

Defined results: a null text has no words; empty tables give no rows (documents) or no findings (benchmark); repeated
documents are judged each; repeated or identical items each count by their own id; items without words never occur; a
single item larger than a block is a block of its own.  Other columns pass through, whatever their names.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._common import ALNUM_TABLE, as_bytes, fresh, hashes, id_key, mix

MATCH_TYPE = "struct<n_words:bigint,n_hit:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<int>>"
_R = np.uint64(0x9E3779B97F4A7C15)
_STOP = b"\x00"  # no word holds this byte


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split() if text else []


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


class WuManber:
    """Search for patterns of one length m (in words). ``find`` gives all (start, pattern number)."""

    LANES = 1024

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        self.patterns, self.m = patterns, len(patterns[0])
        self.b = min(2, self.m)
        h = hashes([w for p in patterns for w in p]).reshape(len(patterns), self.m)
        blocks = self._block(h.T).T  # pattern x (m - b + 1)
        jumps = self.m - self.b
        self.bits = max(10, int(np.ceil(np.log2(blocks.size * 8))))
        self.shift = np.full(1 << self.bits, jumps + 1, np.int32)
        np.minimum.at(self.shift, self._slot(blocks), np.broadcast_to(np.arange(jumps, -1, -1, dtype=np.int32), blocks.shape))
        self.buckets: dict[int, list[int]] = {}
        for k, x in enumerate((blocks[:, -1] ^ mix(blocks[:, 0])).tolist()):
            self.buckets.setdefault(x, []).append(k)
        self.keys = np.sort(np.fromiter(self.buckets, np.uint64, len(self.buckets)))

    def _block(self, h: np.ndarray) -> np.ndarray:
        return mix(h) if self.b == 1 else mix(h[:-1] * _R + h[1:])

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    def _at(self, h: np.ndarray, i: np.ndarray) -> np.ndarray:
        return mix(h[i]) if self.b == 1 else mix(h[i] * _R + h[i + 1])

    def candidates(self, h: np.ndarray) -> np.ndarray:
        """Starts whose last block is some pattern's last block, and first block is that pattern's first."""
        n = len(h) - self.m + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        step = max(64, -(-n // self.LANES))
        pos = np.arange(0, n, step, dtype=np.int64)
        end = np.minimum(pos + step, n)
        found = []
        while len(pos):
            last = self._at(h, pos + (self.m - self.b))
            jump = self.shift[self._slot(last)]
            zero = jump == 0
            if zero.any():
                p, x = pos[zero], last[zero]
                x = x ^ mix(self._at(h, p))
                near = self.keys[np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)] == x
                found.append((p[near], x[near]))
                jump = np.where(zero, 1, jump)
            pos = pos + jump
            on = pos < end
            if not on.all():
                pos, end = pos[on], end[on]
        if not found:
            return np.zeros(0, np.int64)
        return np.sort(np.concatenate([p for p, _ in found]))

    def find(self, words: list[bytes], h: np.ndarray) -> list[tuple[int, int]]:
        at = self.candidates(h)
        if not len(at):
            return []
        key = self._at(h, at + (self.m - self.b)) ^ mix(self._at(h, at))
        out = []
        for p, x in zip(at.tolist(), key.tolist()):
            text = tuple(words[p : p + self.m])
            out += [(p, k) for k in self.buckets.get(x, ()) if self.patterns[k] == text]
        return out


class PatternBlock:
    """All windows of a block of benchmark items: one matcher a length, and the items of each window."""

    def __init__(self, items: list[tuple[int, bytes | None]], window: int):
        owners: dict[tuple[bytes, ...], set[int]] = {}
        for number, text in items:
            for w in windows_of(words_of(text), window):
                owners.setdefault(w, set()).add(number)
        by_length = groupby(sorted(owners, key=len), key=len)
        self.groups = [(m, list(p)) for m, p in by_length]
        self.owners = [[sorted(owners[p]) for p in ps] for _, ps in self.groups]
        self._matchers: list[WuManber] | None = None

    def __getstate__(self):
        return {"groups": self.groups, "owners": self.owners, "_matchers": None}

    def matchers(self) -> list[WuManber]:
        if self._matchers is None:
            self._matchers = [WuManber(ps) for _, ps in self.groups]
        return self._matchers

    def search(self, texts: list[list[bytes]]) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
        """For each text (as words): words hit, their maximal spans, and the numbers of items found."""
        flat: list[bytes] = []
        starts = []
        for ws in texts:
            starts.append(len(flat))
            flat += ws
            flat.append(_STOP)
        bounds = np.array(starts + [len(flat)], np.int64)
        items: list[set[int]] = [set() for _ in texts]
        cover = np.zeros(len(flat) + 1, np.int32)
        h = hashes(flat)
        for matcher, owners in zip(self.matchers(), self.owners):
            hits = matcher.find(flat, h)
            for p, d in zip(hits, np.searchsorted(bounds, [p for p, _ in hits], "right") - 1):
                items[d].update(owners[p[1]])
                cover[p[0]] += 1
                cover[p[0] + matcher.m] -= 1
        on = (np.cumsum(cover[:-1]) > 0).astype(np.int8)
        edges = np.diff(np.concatenate(([0], on, [0])).astype(np.int8))
        a, b = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        doc = np.searchsorted(bounds, a, "right") - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        for d, x, y in zip(doc.tolist(), a.tolist(), b.tolist()):
            spans[d].append((x - starts[d], y - starts[d]))
        return [(sum(y - x for x, y in s), s, sorted(i)) for s, i in zip(spans, items)]


def _matcher(block, chunk_words: int = 400_000):
    @arrow_udf(MATCH_TYPE)
    def match(text: pa.Array) -> pa.Array:
        rows, pending, size = [], [], 0

        def flush():
            for ws, (hit, spans, items) in zip(pending, block.value.search(pending)):
                rows.append({"n_words": len(ws), "n_hit": hit, "spans": [{"start": x, "end": y} for x, y in spans], "items": items})

        for t in as_bytes(text):
            pending.append(words_of(t))
            size += len(pending[-1])
            if size > chunk_words:
                flush()
                pending, size = [], 0
        flush()
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.int32()))])
        return pa.array(rows, kind)

    return match.asNondeterministic()


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 8,
    out: str = "match",
    block_bytes: int = 1 << 20,
) -> DataFrame:
    """``docs`` with a column ``out``: struct(n_words, n_hit, spans in words, items as array of item ids in text form)."""
    spark = docs.sparkSession
    (out,) = fresh(docs, out)
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).filter("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    parts = []
    for b in range(n_blocks):
        some = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == b)
        ids: dict[str, int] = {}
        rows = [(ids.setdefault(r.i, len(ids)), r.t.encode()) for r in some.toLocalIterator()]
        block = spark.sparkContext.broadcast(PatternBlock(rows, window))
        names = F.lit(list(ids) or [""]).cast("array<string>")
        got = docs.withColumn(out, _matcher(block)(F.col(f"`{text_col}`")))
        m = F.col(f"`{out}`")
        found = F.transform(m["items"], lambda x: F.get(names, x))
        parts.append(got.withColumn(out, F.struct(m["n_words"].alias("n_words"), m["n_hit"].alias("n_hit"), m["spans"].alias("spans"), found.alias("items"))))
    if n_blocks == 1:
        return parts[0]
    ks, xs, one, two, rk, rx, rs, ri = fresh(docs, "__k", "__x", "__one", "__two", "__rk", "__rx", "__rs", "__ri")
    # Several blocks: findings (not texts) are merged per document.
    key = [id_key(id_col).alias("k"), F.coalesce(F.xxhash64(f"`{text_col}`"), F.lit(0)).alias("x")]
    some = [p.select(*key, F.col(f"`{out}`.spans").alias("s"), F.col(f"`{out}`.items").alias("i")).filter(F.size("i") > 0) for p in parts[1:]]
    rest = some[0]
    for p in some[1:]:
        rest = rest.union(p)
    rest = rest.groupBy("k", "x").agg(F.array_sort(F.flatten(F.collect_set("s"))).alias(rs), F.array_distinct(F.flatten(F.collect_set("i"))).alias(ri))
    m = F.col(f"`{out}`")
    spans = F.array_sort(F.concat(m["spans"], F.coalesce(F.col(rs), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))))
    merged = F.aggregate(
        spans,
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )
    first = parts[0].withColumn(ks, key[0]).withColumn(xs, key[1])
    joined = first.join(rest.withColumnRenamed("k", rk).withColumnRenamed("x", rx), (F.col(ks) == F.col(rk)) & (F.col(xs) == F.col(rx)), "left")
    joined = joined.withColumn(one, merged).withColumn(two, F.array_union(m["items"], F.coalesce(F.col(ri), F.expr("cast(array() as array<string>)"))))
    hit = F.aggregate(F.col(one), F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return joined.withColumn(out, F.struct(m["n_words"].alias("n_words"), hit.alias("n_hit"), F.col(one).alias("spans"), F.col(two).alias("items"))).select(*[f"`{c}`" for c in parts[0].columns])


def op4_benchmark_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "match.*")
    ids = F.array_join(F.array_sort("items"), ",")
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(8, len(ws)) AS m, array_to_string(ws[i:i + least(8, len(ws)) - 1], ' ') AS win
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 7, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT m FROM p),
d AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS win
      FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, lens WHERE len(ws) >= m)),
h AS (SELECT d.doc_id, d.i, d.m, p.item_id FROM d JOIN p ON d.win = p.win AND d.m = p.m),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(len(w.ws), 0) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(t.n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
"""
