"""Removal of repeated word spans with suffix automata of reference shards.

``remove_spans`` takes a reference: shards of bounded size become suffix automata over words, each is broadcast, documents
stream through it, and the matching statistics (length of the longest match ending at each word) give the maximal spans
of at least ``window`` words, which are removed.

``dedup_corpus`` is the same against the corpus itself, where a window of ``window`` words goes if it also starts earlier.
One set of broadcast automata can't hold a corpus, so the shards are addressed by content:

1. Every window has an anchor, the least hash among its k-word pieces; equal windows have equal anchors. Per anchor the
   first document (its owner) and the number of documents are aggregated, with partial aggregation before the shuffle.
2. Words around anchors that several documents have form regions. A document's regions go to the owners of their
   anchors, as does the owner's own region text: the owner's automaton is the reference shard. A join moves both, so
   adaptive execution can split an owner with very many followers over tasks, each with a copy of that small shard.
3. Matching statistics against the owner's automaton decide every window that the owner holds. Windows it doesn't hold,
   though it has the anchor, can only repeat in documents between: their 128-bit hashes get a minimum (document, start) by
   partial aggregation, and a join back tells which start later.
4. Windows that repeat within one document are found in that document.

The automaton compares words themselves; only step 3's remainder and the choice of candidates rest on hashes (128 and 64 bits).

Defined results: null texts and texts under ``window`` words keep all; repeated rows with one id and text count
as the same document's, and keep their words alike, unless an earlier document takes them; rows with one id and different texts
are different documents, in the order of their texts' hashes; so are all rows without an id, which sort before all others, equal
texts among them too: one keeps its words; an empty table gives no rows; other columns pass through, whatever their names; very long texts are handled in linear time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._common import NULL_KEY, apart, as_bytes, cut, fresh, hashes, id_key, in_arrow, rolling, slices, sliding_min, stage

ANCHOR = 8  # words of an anchor piece


class SuffixAutomaton:
    """Suffix automaton of word sequences; ``None`` symbols separate sequences and match nothing."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        self.last = 0

    def extend(self, symbol) -> None:
        nxt, link, length = self.next, self.link, self.len
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        p = self.last
        while p != -1 and symbol not in nxt[p]:
            nxt[p][symbol] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][symbol]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(symbol) == q:
                    nxt[p][symbol] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def add(self, words: list[bytes]) -> None:
        for w in words:
            self.extend(w)
        self.last = 0  # a new sequence starts; generalised automaton without separators

    def statistics(self, words: list[bytes]) -> list[int]:
        """Length of the longest suffix of words[:i + 1] that occurs in the automaton, for each i."""
        nxt, link, length = self.next, self.link, self.len
        state, n, out = 0, 0, []
        for w in words:
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(w)
            if to is None:
                n = 0
            else:
                state = to
                n += 1
            out.append(n)
        return out


def build(sequences: list[list[bytes]]) -> SuffixAutomaton:
    """Automaton of sequences. They are joined by separators no text word equals, which keeps construction plain."""
    a = SuffixAutomaton()
    for k, s in enumerate(sequences):
        for w in s:
            a.extend(w)
        a.extend(-k - 1)
    return a


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Words covered by windows at these starts."""
    mark = np.zeros(n_words + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + window, -1)
    return np.cumsum(mark[:-1]) > 0


def window_anchors(words: list[bytes], window: int) -> np.ndarray:
    """Anchor of each window: least hash of its pieces."""
    k = min(ANCHOR, window)
    return sliding_min(rolling(hashes(words), k), window - k + 1)


def self_repeats(words: list[bytes], window: int) -> np.ndarray:
    """Starts of windows that also start earlier in the same words (compared by hash, then as words)."""
    h = rolling(hashes(words), window)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.flatnonzero(s[1:] == s[:-1])
    if not len(same):
        return same
    group = np.concatenate(([True], s[1:] != s[:-1]))
    head = order[np.maximum.accumulate(np.where(group, np.arange(len(s)), 0))]
    out = [i for i, j in zip(order[same + 1].tolist(), head[same + 1].tolist()) if words[i : i + window] == words[j : j + window]]
    return np.array(sorted(out), np.int64)


def kept_text(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked as gone and without the white space after each of them."""
    b = np.frombuffer(text, np.uint8)
    space = (b == 0x20) | ((b >= 9) & (b <= 13))
    first = ~space & np.concatenate(([True], space[:-1]))
    number = np.cumsum(first) - 1  # the word a byte belongs to or follows
    drop = np.concatenate((gone, [False]))[np.maximum(number, 0)] & (number >= 0)
    return b[~drop].tobytes()


def _runs(ok: np.ndarray) -> list[tuple[int, int]]:
    e = np.diff(np.concatenate(([0], ok.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(e == 1).tolist(), np.flatnonzero(e == -1).tolist()))


_REGION = "o {0}, d {0}, w array<int>, t array<binary>, starts array<int>, own boolean"


def _regions(window: int, wide: bool):
    """Per document with shared anchors: its region text for each owner, and its own as a shard if others follow it."""

    name = pa.binary() if wide else pa.int64()

    def cut_out(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for k, text, anchors, owners in zip(batch["k"].to_pylist(), as_bytes(batch["t"]), batch["a"].to_pylist(), batch["o"].to_pylist()):
                words = text.split()
                m = window_anchors(words, window)
                a = np.array(anchors, np.int64).view(np.uint64)
                order = np.argsort(a)
                a, own = a[order], np.array(owners, object if wide else np.int64)[order]
                at = np.minimum(np.searchsorted(a, m), len(a) - 1)
                hit = a[at] == m
                owner = own[at]
                for o in np.unique(owner[hit]).tolist():
                    ok = hit & (owner == o)
                    # words of the regions, and the first word number of each
                    spans = [(x, y + window - 1) for x, y in _runs(ok)]
                    merged: list[list[int]] = []
                    for x, y in spans:
                        if merged and x <= merged[-1][1]:
                            merged[-1][1] = max(y, merged[-1][1])
                        else:
                            merged.append([x, y])
                    rows.append((o, k, [x for x, _ in merged], [b" ".join(words[x:y]) for x, y in merged], np.flatnonzero(ok).tolist() if o != k else [], o == k))
            if rows:
                kinds = (name, name, pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.bool_())
                for at in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[at : at + 500]), kinds)], ["o", "d", "w", "t", "starts", "own"])

    return cut_out


_VERDICT = "d {0}, starts array<int>, h1 long, h2 long"


def _match(window: int, wide: bool):
    """Windows of followers: all found in the owner's automaton (h1, h2 null), and each one left over with its hashes."""

    def match(batches):
        owner, held, automaton = None, None, None
        for batch in (part for whole in batches for part in slices(whole)):
            out_d, out_s, out_1, out_2 = [], [], [], []
            for o, d, first, texts, starts, shard in zip(*(batch[c].to_pylist() for c in ("o", "d", "w", "t", "starts", "shard"))):
                if automaton is None or o != owner or shard != held:
                    owner, held, automaton = o, shard, build([x.split() for x in shard])
                wanted = np.array(starts, np.int64)
                for x, text in zip(first, texts):
                    words = text.split()
                    mine = wanted[(wanted >= x) & (wanted + window <= x + len(words))] - x
                    if not len(mine):
                        continue
                    there = np.array(automaton.statistics(words))[mine + window - 1] >= window
                    found, rest = mine[there], mine[~there]
                    if len(found):
                        out_d.append(d)
                        out_s.append((found + x).astype(np.int32))
                        out_1.append(None)
                        out_2.append(None)
                    if len(rest):
                        h = hashes(words)
                        out_d += [d] * len(rest)
                        out_s += [[k] for k in (rest + x).tolist()]
                        out_1 += rolling(h, window)[rest].view(np.int64).tolist()
                        out_2 += rolling(h, window, 0xD6E8FEB86659FD93)[rest].view(np.int64).tolist()
            if out_d:
                yield pa.RecordBatch.from_arrays([pa.array(out_d, pa.binary() if wide else pa.int64()), pa.array(out_s, pa.list_(pa.int32())), pa.array(out_1, pa.int64()), pa.array(out_2, pa.int64())], ["d", "starts", "h1", "h2"])

    return match


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, bool, bool]:
    """A key for each text of each id, in the order of ids, then text hashes; whether it is wide (16 bytes, where an id, or null,
    has several texts, else the id key); whether rows without an id may be copies of one another."""
    k, x = id_key(id_col), F.xxhash64(f"`{text_col}`")
    texts = docs.select(k.alias("k"), x.alias("x")).groupBy("k").agg((F.min("x") != F.max("x")).alias("many"), F.count("*").alias("n"))
    texts = cut(texts.filter(F.col("many") | ((F.col("k") == NULL_KEY) & (F.col("n") > 1))))
    copies = not texts.filter(F.col("k") == NULL_KEY).isEmpty()
    if texts.filter("many").isEmpty():
        return k, False, copies
    if texts.filter(F.col("many") & (F.col("k") != NULL_KEY)).isEmpty():
        x = F.when(k == NULL_KEY, x).otherwise(F.lit(0))
    wide = [F.lpad(F.hex(v.bitwiseXOR(F.lit(NULL_KEY))), 16, "0") for v in (k, x)]
    return F.unhex(F.concat(*wide)), True, copies


def repeated_starts(docs: DataFrame, key: Column, wide: bool, text_col="text", window=20) -> DataFrame:
    """(d, starts) per row key: starts of windows that an earlier document holds."""
    name = "binary" if wide else "long"
    text = F.col(f"`{text_col}`")

    def anchors(t: pa.Array) -> pa.Array:
        out = []
        for x in as_bytes(t):
            words = x.split() if x else []
            out.append(np.unique(window_anchors(words, window)).view(np.int64) if len(words) >= window else np.zeros(0, np.int64))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))

    rows = docs.select(key.alias("d"), arrow_udf(anchors, "array<bigint>").asNondeterministic()(text).alias("a"))
    rows = rows.select("d", F.explode("a").alias("a"))
    owned = rows.groupBy("a").agg(F.min("d").alias("o"), F.max("d").alias("z")).filter("o <> z").select(F.col("a").alias("b"), "o")
    owned = cut(owned)
    shared = rows.join(owned, F.col("a") == F.col("b")).groupBy("d").agg(F.collect_list(F.struct("a", "o")).alias("x"))
    shared = shared.select("d", F.col("x.a").alias("a"), F.col("x.o").alias("o"))
    keyed = docs.select(key.alias("k"), text.alias("t"))
    regions = keyed.join(shared, F.col("k") == F.col("d")).select("k", "t", "a", "o").mapInArrow(_regions(window, wide), _REGION.format(name))
    regions = stage(regions)
    shards = regions.filter("own").select(F.col("o").alias("so"), F.col("t").alias("shard"))
    followers = regions.filter("not own").select("o", "d", "w", "t", "starts")
    verdicts = followers.join(shards, F.col("o") == F.col("so")).drop("so").mapInArrow(_match(window, wide), _VERDICT.format(name))
    verdicts = cut(verdicts)
    found = verdicts.filter("h1 is null").select("d", "starts")
    left = verdicts.filter("h1 is not null")
    first = left.groupBy("h1", "h2").agg(F.min("d").alias("f"), F.max("d").alias("z")).filter("f <> z").select(apart(F.col("h1")).alias("g1"), apart(F.col("h2")).alias("g2"), "f")
    later = left.join(first, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).filter("d > f").select("d", "starts")
    return found.union(later).groupBy("d").agg(F.flatten(F.collect_list("starts")).alias("starts"))


RESULT = "struct<n_words:bigint,n_removed:bigint,text:string,spans:array<struct<start:bigint,end:bigint>>>"
_RESULT = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _remove(window: int):
    def rows(text: pa.Array, starts: pa.Array, again: pa.Array):
        some = ((s, copy) for x, y in zip(slices(starts), slices(again)) for s, copy in zip(x.to_pylist(), y.to_pylist()))
        for t, (s, copy) in zip(as_bytes(text), some):
            words = t.split() if t else []
            n = len(words)
            at = np.array(s or [], np.int64)
            if copy:
                at = np.arange(max(0, n - window + 1))
            elif n >= window:
                at = np.concatenate((at, self_repeats(words, window)))
            if not len(at):
                yield {"n_words": n, "n_removed": 0, "text": None if t is None else t.decode(), "spans": []}
                continue
            gone = covered(at, n, window)
            yield {"n_words": n, "n_removed": int(gone.sum()), "text": kept_text(t, gone).decode(), "spans": [{"start": a, "end": b} for a, b in _runs(gone)]}

    def remove(text: pa.Array, starts: pa.Array, again: pa.Array) -> pa.Array:
        return in_arrow(rows(text, starts, again), _RESULT)

    return arrow_udf(remove, RESULT).asNondeterministic()


def dedup_corpus(docs: DataFrame, id_col="doc_id", text_col="text", window=20, out="dedup") -> DataFrame:
    """``docs`` with a column ``out``: struct(n_words, n_removed, text that is left, removed spans in words)."""
    out, key, d, starts, again = fresh(docs, out, "__k", "__d", "__starts", "__again")
    row, wide, copies = _row_key(docs, id_col, text_col)
    text = F.col(f"`{text_col}`")
    gone = repeated_starts(docs, row, wide, text_col, window).select(F.col("d").alias(d), F.col("starts").alias(starts))
    joined = docs.withColumn(key, row).join(gone, F.col(key) == F.col(d), "left")
    if copies:  # of equal texts without an id one is the first
        order = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t])
        number = F.row_number().over(Window.partitionBy(key).orderBy(order))
        alone = F.col(f"`{id_col}`").isNotNull() | text.isNull()
        joined = joined.filter(alone).withColumn(again, F.lit(False)).union(joined.filter(~alone).withColumn(again, number > 1))
    else:
        joined = joined.withColumn(again, F.lit(False))
    return joined.withColumn(out, _remove(window)(text, F.col(starts), F.col(again))).drop(key, d, starts, again)


def _shard_starts(shard, window: int):
    """Starts of the windows that the shard's automaton holds; the automaton is built once a worker."""

    def match(text: pa.Array) -> pa.Array:
        if not hasattr(shard, "automaton"):
            shard.automaton = build([x.split() for x in shard.value])
        got = []
        for t in as_bytes(text):
            stat = np.array(shard.automaton.statistics(t.split() if t else []), np.int64)
            got.append(np.flatnonzero(stat >= window) - window + 1)
        return pa.array(got, pa.list_(pa.int32()))

    return arrow_udf(match, "array<int>").asNondeterministic()


def remove_spans(docs: DataFrame, reference: DataFrame, text_col="text", reference_text="text", window=20, out="dedup", shard_bytes=2 << 20) -> DataFrame:
    """``docs`` with ``out`` as in ``dedup_corpus``: spans of at least ``window`` words that the reference holds are removed.

    The reference is read in shards of about ``shard_bytes`` (its size is counted first), one broadcast automaton each; the
    documents stream through all of them. A reference text is never cut, so a single longer text is a shard of its own.
    """
    spark = docs.sparkSession
    (out,) = fresh(docs, out)
    ref = reference.select(F.col(f"`{reference_text}`").cast("string").alias("t")).filter("t is not null").distinct()
    total = ref.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    starts = F.array().cast("array<int>")
    for b in range(n):
        texts = [r.t.encode() for r in ref.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == b).toLocalIterator()]
        shard = spark.sparkContext.broadcast(texts)

        starts = F.concat(starts, _shard_starts(shard, window)(F.col(f"`{text_col}`")))

    def remove(text: pa.Array, at: pa.Array) -> pa.Array:
        rows = []
        for t, s in zip(as_bytes(text), at.to_pylist()):
            words = t.split() if t else []
            gone = covered(np.array(s, np.int64), len(words), window)
            rows.append({"n_words": len(words), "n_removed": int(gone.sum()), "text": None if t is None else kept_text(t, gone).decode(), "spans": [{"start": a, "end": b} for a, b in _runs(gone)]})
        return pa.array(rows, _RESULT)

    return docs.withColumn(out, arrow_udf(remove, RESULT).asNondeterministic()(F.col(f"`{text_col}`"), starts))


def op10_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = dedup_corpus(docs).select("doc_id", "dedup.*")
    words = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    return got.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM v) WHERE k > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM r),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w WHERE len(ws) > 0),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.pos) FILTER (x.pos IS NULL) AS kept, count(x.pos) AS gone FROM a LEFT JOIN x ON x.doc_id = a.doc_id AND x.pos = a.pos GROUP BY 1)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
