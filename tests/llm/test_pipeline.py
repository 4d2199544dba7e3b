import importlib.util
import math
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkprep.llm import _common, langid, packing, substring_dedup
from sparkprep.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_storage_operators import check_sequences
from tests.llm.test_text_operators import brute_benchmark, brute_jaccard, words


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE) <= set(QUERIES)


def test_present_in_entry():
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and importlib.util.find_spec("corpus_pipeline")


def brute_language(spark, rows):
    held = [zlib.crc32(str(r[0]).encode()) % 3 == 1 if r[0] is not None else False for r in rows]
    m = langid.learn(spark.createDataFrame([r for r, h in zip(rows, held) if not h], SCHEMA))
    for r in rows:
        ws = langid.words_of(r[1] or "")
        if ws:
            mean = sum(m.forward(w) for w in ws) / len(ws)
            if 1 / sum(math.exp(x - max(mean)) for x in mean) >= 0.5:
                yield r


def brute_cut(rows, window=20):
    """Rows with their words after the cut."""
    seen = {}
    for k, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))):
        ws, gone = words(r[1]), set()
        for i in range(len(ws) - window + 1):
            if seen.setdefault(tuple(ws[i : i + window]), (k, i)) != (k, i):
                gone |= set(range(i, i + window))
        if not gone or len(gone) < len(ws):
            yield r[0], tuple(w for i, w in enumerate(ws) if i not in gone)


def brute_clean(rows, items):
    """Rows without 8 words in a row that windows of items cover."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    wins = {tuple(w[k : k + 8]) for _, t in items for w in [cut(t)] if w for k in range(max(1, len(w) - 7))}
    for r in rows:
        w = cut(r[1])
        hit = {k + j for p in wins for k in range(len(w) - len(p) + 1) if tuple(w[k : k + len(p)]) == p for j in range(len(p))}
        if not any(all(k + j in hit for j in range(8)) for k in hit):
            yield r


def test_stages_like_brute_force(spark, docs, corpus, tmp_path):
    head = lambda k, n: " ".join((corpus[k][1] or "").split()[:n])
    items = [(1, head(1, 12)), (2, head(1, 9)), (3, "nothing like it at all in any of these texts"), (4, head(8, 8)), (5, head(9, 5)), (6, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = list(corpus)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        now = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k == 4:
            break
        assert now.columns == docs.columns
        after = [tuple(r) for r in now.collect()]
        if k == 0:
            assert Counter(after) == Counter(brute_language(spark, before)) and len(after) < len(before)
        if k == 1:
            rows = brute_jaccard(before)
            keep = {i for i, _, _, c in rows if i is not None and i == c}
            assert Counter(r[0] for r in after if r[0] is not None) == Counter(keep)
            assert {r for r in after if r[0] is not None} <= set(before)
        if k == 2:
            assert Counter((r[0], tuple(words(r[1]))) for r in after) == Counter(brute_cut(before))
            assert sum(len(words(r[1])) for r in after) < sum(len(words(r[1])) for r in before)
            assert all(r[4] == len(r[1]) for r in after if r[0] is not None and r[1] and "\r" not in r[1] and r[4] is not None)
        if k == 3:
            kept = list(brute_clean(before, items))
            assert Counter(after) == Counter(kept)
            found = {r[0]: len(f) for r, (_, _, f) in zip(before, brute_benchmark([r[1] for r in before], items))}
            out = {r[0] for r in before} - {r[0] for r in kept}
            assert {found[i] for i in out} >= {1, 2} and corpus[9][0] not in out and found[corpus[9][0]] == 1  # 5 words are no evidence
        before = after
    check_sequences(now.collect(), before, (1024, 2048, 4096, 8192, 16384))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, (i for r in whole for i in r.doc_ids))) == sorted(map(repr, (i for r in now.collect() for i in r.doc_ids)))


def test_other_columns(spark, docs, corpus, tmp_path):
    """Further columns, with names that the stages use themselves, and no ``n_chars``."""
    spark.createDataFrame([(1, corpus[1][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs.drop("n_chars").withColumnsRenamed({"lang": "lang", "source": "match"}).withColumns({"__k": F.lit(1), "dedup": F.lit("x"), "language": F.lit(2), "n": F.lit(3), "c": F.lit(4)})
    for _, stage in corpus_pipeline.STAGES[:4]:
        columns = now.columns
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns and now.count() > 0


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_by_row(spark):
    rng = random.Random(21)
    a, b, p, q, r, x = (prose(rng, 60) for _ in range(6))
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    rows = [(5, a), (5, b), (None, a), (None, near(a)), (3, near(b)), (None, p), (None, p), (None, near(p)), (9, q), (9, q), (9, r), (7, x), (7, near(x)), (None, ""), (None, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", None) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    first = {r.t: r.x for r in spark.createDataFrame([(t,) for t in (p, near(p), x, near(x))], "t string").selectExpr("t", "xxhash64(t) as x").collect()}
    least = lambda t: min(t, near(t), key=first.get)
    assert got == Counter([(5, a), (3, near(b)), (None, least(p)), (9, q), (9, r), (7, least(x)), (None, ""), (None, ""), (None, None), (None, None)])


def most(work) -> int:
    """MB of Python objects and arrays at once."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()


def test_workers_hold_few_rows_as_objects(spark):
    texts = pa.array([f"{k} " + "x" * 2000 for k in range(12_000)])  # 24 MB
    assert most(lambda: sum(map(len, _common.as_bytes(texts)))) < 6
    remove = substring_dedup._remove(20).func
    assert most(lambda: remove(texts, pa.nulls(len(texts), pa.list_(pa.int32())), pa.array([False] * len(texts)))) < 6
    pieces = pa.array([[np.full(40, k, "<u2").tobytes()] * 20 for k in range(5000)], pa.list_(pa.binary()))  # 8 MB, 16 MB as integers
    assert most(lambda: packing._numbers(pieces)) < 24


def test_rows_in_slices_are_all_there(spark):
    texts = pa.array([None if k % 7 == 0 else f"t{k}" for k in range(3 * _common.ROWS + 5)])
    for a in (texts, texts.slice(3, _common.ROWS), texts.slice(9, 0), texts.cast(pa.large_string())):
        assert list(_common.as_bytes(a)) == [None if t is None else t.encode() for t in a.to_pylist()]
        assert _common.in_arrow(iter(a.to_pylist()), pa.string()).to_pylist() == a.to_pylist()
    starts = pa.array([[k % 5] if k % 3 else None for k in range(700)], pa.list_(pa.int32()))
    got = substring_dedup._remove(4).func(pa.array(["a b c d e f g h i"] * 700), starts, pa.array([k % 10 == 9 for k in range(700)]))
    for k, r in enumerate(got.to_pylist()):
        assert r["n_removed"] == (9 if k % 10 == 9 else 4 if k % 3 else 0) and (k % 10 == 9 or r["spans"] == ([{"start": k % 5, "end": k % 5 + 4}] if k % 3 else []))


def test_numbers_of_pieces():
    ids = [[[1, 2], [65535]], [[3]], [], [[9, 8], []]]
    array = pa.array([[np.array(p, "<u2").tobytes() for p in row] for row in ids], pa.list_(pa.binary()))
    want = [[i for p in row for i in p] for row in ids]
    for a, n in ((0, 4), (1, 3), (2, 1), (3, 1), (0, 0)):
        assert packing._numbers(array.slice(a, n)).to_pylist() == want[a : a + n]


GIVE_BACK = r"""
import re
from sparkprep.llm import _common

def held():
    return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read()).group(1)) >> 10

before = held()
blocks = [bytes(2000) for _ in range(50_000)]  # 95 MB below a block that stays
_common.claim("one", lambda: blocks.__delitem__(slice(0, -1)))
assert held() - before > 80
_common.claim("two", None)
assert held() - before < 30, held() - before
"""


@pytest.mark.skipif(not sys.platform.startswith("linux") or getattr(_common, "_malloc_trim", 1) is None, reason="needs glibc")
def test_operators_give_memory_back_to_the_next_one():
    got = subprocess.run([sys.executable, "-c", GIVE_BACK], capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
