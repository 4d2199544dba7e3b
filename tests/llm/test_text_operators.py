import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.llm import decontaminate, jaccard, langid, licenses, quality, substring_dedup
from sparkprep.llm._common import rolling, sliding_min
from sparkprep.llm.components import connected_components
from tests.llm.conftest import WORDS, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def test_rolling_and_minimum():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 4, 60, dtype=np.uint64)
    for k in (1, 2, 3, 5, 8, 13, 20):
        r = rolling(h, k)
        assert len(r) == 61 - k
        assert {(i, j) for i in range(len(r)) for j in range(i) if r[i] == r[j]} == {(i, j) for i in range(len(r)) for j in range(i) if (h[i : i + k] == h[j : j + k]).all()}
        assert sliding_min(h, k).tolist() == [h[i : i + k].min() for i in range(61 - k)]
    assert len(rolling(h[:3], 4)) == 0 == len(sliding_min(h[:3], 4))


# 2: quality rules


def brute_quality(rows, min_docs, max_share):
    norm = lambda x: re.sub(r"[\W_]+", " ", re.sub(r"\d", "0", x.lower())).strip()
    seen, hosts = defaultdict(set), Counter()
    for _, t, _, s, _ in rows:
        hosts[s] += 1
        for line in (t or "").split("\n"):
            if norm(line):
                seen[s, norm(line)].add(t)
    hot = {k for k, v in seen.items() if len(v) > max(min_docs, max_share * hosts[k[0]])}
    for i, t, _, s, _ in rows:
        ws = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        wins = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
        c = Counter(wins)
        rep = len({k + j for k, w in enumerate(wins) if c[w] > 1 for j in range(5)})
        gone = sum(len(words(x)) for x in (t or "").split("\n") if (s, norm(x)) in hot)
        failed = len(ws) < 10 or 100 * rep > 20 * len(ws)
        left = len(ws) - gone
        yield i, len(ws), sum(map(len, ws)), sum(ch in "#*$%&|<>" for ch in t or ""), len(lines) - len(set(lines)), rep, failed, not failed and left >= 10 and left >= 0.3 * len(ws), gone


def test_quality_like_brute_force(docs, corpus):
    got = quality.quality_rules(docs, min_docs=1, max_share=0.01).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_quality(corpus, 1, 0.01), key=repr)
    assert any(r.n_removed for r in got)


def test_quality_edges(spark, docs, empty):
    assert quality.quality_rules(empty).count() == 0
    clash = docs.withColumnsRenamed({"n_chars": "n_words", "lang": "kept"}).withColumn("h1", F.lit(1))
    assert quality.quality_rules(clash).count() == docs.count()
    kept = quality.without_lines(docs, min_docs=1)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert kept.filter("text is null").count() == docs.filter("text is null").count()


# 3: language ID


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "ab", "b", "c", "▁ab", "ca"]
    rng = np.random.default_rng(0)
    m = langid.PieceModel(["x", "y"], pieces, rng.random((7, 2)), 1e-6)

    def brute(s, k):
        return 1.0 if not s else 1e-6 * brute(s[1:], k) + sum(m.probs[pieces.index(s[:n]), k] * brute(s[n:], k) for n in range(1, len(s) + 1) if s[:n] in pieces)

    ws = ["ab", "abc", "xab", "a", "cabbac", "q", "c" * 500]
    many = m.forward_many(ws)
    for w, row in zip(ws[:6], many):
        assert np.allclose(row, [math.log(brute("▁" + w, k)) for k in (0, 1)])
    assert np.allclose(many, [m.forward(w) for w in ws]) and np.isfinite(many).all()
    sums, sizes = m.score_many(["ab abc", "", "ab  AB 12"])
    assert np.allclose(sums, [many[0] + many[1], [0, 0], 2 * many[0]]) and sizes.tolist() == [2, 0, 2]


def test_fit_like_brute_force(monkeypatch):
    """Expected piece counts over all segmentations, written out, for two rounds; in logarithms too."""
    pieces, floor = ["▁", "▁a", "ab", "b", "c", "▁ab", "ca"], 1e-3

    def ways(s):
        """Segmentations as lists of pieces; None is an unknown character."""
        if not s:
            return [[]]
        out = [[None, *rest] for rest in ways(s[1:])]
        return out + [[s[:n], *rest] for n in range(1, len(s) + 1) if s[:n] in pieces for rest in ways(s[n:])]

    counts = {"x": {"ab": 3.0, "abc": 1.0, "cab": 2.0}, "y": {"cc": 1.0, "a": 5.0, "qab": 1.0}}
    want = {}
    for lang, ws in counts.items():
        p = dict.fromkeys(pieces, 1 / len(pieces))
        for _ in range(2):
            seen = Counter()
            for w, n in ws.items():
                each = [(math.prod(floor if x is None else p[x] for x in way), way) for way in ways("▁" + w)]
                total = sum(q for q, _ in each)
                for q, way in each:
                    for x in way:
                        if x is not None:
                            seen[x] += n * q / total
            p = {x: max(floor, seen[x] / sum(seen.values())) for x in pieces}
        want[lang] = [p[x] for x in pieces]
    for short in (40, 0):
        monkeypatch.setattr(langid, "SHORT", short)
        m = langid.fit(counts, pieces, 2, floor)
        assert m.langs == ["x", "y"] and np.allclose(m.probs, np.array([want["x"], want["y"]]).T)
    long = langid.fit({"x": {"ab" * 200: 1.0, "c": 1.0}}, pieces, 2, 1e-7)
    assert np.isfinite(long.probs).all() and long.probs[2, 0] > 0.9


def test_words_are_letters():
    assert langid.words_of("½ ² Ⅷ 12 _ ١ -") == [] and langid.words_of("Ab½c ünï_日本9x") == ["ab", "c", "ünï", "日本", "x"]


def test_language_of_held_out_texts(spark, empty):
    rng = random.Random(3)
    other = "der die das und nicht ich wir haben werden schon über für gegen zwischen straße".split()
    rows = [(k, prose(rng, 40) if k % 2 else " ".join(rng.choice(other) for _ in range(40)), "en" if k % 2 else "de") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model = langid.learn(df.filter("doc_id < 50"))
    extra = spark.createDataFrame([(90, None, None), (91, "", None), (92, "12 34 ! ½ ² Ⅷ", None), (93, "x" * 5000, None)], df.schema)
    got = langid.predict(df.filter("doc_id >= 50").union(extra).withColumn("Language", F.lit(1)), model, out="language").collect()
    by = {r.doc_id: r["_language"] for r in got}
    assert all(by[k].lang == ("en" if k % 2 else "de") and 0.5 < by[k].score <= 1 for k in range(50, 80))
    tie = langid.PieceModel(["de", "en"], ["▁", "a"], np.full((2, 2), 0.5), 1e-7)
    assert [tuple(r.language) for r in langid.predict(spark.createDataFrame([("a",)], "text string"), tie).collect()] == [("de", 0.5)]
    assert [tuple(by[k]) for k in (90, 91, 92)] == [("und", 0.0)] * 3 and by[93].lang in ("en", "de")
    assert langid.predict(empty, model).count() == 0
    none = langid.learn(empty)
    assert {r.language.lang for r in langid.predict(df, none).collect()} == {"und"}


# 4: decontamination


def brute_benchmark(texts, items, window=8):
    ws = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = ws(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[k : k + window])].add(str(i))
    out = []
    for t in texts:
        w, hit, found = ws(t), set(), set()
        for p, ids in wins.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= ids
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_benchmark_like_brute_force(spark, docs, corpus, block):
    rng = random.Random(9)
    items = [(1, prose(rng, 12)), (2, None), (3, "..."), (4, corpus[2][1]), (5, corpus[2][1]), (6, "One"), (7, "a b, C d"), (8, " ".join((corpus[69][1] or "").split()[3:20])), (10, "word word"), (1, "zeta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs.withColumn("match", F.lit("mine")).withColumn("items", F.lit(0))
    got = decontaminate.find_benchmark(df, bench, block_bytes=block)
    assert "_match" in got.columns and got.count() == len(corpus)
    want = Counter((r[0], n, h, tuple(i)) for r, (n, h, i) in zip(corpus, brute_benchmark([r[1] for r in corpus], items)))
    assert Counter((r.doc_id, r["_match"].n_words, r["_match"].n_hit, tuple(sorted(r["_match"]["items"]))) for r in got.collect()) == want


def test_benchmark_edges(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_benchmark(docs, bench).filter("size(match.items) > 0").count() == 0
    assert decontaminate.find_benchmark(empty, spark.createDataFrame([(1, "x")], bench.schema)).count() == 0


def test_wu_manber_random():
    rng = random.Random(4)
    for m in (1, 2, 3, 8):
        pats = list({tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(m)) for _ in range(5)})
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(3000)]
        from sparkprep.llm._common import hashes

        got = sorted(decontaminate.WuManber(pats).find(text, hashes(text)))
        assert got == sorted((i, k) for i in range(len(text) - m + 1) for k, p in enumerate(pats) if tuple(text[i : i + m]) == p)


# 7: Jaccard join


def brute_jaccard(rows, percent=90, n=5):
    def shingles(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()

    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= percent * len(sets[i] | sets[j]):
                near[i] += 1
                near[j] += 1
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            ids[find(k)].append(r[0])
    return Counter((r[0], len(s), c, min(ids[find(k)], default=None)) for k, (r, s, c) in enumerate(zip(rows, sets, near)))


@pytest.mark.parametrize("percent,frequent", [(90, 200_000), (60, 0)])
def test_jaccard_like_brute_force(docs, corpus, percent, frequent):
    got = jaccard.similar_documents(docs.withColumn("key", F.lit(1)).withColumn("c", F.lit(2)), percent=percent, max_frequent=frequent)
    assert Counter(map(tuple, got.collect())) == brute_jaccard(corpus, percent)


def test_jaccard_random_near_copies(spark):
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = prose(rng, rng.choice([6, 20, 60, 120])).split()
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(w), None, None, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(map(tuple, jaccard.similar_documents(df).collect())) == brute_jaccard(rows)


def test_jaccard_empty(empty):
    assert jaccard.similar_documents(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(20, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7), (3, 1), (1, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        want[n] = min(seen)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# 8: licences


def test_licenses_like_brute_force():
    rng = random.Random(6)
    templates = {"one": "alpha beta gamma delta", "two": "mu nu xi\npi rho sigma tau phi chi", "none": "single"}

    def grams(t):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
        return set(zip(w, w[1:]))

    def brute(text, t=0.8):
        lines, found = text.split("\n"), []
        for name, text_ in templates.items():
            b, got = grams(text_), []
            for s in range(len(lines)):
                for e in range(s, len(lines)):
                    a = grams("\n".join(lines[s : e + 1]))
                    if b and a & b:
                        d = 2 * len(a & b) / (len(a) + len(b))
                        if d >= t:
                            got.append((d, s, e))
            kept = []
            for d, s, e in sorted(got, key=lambda x: (-x[0], x[1], x[2])):
                if all(e < s2 or s > e2 for _, s2, e2 in kept):
                    kept.append((d, s, e))
            found += [(name, round(d, 9)) for d, _, _ in kept]
        return sorted(found)

    scanner = licenses.Scanner(templates, 0.8)
    for _ in range(60):
        parts = [rng.choice(["alpha beta gamma delta", "Alpha, beta gamma", "mu nu xi", "pi rho sigma tau", "phi chi", "pi rho sigma tau phi chi", prose(rng, 4), "", "x"]) for _ in range(rng.randint(1, 9))]
        text = "\n".join(parts)
        assert sorted((n, round(d, 9)) for n, d, _, _ in scanner.scan(text.encode())) == brute(text), text
    assert scanner.scan(None) == [] == scanner.scan(b"") == scanner.scan(b"\n\n")
    assert licenses.Scanner({}, 0.8).scan(b"alpha beta") == []


def test_license_texts(spark, docs, empty):
    from sparkprep.llm.license_texts import TEMPLATES

    rows = [(k, "Intro line\n" + t.upper() + "\nmore of the file") for k, t in enumerate(TEMPLATES.values())]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("licenses", F.lit(1))
    got = {r.doc_id: [x.license for x in r["_licenses"]] for r in licenses.scan_licenses(df).collect()}
    assert all(name in got[k] for k, name in enumerate(TEMPLATES))
    assert licenses.scan_licenses(docs).filter("size(licenses) > 0").count() == 0 == licenses.scan_licenses(empty).count()


@pytest.mark.parametrize(
    "text,want",
    [
        ("This project is licensed under the MIT License.", "MIT-notice"),
        ("Released under the MIT license, see LICENSE for details.", "MIT-notice"),
        ("Some text before. Released under the MIT License.", "MIT-notice"),
        ("a few words of prose and released under the MIT License and more words after it", "MIT-notice"),
        ("This project is licensed under the Apache License 2.0.", "Apache-2.0-notice"),
        ("It is licensed under the GNU General Public License, version 2.", "GPL-2.0-notice"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0-notice"),
        ("# SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause-notice"),
        ("the weather was fine under the old bridge, and the license of the fisherman had expired", None),
    ],
)
def test_license_wordings(spark, text, want):
    df = spark.createDataFrame([("x y z\n" + text,)], "text string")
    assert {x.license for x in licenses.scan_licenses(df).first().licenses} == {want} - {None}


def test_whole_licence_texts(spark):
    from sparkprep.llm.license_texts import VARIANTS

    names = ["Apache-2.0", "GPL-3.0"]
    df = spark.createDataFrame([(k, "Title of it. " + " ".join(VARIANTS[n][0].split()) + " The end") for k, n in enumerate(names)], "doc_id int, text string")
    got = {r.doc_id: {x.license: x.dice for x in r.licenses} for r in licenses.scan_licenses(df).collect()}
    assert all(got[k][n] > 0.99 for k, n in enumerate(names))


def test_many_notices():
    from sparkprep.llm.license_texts import TEMPLATES, VARIANTS

    scanner = licenses.Scanner({k: [*([TEMPLATES[k]] if k in TEMPLATES else []), *VARIANTS.get(k, [])] for k in TEMPLATES | VARIANTS}, 0.85)
    began = time.process_time()
    got = scanner.scan(b"Released under the MIT License.\n" * 100_000)
    assert Counter(n for n, *_ in got) == {"MIT-notice": 100_000} and [x[2] for x in got] == list(range(100_000)) and {d for _, d, _, _ in got} == {1.0}
    assert time.process_time() - began < 40  # some seconds; it must not be quadratic
    for name, texts in VARIANTS.items():
        for text in texts[:1]:
            assert name in {n for n, *_ in scanner.scan(("Some words.\n" + text + "\nmore words").encode())}, name


# 10: substring dedup


def brute_spans(rows, window):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, out = {}, {}
    for k in order:
        ws, gone = words(rows[k][1]), set()
        for i in range(len(ws) - window + 1):
            w = tuple(ws[i : i + window])
            first = seen.setdefault(w, (rows[k][0], i))
            if first[0] != rows[k][0] or first[1] < i:
                gone |= set(range(i, i + window))
        out[k] = (rows[k][0], len(ws), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(ws) if i not in gone).encode()).hexdigest())
    return Counter(out.values())


@pytest.mark.parametrize("window", [20, 5])
def test_spans_like_brute_force(docs, corpus, window):
    df = docs.withColumn("dedup", F.lit(0)).withColumn("d", F.lit(0)).withColumn("starts", F.lit(0))
    got = substring_dedup.dedup_corpus(df, window=window)
    assert got.columns == [*df.columns, "_dedup"]
    assert Counter((r.doc_id, r["_dedup"].n_words, r["_dedup"].n_removed, hashlib.sha256(" ".join(words(r["_dedup"].text)).encode()).hexdigest()) for r in got.collect()) == brute_spans(corpus, window)


def test_spans_random(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.dedup_corpus(df, window=9)
    assert Counter((r.doc_id, r.dedup.n_words, r.dedup.n_removed, hashlib.sha256(" ".join(words(r.dedup.text)).encode()).hexdigest()) for r in got.collect()) == brute_spans(rows, 9)


def test_spans_edges(empty):
    assert substring_dedup.dedup_corpus(empty).count() == 0
    assert substring_dedup.kept_text(b" a b\n c ", np.array([False, True, False])) == b" a c "


def test_automaton_statistics():
    rng = random.Random(1)
    ref = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))] for _ in range(4)]
    auto = substring_dedup.build(ref)
    text = [rng.choice([b"a", b"b", b"c"]) for _ in range(200)]
    subs = {tuple(r[i:j]) for r in ref for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    want = [max(n for n in range(0, i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in subs) for i in range(len(text))]
    assert auto.statistics(text) == want


@pytest.mark.parametrize("shard", [2 << 20, 400])
def test_remove_reference_spans(spark, docs, corpus, shard):
    ref = spark.createDataFrame([(corpus[64][1],), (None,), ("short",), (corpus[70][1],)], "text string")
    got = substring_dedup.remove_spans(docs, ref, window=6, shard_bytes=shard).collect()
    known = {tuple(w[i : i + 6]) for t in (corpus[64][1], corpus[70][1]) for w in [words(t)] for i in range(len(w) - 5)}
    for r in got:
        ws = words(r.text)
        gone = {i + j for i in range(len(ws) - 5) if tuple(ws[i : i + 6]) in known for j in range(6)}
        assert r.dedup.n_removed == len(gone) and words(r.dedup.text) == [w for i, w in enumerate(ws) if i not in gone]


@pytest.mark.parametrize("twice", [False, True])
def test_spans_by_row(spark, twice):
    rng = random.Random(12)
    share = [prose(rng, 9) for _ in range(4)]
    text = lambda: " ".join(rng.choice([rng.choice(share), prose(rng, rng.randint(0, 8))]) for _ in range(rng.randint(0, 8)))
    rows = [(None, text()) for _ in range(12)] + [(k, text()) for k in range(8)]
    rows += [rows[0], rows[0], rows[3], rows[14], (None, None), (None, None), (None, "")]
    if twice:
        rows += [(k % 3, text()) for k in range(9)] + [(2, share[0]), (2, "short"), (None, share[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    x = {r.text: r.x for r in df.selectExpr("text", "xxhash64(text) as x").collect()}
    seen, want = {}, Counter()
    for k, (i, t) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, x[r[1]]))):
        ws, gone, me = words(t), set(), k if i is None else (i, t)
        for at in range(len(ws) - 5):
            first = seen.setdefault(tuple(ws[at : at + 6]), (me, at))
            if first[0] != me or first[1] < at:
                gone |= set(range(at, at + 6))
        want[i, len(ws), len(gone), " ".join(w for at, w in enumerate(ws) if at not in gone)] += 1
    got = Counter((r.doc_id, r.dedup.n_words, r.dedup.n_removed, " ".join(words(r.dedup.text))) for r in substring_dedup.dedup_corpus(df, window=6).collect())
    assert got == want


def test_match_rebuilds_for_each_shard():
    import pyarrow as pa

    def row(shard):
        return {"o": 1, "d": 2, "w": [0], "t": [b"a b c"], "starts": [0], "shard": [shard]}

    got = [b.to_pydict() for b in substring_dedup._match(3, False)([pa.RecordBatch.from_pylist([row(b"x a b c"), row(b"x y z")])])]
    assert [h is None for h in got[0]["h1"]] == [True, False]


def test_languages_like_brute_force(spark, tmp_path):
    """The query, against a forward pass word by word with the model of the same training rows."""
    rng = random.Random(7)
    other = "der die das und nicht ich wir haben werden schon über für gegen zwischen straße".split()
    rows = [(k, [prose(rng, 12), " ".join(rng.choice(other) for _ in range(9)), "½ 12", None][k % 4 if k % 9 else 0], ["en", "de", "en", None][k % 4 if k % 9 else 0]) for k in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    counts = {}
    for lang, t in {(lang, t) for i, t, lang in rows if t and lang and not held[i]}:
        for w in re.findall(r"[^\W\d_½]+", t.lower()):
            counts.setdefault(lang, Counter())[w] += 1
    m = langid.fit(counts, langid.load_pieces())
    got = {r.doc_id: r for r in langid.op3_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        ws = re.findall(r"[^\W\d_½]+", (t or "").lower())
        assert got[i].held_out == held[i]
        if not ws:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        mean = sum(m.forward(w) for w in ws) / len(ws)
        best = max(range(2), key=lambda c: mean[c])
        assert got[i].lang_pred == m.langs[best] and abs(got[i].score - 1 / sum(math.exp(x - mean[best]) for x in mean)) < 1e-9
