import datetime as dt
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkprep.llm import packing, token_store, url_filter, warc

TOK = Tokenizer.from_file(token_store.default_tokenizer())


# 1: packing


def check_packing(rows, lengths, capacities):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
        pieces[r.doc_id].append(r)
    for rs in bins.values():
        size, used = rs[0].bin_size, sum(r.piece_len for r in rs)
        assert {r.bin_size for r in rs} == {size} and size == min(c for c in capacities if c >= used)
        at = 0
        for r in sorted(rs, key=lambda r: r.bin_start):
            assert r.bin_start == at
            at += r.piece_len
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(i for i, _ in lengths)
    assert sum(r.piece_len for r in rows) == sum(n for _, n in lengths)


def n_tokens(text):
    return len(TOK.encode(text or "", add_special_tokens=False).ids) + 1


def test_packing_keeps_everything(docs, corpus, empty):
    caps = (16, 64, 256, 1024)
    rows = packing.pack_documents(docs.withColumn("n", F.lit(1)).withColumn("shard", F.lit(0)).withColumn("row", F.lit(0)), capacities=caps).collect()
    check_packing(rows, [(r[0], n_tokens(r[1])) for r in corpus], caps)
    assert packing.pack_documents(empty).count() == 0 == packing.packed_sequences(empty).count()
    small = packing.pack_documents(docs, capacities=caps, shard_items=10)
    check_packing(small.collect(), [(r[0], n_tokens(r[1])) for r in corpus], caps)
    own = packing.pack_documents(docs, length=F.octet_length("text"), capacities=caps).collect()
    check_packing(own, [(r[0], max(1, len((r[1] or "").encode()))) for r in corpus], caps)


def check_sequences(rows, docs, capacities):
    """Every document's ids are there, whole and in order, and a sequence is as large as its contents need."""
    pieces = []
    for r in rows:
        assert r.n_tokens == len(r.ids) and r.bin_size == min(c for c in capacities if c >= r.n_tokens)
        ends = [*r.bin_starts[1:], r.n_tokens]
        assert r.bin_starts[0] == 0 and all(a < b for a, b in zip(r.bin_starts, ends))
        pieces += [(repr(i), at, tuple(r.ids[a:b])) for i, at, a, b in zip(r.doc_ids, r.piece_starts, r.bin_starts, ends)]
    want, top = [], max(capacities)
    for r in docs:
        ids = (*TOK.encode(r[1] or "", add_special_tokens=False).ids, 0)
        want += [(repr(r[0]), at, ids[at : at + top]) for at in range(0, len(ids), top)]
    assert sorted(pieces) == sorted(want)


def test_sequences_hold_all_ids(docs, corpus):
    for items in (50_000, 10):
        check_sequences(packing.packed_sequences(docs, capacities=(16, 64, 256), shard_items=items).collect(), corpus, (16, 64, 256))


def test_best_fit_takes_the_tightest_bin():
    placed = packing.best_fit([60, 50, 40, 35, 5], [100], [1.0], 1.0)
    assert [b for b, _ in placed] == [0, 1, 0, 1, 1]

    rng = random.Random(0)
    for _ in range(30):
        lengths = sorted((rng.randint(1, 100) for _ in range(80)), reverse=True)
        caps, fill = [25, 50, 100], rng.choice([0.5, 0.9, 1.0])
        costs = [packing.default_cost(c) for c in caps]
        size, used = [], []
        for (b, at), n in zip(packing.best_fit(lengths, caps, costs, fill), lengths):
            rooms = [s - u for s, u in zip(size, used) if s - u >= n]
            if b == len(size):  # a bin is opened only where none fits, at the least cost
                assert not rooms
                size.append(min((costs[j] * n / max(n, fill * c), c) for j, c in enumerate(caps) if c >= n)[1])
                used.append(0)
            else:
                assert size[b] - used[b] == min(rooms)
            assert at == used[b]
            used[b] += n
        placed, sizes = packing.pack(lengths, caps)
        filled = Counter()
        for (b, _), n in zip(placed, lengths):
            filled[b] += n
        assert sizes == [min(c for c in caps if c >= filled[b]) for b in range(len(sizes))]


# 5: URL lists


def test_lists_like_brute_force(spark):
    rng = random.Random(2)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "ba.com", "A.com."]
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    entries = [(rng.choice(["l1", "l2"]), rng.choice(["a.com", "x.a.com", "B.org", "com"]), day(rng.randrange(200)), rng.choice(["add", "remove"])) for _ in range(40)]
    entries += [entries[0], ("l1", None, day(3), "add"), ("l2", "a.com", None, "add")]
    pages = [(k, f"http://{rng.choice(hosts)}:80/p?q" if k % 9 else None, day(rng.randrange(220)) if k % 7 else None) for k in range(200)]
    pages += [pages[1], (None, "mailto:x", day(1))]
    df = spark.createDataFrame(pages, "page_id long, url string, fetched date").withColumn("h", F.lit(1)).withColumn("Lists", F.lit(0)).withColumn("list", F.lit("z"))
    got = url_filter.match_lists(df, spark.createDataFrame(entries, "list string, domain string, date date, action string"))

    def brute(url, at):
        if not url or at is None or "//" not in url:
            return []
        host = url.split("//")[1].split(":")[0].lower().rstrip(".")
        out = set()
        for name in ("l1", "l2"):
            for d in ("a.com", "x.a.com", "b.org", "com"):
                if host == d or host.endswith("." + d):
                    acts = [(e[2], e[3] == "add") for e in entries if e[0] == name and e[1] and e[1].lower() == d and e[2] and e[2] <= at]
                    if acts and max(acts)[1]:
                        out.add(name)
        return sorted(out)

    assert sorted(((r.page_id, r.url, r["_lists"]) for r in got.collect()), key=repr) == sorted(((p, u, brute(u, t)) for p, u, t in pages), key=repr)
    assert got.columns == [*df.columns, "_lists"]
    none = spark.createDataFrame([], "list string, domain string, date date, action string")
    assert url_filter.match_lists(df, none).filter("size(_lists) > 0").count() == 0
    assert url_filter.match_lists(df.limit(0), none).count() == 0


# 6: WARC


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "é" * 600
    rows = [(5, "http://www.Ex.org/b", big), (9, "http://ex.org/a?x=1", big), (2, "https://sub.ex.org:8443/a#f", big), (7, "http://ex.org/a?x=1", "small"), (8, "http://z.com", "small"), (11, None, None), (12, "http://bad:port/", ""), (13, "http://ex.org/a b\nc", "x" * 999), (14, "http://ex.org/c", "x" * 999), (None, "http://ex.org/n", big), (9, "http://ex.org/a?x=1", big)]
    rows += [(100 + k, f"http://h{k % 7}.net/{k}", f"<html>{'y' * (990 + k % 30)}") for k in range(60)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("offset", F.lit("x")), rows


def test_archives(pages, tmp_path):
    df, rows = pages
    captures = warc.write_archives(df, "file://" + str(tmp_path / "w"), roll_bytes=5000)
    index = warc.write_index(captures, "file://" + str(tmp_path / "i"), block_lines=7)
    got = warc.read_archives(warc.read_index(index)).collect()
    best = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and i is not None:
            best[raw] = max(best.get(raw, i), i)
    want = Counter()
    for i, u, h in rows:
        raw = (h or "").encode()
        top = best.get(raw)
        again = top is not None and (i is None or i < top)
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None, b"" if again else raw] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == want
    look = warc.CaptureIndex(index)
    assert {r.page_id for r in look.lookup("http://EX.org/a?x=1")} == {9, 7} and len(look.lookup("http://ex.org/a?x=1")) == 3
    for k in range(60):
        assert [r.page_id for r in look.lookup(f"http://h{k % 7}.net/{k}")] == [100 + k]
    assert look.lookup("http://nowhere.net/") == [] and [r.page_id for r in look.lookup("http://ex.org/b")] == [5]
    firsts = [b[0] for b in look.blocks]
    assert firsts == sorted(firsts)


def test_archives_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.write_index(warc.write_archives(none))
    assert index.count() == 0 == warc.read_archives(warc.read_index(index)).count()
    assert warc.CaptureIndex(index).lookup("http://a.b/") == []


def test_keys_and_names():
    assert warc.url_key("http://www.Example.com:80/a?b#c") == "com,example)/a?b" and warc.url_key("https://a.b:444") == "b,a:444)/" and warc.url_key(None) == "-"
    for i in (0, 5, -3, 2**62, None):
        assert warc.id_of(warc.record_id(i)) == i


# 9: token ids

HARD = ["", " ", "a  b", " a", "a ", "a \n b\t c", "x  y 　z", "it's 12 3\n\n\nfoo  bar <|endoftext|> x", "é ß\x1c x \x85 y", "a  b", "' s 's don't", "\x00 \x01", "日本語 テキスト 😀 x", "a\r\n b"]


def test_encoder_equals_the_library(corpus):
    enc, tok = token_store.Encoder(token_store.default_tokenizer()), Tokenizer.from_file(token_store.default_tokenizer())
    rng = random.Random(3)
    parts = [*" \n\r\tab'é.,1\u00a0\u3000\u2003\x1c\x85шß日", "<|endoftext|>", "  ", "\n\n", " the", "'s", "'ll", " naïve", "x" * 40]
    for trial in range(12):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(200)] + HARD + [r[1] for r in corpus][trial % 2 :: 2]
        for t, ids in zip(texts, enc.encode_many(texts)):
            assert ids.tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_encoder_forgets_and_starts_anew(corpus, monkeypatch):
    monkeypatch.setattr(token_store, "CACHE", 50)
    monkeypatch.setattr(token_store, "CHUNK", 300)
    enc, tok = token_store.Encoder(token_store.default_tokenizer()), Tokenizer.from_file(token_store.default_tokenizer())
    texts = [r[1] for r in corpus] + ["y" * 100 + " " + "z" * 70, None, "y" * 100]
    for _ in range(2):
        assert [x.tolist() for x in enc.encode_many(texts)] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_merges_of_single_words():
    enc, tok = token_store.Encoder(token_store.default_tokenizer()), Tokenizer.from_file(token_store.default_tokenizer())
    rng = random.Random(4)
    words = [rng.choice(["", " "]) + "".join(rng.choice("etaoinshrdlucmfwypvbgkjqxzAETßéñш") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for where, ids in enc.merges.encode([w.encode() for w in words]):
        for k, x in zip(where.tolist(), ids.tolist()):
            assert x == tok.encode(words[k], add_special_tokens=False).ids


def test_added_tokens_like_the_library_as_it_is():
    path = token_store.default_tokenizer()
    tok = Tokenizer.from_file(path)
    texts = ["see <|endoftext|> here", "plain text", "<|endoftext|>", None, "a<|endoftext|><|endoftext|>\n b  c", "<|endoftext |> <|endo", *HARD]
    got = [x.tolist() for x in token_store.Encoder(path).encode_many(texts)]
    assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts] and 50256 in got[0]


def test_grammar_round_trip():
    rng = np.random.default_rng(0)
    for trial in range(20):
        ids = [rng.integers(0, rng.integers(1, 6), rng.integers(1, 400)).astype(np.uint16) for _ in range(rng.integers(1, 8))]
        data = token_store.pack_shard(np.concatenate(ids), np.array([len(x) for x in ids]), np.arange(len(ids)), 1000, rounds=6, per_round=8, least=2)
        shard = token_store.Shard(data)
        for k, x in enumerate(ids):
            assert (shard.document(k) == x).all()
            for _ in range(5):
                a = int(rng.integers(0, len(x)))
                b = int(rng.integers(a, len(x))) + 1
                assert (shard.window(k, a, b) == x[a:b]).all()
        assert (token_store.expand(shard.symbols, shard.rules, 1000) == np.concatenate(ids)).all()
    same = token_store.Shard(token_store.pack_shard(np.zeros(4096, np.uint16), np.array([4096]), np.array([1]), 1000))
    assert len(same.symbols) <= 8 and (same.document(0) == 0).all()


def test_shards_like_brute_force(docs, corpus, empty):
    tok = Tokenizer.from_file(token_store.default_tokenizer())
    table = token_store.write_token_shards(docs.withColumn("k", F.lit(1)).withColumn("path", F.lit(2)), shard_tokens=500)
    got = sorted(map(tuple, token_store.read_token_shards(table).collect()), key=lambda r: r[1])
    want, at = [], 0
    sized = sorted((((r[0] is not None, r[0] or 0), r) for r in corpus), key=lambda x: x[0])
    for _, r in sized:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_store.read_token_shards(token_store.write_token_shards(empty)).count() == 0
