"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The probability of a word is the sum over
*all* its segmentations into pieces, computed by the forward algorithm; a text scores the sum of its words' log
probabilities.  Piece probabilities are fitted by EM (forward-backward expected counts) on word counts.

Pieces never cross white space, so a text's probability factors over its words and each worker keeps the score vector of
words it has met (the cache is emptied at ``CACHE`` words: memory is bounded, results don't depend on it).

Learning uses only rows that the caller admits, and only text and label: the ``docs_per_lang`` documents of each label
that are first in a hash order of their text. Only the counts of their words reach the driver.

Defined results: null text or text without a letter is ``und`` with score 0; ties go to the label that sorts first;
without labelled rows everything is ``und``; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._common import claim, fresh, slices

CACHE = 500_000
_MARK = "▁"
_TOKEN = regex.compile(r"\p{L}+")
SHORT = 40  # longer words are worked on one by one, in logarithms


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def load_pieces(path: str | None = None) -> list[str]:
    """Ordinary pieces of a sentencepiece vocabulary (control and byte pieces are left out)."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]


class PieceModel:
    """Languages, log-free piece probabilities (pieces x languages) and the probability of an unknown character."""

    def __init__(self, langs: list[str], pieces: list[str], probs: np.ndarray, unknown: float):
        self.langs, self.pieces, self.unknown = langs, pieces, unknown
        self.probs = probs
        self._rows = None
        self._cache: dict[str, int] = {}
        self._scores = None

    def __getstate__(self):
        return {"langs": self.langs, "pieces": self.pieces, "probs": self.probs, "unknown": self.unknown, "_rows": None, "_cache": {}, "_scores": None}

    def forget(self) -> None:
        self._rows, self._cache, self._scores = None, {}, None

    def forward_many(self, words: list[str]) -> np.ndarray:
        """``forward`` of many words at once: words of one length share the steps of the recursion."""
        rows, longest = self.row_numbers(), self.longest
        table = np.vstack([self.probs, np.zeros((1, len(self.langs)))])
        none, out = len(table) - 1, np.empty((len(words), len(self.langs)))
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            groups.setdefault(len(w) + 1, []).append(k)
        for n, ks in groups.items():
            if n > SHORT:
                for k in ks:
                    out[k] = self.forward(words[k])
                continue
            arcs = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - longest), j)]
            for at in range(0, len(ks), 2048):
                part = ks[at : at + 2048]
                found = np.array([[rows.get(s[i:j], none) for i, j in arcs] for s in (_MARK + words[k] for k in part)], np.int32)
                a = np.zeros((n + 1, len(part), len(self.langs)))
                a[0] = 1.0
                used = (found != none).any(axis=0)
                for j in range(1, n + 1):
                    a[j] = self.unknown * a[j - 1]
                    for c in self._ending(n, j):
                        if used[c]:
                            a[j] += a[arcs[c][0]] * table[found[:, c]]
                out[part] = np.log(a[n])
        return out

    def _ending(self, n: int, j: int) -> range:
        """Numbers of the arcs that end at j."""
        first = sum(min(x, self.longest) for x in range(1, j))
        return range(first, first + min(j, self.longest))

    def row_numbers(self) -> dict[str, int]:
        if self._rows is None:
            self._rows = {p: k for k, p in enumerate(self.pieces)}
            self.longest = max(map(len, self.pieces), default=1)
        return self._rows

    def forward(self, word: str) -> np.ndarray:
        rows, probs, s = self.row_numbers(), self.probs, _MARK + word
        n, k = len(s), len(self.langs)
        unk, longest = self.unknown, self.longest
        out = []
        # where which pieces end, once for all languages
        ends: list[list[tuple[int, np.ndarray]]] = []
        for j in range(1, n + 1):
            ends.append([(i, p) for i in range(max(0, j - longest), j) if (r := rows.get(s[i:j])) is not None for p in [probs[r]]])
        for c in range(k):
            a, log = [1.0] + [0.0] * n, 0.0
            for j in range(1, n + 1):
                x = unk * a[j - 1]
                for i, p in ends[j - 1]:
                    x += a[i] * p[c]
                a[j] = x
                if x < 1e-150:  # long words: rescale what later sums can still read
                    lo = max(0, j - longest)
                    top = max(a[lo : j + 1])
                    for i in range(lo, j + 1):
                        a[i] /= top
                    log += math.log(top)
            out.append(log + math.log(a[n]))
        return np.array(out)

    def known(self, words: list[str]) -> list[int]:
        """Rows of the score matrix that belong to the words; at most CACHE / 4 words at a time."""
        if self._scores is None:
            self._scores = np.empty((CACHE, len(self.langs)))
        new = [w for w in dict.fromkeys(words) if w not in self._cache]
        if len(self._cache) + len(new) > CACHE:
            self._cache.clear()
            new = list(dict.fromkeys(words))
        if new:
            at = len(self._cache)
            self._scores[at : at + len(new)] = self.forward_many(new)
            self._cache.update(zip(new, range(at, at + len(new))))
        get = self._cache.__getitem__
        return [get(w) for w in words]

    def score_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text under each language, zeros without a letter; how many words it has."""
        out, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        words: list[str] = []
        owner: list[tuple[int, int]] = []  # text, words of it in this round

        def flush():
            if words:
                got = self._scores_of(words)
                at = 0
                for k, n in owner:
                    out[k] += got[at : at + n].sum(axis=0)
                    at += n
            words.clear()
            owner.clear()

        for k, t in enumerate(texts):
            ws = words_of(t)
            size[k] = len(ws)
            for x in range(0, len(ws), CACHE // 4):
                part = ws[x : x + CACHE // 4]
                if len(words) + len(part) > CACHE // 4:
                    flush()
                words += part
                owner.append((k, len(part)))
        flush()
        return out, size

    def _scores_of(self, words: list[str]) -> np.ndarray:
        rows = self.known(words)
        return self._scores[rows]


def _lattices(words: list[str], index: dict[str, int], longest: int):
    """Where which pieces lie in the words, by length: word numbers, length, and (start, end, piece of each word) of each arc."""
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w) + 1, []).append(k)
    get = index.get
    for n, ks in groups.items():
        if n > SHORT:
            yield ks, n, None
            continue
        arcs = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - longest), j)]
        for at in range(0, len(ks), 2048):
            part = ks[at : at + 2048]
            found = np.array([[get(s[i:j], -1) for i, j in arcs] for s in (_MARK + words[k] for k in part)], np.int32)
            used = np.flatnonzero((found >= 0).any(axis=0)).tolist()
            yield part, n, [(*arcs[c], found[:, c].copy()) for c in used]


def _expected(lattices: list, words: list[str], times: np.ndarray, index: dict[str, int], longest: int, p: np.ndarray, floor: float) -> np.ndarray:
    """Expected number of uses of every piece, over all segmentations of the words: forward times backward."""
    seen = np.zeros(len(p) + 1)  # the last is for words without a piece there
    table = np.append(p, 0.0)
    for part, n, arcs in lattices:
        if arcs is None:
            for k in part:
                _expected_long(words[k], times[k], index, longest, table, floor, seen)
            continue
        q = [table[pieces] for _, _, pieces in arcs]
        a, b = np.zeros((n + 1, len(part))), np.zeros((n + 1, len(part)))
        a[0] = b[n] = 1.0
        at = 0
        for j in range(1, n + 1):
            a[j] = floor * a[j - 1]
            while at < len(arcs) and arcs[at][1] == j:
                a[j] += a[arcs[at][0]] * q[at]
                at += 1
        begin: dict[int, list[int]] = {}
        for c, (i, _, _) in enumerate(arcs):
            begin.setdefault(i, []).append(c)
        for i in range(n - 1, -1, -1):
            b[i] = floor * b[i + 1]
            for c in begin.get(i, ()):
                b[i] += b[arcs[c][1]] * q[c]
        if arcs:
            z = times[part] / a[n]
            uses = np.concatenate([z * a[i] * x * b[j] for (i, j, _), x in zip(arcs, q)])
            pieces = np.concatenate([x for _, _, x in arcs])
            seen += np.bincount(np.where(pieces < 0, len(p), pieces), uses, len(seen))
    return seen[:-1]


def _expected_long(word: str, times: float, index: dict[str, int], longest: int, table: np.ndarray, floor: float, seen: np.ndarray) -> None:
    s = _MARK + word
    n = len(s)
    arcs = [(i, j, k) for j in range(1, n + 1) for i in range(max(0, j - longest), j) if (k := index.get(s[i:j])) is not None]
    a = np.full(n + 1, -np.inf)
    a[0] = 0.0
    log, unknown, at = np.log(table[:-1]), math.log(floor), 0
    for j in range(1, n + 1):
        a[j] = unknown + a[j - 1]
        while at < len(arcs) and arcs[at][1] == j:
            a[j] = np.logaddexp(a[j], a[arcs[at][0]] + log[arcs[at][2]])
            at += 1
    b = _backward(n, arcs, log, unknown)
    for i, j, k in arcs:
        seen[k] += times * math.exp(a[i] + log[k] + b[j] - a[n])


def _backward(n: int, arcs: list[tuple[int, int, int]], log: np.ndarray, unknown: float) -> np.ndarray:
    begin: dict[int, list[tuple[int, int]]] = {}
    for i, j, k in arcs:
        begin.setdefault(i, []).append((j, k))
    b = np.full(n + 1, -np.inf)
    b[n] = 0.0
    for i in range(n - 1, -1, -1):
        b[i] = unknown + b[i + 1]
        for j, k in begin.get(i, ()):
            b[i] = np.logaddexp(b[i], b[j] + log[k])
    return b


def fit(counts: dict[str, dict[str, float]], pieces: list[str], rounds: int = 2, floor: float = 1e-7) -> PieceModel:
    """EM over word counts per language. ``floor`` is each piece's least probability, and an unknown character's."""
    langs = sorted(counts)
    index = {p: k for k, p in enumerate(pieces)}
    longest = max(map(len, pieces), default=1)
    probs = np.zeros((len(pieces), len(langs)))
    for c, lang in enumerate(langs):
        words = sorted(counts[lang])
        times = np.array([counts[lang][w] for w in words])
        lattices = list(_lattices(words, index, longest))
        p = np.full(len(pieces), 1.0 / (len(pieces) or 1))
        for _ in range(rounds):
            seen = _expected(lattices, words, times, index, longest, p, floor)
            p = np.maximum(floor, seen / (seen.sum() or 1.0))
        probs[:, c] = p
    return PieceModel(langs, pieces, probs, floor)


def learn(labelled: DataFrame, text_col="text", label_col="lang", vocabulary: str | None = None, docs_per_lang=400, rounds=2) -> PieceModel:
    """Fit on a bounded sample: see the module's text. ``labelled`` must hold training rows only."""
    rows = labelled.select(F.col(f"`{text_col}`").alias("t"), F.col(f"`{label_col}`").cast("string").alias("l")).filter("t is not null and l is not null")
    order = Window.partitionBy("l").orderBy("h")
    first = rows.select("l", F.xxhash64("t").alias("h")).distinct().withColumn("r", F.row_number().over(order)).filter(F.col("r") <= docs_per_lang)
    picked = rows.withColumn("h", F.xxhash64("t")).join(F.broadcast(first.select("l", "h")), ["l", "h"]).dropDuplicates(["l", "h"])

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for lang, t in zip(batch["l"].to_pylist(), batch["t"].to_pylist()):
                found.update((lang, w) for w in words_of(t))
            if found:
                ls, ws = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(ls), pa.array(ws), pa.array(list(found.values()), pa.int64())], ["l", "w", "n"])

    counts: dict[str, dict[str, float]] = {}
    for r in picked.select("l", "t").mapInArrow(count, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r.l, {})[r.w] = float(r.n)
    return fit(counts, load_pieces(vocabulary), rounds)


def predict(docs: DataFrame, model: PieceModel, text_col="text", out="language") -> DataFrame:
    """``docs`` with a column ``out``: struct(lang, score).

    score is the label's posterior under equal priors for a word of average evidence (log probabilities are divided by the number of
    words), so it says how clear the words are about their language, not how many there are.
    """
    (out,) = fresh(docs, out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<lang:string,score:double>")
    def identify(text: pa.Array) -> pa.Array:
        m = shared.value
        claim("words", m.forget)
        lang, score = [], []
        for s, n in (x for part in slices(text) for x in zip(*m.score_many([t or "" for t in part.to_pylist()]))):
            if not m.langs or not n:
                lang.append("und")
                score.append(0.0)
                continue
            best = int(np.argmax(s))
            lang.append(m.langs[best])
            score.append(float(1.0 / np.exp((s - s[best]) / n).sum()))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return docs.withColumn(out, identify.asNondeterministic()(F.col(f"`{text_col}`")))


def op3_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = learn(docs.filter(~held))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
