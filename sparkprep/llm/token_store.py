"""Token ids on disk, compressed by Re-Pair grammars, one grammar a shard.

A shard holds whole documents in ascending id order, about ``shard_tokens`` ids.  Rounds of pair counting pick the most
frequent adjacent id pairs (never across a document's end), each becomes a nonterminal, and its occurrences are replaced
from left to right; rounds go on until pairs are rare or the 16-bit symbol space is full (or ``rounds`` are done, if given).
The file stores rules, the expansion length of every rule and each document's offset among the symbols and among the
ids, so that a document, or a range of its ids, is decoded without expanding anything before it.

Encoding: byte-level BPE never joins a visible character with white space behind it, so texts are cut there. Pieces repeat: a run of
texts is cut, and its pieces are numbered, in numpy and Arrow; each new piece is encoded once by the tokenizer and remembered by the
worker (up to ``CACHE`` pieces, then it starts anew); ids are gathered by number. Texts that contain the string of an added
token (<|endoftext|>) go to the tokenizer whole.

Documents are range-partitioned and sorted by id; only the number of ids per partition reaches the driver.
The table of shards is materialised before anything reads it: a task that runs again writes files of its own.

Defined results: null text is a document with the end id alone; null ids sort first; rows with the same id are ordered
by their text's hash; an empty table gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import NULL_KEY, claim, cut, fresh_dir, give_back, id_key, open_fs

CACHE = 500_000
KEEP = 64  # bytes of the longest piece that is remembered
CHUNK = 2 << 20  # bytes of text that are encoded at once
_MAGIC = b"RPR1"
_encoders: dict[str, "Encoder"] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SPACE_LIKE = _SPACE.copy()
_SPACE_LIKE[28:32] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_NEVER = 1 << 30


def piece_starts(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of texts laid end to end: at every text's start, at white space behind a visible character, and at
    whatever follows a letter and isn't one (of letters, those of ASCII only).

    Byte-level pre-tokenization always ends a piece there, whatever follows, so such pieces are encoded alone. Before white space the
    character must not be white space of any kind; where that is in doubt nothing is cut, which only makes a longer piece.
    """
    mark = _SPACE[b]
    mark[1:] &= ~_SPACE_LIKE[b[:-1]]
    mark[1:] |= _LETTER[b[:-1]] & ~_LETTER[b[1:]] & (b[1:] < 0x80)
    at = np.flatnonzero(mark[1:] & (b[:-1] >= 0x80)) + 1  # behind a longer character: is it white space?
    if len(at):
        wide = np.concatenate((np.zeros(2, np.uint8), b))
        one, two, three = b[at - 1], wide[at], wide[at - 1]
        blank = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
        blank |= (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE1) & (two == 0x9A) | (three == 0xE3) & (two == 0x80)
        mark[at[blank]] = False
    mark[starts] = True
    return np.flatnonzero(mark)


class Merges:
    """Byte-pair merges of many single words at once: in each round every word merges its first pair of least rank."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        rank, made = np.arange(len(pairs), dtype=np.int32), np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.made = made
        # tables with a pair a slot; pairs whose slot is taken go to the next table
        self.tables = []
        for mult in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646C | 1, 0xFD7046C5, 0xB55A4F09):
            table = np.full(1 << 18, -1, np.int32)
            slot = key * np.uint32(mult) >> np.uint32(14)
            table[slot] = rank
            own = table[slot] == rank
            keys = np.zeros(1 << 18, np.uint32)
            keys[slot[own]] = key[own]
            self.tables.append((np.uint32(mult), keys, table))
            key, rank = key[~own], rank[~own]
            if not len(key):
                break
        if len(key):
            raise ValueError("the merges don't fit the tables")
        self.first = np.zeros(256, np.int32)
        for byte, c in enumerate(_byte_letters()):
            self.first[byte] = vocab.get(c, -1)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        out = np.full(key.shape, _NEVER, np.int32)
        for mult, keys, table in self.tables:
            slot = key * mult >> np.uint32(14)
            hit = keys[slot] == key
            out[hit] = table[slot[hit]]
        return out

    def encode(self, words: list[bytes]):
        """Yields numbers of words and their ids, a row a word; words come together by how many ids they have."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(size).tolist():
            where = np.flatnonzero(size == n)
            s = self.first[np.frombuffer(b"".join([words[k] for k in where.tolist()]), np.uint8)].reshape(-1, n)
            r = self.ranks(s[:, :-1], s[:, 1:])
            while n > 1 and len(where):
                best = np.argmin(r, axis=1)
                rows = np.arange(len(where))
                rank = r[rows, best]
                on = rank < _NEVER
                if not on.all():
                    yield where[~on], s[~on]
                    where, s, r, best, rank = where[on], s[on], r[on], best[on], rank[on]
                    rows = rows[: len(where)]
                s[rows, best] = self.made[rank]
                n -= 1
                at = np.arange(n)
                s = np.take_along_axis(s, at + (at > best[:, None]), 1)
                r = np.take_along_axis(r, at[:-1] + (at[:-1] >= best[:, None]), 1)
                k = np.flatnonzero(best < n - 1)
                r[k, best[k]] = self.ranks(s[k, best[k]], s[k, best[k] + 1])
                k = np.flatnonzero(best > 0)
                r[k, best[k] - 1] = self.ranks(s[k, best[k] - 1], s[k, best[k]])
            if len(where):
                yield where, s


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    return [chr(b if b in plain else next(more)) for b in range(256)]


class Encoder:
    """ids of whole texts; equals ``encode(text, add_special_tokens=False).ids`` of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # every character of a byte-level token stands for one byte
        self.width = np.array([len(self.tok.id_to_token(k) or "") for k in range(self.tok.get_vocab_size())], np.int64)
        self.merges = Merges(json.loads(self.tok.to_str())["model"])
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.size, self.start, self.flat = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint16)
        self.used = 0

    @classmethod
    def of(cls, path: str) -> "Encoder":
        claim("ids", _encoders.clear)
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces end to end, and how many each has.

        Words (letters, behind a space or not) take their merges at once. Of other pieces, those that end visibly run through the
        tokenizer together, and their ids are told apart by the byte lengths of the tokens.
        """
        rest, words = [], []
        for k, p in enumerate(pieces):
            t = p[1:] if p[0] == 32 else p
            # letters that every version of Unicode has, so that all libraries agree on them
            word = len(p) <= 32 and (t.isalpha() or not p.isascii() and (t := t.decode()).isalpha() and max(t) < "\u0250")
            (words if word else rest).append(k)
        number, found = np.array(words, np.int64), []
        for where, ids in self.merges.encode([pieces[k] for k in words]):
            found.append((number[where], np.full(len(where), ids.shape[1]), ids.ravel()))
        texts = [pieces[k].decode() for k in rest]
        ends = np.fromiter((t[-1].isspace() for t in texts), bool, len(rest))
        first = np.fromiter((not t[0].isspace() for t in texts), bool, len(rest))
        sizes = np.fromiter((len(pieces[k]) for k in rest), np.int64, len(rest)) + first
        number = np.array(rest, np.int64)
        together = np.flatnonzero(~ends)
        for at in range(0, len(together), 4096):
            some = together[at : at + 4096]
            text = "".join("\n" + texts[k] if first[k] else texts[k] for k in some.tolist())  # a line end is a token by itself
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
            stop = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes[some])) + 1
            begin = np.concatenate(([0], stop[:-1]))
            ids = np.delete(ids, begin[first[some]])
            found.append((number[some], stop - begin - first[some], ids))
        alone = np.flatnonzero(ends)
        got = [e.ids for e in self.tok.encode_batch_fast([texts[k] for k in alone.tolist()], add_special_tokens=False)]
        found.append((number[alone], np.fromiter(map(len, got), np.int64, len(got)), np.fromiter((i for x in got for i in x), np.int64)))
        size = np.zeros(len(pieces), np.int64)
        for where, n, _ in found:
            size[where] = n
        start = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.uint16)
        for where, n, ids in found:
            flat[np.repeat(start[where] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return flat, size

    def _table(self, pieces: list[bytes]) -> np.ndarray:
        """Slots of the pieces, after encoding those that are new. Long ones are forgotten at the next call."""
        if len(self.slots) > CACHE:
            self.clear()
        get = self.slots.get
        slot = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        new = np.flatnonzero(slot < 0)
        if len(new):
            texts = [pieces[k] for k in new.tolist()]
            flat, size = self._encode(texts)
            # those to remember come first, so that the next call overwrites the rest
            keep = np.fromiter((len(t) <= KEEP for t in texts), bool, len(texts))
            order = np.argsort(~keep, kind="stable")
            stop = np.cumsum(size)
            base, n = len(self.slots), len(texts)
            while base + n > len(self.size):
                self.size, self.start = np.concatenate((self.size, self.size)), np.concatenate((self.start, self.start))
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate((self.flat, self.flat))
            size, begin = size[order], (stop - size)[order]
            at = np.cumsum(size) - size
            self.flat[self.used : self.used + len(flat)] = flat[np.repeat(begin - at, size) + np.arange(len(flat))]
            self.size[base : base + n], self.start[base : base + n] = size, at + self.used
            slot[new[order]] = np.arange(base, base + n)
            kept = int(keep.sum())
            self.slots.update(zip((texts[k] for k in order[:kept].tolist()), range(base, base + kept)))
            self.used += int(size[:kept].sum())
        return slot

    def encode_array(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (Arrow strings) end to end, and how many each has; ``end`` is put behind each text."""
        texts = texts.fill_null("").cast(pa.large_binary())
        whole = np.zeros(len(texts), bool)
        for t in self.added:
            whole |= pc.match_substring(texts, t.encode()).to_numpy(zero_copy_only=False)
        special = np.flatnonzero(whole)
        if len(special):
            strings = [texts[k].as_py().decode() for k in special.tolist()]
            texts = pc.if_else(pa.array(whole), pa.scalar(b"", pa.large_binary()), texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        data = texts.buffers()[2]
        b = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        ends = offsets[1:] - offsets[0]
        if len(b):
            begin = offsets[:-1] - offsets[0]
            starts = piece_starts(b, begin[begin < ends])
            cuts = np.append(starts, len(b)).astype(np.int64) + offsets[0]
            pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), data]).dictionary_encode()
            slot = self._table(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())[pieces.indices.to_numpy()]
            size, first = self.size[slot].astype(np.int64), self.start[slot]
            stop = np.cumsum(size)
            ids = self.flat[np.repeat(first - stop + size, size) + np.arange(stop[-1])]
            ends = np.concatenate(([0], stop))[np.searchsorted(starts, ends)]
        else:
            ids, ends = np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
        if len(special):
            got = [np.array(e.ids, np.uint16) for e in self.tok.encode_batch_fast(strings, add_special_tokens=False)]
            ids = np.insert(ids, np.repeat(ends[special], [len(x) for x in got]), np.concatenate(got))
            more = np.zeros(len(texts), np.int64)
            more[special] = [len(x) for x in got]
            ends = ends + np.cumsum(more)
        if end is not None:
            ids = np.insert(ids, ends, end)
            ends = ends + np.arange(1, len(texts) + 1)
        return ids, np.diff(ends, prepend=0)

    def encode_chunks(self, texts: pa.Array, end: int | None = None):
        """``encode_array`` in runs of about ``CHUNK`` bytes: number of the first text, ids, sizes."""
        size = pc.binary_length(texts.cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(size), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right")))
            yield at, *self.encode_array(texts.slice(at, to - at), end)
            give_back(int(size[at:to].sum()))
            at = to

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, ids, size in self.encode_chunks(pa.array(texts, pa.large_string())):
            out += np.split(ids, np.cumsum(size)[:-1])
        return out


def repair(seq: np.ndarray, ends: np.ndarray, base: int, rounds: int | None, per_round: int, least: int):
    """Symbols, ends of documents among them, and rules (pairs). ``ends``: one past each document's last id."""
    none, mult, shift = np.uint32(0xFFFFFFFF), np.uint32(0x9E3779B1), np.uint32(12)
    rules: list[np.ndarray] = []
    n_rules, room = 0, 65535 - base
    seq = seq.copy()
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        if len(seq) < 2 or n_rules >= room:
            break
        pair = seq[:-1].astype(np.uint32)
        pair <<= np.uint32(16)
        pair |= seq[1:]
        pair[ends[:-1] - 1] = none  # no pair crosses a document's end
        ordered = np.sort(pair)
        at = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
        count = np.diff(np.concatenate((at, [len(ordered)])))
        often = np.flatnonzero(count >= least)
        often = often[ordered[at[often]] != none]
        if not len(often):
            break
        take = min(per_round, 32767, room - n_rules, len(often))
        top = often[np.argpartition(-count[often], take - 1)[:take]]
        keys = np.sort(ordered[at[top]])
        # a table with one pair a slot; of the few that share a slot, one waits for a later round
        slots = np.full(1 << 20, -1, np.int16)
        slots[(keys * mult) >> shift] = np.arange(len(keys), dtype=np.int16)
        keys = keys[np.sort(slots[slots >= 0])]
        take = len(keys)
        slots[(keys * mult) >> shift] = np.arange(take, dtype=np.int16)
        slot = pair * mult
        slot >>= shift
        which = slots[slot]
        hit = np.flatnonzero(which >= 0)
        which = which[hit]
        true = keys[which] == pair[hit]
        hit, which = hit[true], which[true]
        # in a run of overlapping hits every second one is replaced, from the left
        number = np.arange(len(hit))
        start = np.concatenate(([True], np.diff(hit) != 1))
        odd = (number - np.maximum.accumulate(np.where(start, number, 0))) & 1
        hit, which = hit[odd == 0], which[odd == 0]
        seq[hit] = base + n_rules + which.astype(np.int32)
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        ends = ends - np.searchsorted(hit + 1, ends)
        seq = seq[keep]
        rules.append(np.stack([keys >> np.uint32(16), keys & np.uint32(0xFFFF)], axis=1).astype(np.uint16))
        n_rules += take
    return seq, ends, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16)


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """All symbols' expansions end to end, and where each one's starts (and the last one's ends)."""
    out: list[bytes] = []
    for a, b in rules.tolist():  # a rule's symbols are terminals or earlier rules
        out.append((out[a - base] if a >= base else a.to_bytes(2, "little")) + (out[b - base] if b >= base else b.to_bytes(2, "little")))
    flat = np.concatenate([np.arange(base, dtype=np.uint16), np.frombuffer(b"".join(out), "<u2")])
    size = np.ones(base + len(rules), np.int64)
    size[base:] = [len(x) // 2 for x in out]
    return flat, np.concatenate(([0], np.cumsum(size)))


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, table: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    if not len(rules) or not len(symbols):
        return symbols.astype(np.uint16)
    flat, start = expansions(rules, base) if table is None else table
    size = (start[1:] - start[:-1])[symbols]
    stop = np.cumsum(size)
    at = np.repeat((start[symbols] - stop + size).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at]


def pack_shard(seq: np.ndarray, sizes: np.ndarray, docs: np.ndarray, base: int, rounds: int | None = None, per_round=2048, least=8) -> bytes:
    """One shard's file. ``seq``: uint16 ids of all documents, each with its end id; ``docs``: their keys."""
    symbols, ends, rules = repair(seq, np.cumsum(sizes), base, rounds, per_round, least)
    length = [1] * base
    for a, b in rules.tolist():
        length.append(length[a] + length[b])
    head = _MAGIC + struct.pack("<IIIQQ", len(sizes), len(rules), base, len(symbols), len(seq))
    parts = [docs.astype("<i8"), np.concatenate(([0], ends)).astype("<u8"), np.concatenate(([0], np.cumsum(sizes))).astype("<u8"), rules.astype("<u2"), np.array(length[base:], "<u4"), symbols.astype("<u2")]
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """Random access into a shard's file."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a shard of token ids")
        size = struct.calcsize("<IIIQQ")
        self.n, n_rules, self.base, n_symbols, self.n_ids = struct.unpack("<IIIQQ", data[4 : 4 + size])
        at = 4 + size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            return x

        self.docs, self.at_symbol, self.at_id = take("<i8", self.n), take("<u8", self.n + 1), take("<u8", self.n + 1)
        self.rules, self.length = take("<u2", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        self.symbols = take("<u2", n_symbols)
        self.table = expansions(self.rules, self.base)

    def document(self, k: int) -> np.ndarray:
        return expand(self.symbols[int(self.at_symbol[k]) : int(self.at_symbol[k + 1])], self.rules, self.base, self.table)

    def window(self, k: int, start: int, stop: int) -> np.ndarray:
        """ids [start, stop) of document k: expansion lengths skip the symbols before it."""
        s = self.symbols[int(self.at_symbol[k]) : int(self.at_symbol[k + 1])]
        size = np.ones(len(s), np.int64)
        size[s >= self.base] = self.length[s[s >= self.base] - np.uint16(self.base)]
        end = np.cumsum(size)
        a, b = int(np.searchsorted(end, start, "right")), int(np.searchsorted(end, stop, "left")) + 1
        before = int(end[a - 1]) if a else 0
        return expand(s[a:b], self.rules, self.base, self.table)[start - before : stop - before]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_token_shards(docs: DataFrame, folder: str | None = None, id_col="doc_id", text_col="text", tokenizer: str | None = None, end_id=0, shard_tokens=3_000_000, rounds: int | None = None) -> DataFrame:
    """Write shards and return their table: path, part, seq, n_docs, n_ids; (part, seq) is ascending id order."""
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "tokens")
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(id_key(id_col).alias("k"), F.col(f"`{text_col}`").alias("t")).withColumn("x", F.xxhash64("t"))
    rows = rows.repartitionByRange("k", "x").sortWithinPartitions("k", "x").select("k", "t")

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = Encoder.of(tokenizer)
        base = enc.tok.get_vocab_size()
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        held, keys, size, seq = [], [], 0, 0
        shards = []

        def flush():
            nonlocal held, keys, size, seq
            if held:
                path = f"{folder}/part-{part:05d}-{seq:04d}-{uuid.uuid4().hex}.rpr"
                with fs.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}") as f:
                    f.write(pack_shard(*(np.concatenate(x) for x in zip(*held)), np.concatenate(keys), base, rounds))
                shards.append((path, part, seq, sum(map(len, keys)), size))
                held, keys, size, seq = [], [], 0, seq + 1

        for batch in batches:
            for at, ids, sizes in enc.encode_chunks(batch["t"], end_id):
                stop = np.cumsum(sizes)
                done = 0
                while done < len(sizes):
                    before = int(stop[done - 1]) if done else 0
                    to = min(len(sizes), int(np.searchsorted(stop, before + shard_tokens - size)) + 1)
                    held.append((ids[before : stop[to - 1]], sizes[done:to]))
                    keys.append(batch["k"].to_numpy()[at + done : at + to])
                    size += int(stop[to - 1]) - before
                    done = to
                    if size >= shard_tokens:
                        flush()
        flush()
        if shards:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*shards)], ["path", "part", "seq", "n_docs", "n_ids"])

    return cut(rows.mapInArrow(write, "path string, part long, seq long, n_docs long, n_ids long"))


def read_token_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files. start: ids of all documents before it."""
    spark = shards.sparkSession
    n = max(1, shards.count())
    starts, total = [], 0
    for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toLocalIterator():  # a row a partition
        starts.append((r.part, total))
        total += r.n
    before = spark.createDataFrame(starts, "p long, before long")
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    at = shards.withColumn("within", within).join(before, F.col("part") == F.col("p"))
    at = at.select("path", (F.col("before") + F.col("within")).alias("start")).repartition(n, "path")

    def read(batches):
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                fs, p = open_fs(path)
                with fs.open_input_stream(p) as f:
                    shard = Shard(f.read())
                ids = expand(shard.symbols, shard.rules, shard.base, shard.table).astype("<u4")
                where = shard.at_id.astype(np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(where[:-1].tolist(), where[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.docs, mask=shard.docs == NULL_KEY), pa.array(where[:-1] + start), pa.array(np.diff(where)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return at.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_ids(spark, sf_dir):
    return read_token_shards(write_token_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")))
