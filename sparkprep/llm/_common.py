"""Shared helpers of the corpus operators: checkpoints, word hashing and rolling windows.

Words are always taken from the UTF-8 bytes of a text.  ``bytes.split()`` splits on exactly
``[\\x20\\x09-\\x0D]``, so it yields the words ``[^\\x20\\x09-\\x0D]+``; the second word class used here,
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, comes from a 256-byte translation table
followed by the same split.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from xxhash import xxh3_64_intdigest

from ..session import shared_dir

#: Stands for a null id inside joins, so that such rows are neither lost nor matched with each other by accident.
NULL_KEY = -(2**63)

#: bytes.translate table: A-Z to a-z, letters, digits and all bytes from 0x80 stay, everything else becomes a space.
ALNUM_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
#: Lower-cases A-Z and nothing else.
LOWER_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

_R = 0x9E3779B97F4A7C15


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage; reads after the loss of an executor still work."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """As ``cut``, as a compressed Parquet table in the shared folder: smaller where rows hold texts."""
    at = fresh_dir(df.sparkSession, "stage")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have yet (Spark compares them without case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def id_key(col: str):
    """Never-null join key of an id column: no null filter is pushed below the exchange, so exchanges can be reused."""
    return F.coalesce(F.col(f"`{col}`").cast("long"), F.lit(NULL_KEY))


def apart(number):
    """The same number as an expression that the planner doesn't see through.

    An aggregate joined on its own key isn't shuffled again, and adaptive execution splits a very common key only where
    both sides of a join are shuffled. Keying the (small) aggregate by this makes it so.
    """
    return F.bitwise_not(F.bitwise_not(number))


def key_filter(keys: DataFrame, *columns: str, bits: int = 1 << 26):
    """Bloom filter of the rows of ``keys``, as a function of the same number of columns: false only where no row has these values.

    It takes ``bits`` / 8 bytes whatever the number of keys, and is broadcast; the driver gets one number for each of its
    ``bits`` / 64 parts at most. With very many keys it lets more rows pass, which costs time, not correctness.
    """
    spots = lambda h: (F.shiftright(h, 32), h)
    h = F.xxhash64(*columns)
    spread = F.explode(F.array(*[F.pmod(x, F.lit(bits)) for x in spots(h)]))
    parts = keys.select(spread.alias("at")).groupBy((F.col("at") / 64).cast("int").alias("part")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("has"))
    got = parts.toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[got["part"].to_numpy()] = got["has"].to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @arrow_udf("boolean")
    def may(h: pa.Array) -> pa.Array:
        table, h = shared.value, h.to_numpy(zero_copy_only=False)
        found = np.ones(len(h), bool)
        for x in (h >> 32, h):
            at = x % bits
            found &= (table[at >> 6] >> (at & 63)) & 1 == 1
        return pa.array(found)

    return lambda *values: may(F.xxhash64(*values))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def rolling(h: np.ndarray, k: int, seed: int = _R) -> np.ndarray:
    """Hash of every window of ``k`` consecutive values, by doubling: O(log k) vector steps."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    seed &= 2**64 - 1
    pieces, size, cur = [], 1, h
    left = k
    while True:
        if left & size:
            pieces.append((size, cur))
            left -= size
        if not left:
            break
        cur = cur[:-size] * np.uint64(pow(seed, size, 2**64)) + cur[size:]
        size *= 2
    acc, at = None, 0
    for size, cur in reversed(pieces):
        part = cur[at : at + n]
        acc = part.copy() if acc is None else acc * np.uint64(pow(seed, size, 2**64)) + part
        at += size
    return mix(acc ^ np.uint64(k))


def sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` consecutive values."""
    n = len(g) - w + 1
    if n <= 0:
        return g[:0]
    size, cur = 1, g
    while size * 2 <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    return np.minimum(cur[:n], cur[w - size : w - size + n])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


_claimed: tuple[str, Callable[[], None]] | None = None


def claim(owner: str | None, forget: Callable[[], None] | None = None) -> None:
    """A Python worker serves one operator after another: whoever keeps a cache there says so, and the next one clears it."""
    global _claimed
    if _claimed and _claimed[0] != owner:
        _claimed[1]()
        _claimed = None
        give_back()
    if owner and forget:
        _claimed = (owner, forget)


ROWS = 256  # that are Python objects at a time
EVERY = 16 << 20
_worked = 0
try:
    _malloc_trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _malloc_trim = None


def give_back(worked: int = EVERY) -> None:
    """Return to the system what the worker has freed, each time it has worked on ``EVERY`` bytes.

    Allocators keep freed memory for the process. Workers serve all operators in turn, so each would hold the most that any took.
    """
    global _worked
    _worked += worked
    if _worked >= EVERY:
        _worked = 0
        pa.default_memory_pool().release_unused()
        if _malloc_trim:
            _malloc_trim(0)


def slices(values) -> Iterator:
    """An Arrow array or batch, ``ROWS`` rows at a time: a whole batch as Python objects takes several times its size."""
    for at in range(0, len(values), ROWS):
        part = values.slice(at, ROWS)
        yield part
        give_back(part.nbytes)


def as_bytes(values) -> Iterator[bytes | None]:
    """UTF-8 bytes of an Arrow string array; null stays None."""
    claim(None)
    values = values.cast(pa.binary() if pa.types.is_string(values.type) else pa.large_binary())
    return (t for part in slices(values) for t in part.to_pylist())


def in_arrow(rows: Iterable, kind: pa.DataType) -> pa.Array:
    """Arrow array of rows that are made one by one, ``ROWS`` at a time."""
    rows = iter(rows)
    return pa.concat_arrays([pa.array([], kind), *(pa.array(some, kind) for some in iter(lambda: list(islice(rows, ROWS)), []))])


def open_fs(uri: str):
    """pyarrow file system and path of a folder or file, for any scheme pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    elif uri.startswith("/"):
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri)
