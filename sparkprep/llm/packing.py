"""Variable-capacity best-fit packing of sequences.

Several sequence lengths (capacities) are permitted, each with a cost. Items are placed in decreasing length into the open
bin with the least sufficient room; where none fits, a bin of the size with the least cost for this item is opened: its
cost divided by what it is expected to hold, never less than the item. Finally every bin shrinks to the smallest
capacity that holds its contents. The expected fill is what couples the sizes, so each shard is packed under every
fill rate of ``fills`` and the packing of least total cost, after shrinking, is taken.

Items are documents as token ids with an end id. Those longer than the largest capacity are cut into pieces of that
capacity; nothing is dropped. Shards of about ``shard_items`` items are packed independently: only (id, position, length) is
shuffled, by a hash that spreads equal ids, into one partition a shard. ``pack_documents`` says where every piece goes;
``packed_sequences`` also moves the ids there and gives the sequences.

Defined results: a null or empty text is its end token alone; null ids and repeated rows are items like others; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._common import give_back, stage
from .token_store import Encoder, default_tokenizer

CAPACITIES = (1024, 2048, 4096, 8192, 16384)
PLACED = "doc_id long, piece int, piece_start long, piece_len long, bin_id long, bin_size long, bin_start long"


def default_cost(capacity: int) -> float:
    """Tokens, a constant for a sequence, and attention that grows with the square."""
    return capacity + 32 + capacity * capacity / 32768


def best_fit(lengths: list[int], capacities: list[int], costs: list[float], fill: float) -> list[tuple[int, int]]:
    """(bin, place within it) of each item; ``lengths`` in decreasing order, none above the largest capacity."""
    rooms: list[int] = []  # distinct amounts of room among open bins, ascending
    bins: dict[int, list[int]] = {}
    capacity: list[int] = []
    out = []
    for n in lengths:
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
        else:
            size = min((costs[k] * n / max(n, fill * c), c) for k, c in enumerate(capacities) if c >= n)[1]
            b, room = len(capacity), size
            capacity.append(size)
        out.append((b, capacity[b] - room))
        left = room - n
        if left:
            if left not in bins:
                bins[left] = []
                insort(rooms, left)
            bins[left].append(b)
    return out


def pack(lengths: list[int], capacities=CAPACITIES, cost=default_cost, fills=(0.5, 0.8, 0.95, 1.0)) -> tuple[list[tuple[int, int]], list[int]]:
    """Best packing over the fill rates: (bin, place) of each item, and each bin's shrunken size."""
    sizes = sorted(capacities)
    costs = [cost(c) for c in sizes]
    best = None
    for fill in fills:
        placed = best_fit(lengths, sizes, costs, fill)
        used: dict[int, int] = {}
        for (b, at), n in zip(placed, lengths):
            used[b] = max(used.get(b, 0), at + n)
        shrunk = [bisect_left(sizes, used[b]) for b in range(len(used))]
        total = sum(costs[k] for k in shrunk)
        if best is None or total < best[0]:
            best = (total, placed, [sizes[k] for k in shrunk])
    return best[1], best[2]


def token_count(text: Column, tokenizer: str | None = None) -> Column:
    """How many ids a text has, with its end id."""
    path = tokenizer or default_tokenizer()

    def count(text: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.int64()), *(pa.array(size + 1) for _, _, size in Encoder.of(path).encode_chunks(text))])

    return arrow_udf(count, "bigint").asNondeterministic()(text)


def token_ids(text: Column, tokenizer: str | None = None, end_id=0) -> Column:
    """The ids of a text and an end id, two bytes each."""
    path = tokenizer or default_tokenizer()

    def encode(text: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.binary())]
        for _, ids, size in Encoder.of(path).encode_chunks(text, end_id):
            ends = np.concatenate(([0], np.cumsum(2 * size))).astype(np.int32)
            parts.append(pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u2"))]))
        return pa.concat_arrays(parts)

    return arrow_udf(encode, "binary").asNondeterministic()(text)


def _numbers(parts: pa.Array) -> pa.Array:
    """The ids of each list of pieces, as integers."""
    give_back(parts.nbytes)
    pieces = parts.values  # end to end already, so nothing is made per piece
    bounds = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, 4 * pieces.offset) if len(pieces) else np.zeros(1, np.int32)
    ends = bounds[parts.offsets.to_numpy()] // 2
    ids = np.frombuffer(pieces.buffers()[2] or b"", "<u2", int(ends[-1] - ends[0]), 2 * int(ends[0]))
    return pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(ids.astype(np.int32)))


def _place(rows: DataFrame, n_rows: int, capacities, cost, shard_items: int) -> DataFrame:
    """``PLACED`` and ``row`` of rows (row, doc_id, n)."""
    top = max(capacities)
    shards = max(1, -(-n_rows // shard_items))
    spread = F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).alias("shard")
    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(top).cast("long"))
    pieces = rows.select("row", "doc_id", "n", spread, F.posexplode(starts).alias("piece", "piece_start"))
    pieces = pieces.select("shard", "row", "doc_id", "piece", "piece_start", F.least(F.col("n") - F.col("piece_start"), F.lit(top)).alias("piece_len"))

    def place(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        table = table.sort_by([("piece_len", "descending"), ("doc_id", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        placed, sizes = pack(table["piece_len"].to_pylist(), capacities, cost)
        names = ["row", "doc_id", "piece", "piece_start", "piece_len"]
        cols = [table[c] for c in names]
        cols += [pa.array([(shard << 40) + b for b, _ in placed], pa.int64()), pa.array([sizes[b] for b, _ in placed], pa.int64()), pa.array([at for _, at in placed], pa.int64())]
        return pa.table(cols, names=[*names, "bin_id", "bin_size", "bin_start"])

    # an explicit number of partitions, as shards are small but take their time
    return pieces.repartition(shards, "shard").groupBy("shard").applyInArrow(place, "row long, " + PLACED)


def pack_documents(docs: DataFrame, id_col="doc_id", text_col="text", length: Column | None = None, capacities=CAPACITIES, cost=default_cost, shard_items=50_000, tokenizer: str | None = None) -> DataFrame:
    """Where every piece of every document goes (``PLACED``). ``length``: tokens with the end id, if not those of the tokenizer."""
    n = token_count(F.col(f"`{text_col}`"), tokenizer) if length is None else F.greatest(F.lit(1), length).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), n.alias("n"))
    return _place(rows, docs.count(), capacities, cost, shard_items).drop("row")


def packed_sequences(docs: DataFrame, id_col="doc_id", text_col="text", capacities=CAPACITIES, cost=default_cost, shard_items=50_000, tokenizer: str | None = None, end_id=0) -> DataFrame:
    """The sequences themselves, a row each: bin_id, bin_size, n_tokens, ids (of all pieces, in place), doc_ids and piece_starts
    (of the pieces) and bin_starts (where each piece begins). A sequence is filled to ``bin_size`` by its reader.

    Texts are encoded once, into a table in the shared folder, as ids must not be made anew where a task is repeated.
    """
    ids = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), token_ids(F.col(f"`{text_col}`"), tokenizer, end_id).alias("ids"))
    ids = stage(ids.withColumn("n", (F.octet_length("ids") / 2).cast("long")))
    placed = _place(ids.select("row", "doc_id", "n"), ids.count(), capacities, cost, shard_items)
    pieces = placed.join(ids.select(F.col("row").alias("of"), "ids"), F.col("row") == F.col("of"))
    part = F.substring("ids", 2 * F.col("piece_start").cast("int") + 1, 2 * F.col("piece_len").cast("int"))
    pieces = pieces.select("bin_id", "bin_size", F.struct("bin_start", "doc_id", "piece_start", part.alias("ids")).alias("p"))
    bins = pieces.groupBy("bin_id", "bin_size").agg(F.array_sort(F.collect_list("p")).alias("p"))  # the largest capacity bounds a group
    bins = bins.select("bin_id", "bin_size", arrow_udf(_numbers, "array<int>").asNondeterministic()("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.piece_start").alias("piece_starts"), F.col("p.bin_start").alias("bin_starts"))
    return bins.select("bin_id", "bin_size", F.size("ids").cast("long").alias("n_tokens"), "ids", "doc_ids", "piece_starts", "bin_starts")


def op1_best_fit_packing(spark, sf_dir):
    """Where whole documents go, as ids of the 50k byte-level vocabulary with an end id."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
