"""Raw JSON records, for what a typed schema loses: missing against null, a value's own type, the order of keys."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MELTED = "row long, pos int, key string, kind string, value string, canon string"


def leaf_values(record, prefix: tuple[str, ...] = ()):
    """(path, value) of the scalar leaves, in order: ``_id`` is skipped, lists pass on their records only."""
    if isinstance(record, dict):
        for k, v in record.items():
            if k == "_id":
                continue
            if isinstance(v, dict):
                yield from leaf_values(v, (*prefix, k))
            elif isinstance(v, (list, tuple)):
                for x in v:
                    if isinstance(x, dict):
                        yield from leaf_values(x, (*prefix, k))
            else:
                yield (*prefix, k), v


def label(v) -> str:
    if v is None:
        return "empty"
    return "typed" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "str"


def canonical(v) -> str:
    """Equal for values that are equal in Python: 1, 1.0 and True are one value, "1" is another."""
    if v is None:
        return "z"
    if isinstance(v, str):
        return "s" + v
    return f"n{int(v)}" if isinstance(v, (bool, int)) or v == v and abs(v) != float("inf") and v == int(v) else f"n{v!r}"


def melt_records(df: DataFrame, column: str = "value") -> DataFrame:
    """One row per leaf value of each JSON text: (row, pos, key, kind, value as Python text, canon)."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{column}`").alias("text"))

    def melt(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for n, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist()):
                if text is None:
                    continue
                for pos, (path, v) in enumerate(leaf_values(json.loads(text))):
                    out.append((n, pos, ".".join(path), label(v), None if v is None else str(v), canonical(v)))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], [x.split()[0] for x in MELTED.split(", ")])

    return rows.mapInArrow(melt, MELTED)
