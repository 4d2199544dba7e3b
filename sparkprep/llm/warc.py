"""WARC archives with a two-level capture index.

Writing: every page becomes a gzip member of a WARC 1.1 file: a response, or a revisit of an equal payload. Of the pages
with equal payloads of at least ``min_bytes`` bytes, those with the largest id are responses and the others revisits of
it; smaller payloads are always responses. Revisits carry the HTTP headers, hence the full payload's length, and its
digest. Files are named by task and a random part, and the table of captures is materialised before use, so a task that
runs again can't disturb what others refer to.

Index: captures are sorted by (reversed-host URL key, date, file, offset) by range partitioning, so that a URL with very
many captures spans partitions, and written as gzip blocks of ``block_lines`` lines; a sparse directory holds each
block's first key and byte range. A lookup bisects the directory, reads the blocks that can hold the key by range, and
then the records by range.

Payload owners come from a pre-aggregated maximum per digest; the join back is an ordinary shuffle join that adaptive
execution splits where one payload is very common.

Defined results: null html is an empty payload; a null url has key "-"; a null id stays null and is never an owner while
others have ids; rows that share the largest id are all responses; an empty table writes no files and gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, fresh_dir, open_fs

_DATE = "2024-01-01T00:00:00Z"
CAPTURES = "key string, date string, page_id long, file string, offset long, length long, digest string, type string"
DIRECTORY = "first string, file string, offset long, length long, lines long, part long"


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://www.Example.com:80/a?b#c`` gives ``com,example)/a?b``."""
    if not url:
        return "-"
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return re.sub(r"\s", "%20", url)
    host = re.sub(r"^www\d*\.", "", host)
    at = ",".join(reversed(host.split(".")))
    if port and (u.scheme, port) not in (("http", 80), ("https", 443)):
        at += f":{port}"
    return re.sub(r"\s", "%20", f"{at}){u.path or '/'}" + (f"?{u.query}" if u.query else ""))


def record_id(page_id: int | None) -> str:
    """An invertible record name: the id's 64 bits behind a fixed prefix."""
    return f"<urn:uuid:{uuid.UUID(int=((0x5EC0 if page_id is None else 0x5EC1) << 64) | ((page_id or 0) & (2**64 - 1)))}>"


def id_of(record: str) -> int | None:
    n = uuid.UUID(record.strip("<>").rpartition(":")[2]).int
    low = n & (2**64 - 1)
    return None if n >> 64 == 0x5EC0 else low - 2**64 if low >> 63 else low


def warc_record(page_id, url, payload: bytes, owner, date=_DATE) -> tuple[bytes, str]:
    sha = hashlib.sha1(payload).digest()
    kind = "response" if owner is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if owner is None else b"")
    target = re.sub(r"[\r\n]", " ", url or "").encode()
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: {record_id(page_id)}".encode(), f"WARC-Date: {date}".encode(), b"WARC-Target-URI: " + target]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}".encode(), f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}".encode()]
    if owner is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(owner)}".encode()]
    return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0), sha.hex()


@dataclass
class Record:
    page_id: int | None
    url: str
    type: str
    payload: bytes
    payload_bytes: int
    digest: str
    refers_to: int | None


def parse_record(member: bytes) -> Record:
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http).group(1))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].rpartition(":")[2]).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = fields.get("WARC-Refers-To")
    return Record(id_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, payload, size, digest, id_of(refers) if refers else None)


def write_archives(pages: DataFrame, folder: str | None = None, id_col="page_id", url_col="url", html_col="html", min_bytes=1000, roll_bytes=256 << 20) -> DataFrame:
    """Write WARC files and return the table of captures (``CAPTURES``), one row a page."""
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    payload = F.coalesce(F.encode(F.col(f"`{html_col}`"), "utf-8"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("p"), F.col(f"`{url_col}`").alias("u"), payload.alias("b")).withColumn("d", F.sha1("b"))
    owners = rows.filter(F.octet_length("b") >= min_bytes).groupBy("d").agg(F.max("p").alias("o"), F.count("*").alias("n")).filter("n > 1")
    # reversed twice, the planner shuffles the owners again, and may then split a very common payload's rows
    owners = owners.select(F.reverse(F.reverse("d")).alias("od"), "o")
    joined = rows.join(owners, F.col("d") == F.col("od"), "left")
    refers = F.when(F.col("o").isNotNull() & (F.col("p").isNull() | (F.col("p") < F.col("o"))), F.col("o"))
    joined = joined.select("p", "u", "b", refers.alias("r"))

    def write(batches):
        from pyspark import TaskContext

        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for p, u, b, r in zip(*(batch[c].to_pylist() for c in ("p", "u", "b", "r"))):
                if out is None or at >= roll_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                member, digest = warc_record(p, u, b, r)
                out.write(member)
                rows.append((url_key(u), _DATE, p, f"{folder}/{name}", at, len(member), digest, "response" if r is None else "revisit"))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], [x.split()[0] for x in CAPTURES.split(", ")])
        if out is not None:
            out.close()

    return cut(joined.mapInArrow(write, CAPTURES))


def write_index(captures: DataFrame, folder: str | None = None, block_lines=3000) -> DataFrame:
    """Write the sorted, blocked index and return its directory (``DIRECTORY``), one row a block."""
    folder = folder or fresh_dir(captures.sparkSession, "cdx")
    order = ["key", "date", "file", "offset"]
    line = F.concat_ws(" ", "key", "date", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "file", F.col("offset").cast("string"), F.col("length").cast("string"), "digest", "type")
    rows = captures.repartitionByRange(*order).sortWithinPartitions(*order).select("key", line.alias("line"))

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        name = f"cdx-{part:05d}-{uuid.uuid4().hex}.gz"
        out, at, held, first, made = None, 0, [], None, []

        def flush():
            nonlocal out, at, held
            if held:
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                block = gzip.compress(("\n".join(held) + "\n").encode(), 6, mtime=0)
                out.write(block)
                made.append((first, f"{folder}/{name}", at, len(block), len(held), part))
                at += len(block)
                held = []

        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["line"].to_pylist()):
                if not held:
                    first = key
                held.append(text)
                if len(held) == block_lines:
                    flush()
        flush()
        if out is not None:
            out.close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*made)], [x.split()[0] for x in DIRECTORY.split(", ")])

    return cut(rows.mapInArrow(write, DIRECTORY))


def _range(file: str, offset: int, length: int) -> bytes:
    fs, path = open_fs(file)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


def block_lines_of(file: str, offset: int, length: int) -> list[str]:
    return gzip.decompress(_range(file, offset, length)).decode().splitlines()


def read_index(directory: DataFrame) -> DataFrame:
    """All captures, read from the index blocks."""

    def read(batches):
        for batch in batches:
            for file, offset, length in zip(*(batch[c].to_pylist() for c in ("file", "offset", "length"))):
                rows = [x.split(" ") for x in block_lines_of(file, offset, length)]
                cols = list(zip(*rows))
                ids = pa.array([None if x == "-" else int(x) for x in cols[2]], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), ids, pa.array(cols[3]), pa.array(map(int, cols[4]), pa.int64()), pa.array(map(int, cols[5]), pa.int64()), pa.array(cols[6]), pa.array(cols[7])], [x.split()[0] for x in CAPTURES.split(", ")])

    return directory.repartition("file", "offset").mapInArrow(read, CAPTURES)


def read_archives(captures: DataFrame) -> DataFrame:
    """(page_id, url, html bytes, payload_bytes, payload_digest, record_type, refers_to) of the captures' records."""
    kind = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    rows = captures.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")

    def read(batches):
        name, f = None, None
        for batch in batches:
            got = []
            for file, offset, length in zip(*(batch[c].to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if f is not None:
                        f.close()
                    fs, path = open_fs(file)
                    name, f = file, fs.open_input_file(path)
                f.seek(offset)
                r = parse_record(f.read(length))
                got.append((r.page_id, r.url, r.payload, r.payload_bytes, r.digest, r.type, r.refers_to))
                if len(got) == 500:
                    yield _batch(got)
                    got = []
            if got:
                yield _batch(got)
        if f is not None:
            f.close()

    return rows.mapInArrow(read, kind)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])


class CaptureIndex:
    """Lookups by URL. The directory holds one row per ``block_lines`` captures and is opened only up to ``max_blocks``."""

    def __init__(self, directory: DataFrame, max_blocks=1_000_000):
        n = directory.count()
        if n > max_blocks:
            raise ValueError(f"{n} blocks: restrict the directory to a range of first keys before opening it")
        self.blocks = [tuple(r) for r in directory.orderBy("part", "offset").toLocalIterator()]
        self.firsts = [b[0] for b in self.blocks]

    def lookup(self, url: str) -> list[Record]:
        key = url_key(url)
        at = max(0, bisect.bisect_left(self.firsts, key) - 1)
        out = []
        while at < len(self.blocks) and self.firsts[at] <= key:
            lines = block_lines_of(*self.blocks[at][1:4])
            k = bisect.bisect_left(lines, key + " ")
            while k < len(lines) and lines[k].startswith(key + " "):
                x = lines[k].split(" ")
                out.append(parse_record(_range(x[3], int(x[4]), int(x[5]))))
                k += 1
            at += 1
        return out


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    got = read_archives(read_index(write_index(captures)))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY d) AS top
      FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages))
"""
