"""WARC archives with a two-level capture index.

Writing: every task writes its records, each a gzip member of its own, to an
archive of its own in the shared folder, and lists them.  The list is sorted
by reversed-host URL key; each sorted partition becomes an index shard of
compressed blocks of lines, and beside it a sparse directory with the first
key and the byte range of each block.  Reading: a key's shard follows from the
shards' first keys, a binary search in the shard's directory gives the block,
a range read of that block gives the record's place, and a range read of the
archive the record.

Equal payloads of at least ``min_bytes`` bytes are stored once, in the record
with the largest id; the others are revisits that refer to it.

File names carry the task attempt, and only what a finished attempt listed is
ever read, so lost executors and repeated attempts leave the result right.

Cases: a null payload is empty; a null URL has the empty key and no target
URI.  Rows with equal ids (or none) and equal payloads are all responses if
theirs is the largest.  Payloads of any length are kept whole.  Repeated rows
give records of their own; an empty table gives no archive and no rows; extra
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import prepare, shared_folder, written
from strata.sources.tables import read_table

DATE = "2024-01-01T00:00:00Z"     # the tables carry no capture time
BLOCK_LINES = 256
ARCHIVE_BYTES = 1 << 30           # a task begins another archive beyond this
READ_BYTES = 64 << 20             # of compressed records that one task reads back
SHARDS = 64                       # index shards at least
SHARD_LINES = 1 << 20             # lines of an index shard beyond that; the shards' first keys go to all tasks

_PLACE = "key string, page_id long, file string, start long, length long"
_GZIP = 31                        # zlib window bits of a gzip member


def _open(path: str):
    """File system and path of a folder that all tasks share."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def url_key(url: str | None) -> str:
    """``com,example,www)/path?query`` in lower-case host order."""
    rest = re.sub(r"^[^/?#]*?://", "", (url or "").split("#")[0])
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host = rest[:cut].lower().rsplit("@", 1)[-1]
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + (rest[cut:] or "/") if rest else ""


def capture_key(url: str | None, page_id: int | None) -> str:
    """Index key: the URL key, then the id, so equal URLs spread over blocks."""
    return f"{quote(url_key(url), safe=',)/?:=&;%@+!$*()~.-_')} {'' if page_id is None else page_id}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one uncompressed record."""
    def headers(part: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in part.decode().split("\r\n")[1:])
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = headers(head)
    block = rest[:int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, headers(http), payload


def _attempt() -> str:
    from pyspark import TaskContext
    c = TaskContext.get()
    return f"{c.partitionId():06d}-{c.taskAttemptId()}"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html") -> DataFrame:
    """Write the archives; returns the place of every record (a written table)."""
    prepare(pages.sparkSession)
    text = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text.alias("payload"),
                        F.sha1(text.cast("binary")).alias("sha"))
    first = (rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first")))
    rows = rows.join(first, "sha", "left").withColumn(
        "refers_to", F.when((F.octet_length("payload") >= min_bytes) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open(folder)
        out, at, name, n = None, 0, "", 0
        try:
            for b in batches:
                places = []
                for page, url, text, sha, refers in zip(b["page_id"], b["url"], b["payload"], b["sha"], b["refers_to"]):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        fs.create_dir(base, recursive=True)
                        name, n, at = f"pages-{_attempt()}-{n:04d}.warc.gz", n + 1, 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    packer = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
                    raw = packer.compress(record(page, url, text.encode("utf-8", "surrogatepass"), digest, refers)) + packer.flush()
                    out.write(raw)
                    places.append((capture_key(url, page), page, name, at, len(raw)))
                    at += len(raw)
                frame = pd.DataFrame(places, columns=["key", "page_id", "file", "start", "length"])
                yield frame.astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    return written(rows.select("page_id", "url", "payload", "sha", "refers_to").mapInPandas(run, _PLACE), "places")


def write_index(places: DataFrame, folder: str, shards: int | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the index; returns ``shard, first_key, blocks`` of every shard (a written table).

    Without ``shards`` there are as many as the lines ask for: one task sorts
    and writes about ``SHARD_LINES`` of them, at any number of records.
    """
    shards = shards or max(SHARDS, -(-places.count() // SHARD_LINES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open(folder)
        name, directory, lines, at, out = f"index-{_attempt()}", [], [], 0, None

        def flush() -> None:
            nonlocal at, lines
            raw = zlib.compress("\n".join(lines).encode())
            out.write(raw)
            directory.append(f"{lines[0].split(chr(9), 1)[0]}\t{at}\t{len(raw)}")
            at, lines = at + len(raw), []

        for b in batches:
            for r in zip(b["key"], b["page_id"], b["file"], b["start"], b["length"]):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}.blocks", compression=None)
                lines.append("\t".join("" if pd.isna(x) else str(int(x) if isinstance(x, float) else x) for x in r))
                if len(lines) == block_lines:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        out.close()
        with fs.open_output_stream(f"{base}/{name}.directory", compression="gzip") as f:
            f.write("\n".join(directory).encode())
        yield pd.DataFrame({"shard": [name], "first_key": [directory[0].split("\t", 1)[0]], "blocks": [len(directory)]})

    # range partitions follow Spark's order of strings, which is that of their UTF-8; keys are ASCII
    ordered = places.repartitionByRange(shards, "key").sortWithinPartitions("key", "file", "start")
    return written(ordered.mapInPandas(run, "shard string, first_key string, blocks long"), "shards")


def look_up(keys: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """Places of all records with the keys (column ``key``, distinct)."""
    listed = sorted((r.first_key, r.shard) for r in shards.select("first_key", "shard").collect())   # a row per SHARD_LINES records
    if not listed:
        return keys.sparkSession.createDataFrame([], _PLACE)
    starts, names = [k for k, _ in listed], [s for _, s in listed]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # equal keys never straddle shards, as range partitions keep them together
            yield pd.DataFrame({"key": b["key"], "shard": [names[max(0, bisect_right(starts, k) - 1)] for k in b["key"]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open(folder)
        shard, blocks, first, ranges, block, lines = None, None, [], [], -1, {}
        for b in batches:
            found = []
            for key, name in zip(b["key"], b["shard"]):
                if name != shard:
                    if blocks is not None:
                        blocks.close()
                    with fs.open_input_stream(f"{base}/{name}.directory", compression="gzip") as f:
                        rows = [x.split("\t") for x in f.read().decode().split("\n")]
                    first, ranges = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
                    shard, blocks, block = name, fs.open_input_file(f"{base}/{name}.blocks"), -1
                at = max(0, bisect_right(first, key) - 1)
                while at > 0 and first[at] == key:      # equal keys may begin in an earlier block
                    at -= 1
                while at < len(first) and first[at] <= key:
                    if at != block:
                        blocks.seek(ranges[at][0])
                        lines, block = {}, at
                        for x in zlib.decompress(blocks.read(ranges[at][1])).decode().split("\n"):
                            k, *rest = x.split("\t")
                            lines.setdefault(k, []).append(rest)
                    found += [(key, int(p) if p else None, f, int(s), int(n)) for p, f, s, n in lines.get(key, ())]
                    at += 1
            yield pd.DataFrame(found, columns=["key", "page_id", "file", "start", "length"]).astype({"page_id": "Int64"})
        if blocks is not None:
            blocks.close()

    routed = keys.select("key").distinct().mapInPandas(route, "key string, shard string")
    return routed.repartition("shard").sortWithinPartitions("shard", "key").mapInPandas(run, _PLACE)


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """The records at the places, by range reads; payload digests are checked."""

    def number(urn: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(m[1]) if m else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open(folder)
        name, f = None, None
        for b in batches:
            rows = []
            for file, start, length in zip(b["file"], b["start"], b["length"]):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, fs.open_input_file(f"{base}/{file}")
                f.seek(int(start))
                warc, http, payload = parse_record(zlib.decompress(f.read(int(length)), _GZIP))
                digest, kind = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"]
                size = int(http["Content-Length"])
                if kind == "response" and (payload_digest(payload) != digest or len(payload) != size):
                    raise ValueError(f"{file} at {start}: the payload doesn't match its digest")
                rows.append((number(warc["WARC-Record-ID"]), warc.get("WARC-Target-URI"), size, digest, kind,
                             number(warc.get("WARC-Refers-To")), payload if kind == "response" else None))
            yield pd.DataFrame(rows, columns=["page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                               ).astype({"page_id": "Int64", "refers_to": "Int64"})
        if f is not None:
            f.close()

    # as many tasks as the archives' bytes ask for: the rows of places are small, what they point to isn't
    places = written(places, "warc-places")
    total = places.agg(F.sum("length")).first()[0] or 0
    cores = places.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-int(total) // READ_BYTES), min(cores, int(total) >> 20))      # small archives: all cores, a MB each
    ordered = places.repartitionByRange(tasks, "file", "start").sortWithinPartitions("file", "start")
    return ordered.select("file", "start", "length").mapInPandas(
        run, "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def keys_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The capture key of each row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": [capture_key(u, None if pd.isna(p) else int(p)) for u, p in zip(b["url"], b["page_id"])]})
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).mapInPandas(run, "key string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written, found by the index and read back."""
    pages = read_table(spark, sf_dir, "pages")
    prepare(spark)
    folder = shared_folder(spark, "warc")
    shards = write_index(write_archives(pages, folder), folder)
    found = look_up(keys_of(pages), shards, folder)
    return read_records(found, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first,
        list_transform(range(0, 8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::BIGINT) AS v FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(v, lambda x:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 15) & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31)::INT + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
