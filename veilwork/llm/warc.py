"""A deterministic, sharded WARC writer, and a reader.

Records are put in ranges of page_id that hold about shard_bytes of payload each. The ranges come from exact histograms, each finer where one
cell still holds too much, so they are the same in every run and no far id spoils them; the driver holds their bounds, so there are MOST_SHARDS of
them at most and beyond some 3 TB (16 MiB each) shards grow, to 500 MB at 100 TB. A task's memory does not grow with its shard: it is sorted by
Spark, which spills, and written record by record. Each shard is a partition of its own, no more and no less. Within a shard files are rolled by
their compressed size, at an eighth of the shard's payload where no size is given, so a shard has several files at any scale. Headers and digests
are made anew. Each attempt writes files of its own under temporary names and reports them in rows; Spark keeps the rows
of one attempt per task, these become the manifest, and only files of the manifest are renamed to their final names (a renaming
that is done again finds the final name and goes on). A reader looks at the manifest only, so what a lost attempt has left behind
is never read.

Of records with equal payloads that with the largest page_id is a response, the others revisit it; payloads shorter than
`least` bytes are all responses. Only digests are grouped; payloads move once.

Defined results: a null html is an empty payload. A null page_id counts as the least id and is written as `-`. Of rows with equal
id and payload the first one in order of url is the response, the others revisit it. An empty table gives an empty manifest. The url is taken
as it is, with control characters removed; null is an empty one. Other columns are left aside.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm._common import cut, passing, shared_dir, table

DATE = "2024-01-01T00:00:00Z"
SHARD_BYTES = 16 << 20
#: A file ends at this share of its shard's payload, compressed.
ROLL_SHARE = 8
CELLS = 4096
MOST_SHARDS = 200_000


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (pafs.LocalFileSystem(), uri)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; the member's header holds no time, so equal records are equal bytes."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, nth: int, url: str, payload: bytes, target: int | None, revisit: bool) -> bytes:
    name = lambda i, k: f"urn:page:{'-' if i is None else i}:{k}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Target-URI", "".join(c for c in url if c >= " " and c != "\x7f")), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32(hashlib.sha1(payload).digest())}")]
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{name(target, 0)}>")]
    return record("revisit" if revisit else "response", name(page_id, nth), headers, http if revisit else http + payload)


class Roller:
    """The files of one shard in one attempt."""

    def __init__(self, out: str, attempt: str, shard: int, roll: int) -> None:
        self.out, self.attempt, self.shard, self.roll = out, attempt, shard, roll
        self.fs, self.path = _fs(out)
        self.done: list[tuple] = []
        self.file, self.size, self.records, self.hash = None, 0, 0, None

    def put(self, data: bytes) -> None:
        if self.file is not None and self.size + len(data) > self.roll:
            self.close()
        if self.file is None:
            self.name = f"shard-{self.shard:06d}-{len(self.done):05d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}/{self.name}"
            self.fs.create_dir(f"{self.path}/_temporary/{self.attempt}", recursive=True)
            self.file, self.size, self.records, self.hash = self.fs.open_output_stream(f"{self.path}/{self.temporary}"), 0, 0, hashlib.sha256()
            self._write(record("warcinfo", f"urn:file:{self.name}", [("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._write(data)
        self.records += 1

    def _write(self, data: bytes) -> None:
        self.file.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append((self.name, self.temporary, self.shard, self.size, self.records, self.hash.hexdigest()))
            self.file = None


MANIFEST = "name string, temporary string, shard long, bytes long, records long, sha256 string"


def _below(bounds: list[int], id_: Column) -> Column:
    """How many of the sorted bounds are at most the id; found by halving. Null for null."""
    if not bounds:
        return F.when(id_.isNotNull(), F.lit(0))
    many, steps = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>"), [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    step = lambda n, p: F.when(F.get(many, n + p - 1) <= id_, n + p).otherwise(n)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _bounds(sized: DataFrame, shard_bytes: int) -> list[int]:
    """The least id of each shard but the first. Of sized (page_id, n) some CELLS sums at a time come to the driver."""
    low, high, total = sized.agg(F.min("page_id"), F.max("page_id"), F.sum("n")).head()
    if low is None:
        return []
    cells = {low: (high, total)}  # least id: greatest id, bytes
    while heavy := sorted(a for a, (b, n) in cells.items() if n > shard_bytes and b > a):
        # Each heavy cell is cut into parts of one width. Distances are decimals: ids may lie as far apart as a long can say.
        parts = max(2, CELLS // len(heavy))
        widths = [(cells[a][0] - a) // parts + 1 for a in heavy]
        of = _below(heavy[1:], F.col("page_id"))
        text = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<decimal(20,0)>")
        begin, width, end = (F.get(text(v), F.col("of")) for v in (heavy, widths, [cells[a][0] for a in heavy]))
        far = F.col("page_id").cast("decimal(20,0)") - begin
        cell = ((far - F.pmod(far, width)) / width).cast("decimal(20,0)")
        inside = sized.withColumn("of", of).filter(F.col("page_id").cast("decimal(20,0)").between(begin, end))
        found = inside.groupBy("of", cell.alias("cell")).agg(F.sum("n").alias("n")).collect()
        ends = {a: cells.pop(a)[0] for a in heavy}
        for i, k, n in found:
            a = heavy[i] + int(k) * widths[i]
            cells[a] = (min(ends[heavy[i]], a + widths[i] - 1), n)
    out, seen, shard = [], 0, 0
    for a in sorted(cells):
        if seen // shard_bytes > shard:
            out.append(a)
            shard = seen // shard_bytes
        seen += cells[a][1]
    return out


def write_warc(pages: DataFrame, out: str, least: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int | None = None) -> str:
    """Write pages (page_id, url, html) to the folder out; returns the path of the manifest there."""
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("html"))
    keys = cut(rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("dg"), F.octet_length("html").cast("long").alias("n")))
    sized = keys.select("page_id", (F.col("n") + 400).alias("n"))
    shard_bytes = max(shard_bytes, (sized.agg(F.sum("n")).head()[0] or 0) // MOST_SHARDS)
    bounds = _bounds(sized, shard_bytes)
    n_shards, roll = len(bounds) + 1, roll_bytes or shard_bytes // ROLL_SHARE
    shard = F.coalesce(_below(bounds, F.col("page_id")), F.lit(0)).cast("long").alias("shard")

    shared = keys.filter(F.col("n") >= least).groupBy("dg").agg(F.max("page_id").alias("target"), F.count("*").alias("c"), F.sum(F.col("page_id").isNull().cast("int")).alias("nulls")).filter("c > 1")
    # A row before each page that has a copy with a larger id; those of the same id are told apart when written.
    marks = keys.join(shared, "dg").select("page_id", "dg", "target").distinct()
    page = rows.select(shard, "page_id", F.sha1(F.col("html").cast("binary")).alias("dg"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("target"), "url", "html")
    mark = marks.select(shard, "page_id", "dg", F.lit(0).alias("kind"), "target", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    ordered = page.unionByName(mark).repartitionById(n_shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "dg", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        attempt = f"{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        roller, done, last, nth, copies, marked = None, [], None, 0, 0, None
        for batch in batches:
            for shard, page_id, dg, kind, target, url, html in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        roller.close()
                        done += roller.done
                    roller, last = Roller(out, attempt, shard, roll), None
                if last is None or last != (page_id, dg):
                    # The response takes number 0 of its id: it is what revisits refer to.
                    nth = nth + 1 if last is not None and last[0] == page_id else 0
                    last, copies, marked = (page_id, dg), 0, None
                if kind == 0:
                    marked = (target,)
                    continue
                if copies:
                    nth += 1
                revisit = marked is not None and (copies > 0 or marked[0] != page_id)
                roller.put(page_record(page_id, nth, url, html.encode(), marked[0] if marked else None, revisit))
                copies += 1
        if roller is not None:
            roller.close()
            done += roller.done
        columns = list(zip(*done, strict=True)) if done else [()] * 6
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["name", "temporary", "shard", "bytes", "records", "sha256"])

    manifest = f"{out}/manifest"
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{out}/_attempts")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(out)
        for batch in batches:
            for name, temporary in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if fs.get_file_info(f"{path}/{name}").type == pafs.FileType.NotFound:
                    fs.move(f"{path}/{temporary}", f"{path}/{name}")
            yield batch

    spark.read.schema(MANIFEST).parquet(f"{out}/_attempts").mapInArrow(commit, MANIFEST).write.parquet(manifest)
    fs, path = _fs(out)
    if fs.get_file_info(f"{path}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{path}/_temporary")
    return manifest


def members(source) -> Iterator[bytes]:
    """The gzip members of a stream, one after the other, unpacked."""
    unpacker, parts, data = zlib.decompressobj(31), [], b""
    while data or (data := source.read(1 << 20)):
        parts.append(unpacker.decompress(data))
        data = b""
        if unpacker.eof:
            yield b"".join(parts)
            data, unpacker, parts = unpacker.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the file ends within a member")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
        raise ValueError(f"block digest of {headers['WARC-Record-ID']}")
    return headers, block


def read_warc(spark: SparkSession, out: str, payload: bool = False) -> DataFrame:
    """The records of the files in out's manifest. Payloads of responses are checked against their digests."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    number = lambda urn: None if (x := urn.strip("<>").split(":")[2]) == "-" else int(x)
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(out)
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{name}") as source:
                    for raw in members(source):
                        headers, block = parse_record(raw)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        http, _, body = block.partition(b"\r\n\r\n")
                        length, digest = int(http.rpartition(b"Content-Length: ")[2]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = headers["WARC-Type"] == "revisit"
                        if not revisit and (len(body) != length or base32(hashlib.sha1(body).digest()) != digest):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']}")
                        rows.append((number(headers["WARC-Record-ID"]), length, digest, headers["WARC-Type"], number(headers["WARC-Refers-To"]) if revisit else None, *([None if revisit else body] * payload)))
                        if len(rows) >= (64 if payload else 5000):
                            yield pack(rows)
                            rows = []
                if rows:
                    yield pack(rows)

    files = spark.read.schema(MANIFEST).parquet(f"{out}/manifest").select("name", "shard")
    last = files.agg(F.max("shard")).head()[0] or 0
    return files.repartitionById(last + 1, F.col("shard").cast("int")).select("name").mapInArrow(run, schema)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS target FROM p),
b AS (SELECT *, list_transform(range(4), lambda i: CAST('0x' || substr(x, 10 * i + 1, 10) AS BIGINT)) AS v FROM r)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((v[1 + j // 8] >> (35 - 5 * (j % 8))) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> target THEN target END AS refers_to FROM b"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passing(spark, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out)
