"""Deterministic sharded WARC writer, and a reader.

Records are sorted by page_id and cut into shards of consecutive ids: the ids'
span is divided into ``BINS`` bins, their bytes are summed, and neighbouring
bins are put together up to the shard size (``SHARD_BYTES``, more if that gave
over ``SHARDS`` shards).  The plan is a function of the data alone, so a second
run writes the same bytes.  Each shard is written in order, one gzip member a
record, into files that are rolled when their compressed size reaches
``FILE_BYTES``.  Headers and digests are made anew from the payloads.

Payloads are shuffled once, by the sort.  Which record a copy refers to is
worked out on (page_id, digest) alone; that answer joins the payload as a row of
its own, just before the page's in the sorted order.

Files are written under temporary names; the rows that successful tasks return
are the manifest.  Only files it names are moved to their final names (moving
again does no harm), and the manifest table is written by that last job, so its
presence marks a complete archive.  What lost or repeated tasks left is removed
with the temporary folder.

Defined results: a null payload is empty, a null url too; of equal payloads the
record with the largest page_id (nulls smallest) is the response and the others
refer to it; repeated rows with that id and payload are all responses; all pages
of one id are in one shard; control characters in urls are percent-encoded; an
empty table gives no file.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import frames

BINS = 1 << 16
SHARDS = 4096
SHARD_BYTES = 4 << 20
FILE_BYTES = 32 << 20
READ_BYTES = 1 << 14
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 3


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [
        *headers, ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Length", str(len(block)))])
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + press.flush()


def page_name(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    """A response, or a revisit of page ``refers_to[0]`` if that is given."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    headers = [("WARC-Type", "revisit" if refers_to else "response"),
               ("WARC-Record-ID", page_name(page_id)), ("WARC-Target-URI", clean),
               ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{sha1(payload)}"),
               ("Content-Type", "application/http;msgtype=response")]
    if refers_to:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", page_name(refers_to[0]))]
    return record(headers, http if refers_to else http + payload)


def info_record(name: str) -> bytes:
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"),
                   ("WARC-Date", DATE), ("WARC-Filename", name),
                   ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def sharded(pages: DataFrame, shard_bytes: int) -> DataFrame:
    """Adds the shard of each row; rows have page_id, url, payload."""
    size = F.octet_length("payload") + 512
    low, high, total = pages.agg(F.min("page_id"), F.max("page_id"), F.sum(size)).first()
    width = max(1, -(-(high - low + 1) // BINS)) if low is not None else 1
    place = F.coalesce(((F.col("page_id") - F.lit(low or 0)) / width).cast("long"), F.lit(0))
    most = max(shard_bytes, -(-(total or 0) // SHARDS))
    bins = pages.groupBy(place.alias("bin")).agg(F.sum(size).alias("n")).collect()
    shard_of, shard, held = [], 0, 0
    for b, n in sorted(tuple(r) for r in bins):
        if held and held + n > most:
            shard, held = shard + 1, 0
        held += n
        shard_of.append((b, shard))
    plan = pages.sparkSession.createDataFrame(shard_of, "bin long, shard int")
    return pages.withColumn("bin", place).join(F.broadcast(plan), "bin").drop("bin")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
          payload_col: str = "html", shard_bytes: int = SHARD_BYTES,
          file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archive; returns its manifest: name, records, bytes, sha256."""
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    leaders = rows.groupBy("digest").agg(F.max("page_id").alias("leader"))
    copies = (rows.select("page_id", "digest").join(leaders, "digest")
              .filter(~F.col("page_id").eqNullSafe(F.col("leader")))
              .select("page_id", "digest", "leader").distinct())
    empty = F.lit(None).cast("string")
    both = sharded(
        rows.withColumn("leader", F.lit(None).cast("long")).unionByName(
            copies.select("page_id", empty.alias("url"), empty.alias("payload"), "digest", "leader")),
        shard_bytes)
    order = ("shard", "page_id", "digest", F.col("payload").isNotNull(), "url")
    held = f"{folder}/_held"

    def put(batches):
        files = Files(folder, held, file_bytes)
        known = None
        for batch in batches:
            for at in range(batch.num_rows):
                page_id, url, payload, digest, leader, shard = (
                    batch.column(i)[at].as_py() for i in range(6))
                if payload is None:
                    known = (page_id, digest, leader)
                    continue
                copy = known is not None and known[:2] == (page_id, digest)
                yield from files.add(shard, page_record(
                    page_id, url, payload.encode(), known[2:] if copy else None))
        yield from files.close()

    ready = both.select("page_id", "url", "payload", "digest", "leader", "shard")
    written = frames.staged(
        ready.repartition("shard").sortWithinPartitions(*order)
        .mapInArrow(put, "name string, held string, records long, bytes long, sha256 string"))

    def move(batch):
        from pyarrow.fs import FileType

        store, root = opened(folder)
        for name, temporary in zip(*(batch.column(i).to_pylist() for i in range(2))):
            if store.get_file_info(f"{root}/{name}").type == FileType.NotFound:
                store.move(f"{root}/_held/{temporary}", f"{root}/{name}")
        return {}

    frames.arrow_map(written, move, "", ("name", "records", "bytes", "sha256")).write.parquet(
        f"{folder}/_manifest")
    store, root = opened(folder)
    if store.get_file_info(f"{root}/_held").type.name == "Directory":
        store.delete_dir(f"{root}/_held")
    return pages.sparkSession.read.parquet(f"{folder}/_manifest")


class Files:
    """The files of one task, rolled by size, under temporary names."""

    def __init__(self, folder: str, held: str, most: int):
        self.store, self.root = opened(held)
        self.store.create_dir(self.root, recursive=True)
        self.most, self.attempt = most, uuid.uuid4().hex
        self.shard, self.number, self.out = None, 0, None

    def add(self, shard: int, data: bytes):
        if shard != self.shard or self.size + len(data) > self.most and self.records:
            yield from self.close()
            self.number = self.number + 1 if shard == self.shard else 0
            self.shard, self.size, self.records, self.sum = shard, 0, 0, hashlib.sha256()
            self.name = f"pages-{shard:05d}-{self.number:05d}.warc.gz"
            self.out = self.store.open_output_stream(
                f"{self.root}/{self.name}.{self.attempt}", compression=None)
            self.put(info_record(self.name))
        self.put(data)
        self.records += 1

    def put(self, data: bytes):
        self.out.write(data)
        self.size += len(data)
        self.sum.update(data)

    def close(self):
        if self.out is not None:
            self.out.close()
            self.out = None
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (self.name, f"{self.name}.{self.attempt}", self.records,
                                         self.size, self.sum.hexdigest())],
                ["name", "held", "records", "bytes", "sha256"])


def members(data: bytes):
    """The gzip members of an archive, one after the other.

    The decompressor gets ``READ_BYTES`` at a time, so what it hands back after a
    member's end is small however long the archive is.
    """
    at = 0
    while at < len(data):
        press, body = zlib.decompressobj(31), []
        while not press.eof:
            if at >= len(data):
                raise ValueError("archive ends inside a record")
            part = data[at:at + READ_BYTES]
            body.append(press.decompress(part))
            at += len(part)
        at -= len(press.unused_data)
        yield b"".join(body)


def parsed(body: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = body.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return headers, rest[:int(headers["Content-Length"])]


def page_number(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "null" else int(number)


READ = ("page_id long, url string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long, payload binary")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every page record; raises where a digest or length does not hold."""
    def take(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for body in members(content.as_buffer().to_pybytes()):
                    headers, block = parsed(body)
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = headers["WARC-Type"] == "revisit"
                    if (headers["WARC-Block-Digest"] != f"sha1:{sha1(block)}"
                            or not revisit and (len(payload), sha1(payload)) != (size, digest)):
                        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                    rows.append((page_number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"],
                                 size, digest, headers["WARC-Type"],
                                 page_number(headers["WARC-Refers-To"]) if revisit else None,
                                 None if revisit else payload))
                    if len(rows) == frames.ROWS:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
            [c.split()[0] for c in READ.split(", ")])

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz")
             .load(folder).select("content"))
    return files.mapInArrow(take, READ)


def report(records: DataFrame) -> DataFrame:
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
