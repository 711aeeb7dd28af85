"""Web archives (WARC/1.1) written and read as a table of payload chunks.

A record is rows of (record, chunk number, data): payloads of at most CHUNK bytes have one row, longer ones as many as they need.
Digests are carried from chunk to chunk, the writer compresses chunk by chunk and the reader yields chunks as it inflates them, so
no task holds more of a payload than a chunk beside the row it came from.

Writing takes two narrow passes and one shuffle: the first pass digests all payloads, a grouped minimum finds the record of
each payload that stays (the others become revisits of it), and the second pass streams the records into files of the shared
folder. Files carry the name of the task attempt that wrote them and count only once Spark has committed the attempt's rows
of the manifest, so a lost executor leaves nothing but a file nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.stage import stage, stage_root

CHUNK = 1 << 20
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 0
#: A file is closed beyond this size; a manifest row covers whole records of about this many stored bytes, read by one task.
FILE_BYTES, SEGMENT_BYTES = 1 << 30, 32 << 20
DATE = "1970-01-01T00:00:00Z"
_RECORD = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
MANIFEST = "path string, position bigint, bytes bigint, records bigint"
CHUNKS = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, chunk_no int, data binary, "
          "payload_bytes bigint, digest string, last boolean")


def base32_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def chunk_rows(df: DataFrame, payload_column: str, chunk: int = CHUNK) -> DataFrame:
    """`df` with its payload column (text, as UTF-8, or binary; NULL: empty) replaced by the columns chunk_no, last and data: one
    row per chunk, the rows of a record one after another; an empty payload has one empty chunk. Narrow."""
    raw = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b""))
    last = F.expr(f"cast(greatest(0, (octet_length(_raw) - 1) div {chunk}) as int)")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.expr("_raw").substr(i * chunk + 1, F.lit(chunk)))
    others = [F.col(c) for c in df.columns if c != payload_column]
    cut = df.select(*others, raw.alias("_raw")).select(*others, last.alias("_last"), F.posexplode(pieces).alias("chunk_no", "data"))
    return cut.select(*others, "chunk_no", (F.col("chunk_no") == F.col("_last")).alias("last"), "data")


def payload_digests(chunks: DataFrame, key: str) -> DataFrame:
    """(key, payload_bytes, sha1, sha256) per record of a chunk table, digests carried over its chunks. Narrow."""

    def run(batches):
        sha1, sha256, size = hashlib.sha1(), hashlib.sha256(), 0
        for batch in batches:
            done = []
            for i, (data, last) in enumerate(zip(batch.column("data"), batch.column("last").to_pylist())):
                piece = data.as_buffer()
                sha1.update(piece)
                sha256.update(piece)
                size += len(piece)
                if last:
                    done.append((i, size, base32_digest(sha1.digest()), sha256.digest()))
                    sha1, sha256, size = hashlib.sha1(), hashlib.sha256(), 0
            if done:
                at, sizes, ones, others = zip(*done)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), pa.array(sizes, pa.int64()), pa.array(ones), pa.array(others)], ["key", "payload_bytes", "sha1", "sha256"])

    rows = chunks.select(F.col(key).alias("key"), "data", "last")
    return rows.mapInArrow(run, f"key {dict(chunks.dtypes)[key]}, payload_bytes bigint, sha1 string, sha256 binary")


def _plan(pages: DataFrame, chunk: int, revisit_bytes: int) -> DataFrame:
    """(id, sha256, payload_bytes, sha1, refers_to) of every id and payload; refers_to is NULL for records that stay."""
    index = stage(payload_digests(chunk_rows(pages.select("id", "payload"), "payload", chunk), "id").distinct(), "payloads")
    # Staged, so that Spark can split its join with the rows of a very common payload.
    groups = stage(index.where(F.col("payload_bytes") >= revisit_bytes).groupBy("sha256", "payload_bytes").agg(F.min("key").alias("stays"), F.count(F.lit(1)).alias("n"))
                   .where("n > 1").select("sha256", "payload_bytes", "stays"), "payload_groups")
    marked = index.join(groups, ["sha256", "payload_bytes"], "left")
    return marked.select(F.col("key").alias("id"), "sha256", "payload_bytes", "sha1", F.when(F.coalesce(F.col("key") != F.col("stays"), F.col("stays").isNotNull()), F.col("stays")).alias("refers_to"))


def _name(page) -> str:
    return f"<{_RECORD}{'null' if page is None else page}>"


def _head(page, url, size: int, sha1: str, refers_to) -> bytes:
    """WARC header and, as the start of the block, the HTTP header that tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page)), ("WARC-Date", DATE),
              ("WARC-Target-URI", urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"{_RECORD}{page}"), ("WARC-Payload-Digest", f"sha1:{sha1}")]
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _name(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + (size if refers_to is None else 0))]
    return "".join(["WARC/1.1\r\n"] + [f"{k}: {v}\r\n" for k, v in fields] + ["\r\n", http]).encode()


def _file_system(folder: str):
    from pyarrow.fs import FileSystem
    return FileSystem.from_uri(folder)


class _Archive:
    """One file being written; every record is a gzip member of its own where `compress` is set."""

    def __init__(self, folder: str, compress: bool):
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc{'.gz' if compress else ''}"
        self.path, self.compress, self.size = f"{folder}/{name}", compress, 0
        self.out = system.open_output_stream(f"{path}/{name}", compression=None)
        self.member = None

    def add(self, data, last: bool = False) -> None:
        if self.compress:
            self.member = self.member or zlib.compressobj(3, zlib.DEFLATED, 31)
            data = self.member.compress(data) + (self.member.flush() if last else b"")
            self.member = None if last else self.member
        self.out.write(data)
        self.size += len(data)


def _written(batches, folder: str, compress: bool, file_bytes: int, segment_bytes: int):
    """Streams chunk rows into archives; yields manifest rows."""
    archive, start, records = None, 0, 0
    rows: list[tuple] = []

    def segment():
        nonlocal start, records
        if records:
            rows.append((archive.path, start, archive.size - start, records))
        start, records = archive.size, 0

    for batch in batches:
        names = ("id", "url", "payload_bytes", "sha1", "refers_to", "chunk_no", "last")
        for i, (page, url, size, sha1, refers_to, chunk_no, last) in enumerate(zip(*[batch.column(c).to_pylist() for c in names])):
            if archive is None:
                archive, start = _Archive(folder, compress), 0
            if chunk_no == 0:
                archive.add(_head(page, url, size, sha1, refers_to))
            if refers_to is None:
                archive.add(batch.column("data")[i].as_buffer())
            if last:
                archive.add(_END, last=True)
                records += 1
                if archive.size - start >= segment_bytes:
                    segment()
                if archive.size >= file_bytes:
                    segment()
                    archive.out.close()
                    archive = None
    if archive is not None:
        segment()
        archive.out.close()
    columns = list(zip(*rows)) if rows else [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["path", "position", "bytes", "records"])


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the cluster's shared folder."""
    root = stage_root(spark)
    if root is None:
        raise ValueError("archives need a folder that all machines share: name one, or set spark.checkpoint.dir")
    return f"{root}/shelfwise/warc-{uuid.uuid4().hex}"


def write(df: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", compress: bool = True,
          revisit_bytes: int = REVISIT_BYTES, chunk: int = CHUNK, file_bytes: int = FILE_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes one record per row of `df` into archives under `folder` (a path or URI that pyarrow can open from every machine)
    and returns the manifest: (path, position, bytes, records) of stretches of whole records.

    Of equal payloads of at least `revisit_bytes` bytes the one with the smallest id is a response and the others revisit it;
    all smaller ones are responses. A NULL payload is empty. Rows that repeat an id and its payload are written as often and
    alike (the smallest id's are all responses). NULL ids come after all others: they revisit a record with an id, and among
    themselves all are responses. A NULL or empty address becomes one made of the id. An empty table gives no files and no rows.
    Other columns are not read."""
    pages = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(url_column).cast("string").alias("url"), F.col(payload_column).cast("binary").alias("payload"))
    plan = _plan(pages, chunk, revisit_bytes)
    keyed = pages.withColumn("strong", F.unhex(F.sha2(F.coalesce("payload", F.lit(b"")), 256))).alias("p")
    rows = keyed.join(plan.alias("q"), F.expr("p.id <=> q.id AND p.strong = q.sha256")).select("p.id", "p.url", "payload", "payload_bytes", "sha1", "refers_to")
    # The payload of a revisit is not needed any more.
    rows = rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    return stage(chunk_rows(rows, "payload", chunk).mapInArrow(lambda b: _written(b, folder, compress, file_bytes, segment_bytes), MANIFEST), "warc_manifest")


class _Reader:
    """Bytes of a stretch of an archive, inflated block by block."""

    def __init__(self, path: str, position: int, size: int):
        system, name = _file_system(path)
        self.file, self.left, self.gzip, self.buffer = system.open_input_file(name), size, path.endswith(".gz"), b""
        self.file.seek(position)
        self.blocks = self._inflated() if self.gzip else self._stored()

    def _stored(self) -> Iterator[bytes]:
        while self.left:
            block = self.file.read(min(self.left, 1 << 18))
            if not block:
                raise ValueError("the archive ends early")
            self.left -= len(block)
            yield block

    def _inflated(self) -> Iterator[bytes]:
        member = None
        for block in self._stored():
            while block:
                member = member or zlib.decompressobj(31)
                yield member.decompress(block, CHUNK)
                block = member.unused_data if member.eof else member.unconsumed_tail
                if member.eof:
                    member = None
        if member is not None:
            raise ValueError("the archive ends inside a record")

    def fill(self) -> bool:
        block = next(self.blocks, None)
        self.buffer += block or b""
        return block is not None

    def until(self, mark: bytes) -> bytes | None:
        """Everything before the next `mark`, which is skipped; None at the end."""
        while (at := self.buffer.find(mark)) < 0:
            if not self.fill():
                if self.buffer:
                    raise ValueError("the archive ends inside a header")
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark):]
        return out

    def take(self, most: int) -> bytes:
        while len(self.buffer) < most and self.fill():
            pass
        out, self.buffer = self.buffer[:most], self.buffer[most:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _records(reader: _Reader, chunk: int) -> Iterator[tuple]:
    """Chunk rows of a stretch, in order."""
    while (head := reader.until(_END)) is not None:
        warc = _fields(head)
        left, size, stored = int(warc["content-length"]), None, warc["warc-type"] != "revisit"
        if "msgtype=response" in warc.get("content-type", ""):
            block = reader.until(_END)
            left -= len(block) + len(_END)
            size = int(_fields(block)["content-length"])
        claimed = warc.get("warc-payload-digest", "").removeprefix("sha1:") or None
        same = (warc["warc-record-id"].strip("<>"), warc["warc-type"], warc.get("warc-target-uri"), warc.get("warc-refers-to", "").strip("<>") or None, claimed)
        sha1, number, seen = hashlib.sha1(), 0, 0
        while True:
            data = reader.take(min(left, chunk))
            if len(data) < min(left, chunk):
                raise ValueError("the archive ends inside a record")
            left -= len(data)
            seen += len(data)
            sha1.update(data)
            digest = base32_digest(sha1.copy().digest())
            if left:
                yield same + (number, data, seen, digest, False)
                number += 1
                continue
            if stored and (claimed not in (None, digest) or size not in (None, seen)):
                raise ValueError(f"the payload of {same[0]} is not the one its header tells")
            yield same + (number, data, seen if stored else size, digest if stored else claimed, True)
            break
        if reader.take(len(_END)) != _END:
            raise ValueError(f"no end after {same[0]}")


def read(manifest: DataFrame, data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of archives: CHUNKS, one row per chunk. payload_bytes and digest are those of the payload so far; a
    revisit has one row without data, with length and digest of the payload it stands for. With `data` false the data
    column is NULL. Payloads that differ from what their header says fail the job. Stretches are dealt evenly to tasks."""
    kinds = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
                       ("chunk_no", pa.int32()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("last", pa.bool_())])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for path, position, size in zip(*[batch.column(c).to_pylist() for c in ("path", "position", "bytes")]):
                for row in _records(_Reader(path, position, size), chunk):
                    if not data:
                        row = row[:6] + (None,) + row[7:]
                    rows.append(row)
                    held += len(row[6] or b"") + 500
                    if held > 8 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "position", "bytes").repartition(tasks).mapInArrow(run, CHUNKS)


def page_number(record: Column) -> Column:
    """The id in a record's name; NULL for records without one."""
    return F.regexp_extract(record, re.escape(_RECORD) + r"(-?[0-9]+)$", 1).try_cast("bigint")


def records(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per record read back: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id or NULL)."""
    rows = read(manifest, data=False, chunk=chunk).where("last")
    return rows.select(page_number(F.col("record_id")).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", page_number(F.col("refers_to")).alias("refers_to"))
