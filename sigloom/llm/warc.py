"""WARC archives of pages with a two-level capture index.

write() puts one record per page into gzip'd WARC 1.1 archives, a member per record. Rows are range-partitioned and sorted
by the reversed-host form of their URL, page_id, URL and digest, so that each task writes its archives in the order of
the index. A task's index file holds its captures in that order as compressed blocks of block_lines lines, and at its end
the sparse block directory: first and last key, offset and length of each block. One row per index file is returned.
lookup() sorts the captures asked for in the same way; for each it binary-searches the index files by key, then a file's
directory, then the block, and reads the record's byte range; ranges that lie close together are read at once.

Of records with equal payloads of min_bytes bytes or more, the first by page_id, then URL, is a response, others are
revisits without payload that refer to it. Digests are the payload's SHA-1; equal digests count as equal payloads. Hot
payloads are counted before they are shuffled, and only responses carry their bytes through the sort.

The folder is reached through pyarrow's file systems, so executors read and write wherever spark.checkpoint.dir lies. A
task names its files itself and they count only once the task's row is committed, so a lost executor leaves no record twice.

Defined results: null html is an empty payload; a null url has an empty key, and its record no target; a null page_id
comes last among equal payloads; rows equal in id, url and html are records of their own, one of them the response;
an empty table gives no archive and no row; pages of any length are one record; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .cells import buckets_for
from .common import materialize, release, shared_dir

BROADCAST_ROWS = 200_000
MOST_FILES = 100_000
READ_AHEAD = 1 << 20
TRAILER = struct.Struct(">QQ")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "path string, first string, first_page long, last string, last_page long, lines long, blocks long, at long, length long"
#: Sorts before every page_id, as null does in Spark.
NO_PAGE = -(1 << 63)


def surt(url: Column) -> Column:
    """The key of a URL: host labels reversed, then port and path, as in `com,example)/path`; other texts stay as they are."""
    parts = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?(.*)"
    host = F.lower(F.regexp_extract(url, parts, 1))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.regexp_extract(url, parts, 2), F.lit(")"), F.regexp_extract(url, parts, 3))
    return F.coalesce(F.when(url.rlike(parts), key).otherwise(url), F.lit(""))


def captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages as records to write: key, page_id, url, digest (hex), size, copy, revisit, head_page, head_url, payload (null for revisits)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select(surt(F.col("url")).alias("key"), "page_id", "url", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"), "payload")
    place = F.struct(F.col("page_id").isNull(), F.col("page_id").alias("page"), F.coalesce(F.col("url"), F.lit("")), F.col("url").isNull(), F.col("url").alias("url"))
    same = rows.where(F.col("size") >= min_bytes).groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"))
    heads = same.groupBy("digest").agg(F.min(F.struct(place.alias("place"), "n")).alias("head"), F.sum("n").alias("all")).where("`all` > 1")
    heads = materialize(heads.select("digest", F.col("head.place.page").alias("head_page"), F.col("head.place.url").alias("head_url"), F.col("head.n").alias("heads")))
    few = heads.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(heads) if few else heads, "digest", "left")
    is_head = F.col("page_id").eqNullSafe(F.col("head_page")) & F.col("url").eqNullSafe(F.col("head_url"))
    revisit = F.col("heads").isNotNull() & ~is_head
    rows = rows.withColumn("revisit", revisit).withColumn("payload", F.when(~revisit, F.col("payload"))).withColumn("copy", F.lit(0))
    out = ["key", "page_id", "url", "digest", "size", "copy", "revisit", "head_page", "head_url", "payload"]
    if heads.where("heads > 1").isEmpty():
        return rows.select(*out)
    # Heads that are there several times over: one response, the others revisits without bytes.
    many = F.coalesce(~F.col("revisit") & (F.col("heads") > 1), F.lit(False))
    firsts = rows.where(many).groupBy("key", "page_id", "url", "digest", "size", "head_page", "head_url").agg(F.first("payload").alias("bytes"), F.first("heads").alias("heads"))
    copies = firsts.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("heads") - 1).cast("int"))))
    copies = copies.withColumn("revisit", F.col("copy") > 0).withColumn("payload", F.when(F.col("copy") == 0, F.col("bytes")))
    return rows.where(~many).select(*out).unionByName(copies.select(*out))


def record_id(page: int | None, url: str | None, digest: str, copy: int) -> str:
    of_url = hashlib.sha1((url or "").encode("utf-8", "surrogatepass")).hexdigest()[:12]
    return f"<urn:capture:{'' if page is None else page}:{of_url}:{digest}:{copy}>"


def _target(url: str) -> str:
    return quote(url, safe="%/:?#[]@!$&'()*+,;=-._~")


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


def page_record(row: dict, date: str) -> bytes:
    """A response or revisit record, compressed."""
    base32 = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    headers = [("WARC-Type", "revisit" if row["revisit"] else "response"), ("WARC-Record-ID", record_id(row["page_id"], row["url"], row["digest"], row["copy"])), ("WARC-Date", date)]
    if row["url"] is not None:
        headers.append(("WARC-Target-URI", _target(row["url"])))
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32}")]
    if row["revisit"]:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(row["head_page"], row["head_url"], row["digest"], 0))]
        if row["head_url"] is not None:
            headers.append(("WARC-Refers-To-Target-URI", _target(row["head_url"])))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    return _record(headers, http + (row["payload"] or b""))


class ArchiveWriter:
    """Archives and the index file of one task."""

    def __init__(self, folder: str, date: str, archive_bytes: int, block_lines: int):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.name, self.date = uuid.uuid4().hex, date
        self.archive_bytes, self.block_lines = archive_bytes, block_lines
        self.archive = self.index = None
        self.archives = self.offset = self.index_offset = self.count = 0
        self.lines: list[list] = []
        self.directory: list[list] = []

    def _open(self, name: str):
        self.files.create_dir(self.folder, recursive=True)
        return self.files.open_output_stream(f"{self.folder}/{name}", compression=None)

    def _next_archive(self) -> None:
        if self.archive is not None:
            self.archive.close()
        self.archives += 1
        self.archive = self._open(self._archive_name())
        info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{self._archive_name()}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        self.archive.write(info)
        self.offset = len(info)

    def _archive_name(self) -> str:
        return f"{self.name}-{self.archives:05d}.warc.gz"

    def add(self, row: dict) -> None:
        if self.archive is None or self.offset >= self.archive_bytes:
            self._next_archive()
        data = page_record(row, self.date)
        self.archive.write(data)
        self.lines.append([row["key"], row["page_id"], row["url"], self._archive_name(), self.offset, len(data)])
        self.offset += len(data)
        if len(self.lines) >= self.block_lines:
            self._block()

    def _block(self) -> None:
        if self.index is None:
            self.index = self._open(f"{self.name}.index")
        data = gzip.compress("\n".join(json.dumps(x) for x in self.lines).encode(), 6, mtime=0)
        self.index.write(data)
        self.directory.append([*self.lines[0][:2], *self.lines[-1][:2], self.index_offset, len(data)])
        self.index_offset += len(data)
        self.count += len(self.lines)
        self.lines = []

    def close(self) -> tuple | None:
        """Ends the files; the row of the index file, none if there were no records."""
        if self.lines:
            self._block()
        if self.index is None:
            return None
        data = gzip.compress(json.dumps(self.directory).encode(), 6, mtime=0)
        self.index.write(data + TRAILER.pack(self.index_offset, len(data)))
        self.index.close()
        self.archive.close()
        first, last = self.directory[0], self.directory[-1]
        return f"{self.name}.index", first[0], first[1], last[2], last[3], self.count, len(self.directory), self.index_offset, len(data)


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, archive_bytes: int = 1 << 30, block_lines: int = 3000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives of pages (page_id, url, html) and their index; a row per index file, with its folder.

    folder: a URI that all executors reach; unset, a new folder in the shared one.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/sigloom/{uuid.uuid4().hex}"
    rows = captures(pages, min_bytes)
    parts = buckets_for(pages, 64 << 20)
    if parts == 1 << 24:  # the size of pages is not known
        parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(parts, MOST_FILES)
    order = ["key", "page_id", "url", "digest", "revisit", "copy"]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ArchiveWriter(folder, date, archive_bytes, block_lines)
        for batch in batches:
            for i in range(batch.num_rows):
                out.add({name: batch.column(name)[i].as_py() for name in batch.schema.names})
        row = out.close()
        if row:
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=arrow)

    names = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
    arrow = pa.schema([(n, pa.string() if n in ("path", "first", "last") else pa.int64()) for n in names])
    return materialize(rows.mapInArrow(run, INDEX_SCHEMA)).withColumn("folder", F.lit(folder))


def _place(key: str, page: int | None) -> tuple[str, int]:
    return key, NO_PAGE if page is None else page


class CaptureIndex:
    """Finds records through the two levels of the index, in one task."""

    def __init__(self, folder: str, files: list[tuple]):
        """files: (path, last key, last page_id, first key, first page_id, directory offset, its length), in key order."""
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.rows = files
        self.lasts = [_place(r[1], r[2]) for r in files]
        self.directory = lru_cache(4)(self._directory)
        self.block = lru_cache(4)(self._block)
        self.open_name, self.handle, self.window, self.window_at = None, None, b"", 0

    def _range(self, name: str, at: int, length: int) -> bytes:
        with self.files.open_input_file(f"{self.folder}/{name}") as f:
            f.seek(at)
            return f.read(length)

    def _directory(self, path: str, at: int, length: int) -> tuple[list, list]:
        blocks = json.loads(gzip.decompress(self._range(path, at, length)))
        return blocks, [_place(b[2], b[3]) for b in blocks]

    def _block(self, path: str, at: int, length: int) -> tuple[list, list]:
        lines = [json.loads(x) for x in gzip.decompress(self._range(path, at, length)).split(b"\n")]
        return lines, [_place(x[0], x[1]) for x in lines]

    def find(self, key: str, page: int | None) -> Iterator[list]:
        """The index lines of a key and page_id."""
        want = _place(key, page)
        for i in range(bisect_left(self.lasts, want), len(self.rows)):
            path, _, _, first, first_page, at, length = self.rows[i]
            if _place(first, first_page) > want:
                return
            blocks, lasts = self.directory(path, at, length)
            for j in range(bisect_left(lasts, want), len(blocks)):
                if _place(*blocks[j][:2]) > want:
                    break
                lines, places = self.block(path, *blocks[j][4:])
                k = bisect_left(places, want)
                while k < len(lines) and places[k] == want:
                    yield lines[k]
                    k += 1

    def record(self, name: str, at: int, length: int) -> bytes:
        """The bytes of a record; what lies behind it is read along, since sorted requests want it next."""
        if name != self.open_name:
            if self.handle is not None:
                self.handle.close()
            self.handle, self.open_name, self.window, self.window_at = self.files.open_input_file(f"{self.folder}/{name}"), name, b"", 0
        if not self.window_at <= at <= at + length <= self.window_at + len(self.window):
            self.handle.seek(at)
            self.window, self.window_at = self.handle.read(max(length, READ_AHEAD)), at
        return self.window[at - self.window_at : at - self.window_at + length]

    def close(self) -> None:
        if self.handle is not None:
            self.handle.close()


def parse(member: bytes) -> dict:
    """Fields of a compressed record; checks the payload of a response against its digest."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    lengths = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    out = {"record_type": fields["WARC-Type"], "payload_digest": digest, "payload_bytes": int(lengths["Content-Length"]), "refers_to": None, "payload": None}
    if out["record_type"] == "response":
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != out["payload_bytes"]:
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
        out["payload"] = payload
    else:
        page = fields["WARC-Refers-To"].split(":")[2]
        out["refers_to"] = int(page) if page else None
    return out


def lookup(index: DataFrame, asked: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the captures (page_id, url) that are asked for, each once: page_id, url, record_type, payload_bytes, payload_digest, refers_to.

    payload: adds the bytes of responses. A capture that is not archived has no row. One small row per index file, at most
    MOST_FILES, goes to every task.
    """
    spark = index.sparkSession
    rows = index.orderBy("first", F.col("first_page").asc_nulls_first()).collect()
    files = [(r["path"], r["last"], r["last_page"], r["first"], r["first_page"], r["at"], r["length"]) for r in rows]
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payload
    if not files:
        return spark.createDataFrame([], schema)
    folder, sent = rows[0]["folder"], spark.sparkContext.broadcast(files)
    asked = asked.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).distinct()
    order = ["key", "page_id", "url"]
    parts = max(len(files), int(spark.conf.get("spark.sql.shuffle.partitions")))  # tasks by what they read, not by the small requests
    asked = asked.withColumn("key", surt(F.col("url"))).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    arrow = pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.string())) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = CaptureIndex(folder, sent.value)
        for batch in batches:
            out, held = [], 0
            for page, url, key in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "key")], strict=True):
                for line in found.find(key, page):
                    if line[2] != url:
                        continue
                    row = parse(found.record(*line[3:])) | {"page_id": page, "url": url}
                    held += len(row["payload"] or b"") if payload else 0
                    out.append({n: row[n] for n in arrow.names})
                    if len(out) >= 4000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        found.close()

    return asked.mapInArrow(run, schema)


def discard(index: DataFrame) -> None:
    """Deletes the archives and index files of write()."""
    spark = index.sparkSession
    for row in index.select("folder").limit(1).collect():
        path = spark._jvm.org.apache.hadoop.fs.Path(row["folder"])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    release(index)
