"""WARC archives: written as whole-file gzip, then normalised to one member a record with a sidecar offset index.

`write_pages` decides which records are responses and which are revisits, and writes each partition as one gzip stream,
as careless crawlers do: such a file can only be read from its start. `normalise` inflates each stream once, rewrites each
record as a gzip member of its own, and writes `<archive>.idx` beside it (offset, length, type, id and target of each
record, tab-separated). `read_index` reads those sidecars back, and `read_records` then single records by offset, whose
payload digests it verifies.

Of records with equal payloads (SHA-1 and length) of at least `min_bytes`, that with the largest page id is the response and
the others are revisits, which hold its id and digest but no payload; smaller payloads are all responses. Which payloads
repeat is counted on hashes alone; a bitmap of bounded size lets rows whose payload occurs once pass without a shuffle.

Files lie in the shared folder and go through the file systems of Arrow, by the folder's scheme (`s3a` and `s3n` are `s3`). Each attempt of a task
writes to names of its own, and only names that a finished stage has returned are read. Records are copied in blocks, so
a payload of any length passes.

Null html is an empty payload, a null url is left out. Repeated rows: all rows with the largest id are responses. A null
page id counts as the smallest; if all are null, all are responses. An empty table gives no archive and an empty result; extra
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from io import BytesIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_bits, key_bitmap, scratch_path, split_hot, table, tidy, with_hit, written

MIN_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
BLOCK = 1 << 20
LEVEL = 1
_PAGE = re.compile(r"<urn:x-page:(.*)>")


#: Schemes of Hadoop, and Arrow's name of the same store.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "file": "file"}


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    scheme, found, rest = uri.partition(":")
    if found and not rest.startswith("//"):  # file:/path
        rest = f"//{rest}"
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}" if found else uri)


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


# ---- records -------------------------------------------------------------------------------------------------------


def record(kind: str, page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to=None, date: str = DATE) -> bytes:
    """One record. payload: the page for a response, nothing for a revisit; size and digest: those of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


_SAFE = "".join(chr(c) for c in range(33, 127))


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    out = {"version": lines[0]}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class Inflated:
    """The bytes of a gzip file of any number of members, read forward once."""

    def __init__(self, source):
        self.source, self.held, self.inflate, self.ended = source, bytearray(), zlib.decompressobj(31), False

    def _more(self) -> bool:
        while not self.ended:
            data = self.inflate.unused_data if self.inflate.eof else b""
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            data = data or self.source.read(BLOCK)
            if not data:
                self.ended = True
                return False
            got = self.inflate.decompress(data)
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to and with mark; None at the end."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("an archive ends within a record")
                return None
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._more():
                raise ValueError("an archive ends within a record")
            out = bytes(self.held[:n])
            del self.held[:n]
            n -= len(out)
            yield out


def normalise_stream(source, archive, index, level: int = LEVEL) -> Iterator[tuple[int, int, str, str, str]]:
    """Rewrites a gzip stream record by record; yields and indexes (offset, length, type, id, target)."""
    stream, at = Inflated(source), 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        told = fields(head.strip())
        member, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0

        def put(data: bytes) -> None:
            nonlocal size
            size += len(data)
            archive.write(data)

        put(member.compress(head.lstrip(b"\r\n")))
        for part in stream.exactly(int(told["content-length"]) + 4):
            put(member.compress(part))
        put(member.flush())
        row = (at, size, told["warc-type"], told["warc-record-id"], told.get("warc-target-uri", ""))
        index.write(("\t".join(map(str, row)) + "\n").encode())
        yield row
        at += size


# ---- stages --------------------------------------------------------------------------------------------------------


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, url, payload, size, digest, refers_to): refers_to is null for responses; revisits have no payload."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("size", F.length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    same = rows.filter(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    same = written(same, "warc-payloads")
    key = F.xxhash64("digest", "size")
    bits = filter_bits(same.count())
    rows = with_hit(rows, key, key_bitmap(same, key, bits), bits)
    # a hot payload's rows lose it before anything is shuffled; there are few such payloads
    hot, cold = split_hot(same, "n", pages.count())
    rows = rows.join(hot.withColumnRenamed("first", "hot_first").drop("n"), ["digest", "size"], "left")
    told = F.col("hot_first").isNotNull()
    again = told & ~F.col("id").eqNullSafe(F.col("hot_first"))
    alone = rows.filter(told | ~F.col("__hit")).withColumn("refers_to", F.when(again, F.col("hot_first"))).withColumn("payload", F.when(~again, F.col("payload")))
    joined = rows.filter(~told & F.col("__hit")).join(cold, ["digest", "size"], "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    joined = joined.withColumn("refers_to", F.when(again, F.col("first"))).withColumn("payload", F.when(~again, F.col("payload")))
    cols = ("id", "url", "payload", "size", "digest", "refers_to")
    return alone.select(*cols).unionByName(joined.select(*cols))


def write_pages(pages: DataFrame, folder: str, **how) -> DataFrame:
    """(archive string, records long): whole-file gzip archives in folder, one a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, n, deflate, system = None, None, 0, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, size, digest, refers_to = (batch.column(c)[i] for c in range(6))
                if out is None:
                    system, path = open_folder(folder)
                    system.create_dir(path, recursive=True)
                    name = f"raw-{uuid.uuid4().hex}.warc.gz"
                    out, deflate = system.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                first = refers_to.as_py()
                body = payload.as_buffer().to_pybytes() if payload.is_valid else b""
                out.write(deflate.compress(record("response" if first is None else "revisit", page.as_py(), url.as_py(), body, size.as_py(), base32(digest.as_py()), first)))
                n += 1
        if out is not None:
            out.write(deflate.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["archive", "records"])

    return decided(pages, **how).mapInArrow(tidy(run), "archive string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(archive string, records long): the archives rewritten with a member a record, each with its sidecar index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            system, path = open_folder(folder)
            for raw in batch.column("archive").to_pylist():
                name = f"{raw.removeprefix('raw-').removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
                with system.open_input_stream(f"{path}/{raw}", compression=None) as source, system.open_output_stream(f"{path}/{name}", compression=None) as out, system.open_output_stream(f"{path}/{name}.idx", compression=None) as index:
                    n = sum(1 for _ in normalise_stream(source, out, index))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["archive", "records"])

    return archives.mapInArrow(tidy(run), "archive string, records long")


def read_index(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, offset, length, type, record_id, target) of the sidecars of archives."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    names = ("archive", "offset", "length", "type", "record_id", "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            system, path = open_folder(folder)
            for name in batch.column("archive").to_pylist():
                with system.open_input_stream(f"{path}/{name}.idx", compression=None) as source:
                    left = b""
                    while data := source.read(BLOCK):
                        *lines, left = (left + data).split(b"\n")
                        if lines:
                            yield made(name, lines)

    def made(name: str, lines: list[bytes]) -> pa.RecordBatch:
        cells = list(zip(*(line.decode().split("\t", 4) for line in lines), strict=True))
        values = [[name] * len(lines), list(map(int, cells[0])), list(map(int, cells[1])), *map(list, cells[2:])]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(values, kinds, strict=True)], names=names)

    return archives.select("archive").mapInArrow(tidy(run), "archive string, offset long, length long, type string, record_id string, target string")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(page_id string, url, record_type, payload_bytes, payload_digest, refers_to string, payload binary), by offset."""

    def one(member: bytes) -> tuple:
        data = BytesIO(zlib.decompress(member, 31)).getvalue()
        head, _, rest = data.partition(b"\r\n\r\n")
        told = fields(head)
        block = rest[: int(told["content-length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(fields(http)["content-length"])
        digest = told["warc-payload-digest"].removeprefix("sha1:")
        if told["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"payload of {told['warc-record-id']} does not match its digest")
        page = _PAGE.fullmatch(told["warc-record-id"])[1]
        refers = _PAGE.fullmatch(told["warc-refers-to"])[1] if "warc-refers-to" in told else None
        return page or None, told.get("warc-target-uri"), told["warc-type"], size, digest, refers, payload if told["warc-type"] == "response" else None

    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
    names = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        with ExitStack() as held_open:
            opened, source = None, None
            for batch in batches:
                rows, held = [], 0
                for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                    if name != opened:
                        held_open.close()
                        opened, source = name, held_open.enter_context(system.open_input_file(f"{path}/{name}"))
                    source.seek(offset)
                    rows.append(one(source.read(length)))
                    held += len(rows[-1][-1] or b"")
                    if held > 16_000_000:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    return index.select("archive", "offset", "length").mapInArrow(tidy(run), "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def archive(pages: DataFrame, folder: str, tasks: int | None = None, **how) -> DataFrame:
    """Writes pages as WARC to folder and normalises the archives; returns the index, read from the sidecars. The whole-file originals go."""
    raw = written(write_pages(pages, folder, **how), "warc-files")
    tasks = tasks or max(1, raw.sparkSession.sparkContext.defaultParallelism * 4)
    done = written(normalise(raw.repartition(tasks), folder), "warc-archives")
    _drop(raw.select("archive"), folder)
    return read_index(done.repartition(tasks), folder)


def _drop(names: DataFrame, folder: str) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                if system.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
                    system.delete_file(f"{path}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([0])], names=["n"])

    names.mapInArrow(run, "n long").agg(F.count("*")).collect()


# ---- query -------------------------------------------------------------------------------------------------------


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = scratch_path(spark, "warc")
    index = archive(pages, folder)
    return read_records(index, folder).select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, n) AS first,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1) FOR i IN range(32)], '') AS b32
  FROM p
)
SELECT page_id, n AS payload_bytes, b32 AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
