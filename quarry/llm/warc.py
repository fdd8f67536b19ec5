"""WARC archives with dictionary compression (.warc.zst): a writer and a reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary, built from a bounded
sample of the records to be archived (SAMPLE records, each up to SAMPLE_BYTES); each record is compressed as a frame of
its own with it. Of records with equal payloads of at least `least` bytes the one with the largest page_id is written
as response and the others as revisits of it.

Payloads are never shuffled: one pass digests them, the choice of revisits is made on digests (aggregated before the
shuffle, so a payload that a third of all pages share costs no more than another), and goes back to the pages by block.
Executors write archives under names of their own attempt to the shared folder; a table that Spark commits lists the
archives of the attempts that counted.

A record's id follows from its row, so a task that runs again writes the same records, and a revisit names the record, the
page and the target of its response, as other readers expect it.

Defined cases: a null html is an empty payload; a null url gives a record without target; a null page_id counts as the
smallest and is written without page; of repeated rows with the same page_id and payload one is the response and the
others revisit that page_id. An empty table gives no archive. Payloads of any length are written whole, in
memory that follows them. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.aligned import by_block, file_system, keyed, with_findings

LEAST = 1000
#: An archive is closed when it has this many compressed bytes.
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES, SAMPLE, SAMPLE_BYTES = 32 << 10, 400, 16 << 10
SKIPPABLE = 0x184D2A5D
LEVEL = 3


def record_id(block: int, row: int) -> str:
    """The id of the record of a row, which `aligned.keyed` names."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{block} {row}')}>"


def _target(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(id_: str, date: str, page_id: int | None, url: str | None, html: str | None, of: dict | None = None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of another (block, row, page_id, url), which has the headers alone."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if of is None else 'revisit'}", f"WARC-Record-ID: {id_}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_target(url)}")
    head += [f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}", f"WARC-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if of is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(of['block'], of['row'])}", f"WARC-Refers-To-Date: {date}"]
        head += [] if of["url"] is None else [f"WARC-Refers-To-Target-URI: {_target(of['url'])}"]
        head += [] if of["page_id"] is None else [f"WARC-Refers-To-Page-ID: {of['page_id']}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary built from records; where there are too few to train one, their text itself, which may be empty."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _info(date: str) -> bytes:
    body = b"software: quarry\r\nformat: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


class Archive:
    """An archive being written at uri."""

    def __init__(self, uri: str, words: bytes, date: str) -> None:
        self.uri, self.records, self.bytes = uri, 0, 0
        where, at = file_system(uri)
        where.create_dir(at.rpartition("/")[0], recursive=True)
        self.out = where.open_output_stream(at)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None).compress
        self._put(struct.pack("<II", SKIPPABLE, len(words)) + words)
        self._put(self.compress(_info(date)))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.compress(data))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.uri, self.records, self.bytes


def read_archive(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive but its warcinfo."""
    where, at = file_system(uri)
    with where.open_input_stream(at) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{uri} does not start with a dictionary frame")
        words = f.read(size)
        context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        with context.stream_reader(f, read_across_frames=True) as stream:
            text = io.BufferedReader(stream, 1 << 18)
            while line := text.readline():
                if line.rstrip() != b"WARC/1.1":
                    raise ValueError(f"{uri}: a record starts with {line[:40]!r}")
                head: dict[str, str] = {}
                while (line := text.readline().rstrip(b"\r\n")):
                    name, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
                    head[name] = value
                block = text.read(int(head["Content-Length"]))
                if len(block) != int(head["Content-Length"]) or text.read(4) != b"\r\n\r\n":
                    raise ValueError(f"{uri}: a record is cut off")
                if head["WARC-Type"] != "warcinfo":
                    yield head, block


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(block, row, of) of the rows of keyed pages that repeat a payload of at least `least` bytes; of: (page_id, block, row, url) of its response."""
    html = common.text_of("html")
    seen = pages.where(F.octet_length(html) >= least).select("block", "row", "page_id", "url", F.sha2(html, 256).alias("digest"))
    first = seen.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "block", "row", "url")).alias("of")).where("n > 1")
    both = seen.join(first, "digest").where((F.col("block") != F.col("of.block")) | (F.col("row") != F.col("of.row")))
    return both.select("block", "row", "of")


def write(pages: DataFrame, folder: str, date: str, least: int = LEAST) -> DataFrame:
    """Writes pages (page_id, url, html) as archives under folder, dated date (like 2024-01-31T12:00:00Z); returns the table
    of archives (uri, records, bytes)."""
    folder = common.qualified(pages.sparkSession, folder)
    docs = keyed(pages, F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html"))
    path = by_block(revisits(docs, least), "revisits")
    some = pages.select("page_id", F.substring("url", 1, 2000).alias("url"), F.substring("html", 1, SAMPLE_BYTES).alias("html")).where(F.octet_length("html") > 64).limit(SAMPLE).collect()
    words = dictionary([record(record_id(0, i), date, *r) for i, r in enumerate(some)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = lambda t: dict(zip(t.column("row").to_pylist(), t.column("of").to_pylist(), strict=True))
        out, done = None, []
        for block, (row, page_id, url, html), of in with_findings(batches, path, index):
            if out is None:
                out = Archive(f"{folder}/{uuid.uuid4().hex}.warc.zst", words, date)
            out.add(record(record_id(block, row), date, page_id, url, html, of))
            if out.bytes >= ARCHIVE_BYTES:
                done.append(out.close())
                out = None
        if out is not None:
            done.append(out.close())
        cols = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["uri", "records", "bytes"])

    return common.written(docs.mapInArrow(run, "uri string, records long, bytes long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to; and the payload's html,
    which is null for revisits. Digests of responses are verified against their payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows, held = [], 0
                for head, block in read_archive(uri):
                    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{uri}: a payload does not have its digest {digest}")
                    page, to = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page-ID")
                    rows.append((None if page is None else int(page), int(head["WARC-Payload-Length"]), digest, kind, None if to is None else int(to), None if payload is None else payload.decode("utf-8", "surrogatepass")))
                    held += len(block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    n = max(1, common.shuffle_partitions(archives.sparkSession))
    return archives.select("uri").repartition(n).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


SQL = """
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN octet_length(encode(h)) >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(h)) >= 1000 AND page_id <> m THEN m END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages)
"""
