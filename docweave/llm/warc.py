"""WARC archives of Zstandard frames: a writer with revisit records, and a reader that validates.

An archive begins with a skippable frame that holds the dictionary (a Zstandard frame
itself, or bare), then has one frame for each record. Archives are rows of a table, each
with the bytes of one file, so any file system that Spark can write to holds them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Workspace, join_groups, table

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
ZSTD_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads under so many bytes are never revisits.
REVISIT_BYTES = 1000
#: Uncompressed bytes after which an archive is closed, and bytes of records from which a dictionary is trained.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 8 << 20, 1 << 20, 16 << 10
ID = "urn:x-page:"


class WarcError(ValueError):
    """A frame, header or length that breaks the format."""


def digest_header(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode("utf-8") + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, date: str, refers_to: int | None = None) -> bytes:
    """A response record, or, with ``refers_to``, a revisit record, which has the HTTP headers but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = "none" if page_id is None else page_id
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{ID}{name}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    headers += [("WARC-Payload-Digest", digest_header(payload)), ("WARC-Block-Digest", digest_header(block))]
    if revisit:
        headers += [("WARC-Refers-To", f"<{ID}{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    return _record([*headers, ("Content-Type", "application/http; msgtype=response")], block)


class ArchiveWriter:
    """Collects records and gives whole archives; each trains its dictionary on its first records."""

    def __init__(self, level: int = 3):
        self.level = level
        self.records: list[bytes] = []
        self.size = 0

    def add(self, record: bytes) -> bool:
        """Whether the archive is now full."""
        self.records.append(record)
        self.size += len(record)
        return self.size >= ARCHIVE_BYTES

    def close(self) -> bytes:
        samples, size = [], 0
        for record in self.records:
            if size >= SAMPLE_BYTES:
                break
            samples.append(record)
            size += len(record)
        dictionary, parts = None, []
        if len(samples) >= 16:
            try:
                dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 8), samples)
            except zstandard.ZstdError:  # too little in common: the archive goes without
                dictionary = None
        if dictionary:
            packed = zstandard.ZstdCompressor(level=self.level).compress(dictionary.as_bytes())
            parts.append(DICTIONARY_FRAME.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)
        packer = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_checksum=True, write_content_size=True)
        parts += [packer.compress(record) for record in self.records]
        self.records, self.size = [], 0
        return b"".join(parts)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, by its header and block lengths."""
    if at + 5 > len(data) or int.from_bytes(data[at : at + 4], "little") != ZSTD_MAGIC:
        raise WarcError(f"no Zstandard frame at {at}")
    flags = data[at + 4]
    single, sized = flags >> 5 & 1, flags >> 6
    pos = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[sized])
    while True:
        if pos + 3 > len(data):
            raise WarcError(f"the frame at {at} is cut short")
        block = int.from_bytes(data[pos : pos + 3], "little")
        kind = block >> 1 & 3
        if kind == 3:
            raise WarcError(f"the frame at {at} has a block of a reserved kind")
        pos += 3 + (1 if kind == 1 else block >> 3)
        if block & 1:
            break
    pos += 4 * (flags >> 2 & 1)
    if pos > len(data):
        raise WarcError(f"the frame at {at} is cut short")
    return pos


def read_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, and where the records begin."""
    if len(data) < 8 or int.from_bytes(data[:4], "little") != DICTIONARY_FRAME:
        return None, 0
    end = 8 + int.from_bytes(data[4:8], "little")
    if end > len(data):
        raise WarcError("the dictionary frame is cut short")
    raw = bytes(data[8:end])
    magic = int.from_bytes(raw[:4], "little")
    try:
        if magic == ZSTD_MAGIC:
            packer = zstandard.ZstdDecompressor().decompressobj()
            raw = packer.decompress(raw)
            if not packer.eof:
                raise WarcError("the dictionary's frame is cut short")
        if int.from_bytes(raw[:4], "little") != DICTIONARY_MAGIC:
            raise WarcError("the dictionary frame holds no dictionary")
        dictionary = zstandard.ZstdCompressionDict(raw)
        zstandard.ZstdDecompressor(dict_data=dictionary).decompress(zstandard.ZstdCompressor().compress(b""))  # loads it
    except zstandard.ZstdError as error:
        raise WarcError(f"the dictionary does not decode: {error}") from error
    return dictionary, end


def frames(data: memoryview, max_bytes: int | None = None) -> Iterator[tuple[int, bytes | None]]:
    """Offset and content of each record's frame, decoded one at a time; None for one of more than ``max_bytes``."""
    dictionary, at = read_dictionary(data)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        if len(data) - at >= 4 and int.from_bytes(data[at : at + 4], "little") in SKIPPABLE:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if end > len(data):
                raise WarcError(f"the skippable frame at {at} is cut short")
            at = end
            continue
        end = frame_end(data, at)
        try:
            params = zstandard.get_frame_parameters(data[at:end])
            known = params.content_size < 1 << 62
            if known and max_bytes is not None and params.content_size > max_bytes:
                yield at, None
                at = end
                continue
            content = decoder.decompress(data[at:end]) if known else decoder.decompressobj().decompress(data[at:end])
        except zstandard.ZstdError as error:
            raise WarcError(f"the frame at {at} does not decode: {error}") from error
        yield at, content
        at = end


_NUMBER = re.compile("[0-9]{1,18}").fullmatch
_LINE = re.compile(rb"([!#$%&'*+\-.^_`|~0-9A-Za-z]+):[ \t]*(.*?)[ \t]*\Z", re.S)
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        found = _LINE.match(line)
        if not found:
            raise WarcError(f"not a header line: {line[:80]!r}")
        last = found[1].decode().lower()
        out.setdefault(last, found[2].decode("utf-8", "replace"))
    return out


def parse_record(content: bytes) -> tuple[dict[str, str], dict[str, str], bytes, bytes]:
    """WARC headers, HTTP headers, block and payload of a record, validated: version,
    required headers, the block's length, the closing line ends, digests and HTTP length."""
    cut = content.find(b"\r\n\r\n")
    if cut < 0 or not re.match(rb"WARC/1\.[01]\r\n", content):
        raise WarcError("not a WARC record")
    headers = _headers(content[:cut].split(b"\r\n")[1:])
    if missing := [k for k in REQUIRED if k not in headers]:
        raise WarcError(f"headers are missing: {', '.join(missing)}")
    if not _NUMBER(headers["content-length"]):
        raise WarcError("Content-Length is no number")
    length = int(headers["content-length"])
    block = content[cut + 4 : cut + 4 + length]
    if len(block) != length or content[cut + 4 + length :] != b"\r\n\r\n":
        raise WarcError("Content-Length differs from the block's length")
    if headers.get("warc-block-digest", "").startswith("sha1:") and headers["warc-block-digest"] != digest_header(block):
        raise WarcError("the block's digest differs")
    http: dict[str, str] = {}
    payload = block
    if headers.get("content-type", "").replace(" ", "").startswith("application/http"):
        stop = block.find(b"\r\n\r\n")
        if stop < 0:
            raise WarcError("the HTTP headers do not end")
        http, payload = _headers(block[:stop].split(b"\r\n")[1:]), block[stop + 4 :]
    if headers["warc-type"] == "response":
        if http.get("content-length", str(len(payload))) != str(len(payload)):
            raise WarcError("the HTTP length differs from the payload's")
        if headers.get("warc-payload-digest", "").startswith("sha1:") and headers["warc-payload-digest"] != digest_header(payload):
            raise WarcError("the payload's digest differs")
    return headers, http, block, payload


def with_revisits(pages: DataFrame, ws: Workspace) -> DataFrame:
    """``page_id, url, payload, refers_to``: of equal payloads of 1000 bytes or more, the largest page_id's is kept.

    Rows that share that page_id are all kept. A row without a page_id revisits like any other;
    where no copy has one, none revisits. A null html is an empty payload, a very long one a payload like others, a null url an
    unknown target. An empty table gives no archives; other columns are ignored, whatever their names.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large, small = (rows.filter(x) for x in (F.octet_length("payload") >= REVISIT_BYTES, F.octet_length("payload") < REVISIT_BYTES))
    groups = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n_rows"))
    copies = ws.save(groups.filter("n_rows > 1 and keeper is not null"), "copies")
    joined = join_groups(large, copies, "digest", "n_rows")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    # Short payloads, of which one may be on very many pages, have no group and don't take part in the join.
    return joined.select("page_id", "url", "payload", refers_to.alias("refers_to")).unionByName(
        small.select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    )


def write_archives(pages: DataFrame, ws: Workspace, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``archive, content``: names and bytes of archives with a record for every row of ``pages``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, writer = TaskContext.get().partitionId(), 0, ArchiveWriter()

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"part-{part:05d}-{number:05d}.warc.zst"], "content": [writer.close()]})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to")]
            for page_id, url, payload, refers_to in zip(*columns, strict=True):
                if writer.add(page_record(page_id.as_py(), url.as_py(), payload.as_py(), date, refers_to.as_py())):
                    yield close()
                    number += 1
        if writer.records:
            yield close()

    return ws.save(with_revisits(pages, ws).mapInArrow(write, "archive string, content binary"), "archives")


READ = {"archive": pa.string(), "offset": pa.int64(), "record_type": pa.string(), "record_id": pa.string(), "target_uri": pa.string(), "refers_to_id": pa.string()}
READ |= {"payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(), "error": pa.string()}
READ_SCHEMA = "archive string, offset long, record_type string, record_id string, target_uri string, refers_to_id string, payload_bytes long, payload_digest string, payload binary, error string"


def _plain_digest(header: str | None) -> str | None:
    """A sha1 header as lower-case hex; other algorithms as they are."""
    if header and header.startswith("sha1:"):
        try:
            digest = base64.b32decode(header[5:])
        except ValueError:
            digest = b""
        if len(digest) != 20:
            raise WarcError("the payload's digest is no base32 of 20 bytes")
        return digest.hex()
    return header


def _read_one(archive: str, data: memoryview, keep_payload: bool, max_bytes: int | None) -> Iterator[tuple]:
    at = 0
    try:
        for at, content in frames(data, max_bytes):
            try:
                if content is None:
                    raise WarcError(f"the record is longer than {max_bytes} bytes")
                headers, http, _, payload = parse_record(content)
                revisit = headers["warc-type"] == "revisit"
                digest = _plain_digest(headers.get("warc-payload-digest")) if revisit else hashlib.sha1(payload).hexdigest()
                length = http.get("content-length") if revisit else str(len(payload))
                if length is not None and not _NUMBER(length):
                    raise WarcError("the HTTP length is no number")
            except WarcError as error:
                yield (archive, at, *(None,) * 7, str(error))
                continue
            ids = [headers.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-target-uri", "warc-refers-to")]
            yield (archive, at, headers["warc-type"], *ids, None if length is None else int(length), digest, payload if keep_payload and not revisit else None, None)
    except WarcError as error:  # the archive can't be followed further
        yield (archive, at, *(None,) * 7, str(error))


def read_archives(archives: DataFrame, keep_payload: bool = True, max_bytes: int | None = None) -> DataFrame:
    """A row for each record of ``archive, content``; ``error`` says what breaks a record that is not valid.

    Records of any length are read unless ``max_bytes`` is given; a longer one is then a row with an error. Null and empty
    contents have no records, a null archive name stays null, and other columns are ignored.

    A broken record leaves the others readable; after a broken frame the archive's rest
    is one row with an error. A revisit has its original's digest and length, no payload.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                if not content.is_valid:
                    continue
                rows: list[tuple] = []
                size = 0
                for row in _read_one(archive, memoryview(content.as_buffer()), keep_payload, max_bytes):
                    rows.append(row)
                    size += len(row[8] or b"")
                    if len(rows) >= 1000 or size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), READ.values(), strict=True)], names=list(READ))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), READ.values(), strict=True)], names=list(READ))

    return archives.select("archive", "content").mapInArrow(read, READ_SCHEMA)


def unresolved_revisits(records: DataFrame) -> DataFrame:
    """Revisits among ``records`` (as ``read_archives`` gives them) whose original is no response among them."""
    responses = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id")).distinct()
    return records.filter("record_type = 'revisit'").join(responses, "refers_to_id", "left_anti")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), Workspace(spark, "warc"))
    page = lambda c: F.when(F.col(c).startswith(ID), F.expr(f"try_cast(substring({c}, {len(ID) + 1}) as long)"))
    return read_archives(archives, keep_payload=False).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to_id").alias("refers_to"), "error"
    )


ORACLE = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
    m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN keeper <> page_id THEN keeper END AS refers_to, CAST(NULL AS VARCHAR) AS error
    FROM m"""
