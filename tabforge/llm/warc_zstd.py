"""Web archives in Zstandard: writing them, and reading them back.

An archive is a file of Zstandard frames. It begins with a skippable frame
that holds a dictionary (trained on a bounded sample of payloads); each
further frame is one WARC record, so a record can be read, checked or skipped
by itself. Frame ends are found from the block headers, without decoding.

Spark's text writer puts the frames into files through its own committer, on
any file system: a frame is a row, and the line separator is an empty
skippable frame, which every reader passes over. Spark's binary reader brings
the files back, and each task decodes the records of its files.

Of records with equal payloads of at least ``min_bytes`` bytes the one with
the smallest id is a response and the others are revisits. Equality is that
of SHA-256 and length. A payload is moved once for each different content
(copies are combined before the shuffle); revisits move only their digests.

Defined cases. Null payload: empty. Null id: written without one, read back
as null, sorts after all ids. Null URL: header left out; control characters
and spaces of a URL are percent-encoded, so they cannot begin a new header.
Repeated ids or rows: one of the rows with the smallest id is the response,
the others are revisits that refer to that id. Payloads of any length are one
record. Empty table: no archive, no row. Extra columns are not read; helper
columns are named after the parameters only.

A record that fails a check (dictionary, frame, checksum, headers, lengths,
digests) ends a strict read with ``ArchiveError``; otherwise it becomes a row
whose ``error`` says what is wrong, and reading goes on at the next frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.common import materialize
from tabforge.session import scratch_path

# Fixed values of the Zstandard format (RFC 8878) and of the dictionary frame of .warc.zst files.
FRAME_MAGIC, SKIPPABLE_MAGIC, SKIPPABLE_MASK = 0xFD2FB528, 0x184D2A50, 0xFFFFFFF0
DICTIONARY_FRAME, DICTIONARY_MAGIC = 0x184D2A5D, 0xEC30A437
# An empty skippable frame; all its bytes are ASCII, so it can be a line separator.
SEPARATOR = struct.pack("<II", SKIPPABLE_MAGIC, 0).decode("ascii")
# Fixed values of WARC 1.1.
VERSION = "WARC/1.1"
REQUIRED = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# The dictionary is trained on at most so many payloads of at most so many characters each.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 8192, 64 << 10
LEVEL = 3

RECORD = ("record_id string, page_id long, record_type string, uri string, refers_to long, payload binary, "
          "payload_bytes long, payload_digest string, error string")


class ArchiveError(ValueError):
    """A record or a frame that breaks the format."""


def base32_sha1(data) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary if dictionary else b""


def _page_uri(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _page_of(uri: str | None) -> int | None:
    tail = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(tail) if tail.removeprefix("-").isdigit() else None


def _safe(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP head alone."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n").encode()
    block = head if revisit else head + payload
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_page_uri(page_id)}",
             f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    if revisit:
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {_page_uri(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
              "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def frames(data: memoryview) -> Iterator[tuple[int, int, int]]:
    """(magic, begin, end) of every frame, from the headers of frames and blocks."""
    at = 0
    while at < len(data):
        try:
            magic, size = struct.unpack_from("<II", data, at) if len(data) - at >= 8 else (0, 0)
            if magic & SKIPPABLE_MASK == SKIPPABLE_MAGIC:
                end = at + 8 + size
            elif magic == FRAME_MAGIC:
                end = at + zstandard.frame_header_size(data[at:at + 18])
                last = False
                while not last:
                    block = int.from_bytes(data[end:end + 3], "little")
                    if end + 3 > len(data):
                        raise ArchiveError("a frame is cut short")
                    last, kind = bool(block & 1), block >> 1 & 3
                    end += 3 + (1 if kind == 1 else block >> 3)
                end += 4 * zstandard.get_frame_parameters(data[at:at + 18]).has_checksum
            else:
                raise ArchiveError("no frame begins here")
        except zstandard.ZstdError as e:
            raise ArchiveError(f"bad frame header: {e}")
        if end > len(data):
            raise ArchiveError("a frame is cut short")
        yield magic, at, end
        at = end


def _dictionary(content: memoryview) -> zstandard.ZstdCompressionDict:
    """The dictionary of a leading skippable frame, which may itself be compressed."""
    raw = bytes(content)
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if raw[:4] != struct.pack("<I", DICTIONARY_MAGIC):
        raise ArchiveError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(raw)


def parse(data: bytes) -> dict:
    """The checked fields of one record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in (VERSION, "WARC/1.0"):
        raise ArchiveError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ArchiveError(f"bad header line {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in REQUIRED:
        if not fields.get(name.lower()):
            raise ArchiveError(f"{name} is missing")
    size = fields["content-length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError(f"the block is {len(rest) - 4} bytes long and ends its record, the header says {size[:20]}")
    block, kind = memoryview(rest)[:-4], fields["warc-type"]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ArchiveError("the block does not have its digest")
    out = {"record_id": fields["warc-record-id"], "page_id": _page_of(fields["warc-record-id"]), "record_type": kind,
           "uri": fields.get("warc-target-uri"), "refers_to": _page_of(fields.get("warc-refers-to")), "error": None}
    payload, declared = block, None
    if fields.get("content-type", "").startswith("application/http"):
        http, gap, _ = bytes(block[:65536]).partition(b"\r\n\r\n")
        if not gap:
            raise ArchiveError("no HTTP header")
        for line in http.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                declared = int(value)
        payload = block[len(http) + 4:]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        return out | {"payload": None, "payload_bytes": declared, "payload_digest": digest}
    if declared is not None and declared != len(payload):
        raise ArchiveError(f"the payload is {len(payload)} bytes long, its header says {declared}")
    found = base32_sha1(payload)
    if digest not in (None, found):
        raise ArchiveError("the payload does not have its digest")
    return out | {"payload": bytes(payload), "payload_bytes": len(payload), "payload_digest": found}


def read_archive(data: bytes, strict: bool = True) -> Iterator[dict]:
    """The records of one archive, frame by frame."""
    view = memoryview(data)
    reader = zstandard.ZstdDecompressor()
    try:
        for magic, begin, end in frames(view):
            if magic != FRAME_MAGIC:
                if magic == DICTIONARY_FRAME and begin == 0:
                    reader = zstandard.ZstdDecompressor(dict_data=_dictionary(view[8:end]))
                continue
            try:
                yield parse(reader.decompressobj().decompress(view[begin:end]))
            except (ArchiveError, zstandard.ZstdError, UnicodeDecodeError) as e:
                if strict:
                    raise ArchiveError(f"record at byte {begin}: {e}")
                yield {"error": f"record at byte {begin}: {e}"}
    except ArchiveError as e:  # past a broken frame nothing can be found
        if strict:
            raise
        yield {"error": str(e)}


def train_dictionary(bodies: DataFrame, keys: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the ``SAMPLE_ROWS`` different payloads of least key
    (their first ``SAMPLE_CHARS`` characters); empty where they are too few to
    train one. Keys alone are ordered, so a task returns no text to the driver
    but that of the chosen payloads."""
    last = keys.select("key").orderBy("key").limit(SAMPLE_ROWS).agg(F.max("key")).first()[0]
    rows = bodies.filter(F.col("key") <= F.lit(last)).select("key", F.substring("payload", 1, SAMPLE_CHARS).alias("t")).collect()
    sample = [r["t"].encode() for r in sorted(rows) if r["t"]]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, sample)) // 8), sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def _writer(dictionary: bytes, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
        lead = [dictionary_frame(dictionary)] if dictionary else []
        for batch in batches:
            out, size = [], 0
            for page_id, url, payload, n, sha1, refers_to, revisit in zip(*batch.columns):
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode("ascii")
                body = payload.as_py()
                out.append(pack.compress(record(page_id.as_py(), url.as_py(), (body or "").encode(), n.as_py(), digest,
                                                refers_to.as_py(), revisit.as_py(), date)))
                size += len(out[-1])
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(lead + out, pa.binary())], ["frame"])
                    lead, out, size = [], [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(lead + out, pa.binary())], ["frame"])
                lead = []
    return run


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                   min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> None:
    """Write a record per row of ``pages`` below ``path``, one archive a task."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    raw = F.encode(body, "utf-8")
    key = F.concat_ws("-", F.sha2(raw, 256), F.octet_length(body))
    # the digests of all rows, numbered once: what follows agrees on the numbers
    rows = materialize(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), key.alias("key"),
                                    F.octet_length(body).cast("long").alias("n"), F.sha1(raw).alias("sha1"),
                                    F.monotonically_increasing_id().alias("rid")), "warc-rows")
    alone = F.col("n") < min_bytes
    first = (rows.filter(~alone).groupBy("key").agg(F.min(F.struct(F.isnull("page_id").alias("no"), "page_id", "rid")).alias("f"),
                                                    F.count("*").alias("copies")))
    marked = (rows.filter(~alone).join(first, "key")
              .select("page_id", "url", "key", "n", "sha1", F.col("f.page_id").alias("refers_to"),
                      (F.col("rid") != F.col("f.rid")).alias("revisit"))
              .unionByName(rows.filter(alone).select("page_id", "url", "key", "n", "sha1",
                                                     F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))))
    # one text for each content, combined before the shuffle
    bodies = pages.select(key.alias("key"), body.alias("payload")).groupBy("key").agg(F.first("payload").alias("payload"))
    columns = ["page_id", "url", "payload", "n", "sha1", "refers_to", "revisit"]
    responses = (marked.filter(~F.col("revisit")).join(bodies, "key")
                 .withColumn("refers_to", F.lit(None).cast("long")).select(columns))
    revisits = marked.filter("revisit").withColumn("payload", F.lit(None).cast("string")).select(columns)
    dictionary = train_dictionary(bodies, rows.select("key").distinct())
    frame = responses.unionByName(revisits).mapInArrow(_writer(dictionary, date), "frame binary")
    frame.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).text(path)


def _reader(strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.partition(" ")[0] for c in RECORD.split(", ")]
        types = [{"long": pa.int64(), "binary": pa.binary()}.get(c.partition(" ")[2], pa.string()) for c in RECORD.split(", ")]

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(names, types)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for found in read_archive(content.as_buffer(), strict):
                    rows.append(found)
                    size += len(found.get("payload") or b"") + 200
                    if size > 1 << 23:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)
    return run


def read_archives(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The records of all archives below ``path``; for a revisit, length and
    digest are those of the full payload it stands for."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(_reader(strict), RECORD)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` written as archives in the shared scratch folder and read back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes=min_bytes)
    return read_archives(pages.sparkSession, path)
