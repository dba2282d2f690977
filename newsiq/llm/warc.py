"""WARC archives under Zstandard: one frame per record behind a dictionary frame.

An archive is a ``.warc.zst`` file: a skippable frame that holds the
dictionary, then one frame for each record.  Archives are written and read by
Spark's own sources, so they may lie in any store that Spark reaches.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGICS = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
ZSTD_DICTIONARY_MAGIC = 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

#: Written between frames: an empty skippable frame, which every decoder skips.
SEPARATOR = "P*M\x18\0\0\0\0"
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 1 << 14, 100, 1 << 13
#: Payload bytes of one batch that a reading task hands on.
BATCH_BYTES = 1 << 23

RECORD = (
    "archive string, offset long, record_type string, record_id string, target_uri string, date string, "
    "content_length long, payload_bytes long, payload_digest string, refers_to string, payload binary, error string"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _escape(text: str) -> str:
    """Header value on one line of printable ASCII; ``%`` and all else as %XX."""
    return "".join(chr(b) if 0x20 < b < 0x7F and b != 0x25 else f"%{b:02X}" for b in text.encode("utf-8", "replace"))


def record(kind: str, record_id: str, uri: str | None, date: str, digest: bytes, size: int, refers_to: str | None, payload: bytes) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that keeps only the HTTP head."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_escape(uri)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [
        f"WARC-Payload-Digest: sha1:{base32(digest)}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the samples' own bytes where they are too few or too alike to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _page_urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _frames(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    """The frames of one archive: the dictionary first, then a frame per page."""
    packer = None
    for batch in batches:
        out, made, size = [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

        def pack(frames):
            return [packer.compress(f) for f in frames]

        for i in range(batch.num_rows):
            page_id, url, digest, n, refers_to, payload = (batch.column(k)[i].as_py() for k in range(6))
            kind = "response" if payload is not None else "revisit"
            target = None if payload is not None else _page_urn(refers_to)
            made.append(record(kind, _page_urn(page_id), url, date, digest, n, target, payload or b""))
            size += len(made[-1])
            if packer is None and (len(made) == SAMPLES or i + 1 == batch.num_rows):
                raw = dictionary([m[:SAMPLE_BYTES] for m in made])
                packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
                out.append(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
            if packer is not None and (size >= BATCH_BYTES or i + 1 == batch.num_rows):
                out += pack(made)
                yield flush()
                out, made, size = [], [], 0


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``pages`` (page_id, url, html) as archives under ``path``, one per partition.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with
    the smallest page_id is a response, the others are revisits that refer to
    it and carry no payload; smaller payloads are all responses.  A null html
    is an empty payload.  Rows that repeat the smallest page_id with the same
    payload are alike and are all responses; a null page_id never is the
    smallest unless all are null.  A null url leaves the header out; spaces,
    percent signs, control and non-ASCII characters of a url are percent-encoded.  An empty table
    gives a folder without records.  Other columns are ignored.

    A digest that many pages share is reduced to one row before the join, and
    a large join partition is split by the adaptive planner; payloads cross the
    network once.  The file names are those of Spark's text writer.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first")).hint("shuffle_hash")
    size = F.octet_length("payload").cast("long")
    revisit = (size >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    records = rows.join(first, "digest").select(
        "page_id", "url", "digest", size.alias("n"),
        F.when(revisit, F.col("first")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    frames = records.mapInArrow(lambda batches: _frames(batches, date), "frame binary")
    lines = frames.select(F.col("frame").cast("string").alias("value"))
    lines.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 0).option("compression", "none").text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Position behind the Zstandard frame at ``at``, found from its block headers alone."""
    mark = data[at + 4]
    single, checksum = mark >> 5 & 1, mark >> 2 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[mark & 3] + (single, 2, 4, 8)[mark >> 6]
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        if at + 3 > len(data) or block >> 1 & 3 == 3:
            raise ValueError("broken block")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            at += 4 * checksum
            if at > len(data):
                raise ValueError("cut off frame")
            return at


def frames(data: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, decoded frame or None, error or None) of the frames of one archive."""
    view, at, decoder = memoryview(data), 0, None
    while at < len(data):
        start = at
        try:
            magic, size = struct.unpack_from("<II", data, at) if at + 8 <= len(data) else (0, 0)
            if magic in SKIPPABLE_MAGICS:
                at += 8 + size
                if at > len(data):
                    raise ValueError("cut off skippable frame")
                if start == 0 and magic == DICTIONARY_MAGIC:
                    raw = data[8:at]
                    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
                continue
            if magic != FRAME_MAGIC:
                raise ValueError("not a frame")
            at = frame_end(view, at)
        except (ValueError, IndexError) as e:
            yield start, None, f"{e}"  # without its end nothing behind it can be found
            return
        try:
            decoder = decoder or zstandard.ZstdDecompressor()
            yield start, decoder.decompressobj().decompress(view[start:at]), None
        except zstandard.ZstdError as e:
            yield start, None, f"{e}"


def parse(raw: bytes) -> dict:
    """Fields of one record, with ``error`` naming the first rule it breaks.

    Checked: version line, mandatory headers, that the frame holds exactly one
    record of the declared length, block digest, HTTP length and, for a
    response, the payload digest.
    """
    out = dict.fromkeys(("record_type", "record_id", "target_uri", "date", "content_length", "payload_bytes", "payload_digest", "refers_to", "payload", "error"))
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        return out | {"error": "no WARC head"}
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return out | {"error": "header without colon"}
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    out |= {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "refers_to": fields.get("warc-refers-to"), "payload_digest": (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None}
    if missing := [name for name in MANDATORY if not fields.get(name)]:
        return out | {"error": f"no {missing[0]}"}
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        return out | {"error": "bad content-length"}
    size = out["content_length"] = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        return out | {"error": "length differs from content-length"}
    block = rest[:size]
    if (claim := fields.get("warc-block-digest")) and claim != f"sha1:{base32(hashlib.sha1(block).digest())}":
        return out | {"error": "block digest differs"}
    payload, http = block, None
    if fields.get("content-type", "").startswith("application/http"):
        top, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            return out | {"error": "no HTTP head"}
        named = dict(x.lower().split(b":", 1) for x in top.split(b"\r\n")[1:] if b":" in x)
        length = named.get(b"content-length", b"").strip()
        http = int(length) if length.isdigit() else None
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": http, "error": None if http is not None and out["refers_to"] else "revisit without length or target"}
    out |= {"payload_bytes": len(payload), "payload": payload}
    if http is not None and http != len(payload):
        return out | {"error": "HTTP length differs"}
    digest = base32(hashlib.sha1(payload).digest())
    if out["payload_digest"] not in (None, digest):
        return out | {"error": "payload digest differs"}
    return out | {"payload_digest": digest}


def read(spark, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives under ``path``, checked; see :func:`parse`.

    A broken record has its ``error`` and whatever could be read; a frame
    whose end cannot be found ends its archive with one such row.  One task
    reads an archive as a whole, so archives must fit a task (the sources'
    ``spark.sql.sources.binaryFile.maxLength`` is the hard bound); those
    written here have the size of one partition.  Empty files give no rows.
    """
    schema = RECORD if payloads else RECORD.replace("payload binary, ", "")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"offset": pa.int64(), "content_length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for at, raw, error in frames(batch.column(1)[i].as_py()):
                    row = parse(raw) if error is None else {"error": error}
                    rows.append(row | {"archive": batch.column(0)[i].as_py(), "offset": at})
                    size += len(raw or b"")
                    if size >= BATCH_BYTES:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
