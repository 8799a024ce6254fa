"""WARC archives under Zstandard: one frame per record, the dictionary in a leading skippable frame.

``write`` puts rows (page_id, url, html) into ``*.warc.zst`` archives in a shared folder, ``read`` gives their
records back.  Archive layout: a skippable frame (magic 0x184D2A5D) with the dictionary, itself a Zstandard
frame, then a frame per WARC/1.1 record.  ``read`` walks the block headers of each frame to find its end,
decodes it with the archive's dictionary and checks version line, needed headers, Content-Length, the closing
blank lines, the HTTP header's length, and for full payloads the SHA-1.  A record that fails stops the read with its archive
and offset, or with on_error="report" becomes a row whose ``error`` says why.

Equal payloads of at least ``least`` bytes are stored once, by the largest page_id; the others become revisit
records that keep the HTTP header, digest and length.  Null html is an empty payload.  A null url has the target
"about:blank"; control and non-ASCII characters in a url are percent-encoded.  Rows without page_id are written, never
referred to, and come back with a null page_id.  Repeated rows give repeated records.  No rows, no archives.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, binary_list

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string, position long, error string"
ID = "<urn:sieveline:page:{}>"
TAIL = b"\r\n\r\n"


def train(pages: DataFrame, size: int = 32_768, samples: int = 400, sample_bytes: int = 8_192) -> bytes:
    """A compression dictionary from at most ``samples`` payloads of at most ``sample_bytes`` each."""
    import zstandard

    found = [r[0].encode() for r in pages.where("html <> ''").select(F.substring("html", 1, sample_bytes)).limit(samples).collect()]
    try:
        return zstandard.train_dictionary(size, found).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train from
        return b"".join(found)[:size] or b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nWARC/1.1\r\n"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """The bytes of one WARC record; a revisit has the HTTP header of the payload, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = urllib.parse.quote(url, safe=";/?:@&=+$,#[]%!*'()~") if url else "about:blank"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ID.format('none' if page_id is None else page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {ID.format(refers_to)}"]
    return "\r\n".join(lines).encode() + TAIL + block + TAIL


def frame_size(data: memoryview, at: int) -> int:
    """The length of the Zstandard frame at ``at``, from its header and block headers."""
    head = data[at + 4]
    single = head >> 5 & 1
    end = at + 5 + (not single) + (0, 1, 2, 4)[head & 3] + ((single, 2, 4, 8)[head >> 6])
    while True:
        block = int.from_bytes(data[end : end + 3], "little")
        if end + 3 > len(data) or block >> 1 & 3 == 3:
            raise ValueError("truncated or corrupt frame")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            end += 4 * (head >> 2 & 1)
            if end > len(data):
                raise ValueError("truncated frame")
            return end - at


def parse(raw: bytes) -> dict:
    """Headers, type, page_id, refers_to, length, digest and payload of one record; ValueError says what is wrong."""
    head, blank, rest = raw.partition(TAIL)
    lines = head.decode("utf-8").split("\r\n")
    if not blank or lines[0] not in ("WARC/1.1", "WARC/1.0"):
        raise ValueError("no WARC version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"malformed header {line!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"header {name} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + len(TAIL) or rest[-4:] != TAIL:
        raise ValueError(f"Content-Length is {headers['content-length']}, the block has {len(rest) - len(TAIL)} bytes")
    out = {"type": headers["warc-type"], "url": headers.get("warc-target-uri"), "refers_to": None, "length": len(rest) - 4, "digest": None, "payload": rest[:-4]}
    last = headers["warc-record-id"].strip("<>").rpartition(":")[2]
    out["page_id"] = int(last) if last.lstrip("-").isdigit() else None
    if out["type"] in ("response", "revisit"):
        http, blank, body = rest[:-4].partition(TAIL)
        fields = dict(x.lower().split(b": ", 1) for x in http.split(b"\r\n")[1:] if b": " in x)
        if not blank or not http.startswith(b"HTTP/") or not fields.get(b"content-length", b"").isdigit():
            raise ValueError("no HTTP header with a length")
        out["length"], out["payload"] = int(fields[b"content-length"]), body
        out["digest"] = base64.b32decode(headers.get("warc-payload-digest", "").removeprefix("sha1:")).hex()
        if out["type"] == "response" and (len(body) != out["length"] or hashlib.sha1(body).hexdigest() != out["digest"]):
            raise ValueError("the payload differs from its length or digest")
        if out["type"] == "revisit":
            if body or "warc-refers-to" not in headers:
                raise ValueError("a revisit with a payload, or without WARC-Refers-To")
            out["refers_to"] = int(headers["warc-refers-to"].strip("<>").rpartition(":")[2])
    return out


def write(spark: SparkSession, pages: DataFrame, folder: str, dictionary: bytes, least: int = 1000, archive_bytes: int = 24_000_000, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives into ``folder``, a URI that all executors reach; returns rows (archive, folder, records)."""
    html = F.coalesce("html", F.lit(""))
    sized = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    # One row per payload, made with partial sums; a hot payload only repeats on the other side, which AQE splits.
    first = sized.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = sized.join(first, ["digest", "size"], "left").select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        packed = zstandard.ZstdCompressor(level=6).compress(dictionary)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)
        k, out, temporary, name, size, n = 0, None, "", "", 0, 0

        def close():
            out.close()
            store.move(temporary, name)  # only whole archives are ever visible
            return pa.RecordBatch.from_pydict({"archive": [name], "folder": [folder], "records": pa.array([n], pa.int64())})

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_list(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if out is None:
                    name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{k:05d}.warc.zst"  # an attempt's own names
                    temporary = f"{root}/_{task.taskAttemptId()}-{k:05d}"
                    out, size, n, k = store.open_output_stream(temporary), 0, 0, k + 1
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
                out.write(compressor.compress(record("response" if refers_to is None else "revisit", page_id, url, payload, digest, refers_to, date)))
                size, n = size + len(payload), n + 1
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return rows.mapInArrow(put, "archive string, folder string, records long")


def records_of(data: memoryview) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, raw record, error) of each frame of an archive; after a corrupt frame nothing more can be found."""
    import zstandard

    at, dictionary = 0, None
    while at < len(data):
        try:
            if len(data) - at < 8:
                raise ValueError("trailing bytes")
            magic, size = struct.unpack_from("<II", data, at)
            if magic & 0xFFFFFFF0 == 0x184D2A50:
                if at + 8 + size > len(data):
                    raise ValueError("truncated skippable frame")
                if magic == DICTIONARY_MAGIC and at == 0:
                    content = bytes(data[8 : 8 + size])
                    packed = content[:4] == struct.pack("<I", FRAME_MAGIC)
                    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompressobj().decompress(content) if packed else content)
                at += 8 + size
                continue
            if magic != FRAME_MAGIC:
                raise ValueError("not a Zstandard frame")
            size = frame_size(data, at)
            decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
            yield at, decoder.decompressobj().decompress(data[at : at + size]), None
            at += size
        except (ValueError, IndexError, zstandard.ZstdError) as e:
            yield at, None, str(e)
            return


def read(spark: SparkSession, archives: str | DataFrame, on_error: str = "raise", payloads: bool = True) -> DataFrame:
    """The records of archives, as RECORD says; payloads=False leaves payloads out of the rows.

    archives: a folder, all of whose archives are read; or rows (archive) with paths and the folder's URI as ``write`` gives them
    (so what a lost task has left in the folder is not read).
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.FileSystem.from_uri(folder)[0].open_input_file(path) as source:
                    yield from get([pa.RecordBatch.from_arrays([pa.array([path]), pa.array([source.read()], pa.binary())], ["path", "content"])])

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                held = 0
                for at, raw, error in records_of(memoryview(content.as_buffer())):
                    found: dict = {}
                    try:
                        found = parse(raw) if error is None else {}
                    except (ValueError, UnicodeDecodeError) as e:
                        error = str(e)
                    if error and on_error == "raise":
                        raise ValueError(f"{path} at byte {at}: {error}")
                    rows.append((found.get("page_id"), found.get("url"), found.get("type"), found.get("refers_to"), found.get("length"), found.get("digest"), found.get("payload") if payloads else None, path, at, error))
                    held += len(raw or b"")
                    if held > 16_000_000:
                        yield to_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield to_batch(rows)

    if isinstance(archives, DataFrame):
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return archives.select("archive", "folder").distinct().repartition(n, "archive").mapInArrow(opened, RECORD)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(archives).select("path", "content").mapInArrow(get, RECORD)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back."""
    pages = pages.select("page_id", "url", "html")
    scratch = Scratch(spark)
    folder = scratch.path("archives")
    written = scratch.save(write(spark, pages, folder, train(pages), least), "manifest")
    return read(spark, written, payloads=False)
