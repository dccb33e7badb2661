"""WARC archives of Zstandard frames: written by Spark's own file writer, read back frame by frame.

An archive starts with a skippable frame that holds the compression dictionary. One frame for each record follows. Rows of the text
writer are frames here, and the line separator is an empty skippable frame, so the files are whole archives, committed as any output of
Spark is. An archive stays below a size bound, since a reader holds one at a time.

Of pages with the same payload of at least LEAST bytes the one with the largest id is written as a response, the others as revisits of it:
headers without the payload. Shorter payloads are all responses.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b32decode, b32encode
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventara.llm.base import Scratch

#: Payloads below this size are never revisits.
LEAST = 1000
#: Bytes after which an archive is full.
ARCHIVE_BYTES = 16_000_000
#: Rows, and characters of each, that the dictionary is trained on (it decides sizes only, never results), and its size.
SAMPLE, SAMPLE_CHARS, DICTIONARY = 256, 8192, 32_768
#: Revisits up to which their list is broadcast; beyond that it is joined by shuffle.
BROADCAST = 200_000
#: Written as the date of every record.
DATE = "2000-01-01T00:00:00Z"

# Fixed values of the formats.
MAGIC, SKIPPABLE, DICTIONARY_FRAME = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty skippable frame, as the line separator of the text writer.
BETWEEN = (SKIPPABLE.to_bytes(4, "little") + bytes(4)).decode()


def skippable(content: bytes) -> bytes:
    return DICTIONARY_FRAME.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def train(samples: list[bytes]) -> bytes:
    """A dictionary from samples; of plain sample text where they are too few to train on, empty without samples."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        plain = b"".join(samples)[-DICTIONARY:]
        return plain if len(plain) >= 256 else b""


# --- records ---------------------------------------------------------------------------------


def _sha1(data: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page, url: str | None, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """A response, or without payload a revisit of the page `refers_to`; digest is the payload's SHA-1 in hex."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    fields = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", "sha1:" + b32encode(bytes.fromhex(digest)).decode()))
    fields.append(("WARC-Block-Digest", _sha1(block)))
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode(errors="replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"no header field: {line[:60]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def parse(data: bytes) -> dict:
    """A record's `warc` and `http` headers and its payload (None for a revisit). Raises ValueError where headers, lengths or digests are wrong."""
    head, end, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not end or not re.fullmatch(rb"WARC/1\.\d", version):
        raise ValueError("no WARC record")
    warc = _headers(lines)
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - warc.keys():
        raise ValueError(f"missing {', '.join(sorted(missing))}")
    if not warc["content-length"].isdecimal() or len(rest) != int(warc["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"content-length {warc['content-length']} of a block of {len(rest) - 4} bytes")
    block = rest[:-4]
    if warc.get("warc-block-digest", "").startswith("sha1:") and warc["warc-block-digest"] != _sha1(block):
        raise ValueError("block digest")
    http, payload = {}, block
    if warc.get("content-type", "").startswith("application/http"):
        head, end, payload = block.partition(b"\r\n\r\n")
        status, _, lines = head.partition(b"\r\n")
        if not end or not status.startswith(b"HTTP/"):
            raise ValueError("no HTTP response")
        http = _headers(lines) if lines else {}
    revisit = warc["warc-type"] == "revisit"
    if revisit and (payload or not {"warc-refers-to", "warc-payload-digest", "warc-profile"} <= warc.keys()):
        raise ValueError("revisit with a payload, or without target, digest or profile")
    if not revisit and int(http.get("content-length", len(payload))) != len(payload):
        raise ValueError(f"HTTP content-length {http['content-length']} of a payload of {len(payload)} bytes")
    if not revisit and warc.get("warc-payload-digest", "").startswith("sha1:") and warc["warc-payload-digest"] != _sha1(payload):
        raise ValueError("payload digest")
    return {"warc": warc, "http": http, "payload": None if revisit else payload}


# --- frames ----------------------------------------------------------------------------------


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at `at` ends, by its headers alone."""
    magic = int.from_bytes(data[at : at + 4], "little")
    if magic & ~0xF == SKIPPABLE and len(data) >= at + 8:
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    elif magic == MAGIC:
        start = bytes(data[at : at + 18])
        here, last = at + zstandard.frame_header_size(start), False
        while not last:
            if here + 3 > len(data):
                raise ValueError("cut frame")
            block = int.from_bytes(data[here : here + 3], "little")
            last, kind = bool(block & 1), block >> 1 & 3
            here += 3 + (1 if kind == 1 else block >> 3)
        end = here + 4 * zstandard.get_frame_parameters(start).has_checksum
    else:
        raise ValueError("no frame")
    if end > len(data):
        raise ValueError("cut frame")
    return end


def read_archive(data: memoryview) -> Iterator[tuple[int, dict | None, str | None]]:
    """(offset, record, fault) of every record; what can't be read has a fault, and after a broken frame nothing more is read."""
    at, reader = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        try:
            end = frame_end(data, at)
        except (ValueError, zstandard.ZstdError) as error:
            yield at, None, f"frame: {error}"
            return
        magic, content = int.from_bytes(data[at : at + 4], "little"), data[at + 8 : end]
        if at == 0 and magic == DICTIONARY_FRAME and len(content):
            held = bytes(content)
            if int.from_bytes(held[:4], "little") == MAGIC:
                held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
        elif magic == MAGIC:
            try:
                yield at, parse(reader.decompressobj().decompress(data[at:end])), None
            except (ValueError, zstandard.ZstdError) as error:
                yield at, None, str(error) or "record"
        at = end


# --- on Spark --------------------------------------------------------------------------------


def write_archives(df: DataFrame, path: str, scratch: Scratch, page: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one record per row of df below `path`, as archive=<name>/ folders of one archive each.

    A null html counts as empty. Rows without page id revisit the page with the largest id of their payload, if there is one. Repeated
    rows are records of their own; if they bear the largest id, all are responses. A missing url is left out.
    """
    spark = df.sparkSession
    rows = df.select(df[page].alias("page"), df[url].cast("string").alias("url"), F.coalesce(df[html], F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("bigint")})
    long = rows.where(F.col("size") >= LEAST).select("page", "digest")
    latest = long.groupBy("digest").agg(F.max("page").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    revisits = scratch.write(long.join(latest, "digest").where("page is null or page <> refers_to").distinct(), "revisits")
    side = revisits.select(F.col("page").alias("p"), F.col("digest").alias("d"), "refers_to")
    if side.count() <= BROADCAST:
        side = F.broadcast(side)
    told = rows.join(side, rows["page"].eqNullSafe(F.col("p")) & (rows["digest"] == F.col("d")), "left")
    told = told.select("page", "url", F.when(F.col("d").isNull(), F.col("html").cast("binary")).alias("payload"), "size", "digest", "refers_to")
    sample = [r[0].encode() for r in df.limit(SAMPLE).select(F.substring(F.coalesce(df[html], F.lit("")), 1, SAMPLE_CHARS)).collect()]
    dictionary = train([x for x in sample if x])

    def run(batches):
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if held:
            held.precompute_compress(level=3)
        writer = zstandard.ZstdCompressor(level=3, dict_data=held, write_checksum=True)
        first = skippable(zstandard.ZstdCompressor(level=19).compress(dictionary)) if dictionary else b""
        part, number, size, position = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                    if size >= ARCHIVE_BYTES:
                        number, size = number + 1, 0
                    frame = writer.compress(record(*row))
                    if not size and first:
                        out.append((f"{part:06}-{number:06}", position, first))
                        position += 1
                    out.append((f"{part:06}-{number:06}", position, frame))
                    position += 1
                    size += len(frame)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["archive", "position", "frame"])

    frames = told.mapInArrow(run, "archive string, position long, frame binary")
    frames.sortWithinPartitions("archive", "position").select("archive", F.col("frame").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", BETWEEN).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below `path`, in any folder and with any name.

    (archive, offset, record_type, record_id, target_uri, refers_to, payload_bytes, payload_digest (SHA-1, hex), payload, fault). Size and
    digest are those of the payload as read; of a revisit, those that its headers give. `payload` is null without `payloads`. A record that
    breaks the format has a `fault` and nothing else.
    """
    names = ["archive", "offset", "record_type", "record_id", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload", "fault"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary(), pa.string()]

    def row(offset: int, found: dict | None, fault: str | None) -> tuple:
        if found is None:
            return (offset, *[None] * 7, fault)
        warc, payload = found["warc"], found["payload"]
        if payload is None:
            size, digest = int(found["http"].get("content-length", -1)), b32decode(warc["warc-payload-digest"].partition(":")[2]).hex()
        else:
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        return (offset, warc["warc-type"], warc["warc-record-id"], warc.get("warc-target-uri"), warc.get("warc-refers-to"), size, digest, payload if payloads else None, None)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                archive, out, held = batch.column(0)[k].as_py(), [], 0
                for found in read_archive(memoryview(batch.column(1)[k].as_buffer())):
                    out.append((archive, *row(*found)))
                    held += len(out[-1][8] or b"") + 300
                    if held > 4_000_000:
                        yield _batch(out, kinds, names)
                        out, held = [], 0
                if out:
                    yield _batch(out, kinds, names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    schema = "archive string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, fault string"
    return files.select("path", "content").mapInArrow(run, schema)


def _batch(rows: list, kinds: list, names: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def archived(df: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page id, payload_bytes, payload_digest, record_type, refers_to) of every row of df, as its archives tell when read back.

    An empty table has no archives and no rows. A record with a fault ends the query.
    """
    spark, kind = df.sparkSession, df.schema[page].dataType
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write_archives(df, path, scratch, page, url, html)
    names = [page, "payload_bytes", "payload_digest", "record_type", "refers_to"]
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
    if scratch.empty("archives"):
        return spark.createDataFrame([], f"`{page}` {kind.simpleString()}, payload_bytes long, payload_digest string, record_type string, refers_to {kind.simpleString()}")
    found = read_archives(spark, path, payloads=False)
    sound = F.when(F.col("fault").isNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.concat("archive", F.lit(": "), "fault")).cast("bigint"))
    result = scratch.write(found.select(number("record_id").alias(page), sound.alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to")).select(*names), "result")
    scratch.drop("archives")
    scratch.drop("revisits")
    return result
